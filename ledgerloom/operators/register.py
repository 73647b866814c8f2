"""Reads of the decision register: scope, filters, permissions, lists, hydration, corrections.

All operators take and return DataFrames and an explicit ``as_of`` where they need a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CHANNEL, CHANNEL_THREAD, CHAT_USER, UUID, deterministic_uuid, percent


def tenant_scope(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant; without a tenant none.  On data partitioned by tenant_id this prunes."""
    return df.where(F.lit(False)) if not tenant_id else df.where(F.col("tenant_id") == tenant_id)


def assert_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """The same rows; a row of another tenant raises when it is produced."""
    ok = F.col("tenant_id").eqNullSafe(F.lit(tenant_id))
    checked = F.when(ok, F.col("tenant_id")).otherwise(F.raise_error(F.lit("row of another tenant")).cast("string"))
    return df.withColumn("tenant_id", checked)


def filter_decisions(decisions: DataFrame, decision_actors: DataFrame | None = None, status: str | None = None, min_confidence: float | None = None, actor_id: str | None = None, since=None, until=None) -> DataFrame:
    """Optional filters; the time bounds are inclusive."""
    out = decisions
    if status is not None:
        out = out.where(F.col("status") == status)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until))
    return out if actor_id is None else decisions_of_actor(out, decision_actors, actor_id)


def decisions_of_actor(decisions: DataFrame, decision_actors: DataFrame, actor_id: str) -> DataFrame:
    """Decisions that name an actor of their tenant."""
    own = decision_actors.where(F.col("actor_id") == actor_id).select(F.col("decision_id").alias("id"), "tenant_id")
    return decisions.join(own, ["id", "tenant_id"], "left_semi")


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """L1: one page in order, with the total of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # the total is one row


def list_decisions(decisions: DataFrame, raw_events: DataFrame, limit: int = 50, offset: int = 0, record_type: str | None = None, source: str | None = None, include_superseded: bool = False) -> DataFrame:
    """Decisions newest first with their origin's source; the limit is held to 1..200."""
    rows = with_origin_source(decisions, raw_events)
    if not include_superseded:
        rows = rows.where(F.col("superseded_by").isNull())
    if record_type is not None:
        rows = rows.where(F.col("record_type") == record_type)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return page(rows, [F.desc("created_at"), F.asc("id")], min(max(limit, 1), 200), offset)


def list_all(df: DataFrame, cap: int = 2000) -> DataFrame:
    """L4: everything, newest first, up to the listing's hard cap."""
    return df.orderBy(F.desc("created_at"), F.asc("id")).limit(cap)


def latest_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The latest rows."""
    return df.orderBy(*order).limit(n)


def scope_visible(scope: Column, caller: Column, strict: bool = False) -> Column:
    """The permission rule: an empty scope, a shared scope, or only ids of channels and pages that nobody mapped."""
    open_ = (F.size(scope) == 0) | F.arrays_overlap(scope, caller)
    unmapped = F.forall(scope, lambda s: s.rlike(CHANNEL) | s.rlike(UUID))
    return F.coalesce(open_ if strict else open_ | unmapped, F.lit(True))


def permission_filter(df: DataFrame, caller_scopes: list[str] | Column, scope: str = "permission_scope", strict: bool = False) -> DataFrame:
    """P5: rows that the caller may see."""
    caller = F.array(*map(F.lit, caller_scopes)).cast("array<string>") if isinstance(caller_scopes, list) else caller_scopes
    return df.where(scope_visible(F.coalesce(F.col(scope), F.array().cast("array<string>")), caller, strict))


def caller_scopes(users: DataFrame, connections: DataFrame, mail_only: bool = False) -> DataFrame:
    """(tenant_id, user_id, scopes): the mail address and the workspaces of active connections."""
    active = connections.where(F.col("status") == "active")
    if mail_only:
        active = active.where(F.col("source") == "gmail")
    own = active.groupBy("tenant_id").agg(F.array_sort(F.collect_set("external_workspace_id")).alias("workspaces"))
    mail = F.when(F.col("email").isNotNull(), F.array("email")).otherwise(F.array().cast("array<string>"))
    scopes = F.array_union(mail, F.coalesce("workspaces", F.array().cast("array<string>")))
    return users.join(own, "tenant_id", "left").select("tenant_id", "user_id", scopes.alias("scopes"))


def substring_search(df: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Statement or rationale holds the text, case aside; newest first."""
    found = F.contains(F.lower("decision_statement"), F.lit(query.lower())) | F.contains(F.lower("rationale"), F.lit(query.lower()))
    return df.where(F.coalesce(found, F.lit(False))).orderBy(F.desc("created_at"), "id").limit(limit)


def in_period(df: DataFrame, start, end, column: str = "created_at") -> DataFrame:
    """From the first day to the end of the last one."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def effective_capture_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items with their include flag; without a rule they are included."""
    keys = ["tenant_id", "source", "item_id"]
    return items.join(rules.select(*keys, "included"), keys, "left").withColumn("included", F.coalesce("included", F.lit(True)))


def actor_name() -> Column:
    """Display name, else mail, else an id that is not a bare system id."""
    notion = F.when(~F.col("notion_user_id").rlike(UUID), F.col("notion_user_id"))
    slack = F.when(~F.col("slack_user_id").rlike(CHAT_USER), F.col("slack_user_id"))
    filled = [F.nullif(F.trim(c), F.lit("")) for c in (F.col("display_name"), F.col("email"), notion, slack)]
    return F.coalesce(*filled)


def repair_thread_ref(raw_events: DataFrame) -> DataFrame:
    """Chat rows whose thread is a channel id take their own id as thread."""
    wrong = (F.col("source") == "slack") & F.col("thread_ref").rlike(CHANNEL_THREAD)
    return raw_events.withColumn("thread_ref", F.when(wrong, F.col("source_id")).otherwise(F.col("thread_ref")))


def build_permalinks(rows: DataFrame) -> DataFrame:
    """Links rebuilt for mails of the old form and for pages without one; chat links give channel and time."""
    mail = F.concat(F.lit("https://mail.google.com/mail/u/?authuser="), F.col("external_workspace_id"), F.lit("#all/"), F.col("source_id"))
    page_link = F.concat(F.lit("https://www.notion.so/"), F.replace(F.col("source_id"), F.lit("-")))
    old = F.col("permalink").isNull() | F.col("permalink").rlike(r"/mail/u/\d+/")
    link = F.when((F.col("source") == "gmail") & old, mail).when((F.col("source") == "notion") & F.col("permalink").isNull(), page_link).otherwise(F.col("permalink"))
    channel = F.coalesce(F.try_parse_url(F.col("permalink"), F.lit("QUERY"), F.lit("channel")), F.nullif(F.regexp_extract("permalink", r"/archives/([A-Z0-9]+)", 1), F.lit("")))
    ts = F.coalesce(F.try_parse_url(F.col("permalink"), F.lit("QUERY"), F.lit("message_ts")), F.nullif(F.regexp_replace(F.regexp_extract("permalink", r"/p(\d{16})", 1), r"^(\d{10})(\d{6})$", "$1.$2"), F.lit("")))
    slack = F.col("source") == "slack"
    return rows.withColumns({"fixed_permalink": link, "link_channel": F.when(slack, channel), "link_ts": F.when(slack, ts)})


def with_origin_source(decisions: DataFrame, raw_events: DataFrame) -> DataFrame:
    """Decisions with the source of their origin event."""
    origin = raw_events.select(F.col("id").alias("origin_raw_event_id"), "tenant_id", "source")
    return decisions.join(origin, ["origin_raw_event_id", "tenant_id"], "left")


def embedded_decisions(embeddings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that have a vector, with it."""
    return decisions.join(embeddings.select(F.col("decision_id").alias("id"), "tenant_id", "embedding"), ["id", "tenant_id"])


def hydrate(decisions: DataFrame, actors: DataFrame, decision_actors: DataFrame, decision_sources: DataFrame, raw_events: DataFrame) -> DataFrame:
    """Decisions with their actors, links and platforms; without any the arrays are empty.

    Children are gathered before the join, so a decision is never multiplied.
    """
    named = actors.select(F.col("id").alias("actor_id"), "tenant_id", actor_name().alias("name"))
    people = decision_actors.join(named, ["actor_id", "tenant_id"], "left").groupBy(F.col("decision_id").alias("id"), "tenant_id").agg(F.array_sort(F.collect_list(F.struct(F.col("actor_id").alias("id"), "role", "name"))).alias("actors"))
    origin = raw_events.select(F.col("id").alias("raw_event_id"), "tenant_id", "source")
    links = decision_sources.join(origin, ["raw_event_id", "tenant_id"], "left").groupBy(F.col("decision_id").alias("id"), "tenant_id").agg(
        F.array_sort(F.collect_list("permalink")).alias("source_links"), F.array_sort(F.collect_set("source")).alias("source_platforms")
    )
    out = decisions.join(people, ["id", "tenant_id"], "left").join(links, ["id", "tenant_id"], "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"actors": F.coalesce("actors", F.array().cast("array<struct<id:string,role:string,name:string>>")), "source_links": F.coalesce("source_links", none), "source_platforms": F.coalesce("source_platforms", none)})


def owner(decisions: DataFrame, decision_actors: DataFrame, actors: DataFrame) -> DataFrame:
    """Decisions with the name of their first deciding actor (by actor id)."""
    named = actors.select(F.col("id").alias("actor_id"), "tenant_id", actor_name().alias("name"))
    first = decision_actors.where(F.col("role") == "decided_by").join(named, ["actor_id", "tenant_id"]).groupBy(F.col("decision_id").alias("id"), "tenant_id").agg(F.min_by("name", "actor_id").alias("owner"))
    return decisions.join(first, ["id", "tenant_id"], "left")


def both_sides(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Edges in both orientations as (id, other_id): what an OR condition on two columns asks for."""
    rest = [c for c in edges.columns if c not in (left, right)]
    forth = edges.select(F.col(left).alias("id"), F.col(right).alias("other_id"), *rest)
    return forth.unionByName(edges.select(F.col(right).alias("id"), F.col(left).alias("other_id"), *rest))


def conflicts_of(conflicts: DataFrame, decisions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each decision's conflicts with the other side's statement."""
    sides = both_sides(conflicts.select("decision_id", "related_decision_id", "tenant_id", "relationship", "reason", "confidence"), "decision_id", "related_decision_id")
    if ids is not None:
        sides = sides.join(ids.select("id").distinct(), "id", "left_semi")
    other = decisions.select(F.col("id").alias("other_id"), "tenant_id", F.col("decision_statement").alias("other_statement"))
    return sides.join(other, ["other_id", "tenant_id"])


def attention(conflicts: DataFrame, decisions: DataFrame, scopes: list[str], fetch: int = 20, show: int = 4) -> DataFrame:
    """The newest conflict pairs of which the caller may see both sides, and how many there are."""
    side = lambda p, k: decisions.select(F.col("id").alias(k), "tenant_id", F.col("decision_statement").alias(f"{p}_statement"), F.col("permission_scope").alias(f"{p}_scope"))
    newest = conflicts.orderBy(F.desc("created_at"), "id").limit(fetch)
    pairs = newest.join(side("first", "decision_id"), ["decision_id", "tenant_id"]).join(side("second", "related_decision_id"), ["related_decision_id", "tenant_id"])
    seen = permission_filter(permission_filter(pairs, scopes, "first_scope"), scopes, "second_scope")
    return page(seen, [F.desc("created_at"), F.asc("id")], show)


def missing_links(decisions: DataFrame, raw_events: DataFrame, decision_sources: DataFrame, source: str) -> DataFrame:
    """Decisions of a source without a link row."""
    own = with_origin_source(decisions, raw_events).where(F.col("source") == source)
    return own.join(decision_sources.select(F.col("decision_id").alias("id"), "tenant_id"), ["id", "tenant_id"], "left_anti")


def tenant_members_only(df: DataFrame, memberships: DataFrame, user_id: str) -> DataFrame:
    """Rows of the tenants that a user belongs to."""
    return df.join(memberships.where(F.col("user_id") == user_id).select("tenant_id"), "tenant_id", "left_semi")


def union_ids(decisions: DataFrame, decision_sources: DataFrame) -> DataFrame:
    """Distinct events behind each decision: its origin and its linked ones."""
    origin = decisions.where(F.col("origin_raw_event_id").isNotNull()).select("tenant_id", F.col("id").alias("decision_id"), F.col("origin_raw_event_id").alias("raw_event_id"))
    return origin.unionByName(decision_sources.select("tenant_id", "decision_id", "raw_event_id")).distinct()


def supersede(decisions: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replacements (old_id, tenant_id, and the new row's columns) applied; unknown old ids are rejected.

    The old row gets status superseded and a pointer, the new row is appended.  Of several
    replacements of one row the one with the largest id counts.
    """
    latest = replacements.withColumn("_n", F.row_number().over(Window.partitionBy("old_id", "tenant_id").orderBy(F.desc("id")))).where("_n = 1").drop("_n")
    known = decisions.select(F.col("id").alias("old_id"), "tenant_id")
    good = latest.join(known, ["old_id", "tenant_id"], "left_semi")
    rejected = replacements.join(known, ["old_id", "tenant_id"], "left_anti").withColumn("reason", F.lit("unknown decision"))
    link = good.select(F.col("old_id").alias("id"), "tenant_id", F.col("id").alias("_new"))
    old = decisions.join(link, ["id", "tenant_id"], "left")
    hit = F.col("_new").isNotNull()
    old = old.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "superseded_by": F.coalesce("_new", "superseded_by")}).select(*decisions.columns)
    return old.unionByName(good.drop("old_id"), allowMissingColumns=True).select(*decisions.columns), rejected


def expand_corrections(decisions: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirm, edit or reject decisions; returns the new register and the correction log.

    A confirmation decides, a rejection supersedes without a successor, an edit supersedes by a
    new row with the corrected statement.
    """
    now = decisions.select(F.col("id").alias("decision_id"), "tenant_id", F.col("decision_statement").alias("original_statement"), F.col("status").alias("original_status"))
    log = corrections.drop("original_statement", "original_status").join(now, ["decision_id", "tenant_id"])
    one = log.withColumn("_n", F.row_number().over(Window.partitionBy("decision_id", "tenant_id").orderBy(F.desc("corrected_at"), F.desc("id")))).where("_n = 1")
    act = one.select(F.col("decision_id").alias("id"), "tenant_id", F.col("action").alias("_action"), F.col("corrected_statement").alias("_text"), F.col("corrected_at").alias("_at"), deterministic_uuid(F.col("decision_id"), F.col("id")).alias("_new"))
    met = decisions.join(act, ["id", "tenant_id"], "left")
    status = F.when(F.col("_action") == "confirmed", "decided").when(F.col("_action").isin("edited", "rejected"), "superseded").otherwise(F.col("status"))
    old = met.withColumns({"status": status, "superseded_by": F.when(F.col("_action") == "edited", F.col("_new")).otherwise(F.col("superseded_by")), "updated_at": F.coalesce("_at", "updated_at")}).select(*decisions.columns)
    fresh = met.where(F.col("_action") == "edited").withColumns({"id": F.col("_new"), "decision_statement": F.coalesce("_text", "decision_statement"), "status": F.lit("decided"), "superseded_by": F.lit(None).cast("string"), "created_at": F.col("_at"), "updated_at": F.col("_at")}).select(*decisions.columns)
    return old.unionByName(fresh), log


def corrections_history(corrections: DataFrame, decision_id: str) -> DataFrame:
    """A decision's corrections, newest first."""
    return corrections.where(F.col("decision_id") == decision_id).orderBy(F.desc("corrected_at"), F.desc("id"))


def context_block(rank: Column | None = None) -> Column:
    """C11: one decision as a text block."""
    line = "-" * 50
    given = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Not provided"))
    none = F.coalesce(F.nullif(F.array_join("alternatives_considered", ", "), F.lit("")), F.lit("None"))
    head = F.concat(F.lit("Decision "), rank.cast("string")) if rank is not None else F.lit("Decision")
    return F.concat_ws(
        "\n", F.lit(line), head, F.concat(F.lit("Statement: "), F.col("decision_statement")), F.concat(F.lit("Rationale: "), given("rationale")), F.concat(F.lit("Alternatives: "), none), F.concat(F.lit("Confidence: "), percent("confidence")), F.lit(line)
    )


def build_context(ranked: DataFrame, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """C11: the blocks of each query's decisions, in rank order, as one text with a token estimate."""
    blocks = ranked.withColumn("_block", context_block(F.col(rank)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("_block").alias("b")))), lambda x: x["b"]), "\n\n")
    return blocks.groupBy(key).agg(text.alias("context")).withColumn("tokens", F.floor(F.length("context") / 4).cast("long"))

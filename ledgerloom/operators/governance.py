"""Retention, deletion, export, search history, provisioning, digests and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import deterministic_uuid, digest_week, workspace_slug

# Allowed words of enumerated columns.
ENUMS = {
    "decisions": {"record_type": ["decision", "action_item", "blocker"], "status": ["proposed", "decided", "superseded"], "scope": ["user", "team"]},
    "source_connections": {"status": ["active", "paused", "error", "revoked"], "ingestion_mode": ["realtime", "near_realtime", "polling"]},
    "raw_events": {"pipeline_status": ["pending", "done"]},
    "memberships": {"role": ["owner", "admin", "member"]},
    "decision_actors": {"role": ["decided_by", "mentioned"]},
    "decision_conflicts": {"relationship": ["contradicts", "duplicates"]},
    "feedback_events": {"signal": ["up", "down"]},
    "radar_corrections": {"action": ["confirmed", "edited", "rejected"]},
    "weekly_digests": {"scope": ["personal", "team"]},
}


def check_constraints(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Q1: violated rules of a table's rows: (key, violation)."""
    rules: dict[str, Column] = {f"{c} is not allowed": ~F.col(c).isin(words) for c, words in ENUMS.get(table, {}).items() if c in df.columns}
    for c in ("tenant_id", key):
        if c in df.columns:
            rules[f"{c} is null"] = F.col(c).isNull()
    if "confidence" in df.columns:
        rules["confidence is out of range"] = ~F.col("confidence").between(0, 1)
    for c in ("permission_scope", "alternatives_considered"):
        if c in df.columns:
            rules[f"{c} is null"] = F.col(c).isNull()
    if table == "weekly_digests":
        rules["team and user do not match"] = (F.col("scope") == "team") != F.col("user_id").isNull()
        rules["period is reversed"] = F.col("period_end") < F.col("period_start")
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda v: v.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("violation"))


#: Parent, its key, child, its reference: the order in which deletions run down.
CASCADE = [
    ("source_connections", "id", "raw_events", "connection_id"),
    ("raw_events", "id", "decisions", "origin_raw_event_id"),
    ("raw_events", "id", "decision_sources", "raw_event_id"),
    ("decisions", "id", "decision_actors", "decision_id"),
    ("decisions", "id", "decision_sources", "decision_id"),
    ("decisions", "id", "decision_embeddings", "decision_id"),
    ("decisions", "id", "decision_conflicts", "decision_id"),
    ("decisions", "id", "decision_conflicts", "related_decision_id"),
]


def cascade_delete(tables: dict[str, DataFrame], root: str, root_key: str, ids: DataFrame, edges: list[tuple[str, str, str, str]] = CASCADE) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(survivors, doomed) of every table when rows of ``root`` go; ``ids`` has the column ``root_key``.

    A row is doomed if one of its references is a doomed key of a parent.  Each edge is one left
    join with the distinct doomed keys; only keys travel, and equal rows stay or go on their own.
    Ids are UUIDs and so unique over all tenants; where they are not, put the tenant into the keys.
    """
    gone = {root: ids.select(root_key).distinct()}
    mark = F.lit(True).alias("_gone0")
    flagged = {root: tables[root].join(gone[root].select(root_key, mark), root_key, "left")}
    doomed: dict[str, DataFrame] = {root: flagged[root].where("_gone0").select(*tables[root].columns)}
    survivors = dict(tables) | {root: flagged[root].where("_gone0 IS NULL").select(*tables[root].columns)}
    for child in dict.fromkeys(c for _, _, c, _ in edges):
        own = [(parent, key, ref) for parent, key, c, ref in edges if c == child and parent in doomed and child in tables]
        if not own:
            continue
        rows, marks = tables[child], []
        for i, (parent, key, ref) in enumerate(own):
            marks.append(f"_gone{i}")
            rows = rows.join(doomed[parent].select(F.col(key).alias(ref)).distinct().withColumn(marks[-1], F.lit(True)), ref, "left")
        hit = F.coalesce(*[F.col(m) for m in marks], F.lit(False))
        doomed[child], survivors[child] = rows.where(hit).select(*tables[child].columns), rows.where(~hit).select(*tables[child].columns)
    return survivors, doomed


def tenant_delete_check(memberships: DataFrame, user_id: str) -> DataFrame:
    """The user's tenants and whether they may be dropped: only those with no other member."""
    owned = memberships.where((F.col("user_id") == user_id) & (F.col("role") == "owner")).select("tenant_id")
    counts = memberships.groupBy("tenant_id").agg(F.count_distinct("user_id").alias("members"))
    return counts.join(owned, "tenant_id", "left_semi").withColumn("verdict", F.when(F.col("members") > 1, "blocked").otherwise("droppable"))


def purge_expired(raw_events: DataFrame, as_of: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the count of those that go."""
    gone = F.coalesce(F.col(expires) < as_of, F.lit(False))
    return raw_events.where(~gone), raw_events.agg(F.count_if(gone).alias("purged"))


def export_account(decisions: DataFrame, memberships: DataFrame, user_id: str) -> DataFrame:
    """All decisions of the user's tenants, newest first; write it with ``write_export``."""
    own = memberships.where(F.col("user_id") == user_id).select("tenant_id")
    return decisions.join(own, "tenant_id", "left_semi").orderBy(F.desc("created_at"), "id")


def write_export(rows: DataFrame, path: str) -> None:
    """One JSON folder for each record type."""
    rows.write.partitionBy("record_type").json(path)


def search_history_list(history: DataFrame, user_id: str, limit: int | None = 50) -> DataFrame:
    """The user's searches newest first with the exact total; ``limit=None`` for the download."""
    own = history.where(F.col("user_id") == user_id)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    rows = own.orderBy(F.desc("searched_at"), "query")
    return (rows if limit is None else rows.limit(limit)).crossJoin(F.broadcast(total))  # the total is one row


def search_history_record(history: DataFrame, searches: DataFrame, prefs: DataFrame) -> DataFrame:
    """The history with new searches of users who keep one (the default); blank queries are not kept."""
    met = searches.where(F.trim("query") != "").join(prefs.select("user_id", "save_history"), "user_id", "left")
    return history.unionByName(met.where(F.coalesce("save_history", F.lit(True))).select(*history.columns))


def provision_tenants(users: DataFrame, tenants: DataFrame, allowlist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New tenants and owner memberships for users (id, email, created_at) that have none, allowed ones only."""
    rows = users if allowlist is None else users.join(allowlist.select(F.lower("email").alias("_m")).distinct(), F.lower(users["email"]) == F.col("_m"), "left_semi")
    made = rows.select(deterministic_uuid(F.lit("tenant"), F.col("id")).alias("id"), F.split_part("email", F.lit("@"), F.lit(1)).alias("name"), workspace_slug("email", "id").alias("slug"), F.lit("self_serve").alias("plan"), "created_at", F.col("id").alias("user_id"))
    fresh = made.join(tenants.select("id"), "id", "left_anti")
    members = fresh.select(deterministic_uuid(F.lit("member"), F.col("user_id")).alias("id"), F.col("id").alias("tenant_id"), "user_id", F.lit("owner").alias("role"), "created_at")
    return fresh.drop("user_id"), members


def weekly_digest(matches: DataFrame, tenants: DataFrame, memberships: DataFrame, decisions: DataFrame, scopes: DataFrame, as_of: Column, top_k: int = 25) -> DataFrame:
    """One digest row for each tenant's team and each member.

    ``matches`` has the ranked decisions of the digest question (tenant_id, user_id or null for
    the team's, rank, decision_id); a member without own matches gets the team's and is not
    personalized.  ``scopes`` has tenant_id, user_id and scopes; the team sees what all may see.
    """
    team = tenants.select(F.col("id").alias("tenant_id"), F.lit(None).cast("string").alias("user_id"), F.lit("team").alias("scope"), F.array().cast("array<string>").alias("scopes"))
    people = memberships.select("tenant_id", "user_id").distinct().join(scopes, ["tenant_id", "user_id"], "left")
    people = people.select("tenant_id", "user_id", F.lit("personal").alias("scope"), F.coalesce("scopes", F.array().cast("array<string>")).alias("scopes"))
    readers = team.unionByName(people)
    own = matches.where("user_id IS NOT NULL").select("tenant_id", "user_id").distinct().withColumn("personalized", F.lit(True))
    readers = readers.join(own, ["tenant_id", "user_id"], "left").withColumn("personalized", F.coalesce("personalized", F.lit(False)))
    asked = matches.select("tenant_id", F.col("user_id").alias("_asker"), "rank", "decision_id").where(F.col("rank") <= top_k)
    mine = F.when(F.col("personalized"), F.col("user_id").eqNullSafe(F.col("_asker"))).otherwise(F.col("_asker").isNull())
    rows = readers.join(asked, "tenant_id").where(mine).join(decisions.select(F.col("id").alias("decision_id"), "decision_statement", "record_type", "permission_scope"), "decision_id")
    from .register import scope_visible

    seen = rows.where(scope_visible(F.col("permission_scope"), F.col("scopes")))
    items = seen.groupBy("tenant_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "decision_id", "record_type", "decision_statement"))).alias("items"))
    week = digest_week(as_of)
    out = readers.alias("r").join(items.alias("i"), F.col("r.tenant_id").eqNullSafe(F.col("i.tenant_id")) & F.col("r.user_id").eqNullSafe(F.col("i.user_id")), "left").select("r.*", "i.items")
    return out.drop("scopes").withColumns({"items": F.coalesce("items", F.expr("cast(array() as array<struct<rank:int,decision_id:string,record_type:string,decision_statement:string>>)")), "week_of": week, "period_start": week, "period_end": F.date_add(week, 7)})


def digest_store(stored: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Stored digests with the current week's replaced; past weeks are only kept, never rebuilt."""
    current = digest_week(as_of)
    key = ["tenant_id", F.coalesce("user_id", F.lit("")), "week_of"]
    fresh = new.where(F.col("week_of") == current).withColumn("_new", F.lit(1))
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("created_at")))
    return both.withColumn("_n", rank).where("_n = 1").select(*stored.columns)

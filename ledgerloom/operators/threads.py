"""Conversations: threads around a decision, runs of messages, recent turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .register import actor_name, both_sides, hydrate, union_ids

MENTION = r"<@!?(\d{15,25})>"


def thread_context(decisions: DataFrame, raw_events: DataFrame, decision_sources: DataFrame, window: str = "6 hours", cap: int = 40) -> DataFrame:
    """The events around each decision, oldest first, numbered by ``turn``.

    The origin and linked events give the thread and the time range; siblings are events of the
    same thread within ``window`` of it.  Without a thread only the linked events count.

    Threads are cut into buckets of the window's width, and ranges meet events bucket by bucket, so
    a long thread is many tasks.  Of a bucket that a range enters at its start only the first
    ``cap`` events can matter; only keys and times are joined, and each decision's ``cap`` earliest
    are picked before any event is fetched.
    """
    linked = union_ids(decisions, decision_sources).withColumnRenamed("raw_event_id", "id")
    times = raw_events.select("id", "tenant_id", "thread_ref", "received_at")
    width = F.expr(f"unix_seconds(timestamp_seconds(0) + INTERVAL {window})")  # a constant
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    own = linked.join(times, ["id", "tenant_id"])
    spans = own.where("thread_ref IS NOT NULL").groupBy("tenant_id", "decision_id", "thread_ref")
    spans = spans.agg((F.min("received_at") - F.expr(f"INTERVAL {window}")).alias("_from"), (F.max("received_at") + F.expr(f"INTERVAL {window}")).alias("_to"))
    spans = spans.withColumn("_first", bucket(F.col("_from"))).withColumn("_bucket", F.explode(F.sequence("_first", bucket(F.col("_to")))))
    placed = times.where("thread_ref IS NOT NULL AND received_at IS NOT NULL").withColumn("_bucket", bucket(F.col("received_at")))
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id", "thread_ref", "_bucket").orderBy("received_at", "id")))
    met = placed.join(spans, ["tenant_id", "thread_ref", "_bucket"]).where((F.col("_n") <= cap) | (F.col("_bucket") == F.col("_first")))
    met = met.where(F.col("received_at").between(F.col("_from"), F.col("_to"))).select("decision_id", "tenant_id", "id", "received_at")
    by = Window.partitionBy("tenant_id", "decision_id").orderBy("received_at", "id")
    near = met.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap).select("decision_id", "tenant_id", "id", F.lit(False).alias("is_source"))
    ids = near.unionByName(linked.select("decision_id", "tenant_id", "id", F.lit(True).alias("is_source"))).groupBy("decision_id", "tenant_id", "id").agg(F.bool_or("is_source").alias("is_source"))
    return ids.join(raw_events, ["id", "tenant_id"]).withColumn("turn", F.row_number().over(by)).where(F.col("turn") <= cap)


def thread_relevance(thread: DataFrame, similarity: DataFrame, min_messages: int = 12, k: int = 20) -> DataFrame:
    """Long threads cut to ``k`` messages: source messages, then the most similar ones, in time order.

    ``similarity`` has decision_id, id and similarity to the decision's statement.
    """
    by = Window.partitionBy("tenant_id", "decision_id")
    met = thread.join(similarity.select("decision_id", "id", "similarity"), ["decision_id", "id"], "left").withColumn("_n", F.count(F.lit(1)).over(by))
    met = met.withColumn("_pick", F.row_number().over(by.orderBy(F.desc("is_source"), F.desc_nulls_last("similarity"), "received_at", "id")))
    kept = met.where((F.col("_n") <= min_messages) | F.col("is_source") | (F.col("_pick") <= k))
    return kept.withColumn("turn", F.row_number().over(by.orderBy("received_at", "id"))).drop("_n", "_pick")


def mention_names(messages: DataFrame, actors: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Mentions of people whom the message's tenant knows as @name; others stay.  Blank names count as none."""
    own = ["tenant_id", key]
    found = messages.select(*own, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(MENTION), 1))).alias("discord_user_id"))
    name = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("display_name", "email")))
    named = actors.where("discord_user_id IS NOT NULL").groupBy("tenant_id", "discord_user_id").agg(F.min(name).alias("name")).where("name IS NOT NULL")
    names = found.join(named, ["tenant_id", "discord_user_id"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("discord_user_id", "name"))).alias("_names"))
    put = lambda t, n: F.replace(F.replace(t, F.concat(F.lit("<@"), n["discord_user_id"], F.lit(">")), F.concat(F.lit("@"), n["name"])), F.concat(F.lit("<@!"), n["discord_user_id"], F.lit(">")), F.concat(F.lit("@"), n["name"]))
    met = messages.join(names, own, "left")
    return met.withColumn(text, F.when(F.col("_names").isNull(), F.col(text)).otherwise(F.aggregate("_names", F.col(text), put))).drop("_names")


def recent_turns(messages: DataFrame, n: int = 10, session: str = "session_id", order: list[Column] | None = None) -> DataFrame:
    """The last ``n`` messages of each session, numbered oldest first."""
    order = order or [F.col("created_at"), F.col("id")]
    last = F.row_number().over(Window.partitionBy(session).orderBy(*[c.desc() for c in order]))
    return messages.withColumn("_last", last).where(F.col("_last") <= n).withColumn("turn_no", F.row_number().over(Window.partitionBy(session).orderBy(*order))).drop("_last")


def group_consecutive(messages: DataFrame, thread: str, actor: str, order: list[Column], key: str) -> DataFrame:
    """Runs of messages by one actor in a thread: actor, first and last key, length."""
    by = Window.partitionBy(thread).orderBy(*order)
    marked = messages.withColumn("_new", (~F.col(actor).eqNullSafe(F.lag(actor).over(by)) | (F.row_number().over(by) == 1)).cast("int"))
    runs = marked.withColumn("run_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(thread, "run_no").agg(F.first(actor).alias(actor), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n_messages"))


def decision_detail(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Decisions with people, links, conflicts, arrival time and thread."""
    decisions = tables["decisions"].join(ids.select("id").distinct(), "id", "left_semi")
    rows = hydrate(decisions, tables["actors"], tables["decision_actors"], tables["decision_sources"], tables["raw_events"])
    arrived = tables["raw_events"].select(F.col("id").alias("origin_raw_event_id"), "tenant_id", "received_at")
    rows = rows.join(arrived, ["origin_raw_event_id", "tenant_id"], "left")
    sides = both_sides(tables["decision_conflicts"].select("decision_id", "related_decision_id", "tenant_id", "relationship"), "decision_id", "related_decision_id")
    other = sides.groupBy("id", "tenant_id").agg(F.array_sort(F.collect_list(F.struct("other_id", "relationship"))).alias("conflicts"))
    thread = thread_context(decisions, tables["raw_events"], tables["decision_sources"])
    lines = thread.groupBy(F.col("decision_id").alias("id"), "tenant_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("id").alias("event_id"), "received_at"))).alias("thread"))
    return rows.join(other, ["id", "tenant_id"], "left").join(lines, ["id", "tenant_id"], "left")


def decision_context(ids: DataFrame, tenant_id: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Decisions of one tenant with their source events, oldest first; others give no row."""
    own = tables["decisions"].where(F.col("tenant_id") == tenant_id).join(ids.select("id").distinct(), "id", "left_semi")
    events = union_ids(own, tables["decision_sources"]).join(tables["raw_events"].select(F.col("id").alias("raw_event_id"), "tenant_id", "source", "received_at"), ["raw_event_id", "tenant_id"])
    gathered = events.groupBy(F.col("decision_id").alias("id"), "tenant_id").agg(F.array_sort(F.collect_list(F.struct("received_at", "raw_event_id", "source"))).alias("sources"))
    return own.join(gathered, ["id", "tenant_id"], "left")


__all__ = ["actor_name", "decision_context", "decision_detail", "group_consecutive", "mention_names", "recent_turns", "thread_context", "thread_relevance"]

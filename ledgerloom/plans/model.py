"""A decision register made of the driver's tables: events as messages, most of them decisions too; suppliers as connections; customers as people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table

#: The same tables as SQL, to stand in front of a query.
REGISTER = """
WITH ev AS (SELECT *, 't' || (user_id % 10) AS tenant_id,
  CASE event_type WHEN 'view' THEN 'slack' WHEN 'click' THEN 'gmail' WHEN 'purchase' THEN 'notion' WHEN 'signup' THEN 'jira' ELSE 'github' END AS source FROM events),
raw_events AS (SELECT 'r' || event_id AS id, tenant_id, 'c' || (user_id % 40) AS connection_id, source, 's' || event_id AS source_id, 'u' || user_id AS thread_ref, props AS raw_content, ts AS received_at FROM ev),
decisions AS (SELECT 'd' || event_id AS id, event_id, user_id, tenant_id, CASE event_type WHEN 'click' THEN 'decision' WHEN 'purchase' THEN 'action_item' ELSE 'blocker' END AS record_type,
  'Adopt ' || props AS decision_statement, CASE WHEN event_id % 3 <> 0 THEN 'because ' || event_type END AS rationale, 'decided' AS status,
  CASE WHEN event_id % 11 = 0 THEN 'd' || (event_id + 1) END AS superseded_by, value / 500 AS confidence,
  CASE event_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [source] WHEN 2 THEN ['C0AAAAAAAA1'] ELSE ['hr@x.org'] END AS permission_scope,
  CASE WHEN event_id % 7 <> 0 THEN 'r' || event_id END AS origin_raw_event_id, ts + INTERVAL 5 MINUTE AS created_at FROM ev WHERE event_type <> 'view'),
decision_sources AS (SELECT tenant_id, id AS decision_id, 'r' || event_id AS raw_event_id, 'https://x/' || event_id AS permalink FROM decisions WHERE event_id % 3 = 0
  UNION ALL SELECT tenant_id, id, 'r' || (event_id + 1), 'https://y/' || event_id FROM decisions WHERE event_id % 6 = 0),
decision_actors AS (SELECT tenant_id, id AS decision_id, 'a' || user_id AS actor_id, CASE WHEN event_id % 2 = 0 THEN 'decided_by' ELSE 'mentioned' END AS role FROM decisions
  UNION ALL SELECT tenant_id, id, 'a' || (user_id + 10), 'decided_by' FROM decisions WHERE event_id % 5 = 0),
actors AS (SELECT 'a' || c_custkey AS id, 't' || (c_custkey % 10) AS tenant_id, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name END AS display_name,
  CASE WHEN c_custkey % 8 <> 0 THEN lower(c_name) || '@x.org' END AS email, 'U' || lpad(c_custkey::VARCHAR, 8, '0') AS slack_user_id, NULL::VARCHAR AS notion_user_id, '1' || lpad(c_custkey::VARCHAR, 16, '0') AS discord_user_id FROM customer),
names AS (SELECT id, tenant_id, coalesce(nullif(trim(display_name), ''), email) AS name FROM actors),
source_connections AS (SELECT 'c' || s_suppkey AS id, 't' || (s_suppkey % 10) AS tenant_id, CASE s_nationkey % 5 WHEN 0 THEN 'slack' WHEN 1 THEN 'gmail' WHEN 2 THEN 'notion' WHEN 3 THEN 'jira' ELSE 'github' END AS source,
  'w' || s_nationkey AS external_workspace_id, CASE WHEN s_suppkey % 4 = 0 THEN 'paused' ELSE 'active' END AS status, TIMESTAMP '2024-01-05' + INTERVAL 1 DAY * (s_suppkey % 20) AS last_synced_at,
  TIMESTAMP '2023-01-01' + INTERVAL 1 DAY * s_suppkey AS created_at FROM supplier),
decision_conflicts AS (SELECT 'x' || event_id AS id, tenant_id, id AS decision_id, before AS related_decision_id, 'contradicts' AS relationship, 'r' || event_id AS reason, confidence, created_at
  FROM (SELECT *, lag(id) OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS before FROM decisions) WHERE before IS NOT NULL AND event_id % 20 = 0)
"""
SOURCES = {"view": "slack", "click": "gmail", "purchase": "notion", "signup": "jira"}


def text(*parts):
    return F.concat(*[F.lit(p) if not hasattr(p, "cast") else p.cast("string") for p in parts])


def register_tables(spark, d) -> dict[str, DataFrame]:
    """The register's tables by name."""
    c, n = F.col, F.col("event_id")
    source = F.lit("github")
    for kind, name in SOURCES.items():
        source = F.when(c("event_type") == kind, name).otherwise(source)
    ev = table(spark, d, "events").withColumns({"tenant_id": text("t", c("user_id") % 10), "source": source})
    raw = ev.select(text("r", n).alias("id"), "tenant_id", text("c", c("user_id") % 40).alias("connection_id"), "source", text("s", n).alias("source_id"), text("u", c("user_id")).alias("thread_ref"), c("props").alias("raw_content"), c("ts").alias("received_at"))
    scope = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array("source")).when(n % 4 == 2, F.array(F.lit("C0AAAAAAAA1"))).otherwise(F.array(F.lit("hr@x.org")))
    kind = F.when(c("event_type") == "click", "decision").when(c("event_type") == "purchase", "action_item").otherwise("blocker")
    decisions = ev.where("event_type <> 'view'").select(
        text("d", n).alias("id"), "event_id", "user_id", "tenant_id", kind.alias("record_type"), text("Adopt ", c("props")).alias("decision_statement"), F.when(n % 3 != 0, text("because ", c("event_type"))).alias("rationale"), F.lit("decided").alias("status"),
        F.when(n % 11 == 0, text("d", n + 1)).alias("superseded_by"), (c("value") / 500).alias("confidence"), scope.alias("permission_scope"), F.when(n % 7 != 0, text("r", n)).alias("origin_raw_event_id"), (c("ts") + F.expr("INTERVAL 5 MINUTES")).alias("created_at"),
        F.array().cast("array<string>").alias("alternatives_considered"),
    )
    links = decisions.where("event_id % 3 = 0").select("tenant_id", c("id").alias("decision_id"), text("r", n).alias("raw_event_id"), text("https://x/", n).alias("permalink"))
    links = links.unionByName(decisions.where("event_id % 6 = 0").select("tenant_id", c("id").alias("decision_id"), text("r", n + 1).alias("raw_event_id"), text("https://y/", n).alias("permalink")))
    people = decisions.select("tenant_id", c("id").alias("decision_id"), text("a", c("user_id")).alias("actor_id"), F.when(n % 2 == 0, "decided_by").otherwise("mentioned").alias("role"))
    people = people.unionByName(decisions.where("event_id % 5 = 0").select("tenant_id", c("id").alias("decision_id"), text("a", c("user_id") + 10).alias("actor_id"), F.lit("decided_by").alias("role")))
    k = c("c_custkey")
    actors = table(spark, d, "customer").select(
        text("a", k).alias("id"), text("t", k % 10).alias("tenant_id"), F.when(k % 4 == 0, "  ").otherwise(c("c_name")).alias("display_name"), F.when(k % 8 != 0, text(F.lower("c_name"), "@x.org")).alias("email"),
        text("U", F.lpad(k.cast("string"), 8, "0")).alias("slack_user_id"), F.lit(None).cast("string").alias("notion_user_id"), text("1", F.lpad(k.cast("string"), 16, "0")).alias("discord_user_id"),
    )
    s, w = c("s_suppkey"), c("s_nationkey") % 5
    kind = F.when(w == 0, "slack").when(w == 1, "gmail").when(w == 2, "notion").when(w == 3, "jira").otherwise("github")
    day = lambda start, days: F.lit(start).cast("timestamp") + F.make_interval(days=days.cast("int"))
    connections = table(spark, d, "supplier").select(text("c", s).alias("id"), text("t", s % 10).alias("tenant_id"), kind.alias("source"), text("w", c("s_nationkey")).alias("external_workspace_id"), F.when(s % 4 == 0, "paused").otherwise("active").alias("status"), day("2024-01-05", s % 20).alias("last_synced_at"), day("2023-01-01", s).alias("created_at"))
    from pyspark.sql import Window

    before = F.lag("id").over(Window.partitionBy("tenant_id").orderBy("created_at", "id"))
    conflicts = decisions.withColumn("before", before).where("before IS NOT NULL AND event_id % 20 = 0").select(text("x", n).alias("id"), "tenant_id", c("id").alias("decision_id"), c("before").alias("related_decision_id"), F.lit("contradicts").alias("relationship"), text("r", n).alias("reason"), "confidence", "created_at")
    return {"raw_events": raw, "decisions": decisions, "decision_sources": links, "decision_actors": people, "actors": actors, "source_connections": connections, "decision_conflicts": conflicts}

"""Register reads, joins, corrections and governance on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance, ingest, register
from .base import query, table


@query("""
SELECT d.doc_id, d.lang, d.source, l.quality, (SELECT count(*) FROM documents WHERE lang = 'en') AS total
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en' ORDER BY d.doc_id DESC LIMIT 50 OFFSET 20""")
def list_page(spark, d):
    rows = register.tenant_scope(table(spark, d, "documents").withColumnRenamed("lang", "tenant_id"), "en").withColumnRenamed("tenant_id", "lang")
    rows = rows.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "source", "quality")
    return register.page(rows, [F.desc("doc_id")], 50, 20)


@query("""
SELECT o.o_orderkey, o.o_custkey, coalesce(l.items, '') AS items, coalesce(l.n_items, 0) AS n_items
FROM orders o LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items, count(*) AS n_items FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def hydrate_orders(spark, d):
    """Parents with their gathered children; the children are gathered before the join."""
    each = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(text.alias("items"), F.count(F.lit(1)).alias("n_items"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").fillna("", ["items"]).fillna(0, ["n_items"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def actor_semi(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def missing_anti(spark, d):
    """Customers without a large order."""
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("""
SELECT o_orderkey, l_partkey AS owner_part FROM orders LEFT JOIN (
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS n FROM lineitem) l ON l.l_orderkey = o_orderkey AND n = 1""")
def owner_first(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("owner_part"))
    return table(spark, d, "orders").select("o_orderkey").join(first, "o_orderkey", "left")


SCOPES = """CASE doc_id % 6 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [source] WHEN 2 THEN [lang, source]
  WHEN 3 THEN ['C0' || lpad(doc_id::VARCHAR, 8, '0')] WHEN 4 THEN ['C_HR_CONFIDENTIAL'] ELSE ['C0' || lpad(doc_id::VARCHAR, 8, '0'), lang] END"""


@query(f"""
WITH s AS (SELECT doc_id, {SCOPES} AS scope FROM documents)
SELECT doc_id, array_to_string(scope, '|') AS scope FROM s
WHERE len(scope) = 0 OR list_has_any(scope, ['en', 'src3', 'src7'])
   OR len(list_filter(scope, lambda x: NOT (regexp_matches(x, '^C[A-Z0-9]{{8,}}$') OR regexp_matches(x, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')))) = 0""")
def permission_filter(spark, d):
    key = F.concat(F.lit("C0"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    kind = F.col("doc_id") % 6
    scope = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array("source")).when(kind == 2, F.array("lang", "source")).when(kind == 3, F.array(key)).when(kind == 4, F.array(F.lit("C_HR_CONFIDENTIAL"))).otherwise(F.array(key, F.col("lang")))
    rows = table(spark, d, "documents").select("doc_id", scope.alias("permission_scope"))
    return register.permission_filter(rows, ["en", "src3", "src7"]).select("doc_id", F.array_join("permission_scope", "|").alias("scope"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'edble') OR contains(lower(source), 'edble') ORDER BY doc_id DESC LIMIT 20")
def substring_search(spark, d):
    rows = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at"), F.col("doc_id").alias("id"), F.col("text").alias("decision_statement"), F.col("source").alias("rationale"))
    return register.substring_search(rows, "edble", 20).select(F.col("id").alias("doc_id"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def in_period(spark, d):
    return register.in_period(table(spark, d, "events"), "2024-01-08", "2024-01-14", "ts").select("event_id", "event_type")


@query("""
SELECT 'dropped' AS part, count(*) AS n_orders, coalesce(sum(n), 0)::BIGINT AS n_lines FROM (
  SELECT o.o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.o_orderkey) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey IN (3, 7))
UNION ALL
SELECT 'kept', count(*), coalesce(sum(n), 0)::BIGINT FROM (
  SELECT o.o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.o_orderkey) AS n FROM orders o WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)))""")
def cascade_survivors(spark, d):
    """Two nations go, and with them their customers, orders and line items."""
    nation, customer, orders, lineitem = (table(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    gone = nation.where(F.col("n_nationkey").isin(3, 7)).select(F.col("n_nationkey").alias("c_nationkey"))
    c = customer.join(gone, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    dropped = orders.join(c, "o_custkey", "left_semi").select("o_orderkey")
    kept = orders.join(c, "o_custkey", "left_anti").select("o_orderkey")
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda part, df: df.join(lines, "o_orderkey", "left").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))
    return total("dropped", dropped).unionByName(total("kept", kept))


@query("""
SELECT o_custkey AS tenant_id, count(DISTINCT o_orderpriority) AS members, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'blocked' ELSE 'droppable' END AS verdict
FROM orders GROUP BY 1 HAVING max((o_orderpriority = '1-URGENT')::INT) = 1""")
def sole_owner(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderpriority").alias("user_id"), F.lit("owner").alias("role"))
    return governance.tenant_delete_check(rows, "1-URGENT")


@query("""
SELECT o_orderstatus AS record_type, count(*) AS n, sum(hash_len)::BIGINT AS chars FROM (
  SELECT o_orderstatus, length(o_orderkey || ':' || o_custkey) AS hash_len FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1""")
def export_split(spark, d):
    """An account's rows split by type, read back from the written folders."""
    from uuid import uuid4

    from ..session import shared_folder

    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tenant_id"), F.col("o_orderstatus").alias("record_type"), F.concat_ws(":", "o_orderkey", "o_custkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    members = spark.createDataFrame([("1-URGENT", "u"), ("2-HIGH", "u"), ("5-LOW", "v")], "tenant_id string, user_id string")
    path = f"{shared_folder(spark)}/export-{uuid4().hex}"
    governance.write_export(governance.export_account(rows, members, "u"), path)
    return spark.read.schema("tenant_id string, id string, created_at timestamp, record_type string").json(path).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("id")).alias("chars"))


@query("""
WITH v AS (SELECT event_id,
  event_type NOT IN ('view', 'purchase', 'click', 'signup') AS bad_type, NOT (value / 300 BETWEEN 0 AND 1) AS bad_value FROM events)
SELECT event_id::VARCHAR AS key, 'record_type is not allowed' AS violation FROM v WHERE bad_type
UNION ALL SELECT event_id::VARCHAR, 'confidence is out of range' FROM v WHERE bad_value""")
def check_constraints(spark, d):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "blocker").when(F.col("event_type") == "view", "action_item").otherwise("decision")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("record_type"), (F.col("value") / 300).alias("confidence"))
    return governance.check_constraints(rows, "decisions")


@query("""
WITH e AS (SELECT *, 't' || (user_id % 10) AS tenant, event_type = 'view' AND value > 100 AS bulk,
  CASE WHEN event_id % 11 = 0 THEN 'ok!' ELSE props END AS body FROM events)
SELECT outcome, count(*) AS n FROM (SELECT CASE
  WHEN tenant = 't1' THEN 'learning_paused'
  WHEN event_id % 7 = 0 THEN 'duplicate_skipped'
  WHEN tenant = 't2' THEN 'abandoned_no_active_connection'
  WHEN bulk THEN 'prefiltered_bulk_mail'
  WHEN event_id % 11 = 0 THEN 'prefiltered_trivial_ack'
  WHEN event_type = 'error' THEN 'discarded'
  WHEN event_type = 'click' AND value / 500 < 0.7 THEN 'uncertain_held_out'
  WHEN tenant = 't3' AND event_type = 'signup' THEN 'core_knowledge_only_filtered'
  ELSE 'persisted' END AS outcome FROM e) GROUP BY 1""")
def outcome_counts(spark, d):
    """All events routed as messages of ten tenants."""
    from ..operators.reports import outcome_counts as counts

    e = table(spark, d, "events").withColumn("tenant_id", F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")))
    key = F.col("event_id").cast("string")
    body = F.when(F.col("event_id") % 11 == 0, F.lit('{"text":"ok!"}')).otherwise(F.col("props"))
    envelopes = e.select("tenant_id", F.lit("slack").alias("source"), key.alias("source_id"), body.alias("raw_content"), F.col("ts").alias("received_at"), F.lit(None).cast("string").alias("connection_id"), ((F.col("event_type") == "view") & (F.col("value") > 100)).alias("likely_bulk_mail"))
    ledger = e.where(F.col("event_id") % 7 == 0).select("tenant_id", F.lit("slack").alias("source"), key.alias("source_id"), F.lit("done").alias("pipeline_status"))
    tenants = e.select(F.col("tenant_id").alias("id")).distinct().select("id", (F.col("id") == "t1").alias("learning_paused"), (F.col("id") == "t3").alias("core_knowledge_only"))
    connections = tenants.select(F.concat(F.lit("c-"), "id").alias("id"), F.col("id").alias("tenant_id"), F.lit("slack").alias("source"), F.when(F.col("id") == "t2", "paused").otherwise("active").alias("status"), F.lit("2024-01-01").alias("created_at"))
    word = F.when(F.col("event_type") == "error", "DISCARD").when(F.col("event_type") == "click", "UNCERTAIN").otherwise("KEEP")
    outputs = e.select("tenant_id", F.lit("slack").alias("source"), key.alias("source_id"), word.alias("decision"), (F.col("value") / 500).alias("confidence"), F.when(F.col("event_type") == "signup", "blocker").otherwise("decision").alias("record_type"))
    return counts(ingest.outcome_router(envelopes, ledger, connections, tenants, outputs))


@query("""
SELECT c_custkey, 'C' || c_custkey AS raw_id, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey = c_custkey OR s_nationkey = c_custkey) AS actor_id FROM customer""")
def resolve_actor_ids(spark, d):
    """An id looked up in several id columns through one equi-join."""
    actors = table(spark, d, "supplier").select(F.lit("t").alias("tenant_id"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("email"), F.col("s_nationkey").cast("string").alias("slack_user_id"))
    raw = table(spark, d, "customer").select("c_custkey", F.lit("t").alias("tenant_id"), F.col("c_custkey").cast("string").alias("raw_id"))
    return ingest.resolve_actor_ids(raw, actors).select("c_custkey", F.concat(F.lit("C"), "raw_id").alias("raw_id"), "actor_id")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'superseded' ELSE 'decided' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'new-' || o_orderkey END AS superseded_by FROM orders
UNION ALL SELECT NULL, 'decided', NULL FROM orders WHERE o_orderstatus = 'P'""")
def supersede_rows(spark, d):
    """Every pending order superseded by a new row."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.lit("decided").alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.col("o_orderstatus").alias("k"))
    new = rows.where("k = 'P'").select(F.col("id").alias("old_id"), "tenant_id", F.concat(F.lit("new-"), "id").alias("id"), F.lit("decided").alias("status"), F.lit(None).cast("string").alias("superseded_by"), "k")
    out, _ = register.supersede(rows, new)
    return out.select(F.expr("try_cast(id AS bigint)").alias("id"), "status", "superseded_by")


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal, 2) + 1 ELSE round(c_acctbal, 2) END AS total FROM customer
UNION ALL SELECT -s_suppkey - 1, s_name, round(s_acctbal, 2) FROM supplier""")
def upsert_rows(spark, d):
    """A third of the rows replaced and added to, and new ones appended."""
    from ..sources.tables import upsert

    target = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("total"))
    new = target.where("id % 3 = 0").select("id", F.concat(F.lit("x"), "name").alias("name"), F.lit(1.0).alias("total"))
    fresh = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("total"))
    return upsert(target, new.unionByName(fresh), ["id"], {"total": "add"})

"""Reports, windows, evaluation metrics and dates on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluation, reports, threads
from .base import query, table
from .model import REGISTER, register_tables

AS_OF = "2024-01-20 12:00:00"


def text_time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1")
def volume_by_day(spark, d):
    return reports.volume_by_day(table(spark, d, "events"), "ts").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", text_time("oldest").alias("oldest"), text_time("newest").alias("newest"))


@query(f"SELECT count(*) FILTER (WHERE ts <= TIMESTAMP '{AS_OF}') AS visible, count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}') AS locked, count(*) AS total FROM events")
def visible_locked(spark, d):
    return reports.queue_visibility(table(spark, d, "events"), F.lit(AS_OF).cast("timestamp"), "ts")


@query("SELECT count(DISTINCT (user_id, event_type)) AS unique_keys, count(*) AS total FROM events")
def unique_vs_total(spark, d):
    return reports.unique_vs_total(table(spark, d, "events"), ["user_id", "event_type"], n=None)


@query("SELECT event_type AS source, count(*) AS n, round(avg((value > 100)::INT), 3) AS bulk_share, round(sum(length(props)) / count(*), 3) AS mean_chars FROM events GROUP BY 1")
def sample_by_source(spark, d):
    return reports.sample_by_source(table(spark, d, "events"), F.col("event_type"), F.col("value") > 100, F.col("props"), n=None)


@query("""
WITH k(record_type) AS (VALUES ('decision'), ('action_item'), ('blocker')),
e AS (SELECT CASE event_type WHEN 'view' THEN 'decision' WHEN 'click' THEN 'action_item' ELSE event_type END AS t FROM events)
SELECT record_type, count(t) AS n FROM k LEFT JOIN e ON t = record_type GROUP BY 1""")
def record_type_counts(spark, d):
    kind = F.when(F.col("event_type") == "view", "decision").when(F.col("event_type") == "click", "action_item").otherwise(F.col("event_type"))
    return reports.record_type_counts(table(spark, d, "events").select(kind.alias("record_type")))


@query(f"""
SELECT 'received_2h' AS report, event_type AS label, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR GROUP BY 2
UNION ALL SELECT 'triaged_24h', event_type, count(*) FROM events WHERE ts + INTERVAL 5 MINUTE >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 2
UNION ALL SELECT 'decisions_2h', NULL, count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR""")
def recent_status_counts(spark, d):
    raw = table(spark, d, "events").select(F.col("ts").alias("received_at"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("triage_at"), F.col("event_type").alias("triage_result"))
    made = table(spark, d, "orders").select(F.col("o_orderdate").alias("created_at"))
    return reports.recent_status_counts(raw, made, F.lit(AS_OF).cast("timestamp")).select("report", "label", "n")


@query("""
WITH l AS (SELECT DISTINCT o_custkey FROM orders)
SELECT count(*) AS total, count(o_custkey) AS with_link, count(*) - count(o_custkey) AS without_link FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def link_coverage(spark, d):
    return reports.source_link_coverage(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS user_messages, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def chat_volume(spark, d):
    rows = table(spark, d, "events").withColumn("role", F.when(F.col("event_type") == "click", "user").otherwise("assistant"))
    return reports.chat_volume(rows, "ts", "user_id", "role").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS usage_date, sum(length(props))::BIGINT AS input_tokens, count(*) AS request_count,
  round(sum(length(props)) * 1.0 / 1e6 + sum(user_id) * 5.0 / 1e6, 4) AS cost FROM events GROUP BY 1""")
def usage_cost(spark, d):
    """Counters added up for each day, and their cost."""
    calls = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.length("props").cast("long").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    daily = reports.accumulate_usage(calls, F.col("day"), ["input_tokens", "output_tokens"])
    priced = reports.usage_cost(daily, {"input_tokens": 1.0, "output_tokens": 5.0})
    return priced.select(F.date_format("usage_date", "yyyy-MM-dd").alias("usage_date"), "input_tokens", "request_count", "cost")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return reports.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT 'lang' AS tag FROM documents UNION ALL SELECT 'source' FROM documents) GROUP BY 2""")
def corpus_distribution(spark, d):
    rows = table(spark, d, "documents").withColumn("tags", F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")))
    return reports.corpus_distribution(rows, ["lang", "source"], "tags")


@query("""
SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'permissions', CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN source ELSE lang || ',' || source END, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT 'lang' AS tag FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'source' FROM documents) GROUP BY 2
UNION ALL SELECT 'distinct_statements', NULL, count(DISTINCT text) FROM documents""")
def corpus_permissions(spark, d):
    """Combinations of permissions, tags that some rows lack, and distinct statements."""
    n, none = F.col("doc_id"), F.array().cast("array<string>")
    rows = table(spark, d, "documents").withColumns({
        "scope": F.when(n % 3 == 0, none).when(n % 3 == 1, F.array("source")).otherwise(F.array("lang", "source")),
        "tags": F.when(n % 2 == 0, F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).otherwise(F.array(F.concat(F.lit("source:"), "source"))),
    })
    return reports.corpus_distribution(rows, ["lang"], "tags", "scope", "text")


@query(REGISTER + """
, m AS (SELECT strftime(d.created_at, '%Y-%m-%d') AS day, EXISTS (SELECT 1 FROM decision_sources s WHERE s.decision_id = d.id AND s.tenant_id = d.tenant_id) AS linked
  FROM decisions d JOIN raw_events r ON r.id = d.origin_raw_event_id AND r.tenant_id = d.tenant_id WHERE r.source = 'notion')
SELECT day, count(*) AS total, count(*) FILTER (WHERE linked) AS with_link, count(*) FILTER (WHERE NOT linked) AS without_link FROM m GROUP BY GROUPING SETS ((day), ())""")
def link_coverage_by_day(spark, d):
    """Links of one source's decisions, by day and in all."""
    t = register_tables(spark, d)
    out = reports.source_coverage(t["decisions"], t["raw_events"], t["decision_sources"], "notion")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS user_messages, count(DISTINCT user_id) AS sessions FROM events")
def chat_totals(spark, d):
    """User messages and sessions of all time."""
    rows = table(spark, d, "events").withColumn("role", F.when(F.col("event_type") == "click", "user").otherwise("assistant"))
    return reports.chat_totals(rows, "user_id", "role")


@query("SELECT event_type, count(*) AS n, TRUE AS near, TRUE AS merged FROM events GROUP BY 1")
def sketched_users(spark, d):
    """Distinct users by kind from daily sketches: within 3 % of the exact count, and the same as one sketch over all days."""
    events = table(spark, d, "events")
    daily = reports.daily_sketches(events, F.to_date("ts"), ["event_type"], ["user_id"])
    whole = reports.daily_sketches(events, F.lit(None).cast("date"), ["event_type"], ["user_id"]).select("event_type", reports.sketch_estimate(F.col("sketch")).alias("whole"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    out = reports.merged_sketches(daily, ["event_type"]).join(whole, "event_type").join(exact, "event_type")
    return out.select("event_type", "n", (F.abs(F.col("distinct") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"), (F.col("distinct") == F.col("whole")).alias("merged"))


@query("""
SELECT 'query_understanding_failed_open' AS step, count(*) FILTER (WHERE doc_id % 7 = 0) AS failed_open, count(*) AS n FROM documents
UNION ALL SELECT 'reranking_failed_open', count(*) FILTER (WHERE doc_id % 5 = 1), count(*) FROM documents""")
def failed_open(spark, d):
    """Answers that went on without a step that failed."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select((n % 7 == 0).alias("query_understanding_failed_open"), F.when(n % 2 == 1, n % 5 == 1).otherwise(F.when(n % 5 == 1, True)).alias("reranking_failed_open"))
    return evaluation.failed_open(rows, ["query_understanding_failed_open", "reranking_failed_open"])


@query(f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'paused' WHEN event_id % 5 <> 1 THEN 'active' END AS status, CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL 1 MINUTE * (event_id % 90) END AS synced FROM events),
m AS (SELECT *, greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(synced)) / 60000000))::BIGINT AS m, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(synced))) / 3600)::BIGINT AS h FROM e)
SELECT event_id, CASE WHEN status IS NULL OR status <> 'active' OR synced IS NULL THEN 'Not yet synced' WHEN m < 1 THEN 'Synced just now' WHEN m < 60 THEN 'Synced ' || m || 'm ago' WHEN h < 1 THEN 'Synced just now' WHEN h < 24 THEN 'Synced ' || h || 'h ago' ELSE 'Synced ' || floor(h / 24)::BIGINT || 'd ago' END AS label FROM m""")
def sync_labels(spark, d):
    """When a connection was synced, in words."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(n % 5 == 0, "paused").when(n % 5 != 1, "active").alias("status"), F.when(n % 7 != 0, F.col("ts") + F.make_interval(mins=(n % 90).cast("int"))).alias("synced"))
    return rows.select("event_id", scalars.sync_label("synced", "status", F.lit(AS_OF).cast("timestamp")).alias("label"))


@query("SELECT d.doc_id AS id, f.first_id FROM documents d JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1) f ON d.text = f.text WHERE d.doc_id <> f.first_id")
def exact_duplicates(spark, d):
    return reports.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("""
SELECT 'events' AS table_name, count(*) AS n, count(*) - 5 AS delta FROM events
UNION ALL SELECT 'orders', count(*), NULL FROM orders UNION ALL SELECT 'documents', count(*), NULL FROM documents""")
def table_counts(spark, d):
    return reports.table_counts({t: table(spark, d, t) for t in ("events", "orders", "documents")}, {"events": 5})


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS up, count(*) FILTER (WHERE event_type = 'error') AS down FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def feedback_summary(spark, d):
    signal = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down")
    return reports.feedback_summary(table(spark, d, "events").select("user_id", signal.alias("signal")).where("signal IS NOT NULL"), ["user_id"])


@query("""
SELECT event_type, rank, event_id::VARCHAR AS label, total, CASE WHEN total > 3 THEN (total - 3) || ' more' ELSE '' END AS more FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rank <= 3""")
def pulse_sections(spark, d):
    rows = table(spark, d, "events").withColumn("label", F.col("event_id").cast("string"))
    return reports.pulse_sections(rows, 3, "event_type", [F.desc("value"), F.desc("ts"), F.asc("event_id")], "label")


@query("""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS turn_no FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS last FROM conversations) WHERE last <= 10""")
def recent_turns(spark, d):
    return threads.recent_turns(table(spark, d, "conversations"), 10, "conv_id", [F.col("turn"), F.col("text")]).select("conv_id", "turn", "role", "turn_no")


@query("""
WITH m AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM m)
SELECT user_id, run_no::BIGINT AS run_no, any_value(event_type) AS event_type, min(event_id) AS first_key, max(event_id) AS last_key, count(*) AS n_messages FROM r GROUP BY 1, 2""")
def consecutive_runs(spark, d):
    return threads.group_consecutive(table(spark, d, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], "event_id")


@query("""
WITH s AS (SELECT event_id AS decision_id, user_id, ts FROM events WHERE event_type = 'error'),
t AS (SELECT s.decision_id, e.event_id, row_number() OVER (PARTITION BY s.decision_id ORDER BY e.ts, e.event_id) AS turn, e.event_id = s.decision_id AS is_source
  FROM s JOIN events e ON e.user_id = s.user_id AND e.ts BETWEEN s.ts - INTERVAL 6 HOUR AND s.ts + INTERVAL 6 HOUR)
SELECT * FROM t WHERE turn <= 40""")
def thread_context(spark, d):
    """The events of the same user within six hours of each error."""
    e = table(spark, d, "events")
    raw = e.select(F.col("event_id").alias("id"), F.lit("t").alias("tenant_id"), F.col("user_id").alias("thread_ref"), F.col("ts").alias("received_at"))
    decisions = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("t").alias("tenant_id"), F.col("event_id").alias("origin_raw_event_id"))
    links = spark.createDataFrame([], "tenant_id string, decision_id bigint, raw_event_id bigint")
    return threads.thread_context(decisions, raw, links).select("decision_id", F.col("id").alias("event_id"), "turn", "is_source")


#: A ranking of the documents of each language by size, read as results: rank found, quality expected.
RESULTS = """
WITH r AS (SELECT d.doc_id, d.lang AS mode, d.source AS segment, l.quality, d.n_chars::DOUBLE AS latency,
  CASE WHEN l.quality IS NOT NULL THEN row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) END AS first_expected_rank,
  CASE WHEN l.quality = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def results(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("mode"), F.col("source").alias("segment"), F.col("n_chars").cast("double").alias("latency"))
    rows = rows.join(table(spark, d, "labels"), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("latency"), "doc_id"))
    return rows.withColumn("_r", rank).withColumns({"first_expected_rank": F.when(F.col("quality").isNotNull(), F.col("_r")), "status": F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")}).drop("_r")


@query(RESULTS + """
SELECT mode, segment, round(avg((coalesce(first_expected_rank <= 5, false))::INT), 6) AS recall_at_5, round(avg(coalesce(1.0 / first_expected_rank, 0)), 6) AS mrr, count(*) AS n,
  round(avg((status = 'PASS')::INT), 6) AS pass_rate FROM r GROUP BY GROUPING SETS ((mode), (mode, segment))""")
def metrics_by_segment(spark, d):
    metrics = [F.round(evaluation.recall_at(5), 6).alias("recall_at_5"), F.round(evaluation.mrr(), 6).alias("mrr"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("status") == "PASS").cast("double")), 6).alias("pass_rate")]
    return evaluation.metrics_by_segment(results(spark, d), metrics)


@query(RESULTS + """
, n AS (SELECT mode, segment, latency, row_number() OVER (PARTITION BY mode, segment ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY mode, segment) AS c FROM r)
SELECT mode, segment, round(avg(latency), 4) AS mean_latency, median(latency) AS median_latency, max(latency) FILTER (WHERE i = round_even(0.95 * (c - 1), 0)::BIGINT) AS p95_latency FROM n GROUP BY 1, 2""")
def latency_p95(spark, d):
    return evaluation.latency_stats(results(spark, d), "latency", ["mode", "segment"]).withColumn("mean_latency", F.round("mean_latency", 4))


@query(RESULTS + """
, b AS (SELECT doc_id, CASE WHEN latency > 1500 THEN 'PASS' ELSE 'FAIL' END AS before FROM r WHERE doc_id % 10 <> 0)
SELECT r.doc_id AS query_id, r.status AS now, b.before, CASE WHEN b.before IS NULL THEN 'new' WHEN b.before <> 'PASS' AND r.status = 'PASS' THEN 'improved' WHEN b.before = 'PASS' AND r.status <> 'PASS' THEN 'regressed' ELSE 'unchanged' END AS change
FROM r LEFT JOIN b ON r.doc_id = b.doc_id""")
def compare_runs(spark, d):
    run = results(spark, d).withColumnRenamed("doc_id", "query_id")
    base = run.where("query_id % 10 <> 0").select("query_id", F.when(F.col("latency") > 1500, "PASS").otherwise("FAIL").alias("status"))
    return evaluation.compare_runs(base, run)


@query("SELECT source AS query_id, max(n_chars) FILTER (WHERE lang = 'en') AS en, max(n_chars) FILTER (WHERE lang = 'de') AS de, max(n_chars) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY 1")
def cross_mode(spark, d):
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("query_id"), F.col("lang").alias("mode")).agg(F.max("n_chars").alias("v"))
    return evaluation.cross_mode_table(rows, "v", ["en", "de", "fr"])


@query("SELECT event_id, strftime(date_trunc('week', ts - INTERVAL 9 HOUR), '%Y-%m-%d') AS week_of, 'Q' || quarter(ts) || ' ' || year(ts) AS quarter, weekofyear(ts)::BIGINT AS iso_week FROM events")
def digest_week(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(scalars.digest_week("ts"), "yyyy-MM-dd").alias("week_of"), scalars.quarter_label("ts").alias("quarter"), scalars.iso_week("ts").cast("long").alias("iso_week"))


@query(f"""
WITH h AS (SELECT event_id, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 3600)::BIGINT AS h FROM events)
SELECT event_id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago' ELSE floor(h / 24)::BIGINT || 'd ago' END AS label FROM h""")
def time_ago(spark, d):
    return table(spark, d, "events").select("event_id", scalars.time_ago("ts", F.lit(AS_OF).cast("timestamp")).alias("label"))


@query(f"SELECT event_id, round(1 + pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0) / 14), 9) AS weight FROM events")
def recency_weight(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.recency_weight("ts", F.lit(AS_OF).cast("timestamp")), 9).alias("weight"))


#: Questions with expected and excluded ids, and what was cited.
ASKED = """
WITH q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 5 = 1 THEN ['a' || doc_id, 'b' || doc_id] ELSE ['a' || doc_id] END AS expected, CASE WHEN doc_id % 3 = 0 THEN ['x' || doc_id] ELSE [] END AS excluded,
  CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['b' || doc_id, 'a' || doc_id] WHEN 2 THEN ['z', 'a' || doc_id] ELSE ['x' || doc_id] END AS cited, doc_id % 5 <> 0 AS answerable, doc_id % 5 = 1 AS multi, lang, n_chars FROM documents),
r AS (SELECT *, len(list_intersect(cited, excluded)) > 0 AS leaked, len(list_intersect(cited, expected)) AS hits FROM q),
s AS (SELECT *, CASE WHEN leaked THEN false WHEN NOT answerable THEN len(excluded) > 0 OR len(cited) = 0 WHEN multi THEN hits = len(expected) ELSE hits > 0 END AS good FROM r)
"""


def asked(spark, d):
    n, none = F.col("doc_id"), F.array().cast("array<string>")
    name = lambda letter: F.concat(F.lit(letter), n.cast("string"))
    rows = table(spark, d, "documents").select(
        n.alias("query_id"), F.when(n % 5 == 0, none).when(n % 5 == 1, F.array(name("a"), name("b"))).otherwise(F.array(name("a"))).alias("expected_decision_ids"), F.when(n % 3 == 0, F.array(name("x"))).otherwise(none).alias("excluded_decision_ids"),
        F.when(n % 4 == 0, none).when(n % 4 == 1, F.array(name("b"), name("a"))).when(n % 4 == 2, F.array(F.lit("z"), name("a"))).otherwise(F.array(name("x"))).alias("cited"), (n % 5 != 0).alias("expected_answerable"), (n % 5 == 1).alias("is_multi"), "lang", "n_chars",
    )
    return rows.drop("cited"), rows.select("query_id", "cited")


@query(ASKED + """SELECT query_id, CASE WHEN good THEN 'PASS' ELSE 'FAIL' END AS status, leaked, (SELECT min(p) FROM (SELECT unnest(list_transform(expected, lambda e: nullif(list_position(cited, e), 0))) AS p)) AS first_expected_rank, round(CASE WHEN len(expected) > 0 THEN hits / len(expected) END, 6) AS recall FROM s""")
def score_queries(spark, d):
    """Each question passed or failed, and the rank of its first expected citation."""
    out = evaluation.score_queries(*asked(spark, d))
    return out.select("query_id", "status", "leaked", F.col("first_expected_rank").cast("long").alias("first_expected_rank"), F.round("decision_level_recall", 6).alias("recall"))


@query(ASKED + """SELECT lang, round(avg(CASE WHEN len(cited) > 0 THEN hits / len(cited) END), 6) AS citation_precision, round(avg(CASE WHEN len(expected) > 0 THEN hits / len(expected) END), 6) AS citation_recall,
  round(avg(good::INT), 6) AS multi_strict, round(avg(coalesce(CASE WHEN len(expected) > 0 THEN hits / len(expected) END, 0)), 6) AS multi_recall, round(avg(CASE WHEN len(excluded) > 0 THEN good::INT END), 6) AS permission, round(avg(CASE WHEN NOT answerable AND len(excluded) = 0 THEN good::INT END), 6) AS no_answer FROM s GROUP BY 1""")
def answer_metrics(spark, d):
    """Citation, several-answer, permission and no-answer metrics by language."""
    rows = evaluation.score_queries(*asked(spark, d))
    metrics = [evaluation.citation_precision("cited", "expected_decision_ids").alias("citation_precision"), evaluation.citation_recall("cited", "expected_decision_ids").alias("citation_recall"), *evaluation.multi_accuracy(), evaluation.permission_accuracy("excluded_decision_ids").alias("permission"), evaluation.no_answer_accuracy(excluded="excluded_decision_ids").alias("no_answer")]
    out = rows.groupBy("lang").agg(*metrics)
    return out.select("lang", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(ASKED + """
SELECT query_id, 'reranked beyond authorized' AS finding FROM s WHERE query_id % 7 = 0 UNION ALL SELECT query_id, 'cited beyond authorized' FROM s WHERE len(list_filter(cited, lambda x: NOT list_contains(expected, x))) > 0
UNION ALL SELECT query_id, 'excluded row cited' FROM s WHERE leaked UNION ALL SELECT query_id, 'refusal with citations' FROM s WHERE query_id % 2 = 1 AND len(cited) > 0""")
def security_findings(spark, d):
    """Rows that break a rule of what may be read, cited or refused."""
    rows = evaluation.score_queries(*asked(spark, d))
    reranked = F.when(F.col("query_id") % 7 == 0, F.array(F.lit("w"))).otherwise(F.col("expected_decision_ids"))
    return evaluation.security_findings(rows.select("query_id", reranked.alias("reranked_ids"), F.col("expected_decision_ids").alias("authorized_ids"), "cited", F.col("excluded_decision_ids").alias("excluded"), (F.col("query_id") % 2 == 1).alias("is_refusal")))


@query(ASKED + """
SELECT query_id, CASE WHEN query_id % 6 = 0 AND query_id % 12 = 0 THEN 'PASS' WHEN query_id % 6 = 0 THEN 'ERROR' WHEN good THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN query_id % 12 = 0 THEN -1 ELSE n_chars END AS latency FROM s""")
def merge_retries(spark, d):
    """Results in error replaced by their retries."""
    rows = evaluation.score_queries(*asked(spark, d))
    bad = F.when(F.col("query_id") % 6 == 0, "ERROR").otherwise(F.col("status"))
    results_ = rows.select("query_id", bad.alias("status"), F.col("n_chars").cast("long").alias("latency"))
    again = results_.where("query_id % 4 = 0").withColumns({"status": F.lit("PASS"), "latency": F.lit(-1).cast("long")})
    return evaluation.merge_retries(results_, again)


@query(ASKED + """
, refs AS (SELECT DISTINCT query_id, unnest(list_distinct(list_concat(expected, excluded))) AS ref FROM q)
SELECT query_id, 'missing ' || ref AS violation FROM refs WHERE ref NOT IN (SELECT 'a' || doc_id FROM documents WHERE doc_id % 10 <> 7) AND left(ref, 1) = 'a'
UNION ALL SELECT query_id, 'missing ' || ref FROM refs WHERE left(ref, 1) <> 'a' UNION ALL SELECT query_id, 'expected and excluded' FROM q WHERE query_id % 30 = 9 UNION ALL SELECT query_id, 'answerable does not match' FROM q WHERE query_id % 11 = 0""")
def reference_check(spark, d):
    """Questions that refer to missing rows or contradict themselves."""
    questions, _ = asked(spark, d)
    n = F.col("query_id")
    questions = questions.withColumns({"excluded_decision_ids": F.when(n % 30 == 9, F.concat("excluded_decision_ids", F.col("expected_decision_ids"))).otherwise(F.col("excluded_decision_ids")), "expected_answerable": F.when(n % 11 == 0, ~F.col("expected_answerable")).otherwise(F.col("expected_answerable"))})
    corpus = table(spark, d, "documents").where("doc_id % 10 <> 7").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("source_message_id"))
    return evaluation.reference_check(questions, corpus)


@query("""
WITH s AS (SELECT 'retrieve' AS stage, n_chars::DOUBLE AS ms FROM documents UNION ALL SELECT 'rerank', n_chars * 2.0 FROM documents WHERE doc_id % 2 = 0)
SELECT stage, round(avg(ms), 4) AS mean_ms, count(*) AS n FROM s GROUP BY 1""")
def stage_latency(spark, d):
    """The mean time of each stage."""
    both = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("retrieve"), F.col("n_chars").cast("double"), F.lit("rerank"), F.col("n_chars") * 2.0)).otherwise(F.create_map(F.lit("retrieve"), F.col("n_chars").cast("double")))
    return evaluation.stage_latency(table(spark, d, "documents").select(both.alias("stage_latency_ms"))).withColumn("mean_ms", F.round("mean_ms", 4))


@query("""
WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT event_type AS source, count(*) AS n, round(avg((value > 100)::INT), 3) AS bulk_share, round(sum(length(props)) / count(*), 3) AS mean_chars, (SELECT count(DISTINCT (user_id, event_type)) FROM l) AS unique_keys FROM l GROUP BY 1""")
def latest_sample(spark, d):
    """A4, A5: the reports over the latest thousand rows."""
    e, order = table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")]
    keys = reports.unique_vs_total(e, ["user_id", "event_type"], order).select("unique_keys")
    return reports.sample_by_source(e, F.col("event_type"), F.col("value") > 100, F.col("props"), order).crossJoin(keys)  # one row


@query("""
SELECT event_type, rank, event_id::VARCHAR AS label, total, CASE WHEN total > 2 THEN (total - 2) || ' more' ELSE '' END AS more FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') WHERE rank <= 2""")
def pulse_of_week(spark, d):
    """The sections of one week."""
    rows = table(spark, d, "events").withColumn("label", F.col("event_id").cast("string"))
    return reports.pulse_sections(rows, 2, "event_type", [F.desc("value"), F.desc("ts"), F.asc("event_id")], "label", "2024-01-08", "2024-01-14", "ts")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS user_messages, count(DISTINCT user_id) AS sessions FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY 1")
def chat_volume_window(spark, d):
    """The window is held to at least a day."""
    rows = table(spark, d, "events").withColumn("role", F.when(F.col("event_type") == "click", "user").otherwise("assistant"))
    return reports.chat_volume(rows, "ts", "user_id", "role", F.lit(AS_OF).cast("timestamp"), 0).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""
SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS likeness FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark, d):
    """The cosine of each vector and the next one, from stored norms."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", scalars.norm("embedding").alias("norm"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("norm").alias("other_norm"))
    return v.join(after, "vec_id").select(F.col("vec_id").alias("id"), F.round(scalars.cosine("embedding", "other", F.col("norm"), F.col("other_norm")), 6).alias("likeness"))

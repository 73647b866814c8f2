"""Streaming operators run over a table with availableNow, and their state-like batch forms."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs
from .base import query, table, with_zone


def is_file(spark, path: str) -> bool:
    """Whether a path of any file system that Spark reads is one file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def run_stream(spark, sf_dir, name, build, mode="append"):
    """A streaming query over a table's files, run to its end; its output as a table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A folder may hold the table as one file or as many; the glob finds either.
    stream = with_zone(spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if is_file(spark, f"{sf_dir}/{name}.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet"))
    out = build(stream)
    base = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY 1, 2")
def stream_dedup(spark, d):
    """Every event sent twice, and deduplicated on its way."""
    twice = lambda s: jobs.stream_dedup(s.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy"), ["user_id", "event_type", "event_id"], "ts", "30 days").select("user_id", "event_type", "event_id")
    return run_stream(spark, d, "events", twice).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2")
def tumbling_counts(spark, d):
    """Closed daily windows; the last one stays open behind the watermark."""
    out = run_stream(spark, d, "events", lambda s: jobs.tumbling_counts(s, "ts", "1 day", ["event_type"], "1 hour"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (
  SELECT user_id, event_id, us, i, us AS start, 1 AS used, true AS allowed FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.us, e.i, CASE WHEN e.us >= w.start + 86400000000 THEN e.us ELSE w.start END,
    CASE WHEN e.us >= w.start + 86400000000 THEN 1 WHEN w.used < 3 THEN w.used + 1 ELSE w.used END,
    e.us >= w.start + 86400000000 OR w.used < 3
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id AS key, event_id, start AS window_start_us, used::BIGINT AS used, allowed FROM w""")
def fixed_window_limits(spark, d):
    """Three events a day for each user, in windows that open at their first event."""
    out = jobs.fixed_window_limits(table(spark, d, "events"), 3, 86_400, "user_id", "ts", "event_id")
    return out.select("key", "event_id", F.unix_micros("window_start").alias("window_start_us"), "used", "allowed")


@query("""
WITH s AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, coalesce(sum(value / 1000) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT event_id, day, round(before, 5) AS spent_before, round(before, 6) < 5 AS allowed FROM s""")
def daily_budget(spark, d):
    out = jobs.daily_budget(table(spark, d, "events"), F.col("value") / 1000, "ts", "event_id")
    return out.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("spent_before", 5).alias("spent_before"), "allowed")


@query("SELECT count(*) FILTER (WHERE ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-25') AS purged, count(*) FILTER (WHERE NOT ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-25') AS kept FROM events")
def purge_expired(spark, d):
    from ..operators.governance import purge_expired as purge

    rows = table(spark, d, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    kept, gone = purge(rows, F.lit("2024-01-25").cast("timestamp"))
    return gone.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each

"""Streaming jobs: ingest, bounded dedup, windows, limits, budgets and retention."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import redact_json
from ..operators.ingest import KEYS, outcome_router, retry_pending
from ..session import ship_package
from ..sources.tables import ENVELOPE, split_envelopes, stream_envelopes


#: How long a stored message is known.
LEDGER_DAYS = 30


def stream_dedup(stream: DataFrame, keys: list[str] = KEYS, ingested: str = "ingested_at", ttl: str = "30 days") -> DataFrame:
    """The first row of each key within ``ttl`` of its arrival; state is dropped after that."""
    return stream.withWatermark(ingested, ttl).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(rows: DataFrame, ts: str, width: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Rows for each window and key; with a watermark the stream form appends closed windows."""
    rows = rows if watermark is None else rows.withWatermark(ts, watermark)
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def ingest_stream(spark: SparkSession, in_path: str, out_path: str, tables: dict[str, DataFrame], model_outputs: DataFrame, checkpoint: str, files_per_batch: int = 20, today: date | None = None):
    """Landed envelopes to outcomes, rejects and persisted rows, batch by batch.

    Sinks are folders named by the batch id and written with overwrite, so a batch that is run
    again after a failure replaces what it wrote.  A key that an earlier batch stored as done in the
    last ``LEDGER_DAYS`` days is read back from those folders, older days are not read; a key that comes
    again after that is new, as in the raw store, whose rows expire then.  A message that the model has
    not judged yet is pending: it is kept and taken up by the next batch (T3) together with what has
    landed since; ``wake`` starts one without new messages.  Messages of a paused tenant or without
    a connection are not kept: they are not in the ledger, so they count when they are sent again.
    """
    ledger_path = f"{out_path}/ledger"
    today = today or date.today()

    def stored(path: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path)
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def batch(rows: DataFrame, batch_id: int) -> None:
        good, bad = split_envelopes(rows)
        good = good.withColumn("raw_content", redact_json("raw_content"))
        ledger = stored(ledger_path, f"{', '.join(f'{k} string' for k in KEYS)}, pipeline_status string, day date, batch long")
        ledger = ledger.where((F.col("day") > F.lit(today - timedelta(days=LEDGER_DAYS))) & (F.col("batch") < batch_id))
        waiting = stored(f"{out_path}/pending/batch={batch_id - 1}", ENVELOPE)
        good = good.unionByName(retry_pending(waiting, ledger))
        routed = outcome_router(good, ledger, tables["source_connections"], tables["tenants"], model_outputs)
        judged = model_outputs.select(*KEYS).distinct().withColumn("_judged", F.lit(True))
        pending = (F.col("outcome") == "discarded") & F.col("_judged").isNull()
        routed = routed.join(judged, KEYS, "left").withColumn("outcome", F.when(pending, "pending").otherwise(F.col("outcome"))).drop("_judged")
        routed.write.mode("overwrite").parquet(f"{out_path}/outcomes/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{out_path}/rejected/batch={batch_id}")
        kept = spark.read.parquet(f"{out_path}/outcomes/batch={batch_id}")
        kept.where(F.col("outcome") == "pending").drop("outcome").write.mode("overwrite").parquet(f"{out_path}/pending/batch={batch_id}")
        done = kept.where(~F.col("outcome").isin("pending", "duplicate_skipped", "duplicate_on_insert", "abandoned_no_active_connection", "learning_paused"))
        done.select(*KEYS, F.lit("done").alias("pipeline_status")).distinct().write.mode("overwrite").parquet(f"{ledger_path}/day={today.isoformat()}/batch={batch_id}")

    source = stream_envelopes(spark, in_path, files_per_batch)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wake(spark: SparkSession, in_path: str) -> None:
    """A file without messages, so that the next run takes up what waits though nothing has landed."""
    spark.range(1).select(F.lit("").alias("value")).write.mode("append").text(in_path)


def late_and_bad(rows: DataFrame, as_of: Column, horizon: str = "30 days") -> tuple[DataFrame, DataFrame, DataFrame]:
    """T4: usable rows, rejected rows, and rows older than the horizon."""
    good, bad = split_envelopes(rows if "_corrupt" in rows.columns else rows.withColumn("_corrupt", F.lit(None).cast("string")))
    old = F.coalesce(F.col("received_at") < as_of - F.expr(f"INTERVAL {horizon}"), F.lit(False))
    return good.where(~old), bad, good.where(old)


def embedding_queue(new_decisions: DataFrame, decisions: DataFrame, embedded: DataFrame) -> DataFrame:
    """T5: new decisions that exist and have no vector yet, once each."""
    known = new_decisions.select("id", "tenant_id").distinct().join(decisions.select("id", "tenant_id"), ["id", "tenant_id"], "left_semi")
    return known.join(embedded.select(F.col("decision_id").alias("id"), "tenant_id"), ["id", "tenant_id"], "left_anti")


def _admit(times: list[int], n: int, width: int, strict: bool, start: int | None, count: int) -> tuple[list[tuple[int, int, bool]], int | None, int]:
    """(window start, admitted so far, allowed) of events in order, from a state."""
    out = []
    for t in times:
        if start is None or (t > start + width if strict else t >= start + width):
            start, count = t, 0
        ok = count < n
        count += ok
        out.append((start, count, ok))
    return out, start, count


def fixed_window_limits(events: DataFrame, n: int, window_seconds: int, key: str, ts: str, event_id: str, strict: bool = False) -> DataFrame:
    """Each event admitted or not under ``n`` admissions in windows anchored at their first event.

    A window ends when an event comes ``window_seconds`` or more after its start (``strict``: only
    later than that); denied events do not count.  Keys are dealt to tasks and their events sorted
    there by Spark, so a task follows its rows once and holds a batch and one (start, used) at a time.
    """
    ship_package(events.sparkSession)
    width = window_seconds * 1_000_000
    rows = events.select(F.col(key).alias("key"), F.unix_micros(ts).alias("at"), F.col(event_id).alias("event_id"))

    def follow(batches):
        last, start, used = object(), None, 0
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts, counts, good = [], [], []
            for k, t in zip(keys, times):
                if k != last:
                    last, start, used = k, None, 0
                if start is None or (t > start + width if strict else t >= start + width):
                    start, used = t, 0
                ok = used < n
                used += ok
                starts.append(start)
                counts.append(used)
                good.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(good, pa.bool_())], names=["key", "event_id", "window_start", "used", "allowed"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.where("key IS NOT NULL AND at IS NOT NULL").repartition("key").sortWithinPartitions("key", "at", "event_id")
    out = out.mapInArrow(follow, f"key {kinds['key']}, event_id {kinds['event_id']}, window_start long, used long, allowed boolean")
    return out.withColumn("window_start", F.timestamp_micros("window_start"))


class WindowLimiter(StatefulProcessor):
    """The same as stream state: one (start, count) for each key, dropped after the window has passed twice."""

    def __init__(self, n: int, window_seconds: int, strict: bool = False):
        self.n, self.width, self.strict = n, window_seconds * 1_000_000, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, used long", ttlDurationMs=2 * self.width // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        start, used = self.state.get() if self.state.exists() else (None, 0)
        out, start, used = _admit(frame["at"].tolist(), self.n, self.width, self.strict, start, used)
        self.state.update((start, used))
        yield pd.DataFrame({"key": [str(key[0])] * len(out), "event_id": frame["event_id"].tolist(), "window_start": [s for s, _, _ in out], "used": [c for _, c, _ in out], "allowed": [ok for _, _, ok in out]})

    def close(self) -> None:
        pass


def stream_limits(stream: DataFrame, n: int, window_seconds: int, key: str, ts: str, event_id: str, strict: bool = False) -> DataFrame:
    """``fixed_window_limits`` over a stream."""
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(ts).alias("at"), F.col(event_id).cast("long").alias("event_id"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=WindowLimiter(n, window_seconds, strict), outputStructType="key string, event_id long, window_start long, used long, allowed boolean", outputMode="Update", timeMode="ProcessingTime")


def usage_remaining(limits: DataFrame, n: int, window_seconds: int, as_of: Column) -> DataFrame:
    """Each key's latest window: used, limit, start, end and what remains; an ended window is empty."""
    last = limits.groupBy("key").agg(F.max(F.struct("window_start", "used")).alias("w"))
    end = F.col("w.window_start") + F.make_interval(secs=F.lit(window_seconds))
    used = F.when(as_of >= end, F.lit(0)).otherwise(F.col("w.used"))
    return last.select("key", used.alias("used"), F.lit(n).alias("limit"), F.col("w.window_start").alias("window_start"), end.alias("window_end"), (F.lit(n) - used).alias("remaining"))


def daily_budget(calls: DataFrame, cost: Column, ts: str, call_id: str, cap: float = 5.0) -> DataFrame:
    """Each call with what its day had cost before it, and whether it is allowed.

    What minutes cost is added up first; a call then adds what came before it in its own minute, so
    a day is 1,440 tasks' worth of sorting and its running total is over minutes.
    """
    rows = calls.select(F.col(call_id), F.to_date(ts).alias("day"), F.date_trunc("minute", ts).alias("_minute"), F.col(ts).alias("_at"), cost.alias("_cost"))
    earlier = Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("day", "_minute").agg(F.sum("_cost").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).drop("_sum")
    own = F.coalesce(F.sum("_cost").over(Window.partitionBy("day", "_minute").orderBy("_at", call_id).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spent = rows.withColumn("_own", own).join(base, ["day", "_minute"]).withColumn("spent_before", F.col("_base") + F.col("_own"))
    return spent.select(call_id, "day", "spent_before", (F.round("spent_before", 6) < cap).alias("allowed"))


__all__ = ["WindowLimiter", "daily_budget", "embedding_queue", "fixed_window_limits", "ingest_stream", "late_and_bad", "retry_pending", "stream_dedup", "stream_limits", "tumbling_counts", "usage_remaining"]

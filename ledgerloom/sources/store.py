"""Keyed tables as folders: rows in hash buckets of their key, and by day where they expire.

A write touches only the buckets that its keys fall into.  Spark replaces those partitions when a job
ends (dynamic partition overwrite), so a failed attempt leaves the table as it was, and a repeated one
changes nothing more: rows carry the name of the batch that last wrote them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder, written
from .tables import insert_ignore, upsert

BUCKETS = 64


def _key(keys: list[str]) -> Column:
    """One text for a key, nulls included."""
    return F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(_key(keys)), F.lit(buckets)).cast("int")


def create_store(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, day: Column | None = None) -> None:
    """``rows`` (one for each key) as a keyed table; with ``day`` also parted by it, for ``drop_days``."""
    kept = rows.withColumns({"_batch": F.lit(""), "_bucket": _bucket(keys, buckets)} | ({"_day": day.cast("date")} if day is not None else {}))
    parts = ["_day", "_bucket"] if day is not None else ["_bucket"]
    kept.repartition(*parts).write.partitionBy(*parts).parquet(f"{path}/rows")
    spark = rows.sparkSession
    facts = (keys, buckets, day is not None, kept.select(*(c for c in kept.columns if c not in parts), *parts).schema.json())
    spark.createDataFrame([facts], "keys array<string>, buckets int, dated boolean, columns string").write.json(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str):
    return spark.read.schema("keys array<string>, buckets int, dated boolean, columns string").json(f"{path}/manifest").first()  # one row


def _stored(spark: SparkSession, path: str, facts) -> DataFrame:
    import json

    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(json.loads(facts["columns"]))).parquet(f"{path}/rows")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table."""
    return _stored(spark, path, _manifest(spark, path)).drop("_batch", "_bucket", "_day")


def _touched(new: DataFrame, facts) -> list[int]:
    """The buckets that the new keys fall into: at most as many as the table has."""
    return [r[0] for r in new.select(_bucket(facts["keys"], facts["buckets"])).distinct().collect()]


def upsert_store(new: DataFrame, path: str, batch: str, rules: dict[str, str] | None = None, stamp: Column | None = None) -> int:
    """New rows (one for each key) by key, as ``upsert`` has it; the number of buckets that were rewritten.

    Only buckets with a new key are read and written.  A row that ``batch`` has written already is left
    as it is, so a repeated batch adds nothing twice.  Keys may be null.
    """
    spark = new.sparkSession
    facts = _manifest(spark, path)
    if facts["dated"]:
        raise ValueError("rows of a table by day are only added and dropped")
    keys, buckets = facts["keys"], _touched(new, facts)
    if not buckets:
        return 0
    old = _stored(spark, path, facts).where(F.col("_bucket").isin(buckets)).withColumn("_key", _key(keys))
    fresh = new.withColumns({"_key": _key(keys), "_batch": F.lit(batch), "_bucket": _bucket(keys, facts["buckets"])})
    done = old.where(F.col("_batch") == batch).select("_key")
    fresh = fresh.join(done, "_key", "left_anti")
    # The rows are settled in a table of their own first, as they replace the partitions that they come from.
    merged = written(upsert(old, fresh, ["_key"], rules, stamp).drop("_key"), "upsert")
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")
    return len(buckets)


def insert_store(new: DataFrame, path: str, batch: str, day: Column | None = None) -> DataFrame:
    """Rows whose key is absent are added, the first of each key; the rows of this batch are returned.

    Only the keys of the buckets at hand are read.  A repeated batch finds its own rows and adds none.
    """
    spark = new.sparkSession
    facts = _manifest(spark, path)
    keys, parts = facts["keys"], ["_day", "_bucket"] if facts["dated"] else ["_bucket"]
    buckets = _touched(new, facts)
    known = _stored(spark, path, facts).where(F.col("_bucket").isin(buckets)).select(_key(keys).alias("_key"))
    rows = new.withColumns({"_key": _key(keys), "_batch": F.lit(batch), "_bucket": _bucket(keys, facts["buckets"])} | ({"_day": day.cast("date")} if facts["dated"] else {}))
    added = written(insert_ignore(known, rows, ["_key"]).drop("_key"), "insert")
    added.repartition(*parts).write.mode("append").partitionBy(*parts).parquet(f"{path}/rows")
    return _stored(spark, path, facts).where(F.col("_bucket").isin(buckets) & (F.col("_batch") == batch)).drop("_batch", "_bucket", "_day")


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """The days before ``before`` (yyyy-mm-dd) leave a table by day as folders; no row is read.  The days that went."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]  # one for each day
    gone = sorted(n.removeprefix("_day=") for n in names if n.startswith("_day=") and n.removeprefix("_day=") < before and "HIVE_DEFAULT" not in n)
    for day in gone:
        remove_folder(spark, f"{path}/rows/_day={day}")
    return gone

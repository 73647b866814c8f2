"""How a query is registered: a function of (spark, folder) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import TimestampNTZType

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    ship_package(spark)
    return with_zone(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_zone(df: DataFrame) -> DataFrame:
    """Times without a zone as times of the session's zone."""
    bare = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: df[c].cast("timestamp") for c in bare}) if bare else df


def query(sql: str | None = None):
    """Register a function under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep

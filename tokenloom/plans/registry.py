"""Registry of queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with SQL giving the same rows."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(fn(spark, sf_dir))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def plain_types(df: DataFrame) -> DataFrame:
    """All integers as bigint, so results compare across engines."""
    small = [n for n, kind in df.dtypes if kind in ("int", "smallint", "tinyint")]
    return df.withColumns({n: F.col(n).cast("long") for n in small}) if small else df

"""Session helpers: shared scratch folders and tables that cut a plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session that names none (a local test) falls back to /tmp.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tokenloom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a cut that survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """The rows dealt anew for heavy work on a table of few files; unchanged without arguments.

    By a hash of ``key`` into the session's shuffle partitions, or into ``partitions``. It is
    the caller's choice, never a guess from the machine that makes the plan.
    """
    if partitions is None and key is None:
        return df
    by = [key] if key else []
    return df.repartition(*([partitions] if partitions else []), *by)

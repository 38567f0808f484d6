"""Corpus-order operators: row filters, offsets, text dump, limits, re-sharding.

A corpus is a DataFrame ``(shard bigint, batch_index bigint, row_in_batch
bigint, text string or binary)``; the first three columns are its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.scalars import unescape_delimiter
from tokenloom.operators.ordered import corpus_path, running_total

ORDER = ["shard", "batch_index", "row_in_batch"]


def null_to_empty(df: DataFrame, column: str = "text") -> DataFrame:
    """Dump path: a null row stays, as ''."""
    empty = F.lit("").cast(df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(column, empty))


def nonempty_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """Tokenize path: null and '' rows go."""
    return df.where(F.col(column).isNotNull() & (F.octet_length(column) > 0))


def row_offsets(
    df: DataFrame, column: str = "text", delimiter_bytes: int = 0, out: str = "offset", length: str = "len"
) -> DataFrame:
    """Byte offset of every row inside its shard; ``len`` excludes the delimiter."""
    df = df.withColumn(length, F.coalesce(F.octet_length(column), F.lit(0)).cast("long"))
    df, path = corpus_path(df)
    return running_total(
        df, ["shard"], path, ["row_in_batch"], {out: F.col(length) + delimiter_bytes}
    ).drop("_p1")


def _global_rank(df: DataFrame, out: str) -> DataFrame:
    """0-based position of every row in corpus order, over all shards."""
    df, path = corpus_path(df)
    # the shard is the coarsest step of the path: its windows see one row per shard
    return running_total(df, [], ["shard", *path], ["row_in_batch"], {out: F.lit(1)}).drop("_p1")


def row_cut(df: DataFrame, n: int) -> tuple[int, int, int] | None:
    """``(shard, batch, rows)``: the batch in which the n-th row in corpus order lies, and how many of
    its rows belong to the first n; None if there are not that many rows.

    Only the order columns are read, and one row per batch is folded; one row comes to the driver.
    """
    per = df.groupBy("shard", "batch_index").agg(F.count(F.lit(1)).alias("rows"))
    per, path = corpus_path(per)
    placed = running_total(per, [], ["shard", *path], ["batch_index"], {"before": F.col("rows")})
    hit = placed.where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n)).select(
        "shard", "batch_index", (F.lit(n) - F.col("before")).alias("take")).first()
    return tuple(hit) if hit else None


def max_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in corpus order; negative keeps all.

    The batch in which the n-th row lies is found from the batches' row counts. The rows are
    then asked for by plain comparisons of shard and batch, which a source can use to skip
    files, row groups or batches: texts behind the cut are never read. Only the cut batch, which is
    bounded, is ranked. Any n stays distributed.
    """
    if n < 0:
        return df
    if n == 0:
        return df.where(F.lit(False))
    cut = row_cut(df, n)
    if cut is None:
        return df
    shard, batch, take = cut
    last = df.where((F.col("shard") == shard) & (F.col("batch_index") == batch))
    order = W.partitionBy("shard", "batch_index").orderBy("row_in_batch")
    last = last.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= take).drop("_rank")
    whole = df.where(F.col("shard") < shard)
    return whole.unionByName(df.where((F.col("shard") == shard) & (F.col("batch_index") < batch))).unionByName(last)


def round_robin(df: DataFrame, slots: int, out: str = "slot") -> DataFrame:
    """slot = sequence number mod slots (0 when there are no slots)."""
    if slots == 0:
        return df.withColumn(out, F.lit(0).cast("long"))
    return _global_rank(df, "seq").withColumn(out, F.pmod(F.col("seq"), F.lit(slots).cast("long"))).drop("seq")


def dump_rows(df: DataFrame, column: str = "text", delimiter: str = "\n", rows: int = -1) -> DataFrame:
    """Rows of the text dump with their offset in the whole dump: ``(offset, len, data)``.

    Offsets run over all shards in corpus order; the delimiter follows every row.
    """
    delim = unescape_delimiter(delimiter).encode("utf-8")
    df = max_rows(null_to_empty(df, column), rows)
    df = df.withColumn("len", F.octet_length(column).cast("long"))
    df, path = corpus_path(df)
    placed = running_total(
        df, [], ["shard", *path], ["row_in_batch"], {"offset": F.col("len") + len(delim)}
    )
    data = F.concat(F.col(column).cast("binary"), F.lit(bytearray(delim)))
    return placed.select(*ORDER, "offset", "len", data.alias("data"))


def dump_stats(df: DataFrame, column: str = "text", delimiter: str = "\n", rows: int = -1) -> DataFrame:
    """Rows and bytes of such a dump; lengths alone decide, nothing is placed."""
    delim = unescape_delimiter(delimiter).encode("utf-8")
    size = F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + len(delim)
    return max_rows(df, rows).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("output_bytes")
    )


def batch_range_index(df: DataFrame, column: str = "text", rows: int = -1) -> DataFrame:
    """Per record batch: rows taken, offset of its first value, total value bytes."""
    df = max_rows(df, rows)
    per_batch = (
        df.groupBy("shard", "batch_index")
        .agg(
            F.count(F.lit(1)).alias("num_rows"),
            F.sum(F.coalesce(F.octet_length(column), F.lit(0)).cast("long")).alias("data_length"),
        )
        .withColumn("row_in_batch", F.lit(0))
    )
    per_batch, path = corpus_path(per_batch)
    # text never moves: offsets come from the per-batch totals alone
    return running_total(
        per_batch, ["shard"], path, ["row_in_batch"], {"data_offset": F.col("data_length")}
    ).select("shard", "batch_index", "num_rows", "data_offset", "data_length")


def even_shards(df: DataFrame, n: int) -> DataFrame:
    """Deal the rows of a corpus into n even output shards, order kept."""
    return round_robin(df, n, "out_shard")

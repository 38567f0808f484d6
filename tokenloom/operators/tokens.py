"""Token files: writing, summarising, looking at both ends; token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.scalars import int_div, shard_name
from tokenloom.operators.bpe import packed_column
from tokenloom.operators.corpus import ORDER
from tokenloom.operators.ordered import corpus_path, running_total, with_path
from tokenloom.session import materialize
from tokenloom.sources.sinks import write_positioned

BLOCKS_PER_GROUP = 1024


def packed_rows(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """Corpus order columns and the packed ids of each row (empty for null ids); ``ids`` may be packed."""
    return encoded.select(*ORDER, packed_column(encoded, ids).alias("packed")).withColumn(
        "packed", F.coalesce("packed", F.lit(bytearray()))
    )


def placed_tokens(packed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Packed rows at their byte offset in the shard's token file, which may begin at the
    ``base`` bytes of a row ``shard, base``."""
    rows, path = corpus_path(packed)
    placed = running_total(rows, ["shard"], path, ["row_in_batch"], {"offset": F.octet_length("packed")})
    offset = F.col("offset")
    if base is not None:
        placed = placed.join(base, "shard", "left")
        offset = offset + F.coalesce("base", F.lit(0))
    return placed.select(
        F.concat(shard_name(F.col("shard")), F.lit(".bin")).alias("file"),
        offset.alias("offset"),
        F.col("packed").alias("data"),
    )


def write_token_bins(encoded: DataFrame, path: str, ids: str = "ids", layout: str = "parts") -> None:
    """One ``{shard:05d}.bin`` per shard, ids in row order; an empty shard gives an empty file.

    Rows are encoded once into a table in the shared folder; from its sizes every
    row knows its place, so a shard is written by many tasks.
    """
    once = materialize(packed_rows(encoded, ids), "packed")
    write_positioned(placed_tokens(once), path, layout)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes) of every token file; file contents are not read."""
    return spark.read.format("token_files").load(path)


def token_file_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per file: counts, zero ratio, min and max; files without tokens show only their size.

    The source sums every range of a file while it reads it, so a row stands for a range and
    never for a token.
    """
    files = token_files(spark, path)
    per = spark.read.format("token_stats").load(path).groupBy("path").agg(
        F.sum("tokens").alias("tokens"), F.sum("zeros").alias("zeros"),
        F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"),
    )
    return files.join(per, "path", "left").select(
        "path",
        "size_bytes",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.col("tokens") - F.col("zeros")).alias("nonzero"),
        "zeros",
        (F.col("zeros") / F.col("tokens")).alias("zero_ratio"),
        "min_id",
        "max_id",
    )


def head_tail(spark: SparkSession, path: str, limit: int = 64) -> DataFrame:
    """First ``limit`` ids of each file, and the last ones only if there are more than that.

    Only these ids are read.
    """
    limit = max(0, limit)
    ids = spark.read.format("token_bin").option("ends", limit).load(path)
    counted = token_files(spark, path).select("path", int_div(F.col("size_bytes"), F.lit(4).cast("long")).alias("_n"))
    head = F.when(F.col("pos") < limit, F.lit("HEAD"))
    tail = F.when((F.col("_n") > limit) & (F.col("pos") >= F.col("_n") - limit), F.lit("TAIL"))
    return (
        ids.join(counted, "path")
        .withColumn("part", F.explode(F.array_compact(F.array(head, tail))))
        .select("path", "part", "pos", "token_id")
    )


def token_counts(encoded: DataFrame, by: list[str], ids: str = "ids") -> DataFrame:
    return encoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size(ids)).alias("tokens")
    )


def write_block_bins(tokenized: DataFrame, path: str, block_bytes: int, layout: str = "parts") -> None:
    """Equal-sized output blocks of the block path, one ``.bin`` per shard; ids beyond a
    block's capacity go to the shard's ``.overflow`` in block order. ``tokenized`` is read
    twice: pass a written table."""
    if "overflow" in tokenized.columns:
        more = tokenized.where(F.octet_length("overflow") > 0).select(
            "shard", "block_index", F.col("overflow").alias("packed"))
        more, levels = with_path(more, "block_index", BLOCKS_PER_GROUP)
        placed = running_total(more, ["shard"], levels, ["block_index"], {"offset": F.octet_length("packed")})
        write_positioned(
            placed.select(F.concat(shard_name(F.col("shard")), F.lit(".overflow")).alias("file"),
                          "offset", F.col("packed").alias("data")),
            path, layout,
        )
    write_positioned(
        tokenized.select(
            F.concat(shard_name(F.col("shard")), F.lit(".bin")).alias("file"),
            (F.col("block_index") * block_bytes).alias("offset"),
            F.col("output").alias("data"),
        ),
        path, layout,
    )

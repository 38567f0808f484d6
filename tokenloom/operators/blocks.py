"""Fixed-size block tokenization of a shard's text bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.scalars import int_div
from tokenloom.operators.bpe import bpe_encode
from tokenloom.operators.corpus import row_offsets
from tokenloom.sources.model import BpeModel

BLOCK_BYTES = 131072
SECTOR = 512


def cut_blocks(
    corpus: DataFrame,
    column: str = "text",
    block_bytes: int = BLOCK_BYTES,
    scope: str = "shard",
    delimiter: bytes = b"",
    boundary: str = "raw",
) -> DataFrame:
    """Cut text bytes into blocks ``(shard[, batch_index], block_index, block_len, content)``.

    ``boundary='raw'`` cuts anywhere; ``'char'`` moves a character split at a
    border into the later block, so a block may exceed ``block_bytes`` by up to
    three bytes at its start and lose as many at its end.
    """
    if scope not in ("shard", "batch"):
        raise ValueError("scope is 'shard' or 'batch'")
    if boundary not in ("raw", "char"):
        raise ValueError("boundary is 'raw' or 'char'")
    keys = ["shard"] if scope == "shard" else ["shard", "batch_index"]
    rows = corpus.where(F.col(column).isNotNull()).withColumn(
        "_bin", F.concat(F.col(column).cast("binary"), F.lit(bytearray(delimiter)))
    )
    if scope == "shard":
        rows = row_offsets(rows, "_bin", 0, "_off", "_len")
    else:
        rows = rows.withColumn("_len", F.octet_length("_bin").cast("long"))
        w = W.partitionBy(*keys).orderBy("row_in_batch").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("_off", F.coalesce(F.sum("_len").over(w), F.lit(0)))
    b = F.lit(block_bytes).cast("long")
    rows = rows.where(F.col("_len") > 0)
    first, last = int_div(F.col("_off"), b), int_div(F.col("_off") + F.col("_len") - 1, b)

    def char_start(at):
        # bytes 10xxxxxx at a cut belong to the character before it: the cut
        # moves left to the first byte of that character (at most 3 steps)
        def is_tail(k: int):
            byte = F.conv(F.hex(F.substr("_bin", (at - k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return (at - k >= 0) & (byte.bitwiseAND(F.lit(0xC0)) == 0x80)

        step = F.lit(0)
        for k in (2, 1, 0):
            step = F.when(is_tail(k), step + 1).otherwise(F.lit(0))
        return at - step

    def piece(i):
        lo = F.greatest(i * b - F.col("_off"), F.lit(0).cast("long"))
        hi = F.least((i + 1) * b - F.col("_off"), F.col("_len"))
        if boundary == "char":
            lo = F.when(lo > 0, char_start(lo)).otherwise(lo)
            hi = F.when(hi < F.col("_len"), char_start(hi)).otherwise(hi)
        return F.struct(
            i.alias("block_index"),
            (F.col("_off") + lo).alias("at"),
            F.substr("_bin", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("bytes"),
        )

    pieces = rows.select(
        *keys, F.explode(F.transform(F.sequence(first, last), piece)).alias("p")
    ).select(*keys, "p.*").where(F.octet_length("bytes") > 0)
    # a block collects at most its own bytes
    return (
        pieces.groupBy(*keys, "block_index")
        .agg(F.expr("listagg(bytes) within group (order by at)").alias("content"))
        .withColumn("block_len", F.octet_length("content"))
    )


def block_tokenize(
    blocks: DataFrame, model: BpeModel, block_bytes: int = BLOCK_BYTES, strategy: str = "auto",
    overflow: str = "keep", **options
) -> DataFrame:
    """Encode each block; output is the block's capacity in bytes: ids, then zeros.

    A full block holds ``block_bytes / 4`` ids, a shorter one its length rounded
    up to whole sectors. Ids beyond that are kept as a second packed column
    ``overflow``, so output and overflow together are all ids. ``overflow='error'``
    fails instead, ``'drop'`` leaves them out and counts them in ``dropped``.
    """
    if overflow not in ("keep", "error", "drop"):
        raise ValueError("overflow is 'keep', 'error' or 'drop'")
    if block_bytes % SECTOR:
        raise ValueError(f"block_bytes is a multiple of {SECTOR}")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    # ids stay packed from where they are made: a cut of a block's ids is a cut of its bytes
    enc = bpe_encode(blocks.withColumn("_text", text), model, "_text", "_ids", strategy, packed=True, **options)
    sector = F.lit(SECTOR)
    capacity = F.when(F.col("block_len") >= block_bytes, F.lit(block_bytes)).otherwise(
        int_div(F.col("block_len") + SECTOR - 1, sector) * sector
    ).cast("int")
    out = enc.withColumn("capacity", capacity).withColumn("n_tokens", int_div(F.octet_length("_ids"), 4).cast("int"))
    out = out.withColumn("kept", F.least(F.col("n_tokens"), int_div(F.col("capacity"), F.lit(4))).cast("int"))
    beyond = F.col("n_tokens") - F.col("kept")
    out = out.withColumn("dropped", beyond if overflow == "drop" else F.lit(0))
    if overflow == "error":
        out = out.where(F.when(beyond > 0, F.raise_error(F.lit("a block has more ids than it can hold"))).otherwise(True))
    elif overflow == "keep":
        out = out.withColumn("overflow", F.substr("_ids", F.col("kept") * 4 + 1, beyond * 4))
    packed = F.substr("_ids", F.lit(1), F.col("kept") * 4)
    out = out.withColumn("output", F.rpad(packed, F.col("capacity"), F.lit(bytearray(b"\0"))))
    return out.drop("_text", "_ids", "content")

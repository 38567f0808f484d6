"""Byte ranges and extents: overlap join, coverage, alignment, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.scalars import ceil_div, int_div
from tokenloom.operators.ordered import last_seen, running_total, with_path

SECTOR = 512
MAX_SEGMENT_BLOCKS = 256

# Bucket sizes of the overlap join: 2^9, 2^13, ... 2^61 bytes.
_LEVELS = tuple(range(9, 62, 4))


def _level(length: Column) -> Column:
    """Smallest bucket size (as a power of two) that is at least the length."""
    chain = F
    for bits in _LEVELS:
        chain = chain.when(length <= F.lit(1 << bits), F.lit(bits))
    return chain.otherwise(F.lit(_LEVELS[-1]))


def _bucketed(df: DataFrame, start: str, end: str, own: str, other_levels: DataFrame) -> DataFrame:
    """Place each interval in the buckets it touches: at its own level and at
    every coarser level the other side uses. An interval touches at most two
    buckets of a size not below its length, so rows at most double per level."""
    df = df.withColumn(own, _level(F.col(end) - F.col(start)))
    df = df.withColumn("_others", other_levels.scalar())
    levels = F.filter(
        F.array(*[F.lit(b) for b in _LEVELS]),
        lambda m: (m == F.col(own))
        | ((m > F.col(own)) & F.array_contains(F.col("_others"), m)),
    )
    spots = F.flatten(
        F.transform(
            levels,
            lambda m: F.transform(
                F.sequence(_bucket(F.col(start), m), _bucket(F.col(end) - 1, m)),
                lambda k: F.struct(m.alias("_m"), k.alias("_k")),
            ),
        )
    )
    return df.withColumn("_spot", F.explode(spots)).select("*", "_spot.*").drop("_spot", "_others")


def _bucket(pos: Column, bits: Column) -> Column:
    return F.call_function("shiftright", pos, bits)


def _present_levels(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the (at most 14) levels in use, from a partial aggregate."""
    return df.agg(F.collect_set(_level(F.col(end) - F.col(start))).alias("levels"))


def overlap_join(ranges: DataFrame, extents: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of overlapping ``ranges(start, length, ...)`` and ``extents(logical,
    physical, length, ...)``, with the overlap and its device blocks.

    Both sides are bucketed by their own size, so a huge interval is not cut
    into many small buckets and a small one does not meet far neighbours. Each
    pair is kept only in the bucket of its overlap's start.
    """
    on = list(on)
    r = ranges.withColumnRenamed("length", "range_length").where("range_length > 0")
    r = r.withColumn("_rs", F.col("start").cast("long")).withColumn("_re", F.col("start") + F.col("range_length"))
    e = extents.withColumnRenamed("length", "extent_length").where("extent_length > 0")
    e = e.withColumn("_es", F.col("logical").cast("long")).withColumn("_ee", F.col("logical") + F.col("extent_length"))
    rb = _bucketed(r, "_rs", "_re", "_ra", _present_levels(e, "_es", "_ee"))
    eb = _bucketed(e, "_es", "_ee", "_ea", _present_levels(r, "_rs", "_re"))
    lo, hi = F.greatest("_rs", "_es"), F.least("_re", "_ee")
    pairs = rb.join(eb, [*on, "_m", "_k"]).where(
        (F.col("_es") < F.col("_re"))
        & (F.col("_ee") > F.col("_rs"))
        & ((F.col("_ra") == F.col("_m")) | (F.col("_ea") == F.col("_m")))
        & (_bucket(lo, F.col("_m")) == F.col("_k"))
    )
    pairs = pairs.withColumn("overlap_start", lo).withColumn("overlap_length", hi - lo)
    phys = F.col("physical") + F.col("overlap_start") - F.col("logical")
    pairs = pairs.withColumn("slba", int_div(phys, F.lit(SECTOR).cast("long")))
    return pairs.withColumn(
        "nblocks", ceil_div(phys + F.col("overlap_length"), F.lit(SECTOR).cast("long")) - F.col("slba")
    ).drop("_rs", "_re", "_es", "_ee", "_ra", "_ea", "_m", "_k")


def range_coverage(ranges: DataFrame, pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per range: overlapped bytes, and whether the extents cover it fully."""
    per = pairs.groupBy(*key).agg(F.sum("overlap_length").alias("covered_bytes"))
    return (
        ranges.join(per, list(key), "left")
        .withColumn("covered_bytes", F.coalesce("covered_bytes", F.lit(0)).cast("long"))
        .withColumn("covered", F.col("covered_bytes") >= F.col("length"))
    )


def segment_align(
    inputs: DataFrame, outputs: DataFrame, on: Sequence[str] = (), order: str = "seq"
) -> DataFrame:
    """Align two ordered lists of segments ``(*on, seq, slba, nblocks)`` block by block.

    A sweep: both lists get their cumulative positions, all start positions are
    merged into one ordered list, and each start carries the segment of either
    list that is open there. Rows grow with both lists' sum, no pair is tried.
    Raises through ``raise_error`` when the output list is too short.
    """
    on = list(on)

    def placed(df: DataFrame, name: str) -> DataFrame:
        df = df.where("nblocks > 0").withColumn("nblocks", F.col("nblocks").cast("long"))
        df, path = with_path(df, order, 1 << 12, levels=2)
        df = running_total(df, on, path, [order], {"pos": F.col("nblocks")})
        seg = F.struct(
            F.col("pos").alias("begin"), (F.col("pos") + F.col("nblocks")).alias("end"),
            F.col("slba").cast("long").alias("slba"),
        )
        return df.select(*on, "pos", seg.alias(name))

    a, b = placed(inputs, "i"), placed(outputs, "o")
    starts = a.unionByName(b, allowMissingColumns=True).groupBy(*on, "pos").agg(
        F.max("i").alias("i"), F.max("o").alias("o")
    )
    starts, path = with_path(starts, "pos", 1 << 12, levels=2)
    open_here = last_seen(starts, on, path, ["pos"], {"ic": F.col("i"), "oc": F.col("o")})
    in_len = F.col("ic.end") - F.col("pos")
    out_len = F.col("oc.end") - F.col("pos")
    ok = F.coalesce(out_len, F.lit(0)) > 0
    return (
        open_here.where(in_len > 0)
        .withColumn("_ok", F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("output segments are shorter than input segments")).cast("boolean")))
        .where("_ok")
        .select(
            *on,
            "pos",
            (F.col("ic.slba") + F.col("pos") - F.col("ic.begin")).alias("in_slba"),
            (F.col("oc.slba") + F.col("pos") - F.col("oc.begin")).alias("out_slba"),
            F.least(in_len, out_len).alias("nblocks"),
        )
    )


def split_segments(
    extents: DataFrame, max_blocks: int = MAX_SEGMENT_BLOCKS, keep: Sequence[str] = ()
) -> DataFrame:
    """Split extents into pieces of at most ``max_blocks``; lengths round up to blocks."""
    total = ceil_div(F.col("length").cast("long"), F.lit(SECTOR).cast("long"))
    m = F.lit(max_blocks).cast("long")
    base = int_div(F.col("physical").cast("long"), F.lit(SECTOR).cast("long"))
    return (
        extents.where("length > 0")
        .withColumn("_total", total)
        .withColumn("_base", base)
        .withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_total") - 1, m)))
        .select(
            *keep,
            (F.col("_base") + F.col("_at")).alias("slba"),
            F.least(F.col("_total") - F.col("_at"), m).alias("nblocks"),
        )
    )


def range_index_rows(index: DataFrame, pairs: DataFrame, arrow_path: Column, column: str = "text") -> DataFrame:
    """One nested record per buffer of the range index.

    The extent list of a buffer is bounded by the buffer's own size.
    """
    ext = pairs.groupBy("shard", "batch_index").agg(
        F.array_sort(F.collect_list(F.struct("overlap_start", "slba", "nblocks"))).alias("_x")
    )
    lba = F.transform(F.coalesce("_x", F.array().cast("array<struct<overlap_start:bigint,slba:bigint,nblocks:bigint>>")),
                      lambda x: F.struct(x["slba"].alias("slba"), x["nblocks"].alias("nblocks")))
    return index.join(ext, ["shard", "batch_index"], "left").select(
        arrow_path.alias("arrow_path"),
        F.lit(column).alias("column"),
        "shard",
        F.struct(
            "batch_index",
            "num_rows",
            F.struct(F.col("data_offset").alias("offset"), F.col("data_length").alias("length")).alias("data_range"),
            lba.alias("lba_extents"),
        ).alias("buffer"),
    )

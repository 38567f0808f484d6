"""Running totals and carried values over an ordered table, without one big window.

A window over a whole corpus (or over one hot shard, run or file) would put all
its rows into one task. Here the order is given as a *path* of columns from
coarse to fine, e.g. ``[batch_group, batch_index]``: sorting by the path and
then by ``order`` is the wanted order, and the rows below one full path are
bounded. Rows are summed inside their path, the small per-path summaries are
folded level by level, and the result is joined back on the path. The path is
plain data, so retries and adaptive re-planning give the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.scalars import int_div
from tokenloom.session import materialize

FAN = 4096  # summaries folded by one window partition


def with_path(df: DataFrame, pos: str, width: int, levels: int = 1) -> tuple[DataFrame, list[str]]:
    """Path of a non-negative integer position: blocks of ``width`` positions, and
    with a second level groups of ``FAN`` blocks (where blocks may be many)."""
    df = df.withColumn("_p2", int_div(F.col(pos).cast("long"), F.lit(width).cast("long")))
    if levels == 1:
        return df, ["_p2"]
    return df.withColumn("_p1", int_div(F.col("_p2"), F.lit(FAN).cast("long"))), ["_p1", "_p2"]


def corpus_path(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Path of corpus order inside a shard: group of batches, batch. A record
    batch is what a reader holds at once, so its rows are bounded."""
    group = int_div(F.col("batch_index").cast("long"), F.lit(FAN).cast("long"))
    return df.withColumn("_p1", group), ["_p1", "batch_index"]


def with_row_blocks(df: DataFrame, order: Sequence[str], out: str = "_block") -> DataFrame:
    """The rows written in the order of ``order`` with the number of the block each lies in.

    Block borders are quantiles of the rows, from Spark's own sample of the range partitioning, so
    blocks hold about as many rows each however the values are spread, and one hour or key
    with a third of all rows is many blocks. ``order`` must tell all rows apart. The numbers
    rise with the order and are data of a written table, so they are a path for the scans below.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in order])
    return materialize(dealt.withColumn(out, F.spark_partition_id()), "blocks")


_before = (W.unboundedPreceding, -1)
_upto = (W.unboundedPreceding, W.currentRow)


def running_total(
    df: DataFrame,
    reset: Sequence[str],
    path: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    inclusive: bool = False,
) -> DataFrame:
    """Add ``{out: sum of value over all earlier rows}`` within ``reset``."""
    reset, path, order = list(reset), list(path), list(order)
    outs = list(values)
    df = df.withColumns({f"_v_{o}": F.coalesce(v.cast("long"), F.lit(0)) for o, v in values.items()})
    offsets = _offsets(
        lambda keys: df.groupBy(*keys).agg(*[F.sum(f"_v_{o}").alias(f"_t_{o}") for o in outs]),
        reset, path, outs,
    )
    w = W.partitionBy(*reset, *path).orderBy(*order).rowsBetween(*(_upto if inclusive else _before))
    local = df.withColumns({o: F.coalesce(F.sum(f"_v_{o}").over(w), F.lit(0)) for o in outs})
    joined = local.join(offsets, [*reset, *path], "left")
    return joined.withColumns(
        {o: F.col(o) + F.coalesce(F.col(f"_o_{o}"), F.lit(0)) for o in outs}
    ).drop(*[f"_v_{o}" for o in outs], *[f"_o_{o}" for o in outs])


def _offsets(totals_by, reset, path, outs) -> DataFrame:
    """(reset, path) -> total of everything before that path."""
    finest = totals_by([*reset, *path])
    if len(path) > 1:
        # every level is folded from these few rows, so the source is read once for them
        finest = materialize(finest, "totals")
    levels = [finest]
    for depth in range(len(path) - 1, 0, -1):
        levels.insert(
            0,
            levels[0].groupBy(*reset, *path[:depth]).agg(*[F.sum(f"_t_{o}").alias(f"_t_{o}") for o in outs]),
        )
    carried = None
    for depth, table in enumerate(levels):
        keys = [*reset, *path[:depth]]
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(path[depth]).rowsBetween(*_before)
        here = table.withColumns(
            {f"_o_{o}": F.coalesce(F.sum(f"_t_{o}").over(w), F.lit(0)) for o in outs}
        )
        if carried is not None:
            up = carried.select(*keys, *[F.col(f"_o_{o}").alias(f"_u_{o}") for o in outs])
            here = here.join(up, keys, "left").withColumns(
                {f"_o_{o}": F.col(f"_o_{o}") + F.col(f"_u_{o}") for o in outs}
            )
        carried = here.select(*keys, path[depth], *[f"_o_{o}" for o in outs])
    return carried


def last_seen(
    df: DataFrame,
    reset: Sequence[str],
    path: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add ``{out: last non-null value over earlier rows}`` within ``reset``.

    With ``inclusive=False`` and a struct that is never null this is ``lag``.
    """
    reset, path, order = list(reset), list(path), list(order)
    outs = list(values)
    df = df.withColumns({f"_v_{o}": v for o, v in values.items()})

    def newest(o: str) -> Column:
        value = F.col(f"_v_{o}")
        key = F.struct(*[F.col(c) for c in order], value.alias("_value"))
        # max over (order, value) is a partial aggregate; order is unique
        return F.max(F.when(value.isNotNull(), key))["_value"].alias(f"_t_{o}")

    finest = df.groupBy(*reset, *path).agg(*[newest(o) for o in outs])
    if len(path) > 1:
        finest = materialize(finest, "newest")
    levels = [finest]
    for depth in range(len(path) - 1, 0, -1):
        step = path[depth]
        levels.insert(0, levels[0].groupBy(*reset, *path[:depth]).agg(*[
            F.max(F.when(F.col(f"_t_{o}").isNotNull(),
                         F.struct(F.col(step), F.col(f"_t_{o}").alias("_value"))))["_value"].alias(f"_t_{o}")
            for o in outs
        ]))
    carried = None
    for depth, table in enumerate(levels):
        keys = [*reset, *path[:depth]]
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(path[depth]).rowsBetween(*_before)
        here = table.withColumns({f"_o_{o}": F.last(f"_t_{o}", ignorenulls=True).over(w) for o in outs})
        if carried is not None:
            up = carried.select(*keys, *[F.col(f"_o_{o}").alias(f"_u_{o}") for o in outs])
            here = here.join(up, keys, "left").withColumns(
                {f"_o_{o}": F.coalesce(f"_o_{o}", f"_u_{o}") for o in outs}
            )
        carried = here.select(*keys, path[depth], *[f"_o_{o}" for o in outs])
    w = W.partitionBy(*reset, *path).orderBy(*order).rowsBetween(*(_upto if inclusive else _before))
    local = df.withColumns({o: F.last(f"_v_{o}", ignorenulls=True).over(w) for o in outs})
    joined = local.join(carried, [*reset, *path], "left")
    return joined.withColumns({o: F.coalesce(o, f"_o_{o}") for o in outs}).drop(
        *[f"_v_{o}" for o in outs], *[f"_o_{o}" for o in outs]
    )


def previous_row(
    df: DataFrame,
    reset: Sequence[str],
    path: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    out: str = "prev",
) -> DataFrame:
    """Add struct ``out`` with the columns of the row just before (null at the first)."""
    return last_seen(df, reset, path, order,
                     {out: F.struct(*[F.col(c) for c in columns])}, inclusive=False)

"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The one letter fold of the contracts: ASCII only, as bytes.lower() does it.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names (``new=old``)."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def place_names(df: DataFrame) -> DataFrame:
    """The same columns named ``c0, c1, ...`` by place: no name of the caller's can clash with an
    operator's own or trouble Spark (dots). ``toDF`` with the old names turns it back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def remainder(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def is_held_out(doc_id: Column, n: int) -> Column:
    """True where the remainder is 1; a null id is not held out."""
    return F.coalesce(remainder(doc_id, n) == 1, F.lit(False))


def lowest(rows: DataFrame, order: Column, wanted: int, total: int) -> DataFrame:
    """The ``wanted`` rows with the smallest hash ``order`` out of about ``total``.

    A threshold on the hash leaves some three times as many before they are ordered, so no task
    sends its own ``wanted`` rows to the driver.
    """
    share = min(1.0, (3 * wanted + 100) / max(total, 1))
    near = rows.withColumn("_order", order).filter(F.pmod("_order", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return near.orderBy(F.pmod("_order", F.lit(1 << 30)), "_order", *rows.columns).limit(wanted).drop("_order")


def map_rows(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType,
    bytes_per_call: int = 4 << 20,
) -> DataFrame:
    """``mapInArrow`` in slices of about ``bytes_per_call``, so that memory follows the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, bytes_per_call):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``size`` bytes; a longer row stands alone."""
    if not batch.num_rows:
        return
    weight = np.zeros(batch.num_rows, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
            weight += np.diff(ends)
    part = (np.cumsum(weight) - weight) // size
    starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]

"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily, longest document first. Then its smallest document gives way to two
unpacked documents whose sum is larger and still fits, if there are such: the gap closes
further. How good a bin is depends on lengths only, and there are at most ``capacity``
different ones, so the whole plan is made on the histogram of lengths: one filled bin is
repeated as often as the counts allow, which uses up a length, so there are at most
``capacity`` patterns at any size of the input. The rows are then dealt to the planned places
by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import map_rows, plain_columns
from tokenloom.llm.encode import encode_added
from tokenloom.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# rows of a file that one ranking window holds
RANK_BLOCK = 1 << 16


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of every document: its ids (null text: none) followed by ``end_id``."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ids = np.append(encode_added(text or "", vocabulary), np.uint32(end_id)).astype("<u4")
            starts = cut_points(len(ids), capacity)
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    return map_rows(plain_columns(docs, doc_id="doc_id", text="text"), cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths of a bin, number of such bins)`` for a histogram of lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    plan = []
    while left.any():
        bin_, gap = [], capacity
        while gap:
            fit = np.flatnonzero(left[: gap + 1])
            if not len(fit):
                break
            bin_.append(int(fit[-1]))
            left[fit[-1]] -= 1
            gap -= int(fit[-1])
        if gap and len(bin_) > 1:
            # the smallest one out, the two that fill its place best in
            room = gap + bin_[-1]
            longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
            first = np.flatnonzero(left[: room + 1])
            second = longest[room - first]
            twice = (second == first) & (left[first] < 2)
            second[twice] = longest[first[twice] - 1]
            sums = np.where(second > 0, first + second, 0)
            if len(sums) and sums.max() > bin_[-1]:
                best = int(sums.argmax())
                left[bin_[-1]] += 1
                pair = sorted((int(first[best]), int(second[best])), reverse=True)
                bin_[-1:] = pair
                for v in pair:
                    left[v] -= 1
        used, uses = np.unique(bin_, return_counts=True)
        more = int((left[used] // uses).min())
        left[used] -= more * uses
        plan.append((sorted(bin_, reverse=True), 1 + more))
    return plan


def place_table(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per length, which ranks go where: ``(length, first rank, last rank + 1, uses, first bin, offset)``.

    A length used ``uses`` times in a bin takes that many consecutive ranks of each bin.
    """
    rank: dict[int, int] = {}
    rows, first_bin = [], 0
    for lengths, n in plan:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            uses, at = lengths.count(length), rank.get(length, 0)
            rows.append((length, at, at + uses * n, uses, first_bin, offset))
            rank[length] = at + uses * n
            offset += uses * length
        first_bin += n
    return rows


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` must be a written table (see :func:`best_two_fit`): a row's place in its file
    is its identity. Only the histogram, at most ``capacity`` rows, comes to the driver, and
    only the place table, at most a few rows per pattern, goes out.
    """
    at = F.col("_metadata")
    rows = pieces.select(
        "*", F.xxhash64(at["file_path"]).alias("_file"),
        (F.col("_metadata.row_index") / RANK_BLOCK).cast("long").alias("_block"),
        F.col("_metadata.row_index").alias("_row"),
    )
    counts = rows.groupBy("length", "_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("length").orderBy("_file", "_block")
    before = counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = place_table(plan_bins(histogram, capacity))
    inner = Window.partitionBy("_file", "_block", "length").orderBy("_row")
    ranked = rows.withColumn("_within", F.row_number().over(inner) - 1).join(
        before, ["length", "_file", "_block"]
    )
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within"))

    by_length: dict[int, np.ndarray] = {}
    for row in places:
        by_length.setdefault(row[0], []).append(row[1:])
    by_length = {k: np.array(v, dtype=np.int64) for k, v in by_length.items()}

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
        rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for value in np.unique(length):
            here = length == value
            table, r = by_length[int(value)], rank[here]
            k = np.searchsorted(table[:, 0], r, side="right") - 1
            inside = r - table[k, 0]
            sequence[here] = table[k, 3] + inside // table[k, 2]
            offset[here] = table[k, 4] + inside % table[k, 2] * value
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if not n.startswith("_")]
        return pa.RecordBatch.from_arrays(
            [*[c for _, c in kept], pa.array(sequence), pa.array(offset)],
            names=[*[n for n, _ in kept], "sequence_id", "offset"],
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return map_rows(ranked.select(*pieces.columns, "_rank"), deal,
                    f"{schema}, sequence_id long, offset long", 1 << 30)


def best_two_fit(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Pack whole documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the one id ``end_id``. A text longer than a sequence is cut into
    full pieces, the first one shorter. Repeated rows and ids are packed like any other rows,
    a null ``doc_id`` is kept as null. An empty table gives no rows. The ids of a piece are
    those of its text again, from ``start`` on (:func:`sequence_ids` puts them together).
    """
    return pack(materialize(token_pieces(docs, capacity, end_id, vocabulary), "pieces"), capacity)


def sequence_ids(docs: DataFrame, packed: DataFrame, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """The sequences themselves, for documents with unique ids: ``sequence_id, ids array<int>``.

    A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    texts = plain_columns(docs, doc_id="doc_id", text="text")

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        out = []
        for text, a, n in zip(cols["text"], cols["start"], cols["length"], strict=True):
            out.append(np.append(encode_added(text or "", vocabulary), np.uint32(end_id))[a : a + n].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols["sequence_id"], pa.int64()), pa.array(cols["offset"], pa.int64()),
             pa.array(out, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"],
        )

    joined = packed.select("doc_id", "start", "length", "sequence_id", "offset").join(texts, "doc_id")
    parts = map_rows(joined, fill, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids")
    )

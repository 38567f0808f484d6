"""Exact repeats of a fixed length across all documents, by column-wise construction.

A string of ``length`` bytes is repeated if it starts at two places. Each such window is owned by
the smallest k-gram hash inside it, its anchor; equal windows own equal anchors at the same
offset, so only occurrences of one anchor need to be compared, aligned at the anchor.

Most occurrences are settled by counting: an anchor seen once repeats nothing, and a context (all
windows that an occurrence owns) seen twice repeats wholly. What is left are anchors with
different contexts, the borders of repeats. For these the multi-document construction runs:
columns are taken from the right, each round inserts one symbol per context in front of its
suffix, the order of all suffixes is updated by a stable sort on (symbol, old order) -- the
column of symbols in the old order is that round's part of the Burrows-Wheeler transform -- and
the common prefixes of neighbours follow as one plus the minimum between their old places.
A suffix whose neighbour shares ``length`` bytes starts a repeat. Documents of any length take
``length`` plus the widest ownership rounds, not one round per byte of the longest text. The
method's sequential external files are left out: a batch of ``ROUND_SIZE`` contexts is bounded,
so its two sequences (order and common prefixes) stay in memory from round to round, while
Spark's shuffles and written tables hold what grows with the corpus.

A text is a row of symbols: its bytes, or 64-bit hashes of its words. The second finds passages
of so many words, however many bytes they have and whatever white space lies between them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_rows, place_names, texts_of
from tokenloom.llm.words import split_words
from tokenloom.session import materialize

# symbols hashed to choose an anchor
GRAM, WORD_GRAM = 32, 8
# contexts of one anchor that a task orders; more go by window hashes
MAX_CONTEXTS = 20_000
# contexts that are ordered in one go
ROUND_SIZE = 8_192

_BASE = 0x9E3779B97F4A7C15 | 5  # odd: has an inverse modulo 2 ** 64
ANCHORS = "k long, n int, p int, d0 int, d1 int, h long, ctx long"


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        a = np.full(size, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20_260_101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Hashes of any range of a buffer of bytes or words from one running sum.

    ``room`` is the length of a longer buffer hashed beside it, whose powers serve both.
    """

    def __init__(self, raw: np.ndarray, room: int = 0):
        size = 1 << max(16, int(max(len(raw), room) + 1).bit_length())
        up, self.down = _powers(size)
        with np.errstate(over="ignore"):
            terms = (_byte_values()[raw] if raw.dtype == np.uint8 else raw) * up[: len(raw)]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[b] - self.sums[a]) * self.down[a]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))


def symbols_of(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and how many each has: bytes, or words as 64-bit hashes."""
    if not words:
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
    found = split_words(texts, fold=False)
    return Rolling(found.buffer).of(found.starts, found.ends), found.counts


def anchors_of(texts: list[bytes], length: int, words: bool = False) -> tuple[np.ndarray, ...]:
    """``(text, anchor, first and last owned window, anchor hash, context hash)``, all in one buffer's
    places except the text's index, and the start of every text."""
    raw, sizes = symbols_of(texts, words)
    gram = WORD_GRAM if words else GRAM
    starts = np.cumsum(sizes) - sizes
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), starts
    hashes = Rolling(raw, sum(map(len, texts)) + len(texts))
    at = np.arange(len(raw) - gram + 1)
    grams = hashes.of(at, at + gram)
    # order by hash, ties to the left; the low bits hold the place
    bits = np.uint64(max(24, int(len(raw)).bit_length()))
    low = ((grams >> bits) << bits) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    owner = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    window = np.flatnonzero(doc[: len(owner)] == doc[length - 1 : length - 1 + len(owner)])
    owner = owner[window]
    cut = np.flatnonzero(np.diff(owner, prepend=-1) | (np.diff(window, prepend=-2) != 1))
    first, last = window[cut], window[np.append(cut[1:], len(window)) - 1]
    p = owner[cut]
    return doc[p], p, first, last, grams[p], hashes.of(first, last + length), starts


def _anchor_rows(docs: DataFrame, length: int, words: bool = False) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, p, first, last, h, ctx, starts = anchors_of(texts_of(batch.column(2)), length, words)
        pick = pa.array(doc)
        small = lambda x: pa.array(x.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pick), batch.column(1).take(pick), small(p - starts[doc]), small(first - p),
             small(last - p), pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64))],
            names=["k", "n", "p", "d0", "d1", "h", "ctx"],
        )

    return map_rows(docs.filter(F.col("n") >= length), run, ANCHORS, 1 << 20)


def repeated_starts(
    group: np.ndarray, d0: np.ndarray, d1: np.ndarray, contents: list[bytes], length: int, words: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """``(context, offset)`` of every owned window that another context of its group has too.

    ``group`` is sorted. Context ``i`` holds the symbols at offsets ``d0[i]`` to ``d1[i] + length``.
    """
    m = len(contents)
    low, high = int(d0.min()), int(d1.max()) + length
    if words:  # any order of the words will do
        values, rows = np.unique(np.frombuffer(b"".join(contents), dtype=np.uint64), return_inverse=True)
        pad, kind = len(values), np.int32
    else:
        rows, pad, kind = np.frombuffer(b"".join(contents), dtype=np.uint8), 256, np.uint16
    symbols = np.full((high - low, m), pad, dtype=kind)
    ends = np.cumsum(d1 - d0 + length)
    for i, (a, b) in enumerate(zip(ends - (d1 - d0 + length), ends, strict=True)):
        symbols[d0[i] - low : d1[i] + length - low, i] = rows[a:b]
    order, common = np.arange(m), np.zeros(m, dtype=np.int32)
    block = np.cumsum(np.diff(group, prepend=group[0]) != 0)
    found_at, found_off = [], []
    for c in range(high - low - 1, -1, -1):
        column = symbols[c][order]  # this round's transform
        key = block[order] * (pad + 1) + column
        by = np.argsort(key, kind="stable")
        key = key[by]
        joins = np.flatnonzero((key[1:] == key[:-1]) & (column[by][1:] != pad))
        fresh = np.zeros(m, dtype=np.int32)
        if len(joins):
            # the smallest common prefix between the two old places, the first one excluded
            borders = np.column_stack([by[joins] + 1, by[joins + 1] + 1]).ravel()
            padded = np.append(common, 0)
            fresh[joins + 1] = np.minimum.reduceat(padded, borders)[::2] + 1
        order, common = order[by], fresh
        off = c + low
        if off <= 0:
            long = common >= length
            if long.any():
                hit = order[long | np.append(long[1:], False)]
                hit = hit[(d0[hit] <= off) & (off <= d1[hit])]
                found_at.append(hit)
                found_off.append(np.full(len(hit), off))
    if not found_at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_at), np.concatenate(found_off)


def _runs(at: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges ``(context, from, to)`` of window starts; none of none."""
    if not len(at):
        return at, off, off
    by = np.lexsort((off, at))
    at, off = at[by], off[by]
    new = (np.diff(at, prepend=-1) != 0) | (np.diff(off, prepend=-1 << 40) > length)
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(at)) - 1
    return at[cut], off[cut], off[last] + length


def _order_contexts(contexts: DataFrame, length: int, words: bool) -> DataFrame:
    """Ranges ``h, ctx, a, b`` from rows ``h, ctx, d0, d1, content`` of anchors of bounded size."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, ctx = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        d0, d1 = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        at, a, b = _runs(*repeated_starts(h, d0, d1, batch.column(4).to_pylist(), length, words), length)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[at]), pa.array(ctx[at]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
            names=["h", "ctx", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < ROUND_SIZE:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            h = table.column(0).to_numpy()
            done = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if done:
                yield solve(table.slice(0, done).combine_chunks().to_batches()[0])
            kept = table.slice(done).to_batches()
        if any(b.num_rows for b in kept):
            yield solve(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return contexts.select("h", "ctx", "d0", "d1", "content").repartition("h").sortWithinPartitions("h").mapInArrow(
        run, "h long, ctx long, a int, b int"
    )


def _count_windows(contexts: DataFrame, length: int, words: bool) -> DataFrame:
    """The same ranges for anchors with very many contexts: their windows' hashes are counted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, offs, hashes = [], [], []
        for i, content in enumerate(batch.column(4).to_pylist()):
            symbols = np.frombuffer(content, dtype=np.uint64 if words else np.uint8)
            at = np.arange(len(symbols) - length + 1)
            hashes.append(Rolling(symbols).of(at, at + length))
            offs.append(at + batch.column(2)[i].as_py())
            rows.append(np.full(len(at), i))
        pick = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.concatenate(offs).astype(np.int32)),
             pa.array(np.concatenate(hashes).view(np.int64))], names=["h", "ctx", "d", "w"],
        )

    windows = map_rows(contexts.select("h", "ctx", "d0", "d1", "content"), run, "h long, ctx long, d int, w long", 1 << 20)
    again = windows.groupBy("h", "d", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return windows.join(again, ["h", "d", "w"]).select("h", "ctx", F.col("d").alias("a"), (F.col("d") + length).alias("b"))


def text_keys(text: Column) -> tuple[Column, Column]:
    """What names a text: a 64-bit hash and its size in bytes."""
    return F.xxhash64(text), F.octet_length(text)


def repeated_spans(
    texts: DataFrame, length: int = 400, max_contexts: int = MAX_CONTEXTS, *, words: bool = False
) -> DataFrame:
    """``k, n, spans`` for each distinct text with repeats, from rows ``k, n, text``.

    ``spans`` are the byte ranges that repeated windows cover, by start; they may overlap. Rows with equal
    text are occurrences of their own, so all of a text of ``length`` bytes that occurs twice
    is covered. With ``words``, ``length`` and ``spans`` count words instead of bytes.
    """
    anchors = materialize(_anchor_rows(texts, length, words), "anchors")
    groups = anchors.groupBy("h").agg(
        F.count(F.lit(1)).alias("c"), (F.min("ctx") != F.max("ctx")).alias("mixed")
    ).filter("c > 1").drop("c")
    groups = materialize(groups, "groups")
    met = materialize(anchors.join(groups, "h"), "met")
    mixed = met.filter("mixed").groupBy("h", "ctx", "d0", "d1").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "n", "p")).alias("at")
    )
    mixed = materialize(mixed, "contexts")
    per_anchor = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("least")).filter("least = 1")
    per_anchor = materialize(per_anchor.drop("least"), "open")
    wanted = mixed.join(per_anchor, "h").select(
        F.col("at.k").alias("k"), F.col("at.n").alias("n"), F.struct("h", "ctx", "d0", "d1", "m", F.col("at.p").alias("p")).alias("c")
    )
    wanted = materialize(wanted.groupBy("k", "n").agg(F.collect_list("c").alias("cs")), "wanted")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        symbols, sizes = symbols_of(texts_of(batch.column(0)), words)
        for start, cs in zip((np.cumsum(sizes) - sizes).tolist(), batch.column(1).to_pylist(), strict=True):
            for c in cs:
                a = start + c["p"]
                content = symbols[a + c["d0"] : a + c["d1"] + length].tobytes()
                rows.append((c["h"], c["ctx"], c["d0"], c["d1"], c["m"], content))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["h", "ctx", "d0", "d1", "m", "content"],
        ) if rows else None

    contents = map_rows(
        texts.join(wanted, ["k", "n"]).select("text", "cs"), cut,
        "h long, ctx long, d0 int, d1 int, m long, content binary", 1 << 20,
    )
    contents = materialize(contents.dropDuplicates(["h", "ctx"]), "contents")
    ranges = _order_contexts(contents.filter(F.col("m") <= max_contexts), length, words).union(
        _count_windows(contents.filter(F.col("m") > max_contexts), length, words)
    )
    ranges = materialize(ranges, "ranges")
    # a context seen twice is covered as a whole, as is every one of an anchor without another
    whole = met.join(
        mixed.filter("times = 1").select("h", "ctx"), ["h", "ctx"], "left_anti"
    ).select("k", "n", (F.col("p") + F.col("d0")).alias("s"), (F.col("p") + F.col("d1") + length).alias("e"))
    partly = met.filter("mixed").join(ranges, ["h", "ctx"]).select(
        "k", "n", (F.col("p") + F.col("a")).alias("s"), (F.col("p") + F.col("b")).alias("e")
    )
    pieces = whole.union(partly).distinct().groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    return materialize(pieces, "spans")


def _spans_of(pieces: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges, sorted by start, joined where they touch or overlap."""
    out: list[list[int]] = []
    for x in pieces or ():
        if out and x["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["e"])
        else:
            out.append([x["s"], x["e"]])
    return [(a, b) for a, b in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, text: str, length: int, passage: int | None = None) -> DataFrame:
    """Rows of ``docs``, whose columns are named by place, with ``spans`` of the column ``text``, and
    with ``passages``, the same in words, if ``passage`` names a number of words."""
    k, n = text_keys(F.coalesce(text, F.lit("")))
    texts = docs.select(k.alias("k"), n.alias("n"), F.col(text).alias("text"))
    spans = repeated_spans(texts, length)
    if passage:
        found = repeated_spans(texts, passage, words=True).withColumnRenamed("spans", "passages")
        spans = spans.join(found, ["k", "n"], "full")
    rows = docs.select(*docs.columns, k.alias("_k"), n.alias("_n"))
    return rows.join(spans, (rows["_k"] == spans["k"]) & (rows["_n"] == spans["n"]), "left").drop("k", "n", "_k", "_n")


def repeat_report(docs: DataFrame, length: int = 400, passage: int = 51) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages`` for every row of ``docs``.

    A null text is empty; texts shorter than ``length`` bytes keep all. Repeated rows are
    repeats of each other. Ids may be null or repeat. The last two columns count the words
    ``[^\\x20\\x09-\\x0D]+`` covered by ``passage`` words in a row that also start anywhere else, and
    their maximal runs; nothing is removed for them.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, counts = [], [], []
        for text, *both in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans, passages = map(_spans_of, both)
            n.append(len(text))
            sha.append(hashlib.sha256(_kept(text, spans)).hexdigest())
            counts.append([x for runs in (spans, passages) for x in (sum(b - a for a, b in runs), len(runs))])
        removed, count, words, runs = (pa.array(x, pa.int64()) for x in zip(*counts, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), removed, count, pa.array(sha), words, runs],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"],
        )

    rows = _with_spans(place_names(docs.select("doc_id", "text")), "c1", length, passage)
    return map_rows(
        rows.select("c0", "c1", "spans", "passages"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, n_passage_words long, n_passages long", 2 << 20,
    )


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and ``n_chars``, if there, counted anew.

    A span that ends inside a character takes the whole character with it. A null text stays
    null; a text of repeats only becomes empty. All other columns pass unchanged.
    """

    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rest = [
            text if text is None or not pieces else _kept(text.encode(), _spans_of(pieces)).decode("utf-8", "ignore")
            for text, pieces in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
        ]
        cols = list(batch.columns[:-1])
        cols[at] = pa.array(rest, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    plain = place_names(docs)
    rows = _with_spans(plain, f"c{at}", length)
    cut = map_rows(rows.select(*plain.columns, "spans"), run, plain.schema, 2 << 20)
    if "n_chars" in docs.columns:
        cut = cut.withColumn(f"c{docs.columns.index('n_chars')}", F.length(f"c{at}").cast("long"))
    return cut.toDF(*docs.columns)

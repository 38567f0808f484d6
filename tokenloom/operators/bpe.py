"""Byte-level BPE encoding and decoding of text columns.

Two strategies give the same ids:

``fold``   Catalyst only. Every symbol is one private-use character and each
           merge is one ``replace`` over a piece, in rank order. The most frequent
           pieces are merged once and looked up, all others where they stand; a
           stream, which has no such list, is merged text by text. Exact for models
           that pass :meth:`BpeModel.fold_problem`.
``arrow``  The JVM pre-tokenizes; an Arrow UDF encodes each distinct piece of a
           batch once (task-wide cache) and gathers ids with NumPy. Any model.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.bytelevel import _LATIN1, byte_symbols, latin1, pretokenize
from tokenloom.functions.scalars import int_div
from tokenloom.session import materialize
from tokenloom.sources.model import BORDER, PRIVATE_BASE, BpeModel, added_names, json_literal

CACHE_WORDS = 1 << 18
CACHED_WORD_BYTES = 64
SHORT_PIECE = 48
# pieces that the fold merges beforehand; some 100 bytes each, held once by a task
FOLD_PIECES = 1 << 18
NO_RANK = 1 << 62
# pieces whose ids are gathered in one go
SLICE_PIECES = 1 << 18


# --------------------------------------------------------------------- fold
def _fold_symbols(words: Column, model: BpeModel) -> Column:
    """Pieces -> one string of private-use characters with borders between pieces."""
    private = "".join(chr(PRIVATE_BASE + model.vocab[s]) for s in byte_symbols())

    def one(w: Column) -> Column:
        mapped = F.translate(latin1(w), _LATIN1, private)
        if not model.added:
            return mapped
        chain = F
        for token, i in model.added.items():
            chain = chain.when(w == token, F.lit(chr(PRIVATE_BASE + i)))
        return chain.otherwise(mapped)

    # Whether added tokens count was decided when the text was cut into pieces.
    return F.array_join(F.transform(words, one), BORDER)


def _fold_merged(words: Column, model: BpeModel) -> Column:
    """The private-use characters that are left after all merges, without borders."""
    merges = [
        {
            "p": chr(PRIVATE_BASE + model.vocab[l]) + chr(PRIVATE_BASE + model.vocab[r]),
            "r": chr(PRIVATE_BASE + model.vocab[l + r]),
        }
        for l, r in model.merges
    ]
    start = _fold_symbols(words, model)
    merged = F.aggregate(
        json_literal(merges, "array<struct<p:string,r:string>>"),
        start,
        lambda s, m: F.replace(s, m["p"], m["r"]),
    )
    return F.replace(merged, F.lit(BORDER), F.lit(""))


def _fold_ids(merged: Column) -> Column:
    chars = F.filter(F.split(merged, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c) - F.lit(PRIVATE_BASE))


def _fold_piece(piece: Column, model: BpeModel) -> Column:
    """The ids of one piece; only merges whose product stands in the piece are tried."""
    back = {s: b for b, s in enumerate(byte_symbols())}

    def text(product: str) -> str:
        try:
            return bytes(back[s] for s in product).decode("utf-8")
        except UnicodeDecodeError:
            return ""  # a part of a character: in every piece

    merges = [
        {
            "t": text(l + r),
            "p": chr(PRIVATE_BASE + model.vocab[l]) + chr(PRIVATE_BASE + model.vocab[r]),
            "r": chr(PRIVATE_BASE + model.vocab[l + r]),
        }
        for l, r in model.merges
    ]
    merges = json_literal(merges, "array<struct<t:string,p:string,r:string>>")
    return _fold_ids(F.aggregate(
        F.filter(merges, lambda m: F.contains(piece, m["t"])),
        _fold_symbols(F.array(piece), model),
        lambda s, m: F.replace(s, m["p"], m["r"]),
    ))


def _fold_pieces(df: DataFrame, words: Column, model: BpeModel) -> tuple[DataFrame, int]:
    """The most frequent pieces with their ids, ``FOLD_PIECES`` at most, and their number.

    Which ones they are follows from a count of all pieces by halvings of an octave, so that
    neither a sort nor the driver sees the whole list.
    """
    pieces = df.select(F.explode(words).alias("_piece")).where(F.octet_length("_piece") <= CACHED_WORD_BYTES)
    level = F.floor(F.log2("_n") * 8)
    counted = materialize(pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")), "counts").withColumn("_level", level)
    least, kept = 1 << 10, 0
    for r in sorted(counted.groupBy("_level").count().collect(), reverse=True):
        if kept + r["count"] > FOLD_PIECES:
            break
        least, kept = r["_level"], kept + r["count"]
    known = counted.where(F.col("_level") >= least).select("_piece", _fold_piece(F.col("_piece"), model).alias("_ids"))
    return materialize(known, "pieces"), kept


def _fold_slots(pieces: DataFrame, n: int) -> DataFrame:
    """One row with a hash table: ``n`` slots, each a small map of pieces to ids."""
    entry = F.struct("_piece", "_ids")
    none = F.lit(None).cast(pieces.select(entry.alias("e")).schema["e"].dataType)
    filled = pieces.select(_fold_slot(F.col("_piece"), n).alias("_slot"), entry.alias("_entry")).union(
        pieces.sparkSession.range(n).select(F.col("id").cast("int"), none))
    slots = filled.groupBy("_slot").agg(F.collect_list("_entry").alias("_entries"))
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct("_slot", "_entries"))).alias("_slots"))
    return ordered.select(F.transform("_slots", lambda s: F.map_from_entries(s["_entries"])))


def _fold_slot(piece: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(n)).cast("int")


def _fold_looked_up(df: DataFrame, words: Column, model: BpeModel) -> tuple[DataFrame, Column]:
    """``df`` with a column ``_slots``, and the ids of every row without moving it: frequent pieces are looked up, the others merged in place.

    The merges of a frequent piece run once; places are never dealt out, joined or grouped. The
    table is a cache of bounded size, so that whatever it lacks only costs time.
    """
    pieces, kept = _fold_pieces(df, words, model)
    n = max(1, kept)

    def ids(slots: Column) -> Column:
        return F.flatten(F.transform(words, lambda w: F.coalesce(
            F.element_at(F.get(slots, _fold_slot(w, n)), w), _fold_piece(w, model))))

    # A subquery is refused beside a lambda, so it gets a column, and the optimizer puts it in the column's place: no
    # row may ever hold the table. It does so because the projection below is kept apart by a value that is not
    # deterministic. The index is always 0; for the same reason no filter on the ids goes below a shuffle.
    rows = df.withColumn("_part", F.spark_partition_id()).withColumn("_slots", _fold_slots(pieces, n).scalar())
    return rows, F.get(F.transform(F.array("_slots"), ids), F.least(F.spark_partition_id(), "_part", F.lit(0)))


# -------------------------------------------------------------------- arrow
def merge_piece(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge adjacent pairs, lowest rank first and leftmost first."""
    return (_merge_short if len(symbols) <= SHORT_PIECE else _merge_long)(symbols, ranks)


def _merge_short(symbols: list[str], ranks) -> list[str]:
    """Plain lists, for ordinary words."""
    parts, rank_of = list(symbols), ranks.get
    waiting = [rank_of(pair, NO_RANK) for pair in zip(parts, parts[1:])]
    while waiting and (best := min(waiting)) != NO_RANK:
        i = waiting.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del waiting[i]
        if i > 0:
            waiting[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
        if i < len(waiting):
            waiting[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
    return parts


def _merge_long(symbols: list[str], ranks) -> list[str]:
    """Linked list and heap: O(n log n) for pieces of any length."""
    n = len(symbols)
    parts: list[str | None] = list(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [
        (ranks[pair], i, pair)
        for i, pair in enumerate(zip(symbols, symbols[1:]))
        if pair in ranks
    ]
    heapq.heapify(queue)

    def offer(i: int) -> None:
        if i >= 0 and right[i] < n:
            pair = (parts[i], parts[right[i]])
            if pair in ranks:
                heapq.heappush(queue, (ranks[pair], i, pair))

    while queue:
        _, i, pair = heapq.heappop(queue)
        j = right[i]
        if parts[i] is None or j >= n or (parts[i], parts[j]) != pair:
            continue  # one side was merged meanwhile
        parts[i], parts[j] = pair[0] + pair[1], None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        offer(left[i])
    return [p for p in parts if p is not None]


class _PieceEncoder:
    """Per-task piece -> ids, with a bounded cache."""

    def __init__(self, vocab, merges, added, unknown):
        self.symbols = byte_symbols()
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(merges):
            self.ranks.setdefault(pair, rank)
        self.vocab, self.added, self.unknown = vocab, added, unknown
        self.cache: dict[str, list[int]] = {}

    def __call__(self, piece: str) -> list[int]:
        hit = self.cache.get(piece)
        if hit is None:
            hit = self._encode(piece)
            if len(piece) <= CACHED_WORD_BYTES:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[piece] = hit
        return hit

    def _encode(self, piece: str) -> list[int]:
        if piece in self.added:
            return [self.added[piece]]
        tokens = merge_piece([self.symbols[b] for b in piece.encode("utf-8")], self.ranks)
        ids = [self.vocab.get(t, self.unknown) for t in tokens]
        return [i for i in ids if i is not None]


def _encode_slices(words: pa.ListArray, encode: _PieceEncoder) -> Iterator[pa.ListArray]:
    """Ids of a batch in runs of rows of about ``SLICE_PIECES`` pieces; a longer row stands alone.

    A batch has rows of any length, and the arrays that gather its ids take some 50 bytes a piece.
    """
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_PIECES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(words)]):
        yield _encode_batch(words.slice(a, b - a), encode)


def _encode_batch(words: pa.ListArray, encode: _PieceEncoder) -> pa.ListArray:
    pieces = words.flatten().dictionary_encode()
    table = [encode(p) for p in pieces.dictionary.to_pylist()]
    lengths = np.array([len(t) for t in table], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.fromiter(chain.from_iterable(table), dtype=np.int32, count=int(lengths.sum()))
    use = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # gather the ids of all pieces without a loop over pieces
    n = lengths[use]
    ends = np.cumsum(n)
    ids = flat[np.repeat(starts[use] - (ends - n), n) + np.arange(n.sum())]
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece_end = np.concatenate([[0], np.cumsum(sizes)])
    id_end = np.concatenate([[0], ends])
    offsets = id_end[piece_end].astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(ids, pa.int32()),
        mask=words.is_null() if words.null_count else None,
    )


def encode_pieces_udf(spark: SparkSession, model: BpeModel, use_added: bool = True, packed: bool = False):
    """Arrow UDF ``array<string> -> array<int>``, or packed ids; the model (some MB at most)
    travels as one broadcast."""
    unknown = model.added.get("[UNK]")
    added = model.added if use_added else {}
    shared = spark.sparkContext.broadcast(
        {"model": (model.vocab, model.merges, added, unknown), "encoder": None}
    )

    @F.arrow_udf(T.BinaryType() if packed else T.ArrayType(T.IntegerType()))
    def encode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # the worker process keeps the broadcast, and with it the warm encoder, across tasks
        kept = shared.value
        encode = kept["encoder"] = kept["encoder"] or _PieceEncoder(*kept["model"])
        for words in batches:
            slices = _encode_slices(words, encode)
            done = [_pack_batch(ids) if packed else ids for ids in slices]
            yield pa.concat_arrays(done) if done else pa.array([], pa.binary() if packed else pa.list_(pa.int32()))

    # a filter on the ids must not be pushed below a shuffle and encode twice
    return encode_pieces.asNondeterministic()


def _pack_batch(ids: pa.ListArray) -> pa.BinaryArray:
    """The id buffer itself is the packed form; only the offsets grow fourfold."""
    values = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<i4")
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * 4
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch packs to 2 GiB or more: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    validity = None
    if ids.null_count:
        validity = pa.array(ids.is_valid()).buffers()[1]
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(ids),
        [validity, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)], ids.null_count,
    )


@F.arrow_udf(T.BinaryType())
def pack_ids(ids: pa.Array) -> pa.Array:
    """Vectorized form of ``pack_u32`` for long id arrays."""
    return _pack_batch(ids)


def packed_column(encoded: DataFrame, ids: str = "ids") -> Column:
    """The packed ids of a column of id arrays or of packed ids."""
    return F.col(ids) if isinstance(encoded.schema[ids].dataType, T.BinaryType) else pack_ids(ids)


# ---------------------------------------------------------------------- API
def choose_strategy(model: BpeModel, strategy: str = "auto") -> str:
    if strategy == "auto":
        return "arrow"
    problem = model.fold_problem() if strategy == "fold" else None
    if problem:
        raise ValueError(f"the fold strategy cannot run this model: {problem}")
    if strategy not in ("fold", "arrow"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return strategy


def bpe_encode(
    df: DataFrame,
    model: BpeModel,
    text: str = "text",
    out: str = "ids",
    strategy: str = "auto",
    pretokenizer: str = "gpt2",
    use_added: bool = True,
    packed: bool = False,
) -> DataFrame:
    """Add the id array of every row; null text gives a null array, '' an empty one.

    With ``packed`` the column holds the ids' 32-bit little-endian form instead, made where
    they are encoded, so that no list of ids travels between Python and the JVM.
    """
    strategy = choose_strategy(model, strategy)
    words = pretokenize(F.col(text), pretokenizer, added_names(model, use_added))
    if strategy == "fold":
        # without cutting, a piece may equal an added token only by chance of
        # pretokenizer='none'; the fold must not treat it as one then
        m = model if use_added else BpeModel(model.vocab, model.merges, {})
        if df.isStreaming:
            ids = _fold_ids(_fold_merged(words, m))
            return df.withColumn(out, pack_ids(ids) if packed else ids)
        rows, ids = _fold_looked_up(df, words, m)
        rows = rows.withColumn("_fold_ids", ids)
        return rows.withColumn(out, pack_ids("_fold_ids") if packed else F.col("_fold_ids")).drop("_part", "_slots", "_fold_ids")
    udf = encode_pieces_udf(df.sparkSession, model, use_added, packed)
    return df.withColumn(out, udf(words))


def stage_times(rows: DataFrame, model: BpeModel, text: str = "text") -> DataFrame:
    """Encode and pack every row, keeping only the times: one record per Arrow batch.

    ``worker`` is the task's partition. Waiting for a batch (scan, filter,
    pre-tokenization) counts as reading; nothing is written here.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.vocab, model.merges, {}, model.added.get("[UNK]")))
    columns = ["worker", "shards", "tokens", "read_us", "decode_us", "tokenize_us", "pack_us",
               "write_us", "flush_us", "fsync_us"]

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from time import perf_counter_ns

        from pyspark import TaskContext

        encode = _PieceEncoder(*shared.value)
        worker = f"task-{TaskContext.get().partitionId()}"
        seen: set[int] = set()
        marks = [perf_counter_ns()]
        for batch in batches:
            marks = [marks[-1], perf_counter_ns()]
            words = batch.column("words")
            new = set(batch.column("shard").to_pylist()) - seen
            seen |= new
            marks.append(perf_counter_ns())
            ids = _encode_batch(words, encode)
            marks.append(perf_counter_ns())
            _pack_batch(ids)
            marks.append(perf_counter_ns())
            spent = [(b - a) // 1000 for a, b in zip(marks, marks[1:])]
            record = [worker, len(new), len(ids.flatten()), *spent, 0, 0, 0]
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(columns, record)})

    words = pretokenize(F.col(text)).alias("words")
    ddl = "worker string, " + ", ".join(f"{c} bigint" for c in columns[1:])
    return rows.select("shard", words).mapInArrow(timed, ddl)


def bpe_decode(ids: Column, model: BpeModel) -> Column:
    """Ids -> text; unknown ids vanish, malformed UTF-8 becomes U+FFFD."""
    table = json_literal(model.decode_table(), "array<string>")
    raw = F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")
    return F.make_valid_utf8(F.encode(raw, "ISO-8859-1").cast("string"))


def ids_to_text(ids: Column) -> Column:
    """Decimal ids, each followed by one space."""
    return F.when(F.size(ids) > 0, F.concat(F.array_join(ids, " "), F.lit(" "))).otherwise(F.lit(""))


def flatten_pack(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """Per batch: all ids (arrays or packed) in row order, packed into one buffer.

    A record batch is the reader's unit and bounded by it, so the collected
    group is bounded too. Batches without ids give no buffer.
    """
    rows = encoded.select("shard", "batch_index", "row_in_batch", packed_column(encoded, ids).alias("packed"))
    packed = F.expr("listagg(packed) within group (order by row_in_batch)")
    return (
        rows.where(F.octet_length("packed") > 0)
        .groupBy("shard", "batch_index")
        .agg(packed.alias("packed"))
        .select("shard", "batch_index", int_div(F.octet_length("packed"), 4).alias("n_tokens"), "packed")
    )

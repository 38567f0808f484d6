"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other names and figures
keeps its template. Windows of template words are hashed; document windows that a bit filter of
the benchmark's windows lets through are hash-joined with them, and a joined pair counts only if
its slots are filled consistently: the same benchmark value always by the same document value.
Beside these, windows of the words themselves find whole copies of an item, whatever its slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_rows, texts_of
from tokenloom.llm.words import Words, split_words, xxh64
from tokenloom.session import materialize

# Words that stand for numbers, and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion half dozen"
).split()
UNIT_WORDS = (
    "mm cm m km meter meters metre metres kilometer kilometers inch inches foot feet yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts"
).split()

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[range(0x30, 0x3A)] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that windows can be shifted to a common origin
NUM, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)

# a whole copy of fewer words can't be told from chance
LEAST_WORDS = 3
_LITERAL = np.uint64(0xA5A5_5A5A_C3C3_3C3C)  # keeps the hashes of literal windows apart

# need: 0 for a template window, else the literal windows that a whole copy of the item holds
WINDOWS = "id long, text_key long, at int, size int, win long, need int, slots array<long>"


def _hashes(words: list[str]) -> np.ndarray:
    w = split_words([" ".join(words).encode()])
    return np.sort(xxh64(w.buffer, w.starts, w.ends - w.starts))


def templates(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their template symbols and their own (letter-folded, bare) hashes."""
    words = split_words(texts, fold=False)
    buf, n = words.buffer, len(words.buffer)
    if not len(words.starts):
        empty = np.zeros(0, dtype=np.uint64)
        return words, empty, empty
    # strip punctuation at both ends; a word of nothing else stays
    bare = ~_PUNCT[buf]
    ahead = np.minimum.accumulate(np.where(bare, np.arange(n), n)[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(bare, np.arange(n), -1))
    a, b = ahead[words.starts], behind[words.ends - 1] + 1
    hollow = (a >= words.ends) | (b <= words.starts)
    a, b = np.where(hollow, words.starts, a), np.where(hollow, words.ends, b)
    # two-byte Latin capitals fold like the ASCII ones
    low = _FOLD[buf]
    accent = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    low[accent] += 0x20
    own = xxh64(low, a, b - a)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    number = (digits[b] > digits[a]) & ((letters[b] == letters[a]) | _DIGIT[buf[a]])
    number |= np.isin(own, _hashes(NUMBER_WORDS))
    opens = np.zeros(len(a), dtype=bool)
    opens[words.first[:-1][words.counts > 0]] = True
    after_number = np.concatenate([[False], number[:-1]]) & ~opens
    unit = after_number & np.isin(own, _hashes(UNIT_WORDS))
    # a capital inside a sentence marks a name
    starts_sentence = opens | np.concatenate([[True], _STOP[buf[words.ends[:-1] - 1]]])
    # (all capitals are a style, not a name)
    wide = buf[a] == 0xC3
    second = a + 1 + wide
    capital = (low[a] != buf[a]) | (wide & (low[a + 1] != buf[a + 1]))
    goes_on = (second < b) & (low[second] == buf[second]) & ((buf[second] != 0xC3) | (low[second + 1] == buf[second + 1]))
    name = capital & goes_on & ~starts_sentence & ~number
    symbol = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, own | np.uint64(4))))
    return words, symbol, own


def template_windows(
    words: Words, symbol: np.ndarray, size: int, min_literals: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of the windows inside one text with enough literal words."""
    n = len(symbol)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    literal = np.concatenate([[0], np.cumsum(symbol > UNIT)])
    at = np.flatnonzero((words.doc[: n - size + 1] == words.doc[size - 1 :]) & (literal[size:] - literal[:-size] >= min_literals))
    total = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(_MULTIPLIER) + symbol[at + j]
        total = (total ^ (total >> np.uint64(31))) * np.uint64(_MULTIPLIER) + np.uint64(size)
    return at, total ^ (total >> np.uint64(29))


def literal_windows(words: Words, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of all windows of bare, letter-folded words inside one text."""
    at, win = template_windows(words, own, size, 0)
    return at, win ^ _LITERAL


def _rows(batch: pa.RecordBatch, words: Words, symbol: np.ndarray, own: np.ndarray, found: list) -> pa.RecordBatch:
    at = np.concatenate([f[0] for f in found])
    size = np.concatenate([np.full(len(f[0]), s) for s, f in zip([f[2] for f in found], found, strict=True)])
    win = np.concatenate([f[1] for f in found])
    need = np.concatenate([np.broadcast_to(f[3], len(f[0])) for f in found])
    slots = []
    for a, s, n in zip(at, size, need, strict=True):
        inside = symbol[a : a + s] <= (0 if n else UNIT)
        slots.append(own[a : a + s][inside].view(np.int64) if inside.any() else [])
    doc = words.doc[at]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)),
         pa.array(at - words.first[doc], pa.int32()), pa.array(size, pa.int32()), pa.array(win.view(np.int64)),
         pa.array(need, pa.int32()), pa.array(slots, pa.list_(pa.int64()))],
        names=["id", "text_key", "at", "size", "win", "need", "slots"],
    )


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, size: int, min_literals: int) -> DataFrame:
    """All windows of the items; an item shorter than a window is one window of its own length."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, symbol, own = templates(texts_of(batch.column(2)))
        found = []
        for s in range(min_literals, size + 1):
            at, win = template_windows(words, symbol, s, min_literals)
            if s < size:
                whole = words.counts[words.doc[at]] == s
                at, win = at[whole], win[whole]
            found.append((at, win, s, 0))
        for s in range(LEAST_WORDS, size + 1):
            at, win = literal_windows(words, own, s)
            n = words.counts[words.doc[at]]
            mine = (n == s) | (s == size)
            found.append((at[mine], win[mine], s, (n - s + 1)[mine]))
        return _rows(batch, words, symbol, own, found)

    rows = bench.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("text_key"),
                        F.col(f"`{text_col}`").alias("text"))
    return map_rows(rows, run, WINDOWS, 1 << 20)


def bit_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """A bit per hash value modulo ``bits``: at most ``bits / 64`` numbers reach the driver."""
    place = F.pmod(F.col("win"), F.lit(bits))
    words = windows.groupBy(F.floor(place / 64).cast("long").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("b")
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for r in words.collect():
        out[r["w"]] = r["b"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, min_literals: int = 5, filter_bits: int = 1 << 22,
    doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, text_key, item_id, n_windows``: documents and the items whose windows they hold.

    A window has ``size`` template words, ``min_literals`` of them literal. Items with fewer
    than ``size`` words are looked for whole. Copies of a whole item, letter case and punctuation
    at the ends of words aside, are found whatever they are made of, from ``LEAST_WORDS`` words on;
    shorter items (null and empty ones too) match nothing.
    ``text_key`` with ``doc_id`` names a row; rows equal in both share their verdict.
    The filter has a fixed size; a large benchmark fills it, which costs time but no result.
    """
    bench = materialize(benchmark_windows(benchmark, item_id, item_text, size, min_literals), "benchmark")
    kinds = sorted((r["size"], r["literal"]) for r in bench.select("size", (F.col("need") > 0).alias("literal")).distinct().collect())
    passes = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_filter(bench, filter_bits)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bits = np.unpackbits(passes.value).astype(bool)
        words, symbol, own = templates(texts_of(batch.column(2)))
        found = []
        for s, literal in kinds:
            at, win = literal_windows(words, own, s) if literal else template_windows(words, symbol, s, min_literals)
            ok = bits[(win.view(np.int64) % filter_bits)]
            found.append((at[ok], win[ok], s, int(literal)))
        return _rows(batch, words, symbol, own, found) if found else None

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), text_key(F.col(f"`{doc_text}`")).alias("text_key"),
                       F.col(f"`{doc_text}`").alias("text"))
    near = map_rows(rows, run, WINDOWS, 2 << 20)
    items = bench.select("win", "need", F.col("text_key").alias("item_key"), F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    # one diagonal is one placement of the item in the document
    both = near.withColumnRenamed("need", "literal").join(items, "win").filter((F.col("need") > 0) == (F.col("literal") > 0))
    both = materialize(both, "met")  # two branches read it, and the texts are read once
    met = both.filter("need = 0").select(
        "id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "at",
        F.arrays_zip("item_slots", "slots").alias("slots"),
    )
    placed = met.groupBy("id", "text_key", "item_id", "diagonal").agg(
        F.count_distinct("at").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    same = F.size(F.array_distinct(F.transform("slots", lambda s: s["item_slots"]))) == F.size("slots")
    # all literal windows of an item on one diagonal are a copy of it; its slots need no check
    copied = both.filter("need > 0").groupBy(
        "id", "text_key", "item_id", "item_key", "need", (F.col("at") - F.col("item_at")).alias("diagonal")
    ).agg(F.count_distinct("at").alias("n_windows")).filter("n_windows = need")
    columns = ["id", "text_key", "item_id", "n_windows"]
    return placed.filter(same).select(columns).unionByName(copied.select(columns)).groupBy("id", "text_key", "item_id").agg(F.max("n_windows").alias("n_windows")).select(
        F.col("id").alias("doc_id"), "text_key", "item_id", "n_windows"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``doc_id, contaminated, n_items, n_windows`` for every row of ``docs``.

    Null and empty texts are clean; repeated rows give equal rows, a null ``doc_id`` stays null.
    An empty benchmark leaves all documents clean.
    """
    hits = contamination(docs, benchmark, **settings)
    per_doc = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.count_distinct(F.coalesce("item_id", F.lit(-1).cast("long"))).alias("n_items"), F.sum("n_windows").alias("n_windows")
    )
    per_doc = materialize(per_doc, "hits")
    rows = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"))
    found = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["hit_id"]) & (rows["text_key"] == per_doc["hit_key"]), "left")
    return found.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The clean rows of ``docs`` with all their columns."""
    hits = contamination(docs, benchmark, **settings).select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")
    ).distinct()
    hits = materialize(hits, "hits")
    return docs.join(
        hits, docs["doc_id"].eqNullSafe(hits["hit_id"]) & (text_key(docs["text"]) == hits["hit_key"]), "left_anti"
    )

"""Language identification: TF-IDF of character n-grams, sparse logistic regression, temperature.

Document frequencies cover every training document; the regression learns from a bounded,
per-language balanced sample; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import is_held_out, map_rows, slices
from tokenloom.llm.linear import Ftrl, Sparse, softmax, temperature

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
_PAD = "\n" * (max(ORDERS) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
# brings relative frequencies times IDF to the order of 1
_SCALE = 30.0

PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double"


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``(bucket of every n-gram by order, first of each text, n-grams per text)``, letters folded.

    Every text starts with padding that belongs to it, so n-grams never join two texts.
    """
    folded = [_PAD + t.lower() for t in texts]
    code = np.frombuffer(("".join(folded) + _PAD).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in folded], dtype=np.int64)
    total = int(sizes.sum())
    out, key = [], np.zeros(len(code), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in ORDERS:
            key = (key[: len(code) - k + 1] + code[k - 1 :] + np.uint64(k)) * np.uint64(_MULTIPLIER)
            mixed = key ^ (key >> np.uint64(32))
            out.append(((mixed * np.uint64(_MULTIPLIER)) >> np.uint64(48)).astype(np.int64)[:total])
    return out, np.cumsum(sizes) - sizes, sizes


def document_frequency(texts: DataFrame) -> np.ndarray:
    """Documents per bucket, and their number at the end, over the whole column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, mark = np.zeros(BUCKETS + 1, dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                grams, first, sizes = ngram_buckets([t or "" for t in part.column(0).to_pylist()])
                for a, n in zip(first, sizes, strict=True):
                    mark[:] = False
                    for g in grams:
                        mark[g[a : a + n]] = True
                    df[:-1] += mark
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    # at most BUCKETS + 1 rows, whatever the size of the table
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _vectors(texts: list[str], idf: np.ndarray) -> list[Sparse]:
    out = []
    for text in texts:
        grams, _, sizes = ngram_buckets([text])
        at, n = np.unique(np.concatenate(grams), return_counts=True)
        out.append(Sparse(at, _SCALE * n / (sizes[0] * len(ORDERS)) * idf[at]))
    return out


def balanced_sample(rows: DataFrame, label: str, size: int) -> DataFrame:
    """About ``size`` rows, as many of every label as there are, chosen by a hash of the row.

    Equal texts share their fate and count once.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    limit = F.lit(0)
    for value, n in counts.items():
        share = min(1.0, size / len(counts) / n)
        limit = F.when(F.col(label) == value, F.lit(int(share * (1 << 30)))).otherwise(limit)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 30)) < limit)
    return picked.dropDuplicates([label, "text"]).orderBy(F.xxhash64("text")).limit(2 * size)


def identify(docs: DataFrame, max_train: int = 4000, mod: int = 3) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Learns from ``text`` and non-null ``lang`` of rows whose crc32 of the id is not 1 modulo
    ``mod``; ``max_train`` bounds the regression's sample (a fifth of it sets the temperature).
    Null texts and texts without a letter are ``und`` with score 0; so is every text if there
    is nothing to learn from. A null id is not held out. Repeated rows give equal rows.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), is_held_out(F.col("doc_id"), mod).alias("held_out"))
    train = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = balanced_sample(train.select("text", "lang"), "lang", max_train).collect()
    langs = sorted({r["lang"] for r in sample})
    model = None
    if langs:
        df = document_frequency(train)
        idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1
        xs, ys = _vectors([r["text"] for r in sample], idf), np.array([langs.index(r["lang"]) for r in sample])
        back = np.arange(len(xs)) % 5 == 4
        fit = Ftrl(BUCKETS, len(langs)).fit([x for x, b in zip(xs, back, strict=True) if not b], ys[~back].tolist())
        warmth = temperature(fit.logits([x for x, b in zip(xs, back, strict=True) if b]), ys[back])
        w = fit.weights()
        table = (w[:-1] * idf[:, None] * _SCALE / len(ORDERS)).astype(np.float32)
        model = (langs, table, w[-1], warmth)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        known = np.array([any(map(str.isalpha, t)) for t in texts])
        names, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        if shared.value is not None and known.any():
            langs, table, bias, warmth = shared.value
            grams, first, sizes = ngram_buckets(texts)
            full = np.flatnonzero(sizes)
            total = np.zeros((len(texts), len(langs)))
            for g in grams:
                total[full] += np.add.reduceat(table[g], first[full], axis=0, dtype=np.float64)
            p = softmax((total / np.maximum(sizes, 1)[:, None] + bias) / warmth)
            names[known] = np.array(langs, dtype=object)[p.argmax(axis=1)[known]]
            score[known] = p.max(axis=1)[known]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return map_rows(rows.select("doc_id", "text", "held_out"), predict, PREDICTIONS, 1 << 20)

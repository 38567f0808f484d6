"""Document quality by co-training two views that see different things.

One classifier reads the words of the text, the other what is known around it: language,
source, length and layout figures. Every text is read once, into a written table of both views as
sparse vectors. Each round both classifiers are fitted, score every unlabelled document's views on
the executors, and each names those it is surest of among all; these become labels of the
*other* view. Both are then calibrated on labels that no round has seen, and a last regression
over the two calibrated log-odds scores every document. The driver sees the features of labelled
and named documents only, as sparse vectors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import lowest, map_rows, plain_columns, texts_of
from tokenloom.llm.linear import Ftrl, Sparse
from tokenloom.llm.urls import calibrate
from tokenloom.llm.words import split_words, xxh64
from tokenloom.session import materialize

WORD_BUCKETS = 1 << 17
META_BUCKETS = 1 << 12
_WORD_SCALE = 10.0

SCORES = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of the texts, and the first word of each text (one more closes)."""
    words = split_words(texts)
    hashed = xxh64(words.buffer, words.starts, words.ends - words.starts)
    return (hashed >> np.uint64(47)).astype(np.int64), words.first


def layout(text: bytes) -> list[int]:
    """Coarse figures of a text's form; none depends on which words it uses."""
    raw = np.frombuffer(text, dtype=np.uint8)
    n = max(len(raw), 1)
    upper = int(((raw >= 0x41) & (raw <= 0x5A)).sum())
    marks = int((((raw > 0x20) & (raw < 0x30)) | ((raw > 0x39) & (raw < 0x41)) | ((raw > 0x7A) & (raw < 0x7F))).sum())
    digits = int(((raw >= 0x30) & (raw <= 0x39)).sum())
    lines, gaps = text.count(b"\n") + 1, text.count(b" ") + 1
    # zlib's view of repetition, over the whole text
    packed = len(zlib.compress(text, 1))
    return [
        min(int(40 * upper / n), 20), min(int(40 * marks / n), 20), min(int(40 * digits / n), 20),
        min(int(10 * packed / n), 12), int(np.log2(n)), min(int(np.log2(n / lines + 1)), 14),
        min(int(2 * np.log2(n / gaps + 1)), 14),
    ]


def meta_features(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed one-hot features of the metadata view."""
    facts = [f"lang={lang}", f"source={source}", f"chars={None if n_chars is None else int(np.log2(max(n_chars, 0) + 1))}"]
    facts += [f"layout{k}={v}" for k, v in enumerate(layout(text))]
    return np.unique([zlib.crc32(f.encode()) % META_BUCKETS for f in facts])


@dataclass
class Example:
    text: Sparse
    meta: Sparse
    label: int  # -1: none


VIEWS = "doc_id long, words binary, times binary, n_words long, meta binary"


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary value of 32-bit integers per run; ``first`` holds the runs' borders."""
    edges = pa.py_buffer(np.ascontiguousarray(first * 4, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, edges, pa.py_buffer(values.astype("<i4"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of :func:`_packed`, and the row of each."""
    n = len(column)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    if edges[0] == edges[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.frombuffer(column.buffers()[2], "u1")[edges[0] : edges[-1]].view("<i4")
    return values, np.repeat(np.arange(n), np.diff(edges) // 4)


def both_views(rows: DataFrame) -> DataFrame:
    """Both views of every row ``doc_id, text, lang, source, n_chars`` as sparse vectors, whole texts.

    Hashed words with how often each occurs, and the places of the metadata: at most ``WORD_BUCKETS``
    pairs of numbers for a text of any length.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, texts = batch.num_rows, texts_of(batch.column("text"))
        at, first = word_features(texts)
        pair, times = np.unique(np.repeat(np.arange(n), np.diff(first)) * WORD_BUCKETS + at, return_counts=True)
        borders = np.searchsorted(pair, np.arange(n + 1) * WORD_BUCKETS)
        facts = zip(texts, *[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")], strict=True)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), _packed(pair % WORD_BUCKETS, borders), _packed(times, borders),
            pa.array(np.diff(first).astype(np.int64)),
            pa.array([meta_features(*f).astype("<i4").tobytes() for f in facts], pa.binary()),
        ], names=["doc_id", "words", "times", "n_words", "meta"])

    return map_rows(rows.select("doc_id", "text", "lang", "source", "n_chars"), make, VIEWS, 1 << 20)


def features(rows: DataFrame) -> DataFrame:
    """What the driver needs of labelled or named rows of the written views."""
    return rows.select("doc_id", "good", "words", "times", "n_words", "meta")


def examples(rows: list) -> list[Example]:
    """Collected :func:`features` by ascending id hash of the caller; one example per row."""
    out = []
    for r in rows:
        words, n = np.frombuffer(r["words"], "<i4").astype(np.int64), np.frombuffer(r["times"], "<i4")
        meta = np.frombuffer(r["meta"], "<i4").astype(np.int64)
        out.append(Example(
            Sparse(words, _WORD_SCALE * np.sqrt(n / max(r["n_words"], 1))), Sparse(meta, np.ones(len(meta))), r["good"]
        ))
    return out


def log_odds(model: Ftrl, xs: list[Sparse]) -> np.ndarray:
    z = model.logits(xs)
    return z[:, 1] - z[:, 0]


def _fit(n: int, data: list[tuple[Sparse, int]]) -> Ftrl:
    return Ftrl(n, 2, alpha=0.2, l1=0.01).fit([x for x, _ in data], [y for _, y in data])


def difference(model: Ftrl) -> np.ndarray:
    """Weights of the log-odds of good, the bias last."""
    w = model.weights()
    return (w[:, 1] - w[:, 0]).astype(np.float32)


def view_odds(views: DataFrame, word_weights: np.ndarray, meta_weights: np.ndarray) -> DataFrame:
    """``doc_id, by_text, by_meta``: log-odds of both views for every row of :func:`both_views`."""
    shared = views.sparkSession.sparkContext.broadcast((word_weights, meta_weights))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        zt, zm = odds_of(batch, *shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(zt), pa.array(zm)], names=["doc_id", "by_text", "by_meta"])

    return map_rows(views, judge, "doc_id long, by_text double, by_meta double")


def odds_of(batch: pa.RecordBatch, word_weights: np.ndarray, meta_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views' log-odds of a batch of :func:`both_views`."""
    n = batch.num_rows
    words, doc = _unpacked(batch.column("words"))
    times, _ = _unpacked(batch.column("times"))
    # only words with a weight matter: l1 leaves few
    on = np.flatnonzero(word_weights[words] != 0)
    who, n_words = doc[on], np.maximum(batch.column("n_words").to_numpy(), 1)
    value = _WORD_SCALE * np.sqrt(times[on] / n_words[who])
    zt = float(word_weights[-1]) + np.bincount(who, weights=value * word_weights[words[on]], minlength=n)
    meta, doc = _unpacked(batch.column("meta"))
    return zt, float(meta_weights[-1]) + np.bincount(doc, weights=meta_weights[meta], minlength=n)


def co_train(
    labelled: list[Example], views: DataFrame, marked: DataFrame, rounds: int, per_round: int, sure: float
) -> tuple[Ftrl, Ftrl]:
    """The text and the metadata model after the rounds; ``sure`` is the least log-odds to pass on.

    Every round scores all ``views`` whose id is not ``marked``. A document passes on once; the
    ``rounds * 2 * (per_round + 1)`` documents named at most are all that is collected.
    """
    ys = [e.label for e in labelled]
    text, meta = [(e.text, y) for e, y in zip(labelled, ys, strict=True)], [(e.meta, y) for e, y in zip(labelled, ys, strict=True)]
    share = sum(ys) / max(len(ys), 1)
    quota = (max(1, round(per_round * (1 - share))), max(1, round(per_round * share)))
    used: set[int] = set()
    for _ in range(rounds):
        odds = view_odds(views.filter("doc_id is not null"), difference(_fit(WORD_BUCKETS, text)), difference(_fit(META_BUCKETS, meta)))
        odds = materialize(odds.join(marked, "doc_id", "left_anti"), "odds")
        if used:
            odds = odds.filter(~F.col("doc_id").isin(list(used)))
        named: dict[tuple[str, int], list[int]] = {}
        for by, view in (("by_text", "meta"), ("by_meta", "text")):
            for label, order in ((0, F.col(by)), (1, -F.col(by))):
                # a repeated row counts once
                top = odds.filter(order <= -sure).groupBy("doc_id").agg(F.min(order).alias("z")).orderBy("z", F.xxhash64("doc_id"), "doc_id")
                named[view, label] = [r["doc_id"] for r in top.limit(quota[label]).collect()]
        picked = sorted({i for found in named.values() for i in found})
        if not picked:
            break
        kept = views.filter(F.col("doc_id").isin(picked)).withColumn("good", F.lit(-1))
        got = sorted(features(kept).collect(), key=lambda r: (r["doc_id"], r["words"], r["times"], r["meta"]))
        by_id = dict(zip([r["doc_id"] for r in got], examples(got), strict=True))
        for (view, label), found in named.items():
            (meta if view == "meta" else text).extend((getattr(by_id[i], view), label) for i in found)
        used.update(picked)
    return _fit(WORD_BUCKETS, text), _fit(META_BUCKETS, meta)


def score_quality(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 8000,
    rounds: int = 4, per_round: int = 200, sure: float = 2.0, keep_from: float = 0.5,
) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` for every row of ``docs``.

    A document is good if its label has quality 1 and is not toxic; a null quality is no label,
    a null toxicity is none. ``max_labelled`` bounds the labelled documents that the models are
    fitted on (those with the smallest hash of the id); the unlabelled ones are all scored in each
    of the ``rounds``, which names ``per_round`` of them per view. All documents are scored, whole, from
    views written once in the shared folder. Texts
    that are null score as empty ones, unknown metadata as a value of its own. Repeated rows
    give equal rows; of repeated labels any bad one counts. Without labels of both kinds all
    scores are null and every document is kept.
    """
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(good)
    views = materialize(both_views(
        plain_columns(docs, doc_id="doc_id", text="text", lang="lang", source="source", n_chars="n_chars")), "views")
    # the ids of the sample first, so that only its vectors are joined and moved
    turn = F.xxhash64(F.lit(29), "doc_id")
    ids = views.select("doc_id").filter("doc_id is not null").distinct()
    marked = ids.join(marks, "doc_id")
    picked = F.broadcast(lowest(marked, turn, max_labelled, marked.count()))
    sample = views.join(picked, "doc_id").dropDuplicates(["doc_id"])
    known = examples(features(sample).orderBy(turn, "doc_id").collect())
    back, fit_on = known[::4], [e for i, e in enumerate(known) if i % 4]
    model = None
    if len({e.label for e in fit_on}) == 2 and len({e.label for e in back}) == 2:
        by_text, by_meta = co_train(fit_on, views, marks.select("doc_id"), rounds, per_round, sure)
        y = np.array([float(e.label) for e in back])
        zt, zm = log_odds(by_text, [e.text for e in back]), log_odds(by_meta, [e.meta for e in back])
        ct, cm = calibrate(zt, y), calibrate(zm, y)
        joint = joint_weights(np.stack([ct[0] * zt + ct[1], cm[0] * zm + cm[1], np.ones(len(y))], axis=1), y)
        model = (difference(by_text), difference(by_meta), ct, cm, joint)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, names = batch.num_rows, ["doc_id", "text_score", "meta_score", "score", "kept"]
        if shared.value is None:
            none = pa.nulls(n, pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0), none, none, none, pa.array([True] * n)], names=names)
        word_weights, meta_weights, ct, cm, joint = shared.value
        zt, zm = odds_of(batch, word_weights, meta_weights)
        a, b = ct[0] * zt + ct[1], cm[0] * zm + cm[1]
        score = _sigmoid(joint[0] * a + joint[1] * b + joint[2])
        cols = [pa.array(_sigmoid(a)), pa.array(_sigmoid(b)), pa.array(score), pa.array(score >= keep_from)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return map_rows(views, judge, SCORES)


def joint_weights(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression over the two calibrated log-odds, drawn towards their plain mean."""
    prior = np.array([0.5, 0.5, 0.0])
    theta = prior.copy()
    for _ in range(50):
        p = _sigmoid(design @ theta)
        grad = design.T @ (p - y) + (theta - prior)
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(3)
        theta -= np.linalg.solve(hess, grad)
    return theta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

"""Language-model scores of whole texts, and a unigram base score beside them.

The unigram counts cover every word of every training text, and a text needs the counts of all
its words, so words and texts meet in a shuffle. Texts go in slices of some MB: a slice sends
each of its words once, with the texts it is in, to the word's bucket; a bucket knows all
counts of its words and answers with one partial sum per text. Buckets are as many as the
corpus needs to keep each one small. The same pass writes every text's subword ids, which both
the fit and the scores of the attention model read from there.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.attention import BOUND, N_IDS, STRIDE, Attention, classes_by_mass, log10_probability, to_blocks
from tokenloom.llm.common import is_held_out, slices, texts_of
from tokenloom.llm.encode import encoder
from tokenloom.llm.stretches import stretches
from tokenloom.session import materialize

SLICE_BYTES, READ_BYTES = 6 << 20, 2 << 20  # of a slice, and of what is split and encoded in one go
SLICE_ROWS = 50_000  # a text's place in its slice fits 16 bits
# bytes of text per bucket
BUCKET_BYTES = 32 << 20
# fitting: blocks of a task at least, blocks that a task holds at once, steps of a small corpus in blocks
TASK_BLOCKS, SLICE_BLOCKS, LEAST_BLOCKS = 1 << 16, 1 << 16, 800 * 256
RATE = 0.03  # of learning, at first
# shares of the texts after which the tasks' weights are averaged, and pieces of the embedding for the sums
ROUNDS, PARTS = (0.0, 1 / 16, 1 / 4, 5 / 8, 1.0), 64

MESSAGES = (
    "slice long, bucket int, words binary, train binary, spread binary, doc binary, times binary, "
    "place int, doc_id long, held boolean, n_words int, turn double, ids binary"
)
MESSAGE_FIELDS = pa.schema([
    ("slice", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("words", "train", "spread", "doc", "times")],
    ("place", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_words", pa.int32()),
    ("turn", pa.float64()), ("ids", pa.binary()),
])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def read_texts(rows: DataFrame, n_buckets: int, vocabulary: str | None) -> DataFrame:
    """The one pass over ``doc_id, text, held``, written: a row per text with its subword ids of 16 bits
    (``bucket`` is -1, ``turn`` deals it to a round of the fit), and a slice's words for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rng, number = np.random.default_rng(task), task << 32
        for batch in batches:
            for big in slices(batch, SLICE_BYTES):
                for a in range(0, big.num_rows, SLICE_ROWS):
                    part = big.slice(a, SLICE_ROWS)
                    n, number = part.num_rows, number + 1
                    held = part.column(2).to_numpy(zero_copy_only=False)
                    read = [stretches(vocabulary).read(texts_of(x.column(1))) for x in slices(part, READ_BYTES)]
                    ids, n_ids, words, n_words = (np.concatenate(x) for x in zip(*read, strict=True))
                    requests = _requests(number, words, n_words, held, n_buckets)
                    texts = {
                        "slice": pa.array(np.full(n, number)), "bucket": pa.array(np.full(n, -1, np.int32)),
                        "place": pa.array(np.arange(n, dtype=np.int32)), "doc_id": part.column(0), "held": part.column(2),
                        "n_words": pa.array(n_words.astype(np.int32)), "turn": pa.array(rng.random(n)),
                        "ids": pa.Array.from_buffers(pa.binary(), n, [
                            None, pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(n_ids)]).astype(np.int32)), pa.py_buffer(ids)]),
                    }
                    yield pa.RecordBatch.from_arrays(
                        [texts.get(f.name, pa.nulls(n, f.type)) for f in MESSAGE_FIELDS], schema=MESSAGE_FIELDS)
                    if requests:
                        yield pa.RecordBatch.from_pylist(requests, schema=MESSAGE_FIELDS)

    return materialize(rows.mapInArrow(run, MESSAGES), "messages")


def id_counts(ids: DataFrame) -> tuple[np.ndarray, int]:
    """How often every subword id occurs, with the number of texts at ``BOUND``, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N_IDS + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                raws = part.column(0).to_pylist()
                counts[:N_IDS] += np.bincount(np.frombuffer(b"".join(raws), "<u2"), minlength=N_IDS)
                counts[BOUND] += len(raws)
                counts[N_IDS] += sum(len(raw) // 2 // STRIDE + 1 for raw in raws)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    out = np.zeros(N_IDS + 1, dtype=np.int64)
    # one row per id of the vocabulary at most
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out[:N_IDS], int(out[N_IDS])


def fit(ids: DataFrame, model: Attention, class_of: np.ndarray, n_blocks: int) -> Attention:
    """Fits ``model`` on every text of the table ``ids``, all tasks at once.

    In each round a task goes on from the common weights over its own texts of that round, and the
    weights are averaged: steps follow the number of blocks, and each text is used in one
    round. A small corpus is passed over often enough for ``LEAST_BLOCKS`` in all.
    """
    if not n_blocks:
        return model
    passes = max(1, round(LEAST_BLOCKS / n_blocks))
    n_tasks = max(1, n_blocks // TASK_BLOCKS)
    spark, per_part = ids.sparkSession, -(-N_IDS // PARTS)
    for low, high in zip(ROUNDS, ROUNDS[1:], strict=False):
        rows = ids.filter((F.col("turn") >= low) & (F.col("turn") < high)).select("ids").coalesce(n_tasks)
        n_parts = max(1, rows.rdd.getNumPartitions())  # coalescing only lowers it
        shared = spark.sparkContext.broadcast((model, class_of))

        def work(batches: Iterator[pa.RecordBatch], low=low, high=high, n_parts=n_parts, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            given, classes = shared.value
            mine, state = copy.deepcopy(given), {}
            worker = TaskContext.get().partitionId()
            rng = np.random.default_rng(worker)
            share = passes * n_blocks / n_parts

            def rate(n: int) -> float:
                return RATE * (1 - 0.9 * min(high, low + n / share))

            def train(texts: list[np.ndarray]) -> None:
                mine.fit_blocks(to_blocks(texts), classes, state, rate, rng, passes)

            texts, held = [], 0
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    texts.append(np.frombuffer(raw, "<u2").astype(np.int32))
                    held += len(raw) // 2 // STRIDE + 1
                    if held >= SLICE_BLOCKS:
                        train(texts)
                        texts, held = [], 0
            if texts:
                train(texts)
            if state:
                emb, rest = mine.weighted(state)
                vecs = [v.tobytes() for v in [*(emb[a : a + per_part] for a in range(0, N_IDS, per_part)), rest]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(vecs)), pa.int32()), pa.array([worker] * len(vecs), pa.int32()),
                     pa.array(vecs, pa.binary())], names=["part", "worker", "vec"],
                )

        def add(table: pa.Table) -> pa.Table:
            one = table.sort_by("worker")
            total = sum(np.frombuffer(v, "<f4").astype(np.float64) for v in one["vec"].to_pylist())
            return pa.table({"part": one["part"][:1], "vec": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        # the driver takes one sum of every part, at any number of tasks
        sums = rows.mapInArrow(work, "part int, worker int, vec binary").groupBy("part").applyInArrow(
            add, "part int, vec binary").collect()
        vecs = [np.frombuffer(r["vec"], "<f4") for r in sorted(sums, key=lambda r: r["part"])]
        if vecs:
            model.average(np.concatenate([v.reshape(-1, model.p["emb"].shape[1] + 1) for v in vecs[:-1]]), vecs[-1])
        shared.unpersist()
    return model


def _requests(number: int, h: np.ndarray, n_words: np.ndarray, held: np.ndarray, n_buckets: int) -> list[dict]:
    """A slice's words by bucket, each word once, with its training count and the texts it is in.
    ``h`` are the hashes of its texts' words, ``n_words`` of each."""
    if not len(h):
        return []
    by = np.argsort(h, kind="stable")  # words come text by text, so a word's texts stay in order
    h, doc = h[by], np.repeat(np.arange(len(n_words)), n_words)[by]
    pair = np.flatnonzero((np.diff(h, prepend=h[0] ^ np.uint64(1)) != 0) | (np.diff(doc, prepend=-1) != 0))
    times = np.diff(np.append(pair, len(h)))
    h, doc = h[pair], doc[pair]
    first = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)) != 0)
    spread = np.diff(np.append(first, len(h)))
    train = np.add.reduceat(np.where(held[doc], 0, times), first)
    word = h[first]
    bucket = ((word >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    pair_order = np.argsort(np.repeat(bucket, spread), kind="stable")
    word, train, spread, bucket = word[order], train[order], spread[order], bucket[order]
    doc, times = doc[pair_order], times[pair_order]
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    pairs = np.concatenate([[0], np.cumsum(spread)])
    out = []
    for b in range(n_buckets):
        i, j = cut[b], cut[b + 1]
        if i < j:
            p, q = pairs[i], pairs[j]
            out.append({
                "slice": number, "bucket": b, "words": word[i:j].tobytes(),
                "train": train[i:j].astype("<u4").tobytes(), "spread": spread[i:j].astype("<u2").tobytes(),
                "doc": doc[p:q].astype("<u2").tobytes(), "times": times[p:q].astype("<u4").tobytes(),
            })
    return out


def _answers(table: pa.Table) -> pa.Table:
    """A bucket's requests: per slice and text, the sum of log10(c + 0.5) and the unknown words."""
    rows = table.select(["slice", "words", "train", "spread", "doc", "times"]).to_pylist()
    words = np.concatenate([np.frombuffer(r["words"], "<u8") for r in rows])
    distinct, inverse = np.unique(words, return_inverse=True)
    train = np.concatenate([np.frombuffer(r["train"], "<u4") for r in rows])
    counts = np.bincount(inverse, weights=train, minlength=len(distinct))
    value = np.log10(counts + 0.5)
    at, out = 0, {"slice": [-1], "known": [int((counts > 0).sum())], "doc": [b""], "total": [b""], "missing": [b""]}
    for r in rows:
        n = len(r["words"]) // 8
        mine, at = inverse[at : at + n], at + n
        spread = np.frombuffer(r["spread"], "<u2")
        doc, times = np.frombuffer(r["doc"], "<u2"), np.frombuffer(r["times"], "<u4")
        who, place = np.unique(doc, return_inverse=True)
        word = np.repeat(mine, spread)
        total = np.bincount(place, weights=times * value[word], minlength=len(who))
        missing = np.bincount(place, weights=times * (counts[word] == 0), minlength=len(who))
        out["slice"].append(r["slice"])
        out["known"].append(0)
        out["doc"].append(who.astype("<u2").tobytes())
        out["total"].append(total.tobytes())
        out["missing"].append(missing.astype("<u4").tobytes())
    return pa.table({
        "slice": pa.array(out["slice"], pa.int64()), "known": pa.array(out["known"], pa.int64()),
        **{k: pa.array(out[k], pa.binary()) for k in ("doc", "total", "missing")},
    })


def lm_scores(
    docs: DataFrame, mod: int = 5, n_classes: int = 256, vocabulary: str | None = None,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Texts whose crc32 of the id is 1 modulo ``mod`` are held out, all others train: word and
    subword counts and the attention weights cover them all. ``score`` is the model's log10
    probability of the whole text and its end. A null text is empty, a null id trains;
    repeated rows count each time. With nothing to train on, the base score
    is 0 and the model gives each id its untrained share.
    """
    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id"), mod).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    messages = read_texts(rows, max(12, size // BUCKET_BYTES), vocabulary)
    texts = messages.filter("bucket = -1")
    ids = texts.filter("not held").select("turn", "ids")
    counts, n_blocks = id_counts(ids)
    pieces = [encoder(vocabulary).decode_single_token_bytes(i) for i in range(BOUND)] + [b""]
    class_of = classes_by_mass(counts, pieces, n_classes)
    share = np.log((counts + 0.5) / np.bincount(class_of, weights=counts + 0.5)[class_of]).astype(np.float32)
    mass = np.bincount(class_of, weights=counts, minlength=n_classes)
    model = fit(ids, Attention(n_classes).start(mass), class_of, n_blocks)
    shared = docs.sparkSession.sparkContext.broadcast((model.tables(), class_of, share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, classes, in_class = shared.value
        for batch in batches:
            for part in slices(batch, SLICE_BYTES // 4):
                own = [np.frombuffer(raw, "<u2").astype(np.int32) for raw in part.column("ids").to_pylist()]
                done = pa.array(log10_probability(own, tables, classes, in_class))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], done], names=[*part.schema.names[:-1], "score"])

    answers = messages.filter("bucket >= 0").select("slice", "bucket", "words", "train", "spread", "doc", "times")
    answers = materialize(answers.groupBy("bucket").applyInArrow(
        _answers, "slice long, known long, doc binary, total binary, missing binary"
    ), "answers")
    scored = texts.select("slice", "place", "doc_id", "held", "n_words", "ids").mapInArrow(
        score, "slice long, place int, doc_id long, held boolean, n_words int, score double")
    sizes = texts.filter("not held").agg(
        F.coalesce(F.sum(F.col("n_words") + F.lit(1).cast("long")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("texts")
    ).first()
    known = answers.filter("slice = -1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"]
    n_train, ends = sizes["n"], sizes["texts"]
    distinct = known + (ends > 0)

    def gather(own: pa.Table, parts: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        n_tokens = own["n_words"].to_numpy().astype(np.int64) + 1
        total, unknown = np.full(len(n_tokens), np.log10(ends + 0.5)), np.full(len(n_tokens), int(ends == 0))
        for p in parts.select(["doc", "total", "missing"]).to_pylist():
            who = np.frombuffer(p["doc"], "<u2")
            total[who] += np.frombuffer(p["total"], "<f8")
            unknown[who] += np.frombuffer(p["missing"], "<u4").astype(np.int64)
        base = total - n_tokens * np.log10(n_train + 0.5 * (distinct + 1))
        return pa.table({
            "doc_id": own["doc_id"], "held_out": own["held"], "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(n_tokens - unknown), "train_tokens": pa.array(np.full(len(n_tokens), n_train)),
            "base_score": pa.array(base + 0.0), "score": own["score"],
        })

    return scored.groupBy("slice").cogroup(answers.filter("slice >= 0").groupBy("slice")).applyInArrow(gather, SCORES)

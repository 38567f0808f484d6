"""Ranked search against a plain ranking of all documents."""

import math
import random
import re

import numpy as np
import pytest
from conftest import SF

import __spark_entry__ as entry
from tokenloom.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(docs, items, k):
    terms = [TERM.findall((t or "").translate(FOLD)) for _, t in docs]
    n_docs, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (doc, _), t in zip(docs, terms, strict=True):
            if t:
                m = 50 + (50 * len(t) * n_docs) // total
                score = 0
                for w in set(TERM.findall((text or "").translate(FOLD))):
                    if w in df:
                        tf = t.count(w)
                        score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
                if score > 0:
                    scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scored[:k])]
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score long, `qu.ery` string"),
            spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"))


@pytest.fixture()
def tiny(monkeypatch):
    monkeypatch.setattr(rs, "SLICE_BYTES", 700)
    monkeypatch.setattr(rs, "BLOCK_TERMS", 40)
    monkeypatch.setattr(rs, "FIRST_SHARE", 3)
    monkeypatch.setattr(rs, "DEPTH", 2)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_random_texts_in_many_slices_and_blocks(spark, tiny, k):
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(i // 2 if i % 7 else None, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(300)]
    docs += [(i, "Same W1, w2. same") for i in range(400, 440)] + [(5, "Same W1, w2. same")] * 3
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(20)] + [(3, "same w1"), (None, "W2!"), (3, "same w1")]
    got = rs.ranked_search(*frames(spark, docs, items), k=k)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plainly(docs, items, k), key=repr)


def test_odd(spark):
    docs = [(1, None), (None, "alpha beta"), (2, ""), (3, " .,"), (4, "ALPHA é β alpha"), (4, "ALPHA é β alpha"), (5, "x" * 100_000), (6, "alpha " * 50_000)]
    items = [(1, None), (2, ""), (None, "Alpha"), (3, "é β, beta"), (4, "nowhere"), (5, "x" * 100_000)]
    got = rs.ranked_search(*frames(spark, docs, items))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plainly(docs, items, 50), key=repr)
    some, none = frames(spark, docs, items), frames(spark, [], [])
    none = [spark.createDataFrame([], f.schema) for f in some] if none else none
    for a, b in ((some[0], none[1]), (none[0], some[1]), (none[0], none[1])):
        assert rs.ranked_search(a, b).count() == 0


def test_stops_before_the_end_and_at_the_best_positions(spark):
    rng = random.Random(1)
    texts = [" ".join(["rare"] * (i < 12) + ["often"] * rng.randrange(1, 4) + [f"u{i}"] * rng.randrange(1, 60)).encode() for i in range(4000)]
    sizes, terms, dfs, doc, tf = rs.invert(texts)
    row = {"doc_ids": list(range(4000)), "sizes": sizes.astype("<u4").tobytes(), "terms": terms.tolist(), "dfs": dfs.tolist(),
           "doc": doc.astype("<u2").tobytes(), "tf": tf.astype("<u4").tobytes()}
    from tokenloom.llm.words import split_words, xxh64
    w = split_words([b"rare often"])
    wanted = np.sort(xxh64(w.buffer, w.starts, w.ends - w.starts).view(np.int64))
    df = dict(zip(terms.tolist(), dfs.tolist(), strict=True))
    weight = np.array([math.floor(1000 * math.log(8002 / (2 * df[t] + 1))) + 1 for t in wanted.tolist()])
    lists = rs.Lists(row, wanted, weight, 4000, int(sizes.sum()))
    docs, scores, read = rs.best_positions(lists, lists.number, 10, 0)
    whole = np.zeros(4000, dtype=np.int64)
    np.add.at(whole, lists.doc, lists.impact)
    assert sorted(scores.tolist())[-10:] == sorted(whole.tolist())[-10:] and (whole[docs] == scores).all()
    assert read < len(lists.doc) / 4


def test_given_tables_read_the_sql(spark):
    got = entry.queries()["op11_best_position_search"](spark, SF)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plainly(docs, items, 50), key=repr)

"""Each training-data operator against a brute-force version, and on odd input."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tokenloom.llm import (
    chat, cotraining, decontaminate, langid, lm_scoring, packing, quality_rules, repeats, simhash, urls,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, `a b` string"
# nulls in any column, empty and blank texts, ties, repeated rows, a long text, clashing names
ODD = [
    (1, None, "en", "s", None, 7, None), (None, "lone words here", None, None, 3, None, "x"),
    (2, "", "de", None, 0, 1, "y"), (3, " \n\t ", None, "s", 4, 1, "y"), (4, "%%% 12 ---", "en", "s", 10, 1, "y"),
    (5, "same text " * 60, "en", "s", 600, 1, "y"), (5, "same text " * 60, "en", "s", 600, 1, "y"),
    (6, "same text " * 60, "fr", "t", 600, 2, "z"), (7, "é" * 30_000, "fr", "t", 30_000, 2, "z"),
    (8, " ".join(f"word{i}" for i in range(20_000)), "en", "t", 1, 2, "z"),
    (9, "Der Öl-Preis stieg <|im_end|> um 5 km.", "de", "t", 1, 2, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "word1 word2"), (3, "x y z")], "item_id long, text string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def small(spark, n=200):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(n)


# ---- op1


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], dtype=np.uint64)
    ones = [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(h))


def by_pairs(values, radius):
    """Smallest index reachable over pairs within the radius."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates(spark):
    docs = small(spark)
    data = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = [fingerprint(t, 4) for _, t in data]
    label = by_pairs(prints, 4)
    want = [(d, f"{p:016x}", data[k][0]) for (d, _), p, k in zip(data, prints, label, strict=True)]
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(1)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(2000):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not (m & flip) for m in masks)


@pytest.mark.parametrize("pairwise", [2, 2048])
def test_links_of_large_buckets(spark, monkeypatch, pairwise):
    """Pairs, in-task comparison and middles give the same components."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    values = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links_within(nodes, 4)).collect()}
    label = by_pairs(values, 4)
    groups = Counter(label)
    for i, v in enumerate(signed):
        assert (v in found) == (groups[label[i]] > 1)
        for j, w in enumerate(signed[:i]):
            if v in found and w in found:
                assert (found[v] == found[w]) == (label[i] == label[j])


def test_keep_one_of_each(spark, odd):
    out = rows(simhash.keep_one_of_each(odd).select("doc_id", "text"), "doc_id", "text")
    assert len(out) == 7 and sum(t == "same text " * 60 for _, t in out) == 1
    assert simhash.keep_one_of_each(odd).columns == odd.columns


# ---- op2


def test_perspectives_by_hand(spark):
    talk = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, "ann", "<|im_end|>"), (None, 1, None, "x")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["speaker"]): r for r in chat.perspectives(df).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = out[1, "ann"]
    assert ann["text"] == (
        "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\n<| im_end|><|im_end|>\n"
    )
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|im_end|>", "<| im_end|><|im_end|>"]
    assert (ann["n_turns"], ann["n_trained"], out[1, "bob"]["n_trained"]) == (4, 2, 1)


def test_long_dialogue_in_parts(spark):
    """One conversation with most rows: its parts are those of a plain walk."""
    df = spark.range(1000).select(
        F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"),
    ).repartition(7)
    parts = sorted((r["part"], r["text"]) for r in chat.perspectives(df).filter("speaker = 'a'").collect())
    want = "".join(
        f"<|im_start|>{'assistant' if i % 3 == 0 else 'user name=b'}\n{i}<|im_end|>\n" for i in range(1000)
    )
    assert len(parts) == 16 and "".join(t for _, t in parts) == want
    assert chat.perspectives(df.limit(0)).count() == 0


# ---- op3


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd(odd, none):
    out = langid.identify(odd).collect()
    assert len(out) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 4)} == {1: "und", 2: "und", 3: "und", 4: "und"}
    assert langid.identify(none).count() == 0


# ---- op4


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1, 20_000])
def test_repeats_against_brute_force(spark, monkeypatch, limit):
    """``limit`` 1 sends every open anchor through the window counts instead of the ordering."""
    monkeypatch.setattr(repeats, "MAX_CONTEXTS", limit)
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (400, limit))
    rng = np.random.default_rng(2)
    word = lambda n: bytes(rng.integers(97, 101, n, dtype=np.uint8)).decode()
    shared = [word(n) for n in (399, 400, 401, 700, 1500)]
    texts = [word(int(rng.integers(0, 900))) + shared[i % 5][: int(rng.integers(380, 1500))] + word(int(rng.integers(0, 900))) for i in range(40)]
    texts += ["ab" * 900, "abc" * 300, "", "x" * 399, "x" * 400, "é" * 450, texts[0], "z" * 5 + texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(repeats.repeat_report(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_repeats([t.encode() for t in texts], 400)
    assert got == sorted(((i, *w) for i, w in enumerate(want)), key=repr)


def brute_passages(texts, length):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return out


def test_short_passages_of_many_words_are_reported(spark):
    """51 words and more that two documents share, all below the 400 bytes that are removed; 50 words are none."""
    rng = np.random.default_rng(6)
    own = lambda i, n: " ".join(f"d{i}x{j}" for j in range(n))
    passages = [" ".join(f"{chr(97 + int(c))}{g}q{j}" for j, c in enumerate(rng.integers(0, 26, n))) for g, n in enumerate((50, 51, 52, 60, 65))]
    assert max(len(p.encode()) for p in passages) < 400
    texts = [f"{own(i, 30 + i)} {p} {own(i + 90, 40)}" for p in passages for i in (passages.index(p), passages.index(p) + 5)]
    texts += [own(50 + i, 80) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.repeat_report(df).collect()}
    assert [got[i]["n_passage_words"] for i in range(15)] == [0, 0, 51, 51, 52, 52, 60, 60, 65, 65] + [0] * 5
    assert [got[i]["n_passages"] for i in range(15)] == [0, 0] + [1] * 8 + [0] * 5
    assert {r["n_removed"] for r in got.values()} == {0}


@pytest.mark.parametrize("limit", [1, 20_000])
def test_passages_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (400, limit))
    rng = np.random.default_rng(4)
    gaps = [" ", "\n", "  ", "\t", " \r\n "]
    word = lambda n: "".join(f"{'abÄ'[rng.integers(3)]}{'' if rng.integers(2) else 'xyz'[rng.integers(3)]}{gaps[rng.integers(5)]}" for _ in range(n))
    shared = [word(n) for n in (50, 51, 52, 90, 300)]
    texts = [word(int(rng.integers(0, 120))) + shared[i % 5][: int(rng.integers(90, 700))] + word(int(rng.integers(0, 120))) for i in range(40)]
    texts += ["a " * 500, "a b " * 200, "a b c" * 90, "", " \n", None, "a " * 50, "b " * 51, "\u00a0".join("ab" * 60), texts[0], "z " + texts[1], "A" + texts[2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(repeats.repeat_report(df), "doc_id", "n_passage_words", "n_passages")
    want = brute_passages([(t or "").encode() for t in texts], 51)
    assert got == sorted(((i, *w) for i, w in enumerate(want)), key=repr)


def test_contexts_of_one_anchor_that_share_no_window(spark):
    """Two windows own the same anchor and differ in the rest: nothing repeats, and nothing fails."""
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = word(120)
    df = spark.createDataFrame([(i, word(60) + shared + word(60)) for i in range(8)], "doc_id long, text string")
    met = repeats._anchor_rows(df.selectExpr("doc_id as k", "length(text) as n", "text"), 200).groupBy("h").agg(F.countDistinct("ctx").alias("c"))
    assert met.filter("c > 1").count() > 0
    assert {r["n_removed"] for r in repeats.repeat_report(df, 200).collect()} == {0}
    assert rows(repeats.remove_repeats(df, 200), "doc_id", "text") == rows(df, "doc_id", "text")


def test_remove_repeats_odd(odd, none):
    out = repeats.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert all(not r["text"] for r in out.filter("doc_id in (5, 6)").collect())
    assert repeats.repeat_report(none).count() == 0


# ---- op5


def test_packing_round_trip(spark, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    docs = small(spark).select("doc_id", "text").union(odd.filter("doc_id > 6").select(F.col("doc_id") + 1000, "text"))
    packed = packing.best_two_fit(docs).collect()
    ids = {r["doc_id"]: np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    pieces, places = {}, {}
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 2048 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, cut in pieces.items():
        cut.sort()
        assert [c[0] for c in cut] == list(range(len(cut))) and sum(c[2] for c in cut) == len(ids[doc])
        assert all(c[2] == 2048 for c in cut[1:])
    for spots in places.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:i]) for i in range(len(spots))]
        assert sum(n for _, n in spots) <= 2048
    assert set(pieces) == set(ids) and len(places) <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_ids_of_the_added_token(spark):
    """The library's defaults, with texts that hold the string of the added token."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"x{mark}{mark}  y", f"é  {mark}\n\n 日本", "<|endoftext", f"{mark} don't " * 900, "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert ids[0].tolist() == [64, 220, 50256, 275, 0]
    packed = packing.best_two_fit(docs)
    out = packed.collect()
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in out) == sum(map(len, ids))
    assert sum(r["ids"].count(50256) for r in packing.sequence_ids(docs, packed).collect()) == sum(t.count(mark) for t in texts)


def test_plan_matches_bin_by_bin():
    """The histogram plan is what packing one bin after the other gives."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 60, 500).tolist()
    left, bins = Counter(lengths), []
    while +left:
        bin_, gap = [], 100
        while fit := [v for v in +left if v <= gap]:
            bin_.append(max(fit))
            left[max(fit)] -= 1
            gap -= max(fit)
        if gap and len(bin_) > 1:
            room, free = gap + bin_[-1], +left
            best = max((a + b, a) for a in [0, *free] for b in [0, *free] if a and b and a + b <= room and (a != b or free[a] > 1)) if any(
                a + b <= room and (a != b or free[a] > 1) for a in free for b in free) else (0, 0)
            if best[0] > bin_[-1]:
                left[bin_[-1]] += 1
                bin_[-1:] = [best[1], best[0] - best[1]]
                left.subtract(bin_[-2:])
        bins.append(bin_)
    plan = packing.plan_bins(Counter(lengths), 100)
    assert Counter(v for b, n in plan for v in b * n) == Counter(lengths)
    assert abs(sum(n for _, n in plan) - len(bins)) <= 1 and len(plan) <= 101


def test_packing_odd(odd, none):
    out = packing.best_two_fit(odd).collect()
    assert sum(r["doc_id"] == 5 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1
    assert packing.best_two_fit(none).count() == 0
    one = odd.filter("doc_id in (4, 9)")
    assert sum(len(r["ids"]) for r in packing.sequence_ids(one, packing.best_two_fit(one)).collect()) == sum(
        r["length"] for r in packing.best_two_fit(one).collect())


# ---- op6


def test_longest_repeats_against_brute_force():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 40))).encode() for _ in range(40)] + [b"a " * 50, b""]
    words = quality_rules.split_words(texts, fold=False)
    got = quality_rules.longest_repeats(words)
    for k, t in enumerate(texts):
        w = t.split()
        want = []
        for i in range(len(w)):
            best = 0
            for j in range(len(w)):
                n = 0
                while i != j and i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best)
        assert got[words.first[k] : words.first[k + 1]].tolist() == want


def test_rules_odd(odd, none):
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert out[1]["n_words"] == 0 and out[1]["base_failed"] and not out[5]["kept"] and out[8]["kept"]
    assert out[4]["n_symbols"] == 3 and out[7]["word_chars"] == 30_000
    assert [r["doc_id"] for r in quality_rules.keep_by_rules(odd).collect()] == [8]
    assert quality_rules.quality_rules(none).count() == 0


# ---- op7


def test_base_score_and_model(spark):
    docs = small(spark)
    data = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    counts, held = Counter(), {}
    for d, t in data:
        held[d] = zlib.crc32(str(d).encode()) % 5 == 1
        if not held[d]:
            counts.update([*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    out = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs).collect()}
    for d, t in data:
        w = [*t.encode().lower().split(), None]
        want = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["score"] < 0


def test_attention_is_causal_and_scores_each_id_once():
    from tokenloom.llm import attention

    model = attention.Attention(40).start(np.arange(40))
    class_of = np.arange(attention.N_IDS) % 40
    share = np.log(1 / np.bincount(class_of))[class_of].astype(np.float32)
    ids = np.random.default_rng(6).integers(0, 50_000, 75)
    score = lambda xs: attention.log10_probability(xs, model.tables(), class_of, share)
    p = model.p
    inputs, total = np.concatenate([[attention.BOUND], ids]), 0.0
    for i, target in enumerate([*ids, attention.BOUND]):
        lo = max(0, i - i % 16 - 16)
        x = inputs[lo : i + 1]
        wq, wk, wv = np.split(p["qkv"], 3, axis=1)
        w = (p["emb"][x] @ wk) @ (p["emb"][inputs[i]] @ wq) + p["rel"][i - np.arange(lo, i + 1)]
        w = np.exp(w - w.max())
        h = p["emb"][inputs[i]] + (w / w.sum()) @ (p["emb"][x] @ wv)
        h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        group, member = divmod(int(class_of[target]), attention.GROUP)
        for z, own in ((h @ p["u"] + p["c"], group), (h @ p["ug"][group] + p["cg"][group], member)):
            total += z[own] - np.log(np.exp(z).sum())
        total += share[target]
    assert score([ids])[0] == pytest.approx(total / np.log(10), rel=1e-4)
    both = score([ids[:3], ids, ids[:0]])
    assert both[1] == pytest.approx(score([ids])[0], rel=1e-5) and len(both) == 3


@pytest.mark.parametrize("tasks", [1, 4])
def test_every_training_text_fits_the_weights(spark, monkeypatch, tasks):
    """More texts than any sample, one id of its own in each: the context row of every id moves."""
    from tokenloom.llm import attention

    monkeypatch.setattr(lm_scoring, "TASK_BLOCKS", 2000 // tasks)
    monkeypatch.setattr(lm_scoring, "LEAST_BLOCKS", 2000)
    own = np.arange(1000, 3000)
    rng = np.random.default_rng(7)
    data = [(float(t), np.array([5, i, 6], "<u2").tobytes()) for i, t in zip(own.tolist(), rng.random(len(own)), strict=True)]
    ids = spark.createDataFrame(data, "turn double, ids binary").repartition(4)
    counts, n_blocks = lm_scoring.id_counts(ids)
    assert n_blocks == 2000 and counts[attention.BOUND] == 2000 and (counts[own] == 1).all()
    class_of = np.arange(attention.N_IDS) % 128
    fresh = attention.Attention(128).p["emb"]
    model = lm_scoring.fit(ids, attention.Attention(128), class_of, n_blocks)
    moved = (model.p["emb"] != fresh).any(axis=1)
    assert moved[own].all() and moved[[5, 6]].all() and not moved[:5].any()
    assert all(np.isfinite(v).all() for v in model.p.values())


def test_attention_gradients():
    """Against differences of the loss, for weights of every kind."""
    from tokenloom.llm import attention

    rng = np.random.default_rng(8)
    model = attention.Attention(40, seed=2).start(np.arange(40))
    class_of, share = np.arange(attention.N_IDS) % 40, np.zeros(attention.N_IDS, np.float32)
    texts = [rng.integers(0, 50, n) for n in (3, 40, 16, 0)]
    n_ids = sum(len(t) + 1 for t in texts)
    blocks = attention.to_blocks(texts)
    grads, ids, rows = model._gradients(blocks, 0, len(blocks.inputs), class_of)
    emb = np.zeros_like(model.p["emb"])
    emb[ids] = rows
    loss = lambda: -attention.log10_probability(texts, model.tables(), class_of, share).sum() * np.log(10) / n_ids
    for name, g in {**grads, "emb": emb}.items():
        flat, want = model.p[name].reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(want))[:3]:
            old, step = flat[i], np.float32(2e-3)
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * float(step)) == pytest.approx(want[i], rel=0.05, abs=2e-4), name


def test_stretches_equal_whole_texts(monkeypatch):
    """Ids and words as those of the whole texts, at every bound on what is kept, and known stretches are not encoded again."""
    from tokenloom.llm import stretches
    from tokenloom.llm.encode import encode
    from tokenloom.llm.words import split_words, xxh64

    rng = np.random.default_rng(9)
    bits = [" ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "a", "Bc", "'s", "'ll", "12",
            "\xe9", "\u4e2d", "\u306e", "!", "...", "<|endoftext|>", "\U0001f600", "\u0301", "x" * 90]
    groups = [["".join(rng.choice(bits, rng.integers(0, n))) for n in (1, 3, 9, 40, 200, 1)] for _ in range(40)] + [[], ["", " ", ""]]
    for kept in (1 << 19, 20, 0):
        monkeypatch.setattr(stretches, "KEPT", kept)
        mine = stretches.Stretches(None)
        for texts in groups:
            raws = [t.encode() for t in texts]
            w, want = split_words(raws), [encode(t).tolist() for t in texts]
            ids, n_ids, words, n_words = mine.read(raws)
            assert ids.tolist() == sum(want, []) and n_ids.tolist() == [len(x) for x in want]
            assert words.tolist() == xxh64(w.buffer, w.starts, w.ends - w.starts).tolist() and n_words.tolist() == w.counts.tolist()
            assert len(mine.hashes) == len(mine.rows) <= kept and len(mine.hashes) == len(mine.ids.n) == len(mine.words.n)
    seen = []
    monkeypatch.setattr(stretches, "encode", lambda t, v: seen.append(t) or encode(t, v))
    monkeypatch.setattr(stretches, "KEPT", 1 << 19)
    mine, raw = stretches.Stretches(None), [b"one two three two one", b"two three" * 50]
    first = mine.read(raw)
    seen.clear()
    again = mine.read(raw)
    assert "".join(seen) in ("onetwo", "twoone") and all((a == b).all() for a, b in zip(first, again, strict=True))


def test_lm_odd(odd, none):
    out = lm_scoring.lm_scores(odd).collect()
    assert len(out) == len(ODD) and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in out)
    assert lm_scoring.lm_scores(none).count() == 0


# ---- op8


def test_quality_held_out(spark):
    docs, marks = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    out = cotraining.score_quality(docs, marks).join(marks, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in out]) > 0.85


def test_quality_of_unseen_labels(spark):
    """Only labels of documents that neither the fit nor the calibration has seen are judged."""
    docs, marks = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    away = "pmod(xxhash64(doc_id), 3) = 0"
    out = cotraining.score_quality(docs, marks.filter(f"not {away}")).join(marks.filter(away), "doc_id").collect()
    assert len(out) > 1000
    assert np.mean([r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in out]) > 0.9


def test_quality_names_from_all_unlabelled(spark, monkeypatch):
    """Each round's named documents are the surest of all unlabelled rows, by a plain sort."""
    seen = []
    plain = cotraining.view_odds
    monkeypatch.setattr(cotraining, "view_odds", lambda *a: seen.append(plain(*a)) or seen[-1])
    named = []
    made = cotraining.features
    monkeypatch.setattr(cotraining, "features", lambda rows: named.append(rows) or made(rows))
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.union(docs.limit(20))
    cotraining.score_quality(docs, marks, rounds=1, per_round=10, sure=0.1)
    labelled = {r["doc_id"] for r in marks.collect()}
    odds = {r["doc_id"]: r for r in seen[0].collect() if r["doc_id"] not in labelled}
    assert len(odds) == docs.select("doc_id").distinct().count() - len(labelled & {r["doc_id"] for r in docs.collect()})
    got = {r["doc_id"] for r in named[1].collect()}
    assert got and got <= set(odds)
    for by in ("by_text", "by_meta"):
        for sign in (1, -1):
            z = sorted(sign * r[by] for r in odds.values())
            if z[0] <= -0.1:
                assert any(sign * odds[i][by] == z[0] for i in got)


def test_quality_odd(odd, none, labels):
    out = cotraining.score_quality(odd, labels).collect()
    assert len(out) == len(ODD) and all(r["kept"] for r in out)
    assert cotraining.score_quality(none, labels).count() == 0


# ---- op9


def test_url_rules(spark):
    data = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://net/"), (3, "https://net"), (4, "x://example.com/de/#a"), (5, "http://b.org/fr/1"),
        (6, None), (7, "no scheme"), (None, "http://notnet/"), (8, "http://xexample.net/en/"), (9, "a://b://c.net/d"),
    ]
    out = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(data, "page_id long, url string")).collect()}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in out.items()} == {
        1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("net", "/", "net/"), 3: ("net", "", None),
        4: ("example.com", "/de/", "example.com/de/"), 5: ("b.org", "/fr/1", "org/fr/"), 6: ("", "", None), 7: ("", "", None),
        None: ("notnet", "/", None), 8: ("xexample.net", "/en/", "net/"), 9: ("b:", "//c.net/d", None),
    }
    assert out[1]["verdict"] == "allow" and out[2]["verdict"] == "block"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_tells_the_classes_apart(spark):
    pages = spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    out = urls.filter_urls(pages).filter("rule is not null").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["verdict"] == "allow") for r in out]) > 0.9


def test_markov_probabilities_sum_to_one():
    model = urls.Markov.fit([b"abab", b"abc", b""])
    for context in (b"", b"a", b"zz"):
        keys, _, _, _ = urls.contexts([context + bytes([c]) for c in range(256)])
        at = np.arange(256) * (len(context) + 2) + len(context)
        p = np.exp(model.log_likelihood(keys[:, at], np.arange(256).astype(np.uint64))).sum()
        end = np.exp(model.log_likelihood(urls.contexts([context])[0][:, -1:], np.array([256], np.uint64))).sum()
        assert p + end == pytest.approx(1)


# ---- op10


def test_templates_and_slots(spark):
    item = "If today Anna quickly buys 12 green apples for her aunt and then Anna sells 5 red apples for 3 dollars how many remain"
    docs = [
        (1, "Intro. " + item + " end"), (2, "so " + item.replace("Anna", "Bob").replace("12", "40") + " ok"),
        (3, item.replace("Anna", "Bob", 1)), (4, "nothing of the kind in this short text at all"), (5, None), (None, "x"),
    ]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "two words")], "item_id long, text string")
    out = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    # in 3 one Anna became Bob and the other did not: each window fits alone, the placement does not
    assert out == {1: True, 2: True, 3: False, 4: False, 5: False, None: False}


def test_whole_copies_are_found(spark):
    """Items of one window after a heading, of few words, and of numbers and names."""
    items = ["What is the capital of France?", "Name the author", "Sum 1 2 3 4 5 6 7 8 9 10", "two words"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(0, f"Some questions\n{items[0]} Paris"), (1, "Please name the author, now"), (2, f"so {items[2].lower()} ok"),
            (3, "here are two words"), (4, "Sum 1 2 3 4 5 6 7 8 and 9 10"), (5, "the author name")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert out == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_planted_items_are_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join((t or "").lower().split())
    items = [flat(r["text"]) for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in flat(r["text"]) for i in items)}
    got = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).filter("contaminated").collect()}
    assert got == want and want


def test_decontamination_odd(odd, none, bench):
    out = decontaminate.decontaminate(odd, bench).collect()
    assert len(out) == len(ODD) and not any(r["contaminated"] for r in out)
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.decontaminate(none, bench).count() == 0


# ---- pipeline and SQL


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["op2_chat_perspectives", "op6_suffix_array_rules"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    got = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    order = lambda xs: sorted(repr(sorted(x.items())) for x in xs)
    assert order(got) == order(want)


# ---- long white space, odd column names


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n\t "])
def test_long_white_space_encodes_as_the_json_form(blank):
    import public_tokenizers
    import tokenizers

    from tokenloom.llm.encode import encode, encode_added

    json_form = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = blank * (1_000_000 // len(blank))
    for text in (run, run + "end", f"a{run}b {run}!", f"x{run}<|endoftext|>{run}y"):
        want = json_form.encode(text, add_special_tokens=False).ids
        assert encode_added(text).tolist() == want
        if "<|" not in text:
            assert encode(text).tolist() == want


def test_long_white_space_is_packed_and_scored(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n\t" * 500_000 + "end"), (3, "word")], "doc_id long, text string")
    assert {r[0] for r in packing.best_two_fit(docs).select("doc_id").distinct().collect()} == {1, 2, 3}
    assert lm_scoring.lm_scores(docs).count() == 3


CLASH = "doc_id long, text string, k long, n long, spans string, _text_key long, `a.b` string, h long, row string, n_chars int"


def test_clashing_and_dotted_names_pass_every_stage(spark):
    words = " ".join(f"w{i % 97}x{i}" for i in range(120))
    docs = spark.createDataFrame(
        [(i, f"{words if i < 2 else ''} " + " ".join(f"u{i}v{j}" for j in range(80)), 1, 2, "s", 7, "dot", 3, "r", 5) for i in range(4)], CLASH,
    )
    assert quality_rules.keep_by_rules(docs).columns == docs.columns
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["_text_key"] for r in kept.collect()} == {7}
    cut = repeats.remove_repeats(docs, 200)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r for r in cut.collect()}
    assert words not in got[0]["text"] and got[2]["a.b"] == "dot" and got[3]["k"] == 1
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    items = spark.createDataFrame([(1, "u2v3 u2v4 u2v5 u2v6 u2v7 u2v8 u2v9 u2v10 u2v11")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {0, 1, 3}


def test_roles_that_look_alike_stay_apart(spark):
    talk = spark.createDataFrame([(1, 0, "a|b", "one"), (1, 1, "a b", "two")], "conv_id long, turn long, role string, text string")
    got = {r["speaker"]: r["n_trained"] for r in chat.perspectives(talk).collect()}
    assert got == {"a|b": 1, "a b": 1}


def test_passages_of_51_words_leave_the_stage(spark):
    import corpus_pipeline

    passage = " ".join(f"wo{i % 7}r{i}" for i in range(51))  # some 300 bytes
    docs = spark.createDataFrame(
        [(i, f"own{i}a own{i}b {passage} own{i}c" if i < 2 else f"alone{i} " * 9) for i in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert len(passage.encode()) < 400 and passage not in got[0] and passage not in got[1]
    assert got[0].startswith("own0a own0") and got[2] == "alone2 " * 9

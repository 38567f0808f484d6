"""Encoding and decoding: both strategies, an outside implementation, edge texts."""

import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tokenloom.functions import bytelevel
from tokenloom.operators import bpe
from tokenloom.sources.model import (
    BpeModel, load_model, model_from_merges, model_relations, save_model, toy_model, unordered_merges, write_model,
)

EDGE = [
    "", " ", "a", "two  blanks", "three   blanks at end   ", "tab\tand\nnewline \n x", "no break",
    "nul\x00byte", "emoji 😀👩‍👩‍👧", "it's we'll I'M '", "[PAD] inside [MASK]text[CLS]", "x ![SEP]!", "[ PAD]",
    "123 4567 ½ ²", "über Straße élève", "  line sep", "private  use", "a" * 500, "日本語テキスト", "non\uffffcharacter \uffff the",
]


def outside(model, added):
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer(tk.models.BPE(vocab=dict(model.vocab), merges=list(model.merges)))
    t.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
    if added:
        big = tk.Tokenizer(tk.models.BPE(vocab={**model.added, **model.vocab}, merges=list(model.merges)))
        big.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
        big.add_special_tokens(list(model.added))
        return big
    return t


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def ids_of(df):
    return {r.i: list(r.ids) if r.ids is not None else None for r in df.select("i", "ids").collect()}


@pytest.mark.parametrize("added", [False, True])
@pytest.mark.parametrize("strategy", ["fold", "arrow"])
def test_edge_texts_match_outside(spark, model, strategy, added):
    got = ids_of(bpe.bpe_encode(texts(spark, EDGE), model, strategy=strategy, use_added=added))
    ref = outside(model, added)
    for i, text in enumerate(EDGE):
        assert got[i] == ref.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents_match_outside(spark, model):
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(doc_id as int) as i", "text")
    got = ids_of(bpe.bpe_encode(df, model))
    ref = outside(model, True)
    for r in df.collect():
        assert got[r.i] == ref.encode(r.text, add_special_tokens=False).ids


def test_null_text_gives_null(spark, model):
    df = spark.createDataFrame([(0, None), (1, "x")], "i int, text string")
    for strategy in ("fold", "arrow"):
        got = ids_of(bpe.bpe_encode(df, model, strategy=strategy))
        assert got[0] is None and len(got[1]) == 1


def _big_model(n):
    tk = pytest.importorskip("tokenizers")
    import duckdb

    docs = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    t = tk.Tokenizer(tk.models.BPE())
    t.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = tk.trainers.BpeTrainer(
        vocab_size=256 + n, initial_alphabet=tk.pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    t.train_from_iterator(docs, trainer)
    import json

    merges = [tuple(m) for m in json.loads(t.to_str())["model"]["merges"]]
    return model_from_merges(merges)


def test_large_model_goes_through_arrow(spark):
    big = _big_model(2000)
    assert "merges" in big.fold_problem()
    with pytest.raises(ValueError, match="fold"):
        bpe.bpe_encode(texts(spark, ["x"]), big, strategy="fold")
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(doc_id as int) as i", "text")
    got = ids_of(bpe.bpe_encode(df, big))
    ref = outside(big, True)
    for r in df.collect():
        assert got[r.i] == ref.encode(r.text, add_special_tokens=False).ids


def test_duplicate_product_is_found(spark):
    twice = model_from_merges([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])
    assert "exists already" in twice.fold_problem()
    got = ids_of(bpe.bpe_encode(texts(spark, ["abc", "bc abc"]), twice))
    ref = outside(twice, True)
    assert got[0] == ref.encode("abc").ids and got[1] == ref.encode("bc abc").ids


def test_fold_problem_names_bad_models(model):
    assert model.fold_problem() is None
    assert "no earlier merge" in model_from_merges([("ab", "c")]).fold_problem()
    clash = BpeModel({**model.vocab, "zz": 5}, model.merges, model.added)
    assert "share an id" in clash.fold_problem()


def test_short_and_long_merge_agree(model):
    ranks = {m: i for i, m in enumerate(model.merges)}
    rng = random.Random(5)
    alphabet = ["Ġ", "t", "h", "e", "a", "n", "d", "i", "o", "r", "s"]
    for _ in range(300):
        symbols = [rng.choice(alphabet) for _ in range(rng.randrange(1, 120))]
        assert bpe._merge_short(symbols, ranks) == bpe._merge_long(symbols, ranks)


@pytest.mark.parametrize("strategy", ["fold", "arrow"])
def test_without_pretokenizer(spark, model, strategy):
    """Merges may then cross blanks."""
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer(tk.models.BPE(vocab=dict(model.vocab), merges=list(model.merges)))
    t.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    values = ["the end of the end", "a  b  the", "on the 'the"]
    got = ids_of(bpe.bpe_encode(texts(spark, values), model, strategy=strategy, pretokenizer="none", use_added=False))
    for i, v in enumerate(values):
        assert got[i] == t.encode(v).ids


def test_decode_returns_the_text(spark, model):
    df = bpe.bpe_encode(texts(spark, EDGE), model)
    back = df.select("text", bpe.bpe_decode(F.col("ids"), model).alias("b")).collect()
    assert all(r.text == r.b for r in back)
    odd = spark.createDataFrame([([999999, 5 + ord("A")],), ([5 + 0xC3],)], "ids array<int>")
    assert [r.b for r in odd.select(bpe.bpe_decode(F.col("ids"), model).alias("b")).collect()] == ["A", "�"]


def test_byte_symbols_and_maps(spark):
    symbols = bytelevel.byte_symbols()
    assert len(set(symbols)) == 256 and symbols[32] == "Ġ" and symbols[10] == "Ċ"
    df = texts(spark, EDGE)
    back = df.select("text", bytelevel.byte_unmap(bytelevel.byte_map(F.col("text"))).cast("string").alias("b"))
    assert all(r.text == r.b for r in back.collect())


def test_pack_round_trip(spark):
    rows = [([],), ([0, 1, 2**31 - 1],), ([5] * 1000,)]
    df = spark.createDataFrame(rows, "ids array<int>")
    out = df.select(
        "ids",
        bytelevel.pack_u32(F.col("ids")).alias("native"),
        bpe.pack_ids("ids").alias("arrow"),
        bytelevel.unpack_u32(F.concat(bytelevel.pack_u32(F.col("ids")), F.lit(bytearray(b"xyz")))).alias("back"),
        bytelevel.frame_u64_count(F.col("ids")).alias("frame"),
    ).collect()
    for r in out:
        want = b"".join(i.to_bytes(4, "little") for i in r.ids)
        assert bytes(r.native) == want == bytes(r.arrow)
        assert list(r.back) == list(r.ids)
        assert bytes(r.frame) == len(r.ids).to_bytes(8, "little") + want
    high = spark.sql("select unhex('FFFFFFFF00000080') as b").select(bytelevel.unpack_u32(F.col("b")).alias("u"))
    assert high.first().u == [2**32 - 1, 2**31]


@pytest.mark.parametrize("as_lists", [True, False])
def test_model_files(spark, model, folder, as_lists):
    as_json, as_text = save_model(model, folder, as_lists)
    assert load_model(spark, as_json) == model
    assert load_model(spark, as_json, as_text) == model
    with pytest.raises(Exception):
        load_model(spark, folder + "/missing.json")


def test_sql_functions(spark, model):
    from tokenloom.functions.registry import register_functions

    register_functions(spark, model)
    text = "it's the “end” of the world"
    r = spark.sql(
        "select bpe_encode(:t) e, bpe_decode(bpe_encode(:t)) d, pack_u32(array(1L, 70000L)) p, "
        "unpack_u32(unhex('0100000070110100FF')) u", args={"t": text}).first()
    assert r.d == text and bytes(r.p) == (1).to_bytes(4, "little") + (70000).to_bytes(4, "little")
    assert r.u == [1, 70000]
    assert list(r.e) == outside(model, False).encode(text).ids


@pytest.mark.parametrize("as_lists", [True, False])
def test_model_file_as_relations(spark, tmp_path, as_lists):
    model = toy_model()
    path = write_model(spark, model, str(tmp_path / "model"), as_lists)
    rows = [sorted(tuple(r) for r in df.collect()) for df in model_relations(spark, path)]
    assert rows == [sorted(tuple(r) for r in df.collect()) for df in model.relations(spark)]
    assert load_model(spark, path) == model


def test_model_file_faults(spark, tmp_path):
    sound = model_from_merges([("a", "b"), ("ab", "c")])
    vocab, merges, _ = sound.relations(spark)
    assert unordered_merges(vocab, merges).count() == 0
    # the parts of the first merge are made by the second, and "zz" has no id
    late = BpeModel(sound.vocab, (("ab", "c"), ("a", "b"), ("z", "z")), {})
    vocab, merges, _ = late.relations(spark)
    assert sorted(tuple(r) for r in unordered_merges(vocab, merges).collect()) == [(0, "ab"), (2, "zz")]
    bad = BpeModel(sound.vocab, (("a", "b", "c"),), {})
    with pytest.raises(Exception, match="two parts"):
        model_relations(spark, write_model(spark, bad, str(tmp_path / "bad")))[1].collect()


def test_packed_encoding_equals_packed_ids(spark, model):
    texts = [None, "", "the end", "é の the\n", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for strategy in ("arrow", "fold"):
        lists = bpe.bpe_encode(df, model, strategy=strategy).select("doc_id", bpe.pack_ids("ids").alias("want"))
        both = bpe.bpe_encode(df, model, out="got", strategy=strategy, packed=True).join(lists, "doc_id").collect()
        assert len(both) == len(texts) and all(r.got == r.want for r in both)
        assert [r.got for r in both if r.doc_id == 0] == [None]


def test_fold_merges_each_distinct_piece_once(spark, model, monkeypatch):
    """Rows that repeat, have no key, or hold dots in their names; the merges see no piece twice."""
    seen = []
    plain = bpe.materialize
    monkeypatch.setattr(bpe, "materialize", lambda df, label: seen.append((label, plain(df, label))) or seen[-1][1])
    rows = [("the end of the end " * 50, 1)] * 3 + [(None, 2), ("", 3), ("the end", None)]
    df = spark.createDataFrame(rows, "text string, `a.b` int").repartition(3)
    fold, arrow = (bpe.bpe_encode(df, model, strategy=s) for s in ("fold", "arrow"))
    assert fold.columns == arrow.columns == ["text", "a.b", "ids"]
    assert sorted(map(repr, fold.collect())) == sorted(map(repr, arrow.collect()))
    pieces = dict(seen)["pieces"]
    assert pieces.count() == pieces.select("_piece").distinct().count() == len({"the", " end", " of", " the", " "})
    over = bpe.bpe_encode(df, model, out="text", strategy="fold")
    assert over.columns == ["text", "a.b"] and sorted(map(repr, over.select("text").collect())) == sorted(
        map(repr, fold.select(F.col("ids").alias("text")).collect()))


def test_batches_are_encoded_in_slices(model, monkeypatch):
    """What a batch needs beside its ids follows the slice, not the batch; a long row stands alone."""
    import pyarrow as pa

    unknown = model.added.get("[UNK]")
    encode = bpe._PieceEncoder(model.vocab, model.merges, model.added, unknown)
    words = pa.array([["the", " end"]] * 7 + [None, [], [" a"] * 40, None] + [["x"]] * 9, pa.list_(pa.string()))
    whole, sizes, plain = bpe._encode_batch(words, encode), [], bpe._encode_batch
    monkeypatch.setattr(bpe, "SLICE_PIECES", 8)
    monkeypatch.setattr(bpe, "_encode_batch", lambda w, e: sizes.append(len(w.flatten())) or plain(w, e))
    parts = list(bpe._encode_slices(words, encode))
    assert pa.concat_arrays(parts).to_pylist() == whole.to_pylist() and len(parts) > 2
    assert sum(sizes) == len(words.flatten()) and max(sizes) < 40 + 8
    assert list(bpe._encode_slices(words.slice(0, 0), encode)) == []


def test_fold_keeps_places_where_they_are(spark, model):
    """Rows are neither written, joined nor grouped for the fold, and no row holds its table of pieces."""
    df = spark.createDataFrame([("the end of the end", 1), (None, 2), ("[CLS]x", None)], "text string, i int")
    plain = bpe.bpe_encode(df, model, strategy="fold")
    made = bpe.bpe_encode(df.withColumn("text", F.concat("text", F.lit(" x"))), model, strategy="fold", packed=True)
    for out in (plain, made, made.where("octet_length(ids) > 0")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        steps = set(re.findall(r"^[ +-]*([A-Z]\w+)", plan, re.M))  # without those of the subquery
        assert {"Project", "LogicalRDD"} <= steps <= {"Project", "LogicalRDD", "Filter", "ArrowEvalPython"}
        assert "scalar-subquery" in plan and "AS _slots#" not in plan and plan.count("element_at(") == 1


def test_fold_with_few_known_pieces(spark, model, monkeypatch):
    """The table holds the most frequent pieces up to a number and a length; the ids do not depend on it."""
    seen, plain = [], bpe.materialize
    monkeypatch.setattr(bpe, "materialize", lambda df, label: seen.append((label, plain(df, label))) or seen[-1][1])
    long = "y" * (bpe.CACHED_WORD_BYTES + 1)
    df = texts(spark, [*EDGE, f" the end the end the {long} {long}", " the end é the"])
    want = ids_of(bpe.bpe_encode(df, model))
    for n, known in ((0, set()), (1, {" the"}), (2, {" the", " end"}), (bpe.FOLD_PIECES, None)):
        monkeypatch.setattr(bpe, "FOLD_PIECES", n)
        assert ids_of(bpe.bpe_encode(df, model, strategy="fold")) == want
        got = {r[0] for r in dict(seen)["pieces"].select("_piece").collect()}
        assert got == known if known is not None else {" the", " end", "é"} & got and not any(long in p for p in got)
    none = spark.createDataFrame([], "i int, text string")
    assert ids_of(bpe.bpe_encode(none, model, strategy="fold")) == {}

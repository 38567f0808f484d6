"""Byte-level BPE models: loading, validation and their relational form."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.bytelevel import byte_symbols

# The five added tokens and their reserved ids.
ADDED_TOKENS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4}

# Private-use characters U+E000..U+F8FE carry ids in the merge fold; U+F8FF is
# the word border.
PRIVATE_BASE = 0xE000
PRIVATE_IDS = 0xF8FF - PRIVATE_BASE
BORDER = chr(0xF8FF)
# The fold scans each text once per merge, so long merge lists go another way.
FOLD_MAX_MERGES = 1000


@dataclass(frozen=True)
class BpeModel:
    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...]
    added: dict[str, int] = field(default_factory=dict)

    def relations(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``vocab(token,id)``, ``merges(rank,left,right)``, ``added(token,id)``."""
        vocab = spark.createDataFrame(list(self.vocab.items()), "token string, id int")
        merges = spark.createDataFrame(
            [(rank, l, r) for rank, (l, r) in enumerate(self.merges)],
            "rank int, left string, right string",
        )
        added = spark.createDataFrame(list(self.added.items()), "token string, id int")
        return vocab, merges, added

    def fold_problem(self) -> str | None:
        """Why rank-ordered whole-text merging would differ from lowest-rank-first."""
        known = set(byte_symbols())
        if len(self.merges) > FOLD_MAX_MERGES:
            return f"more than {FOLD_MAX_MERGES} merges"
        if max(self._ids_used(), default=0) >= PRIVATE_IDS:
            return "an id beyond the private-use range"
        missing = known - self.vocab.keys()
        if missing:
            return f"{len(missing)} byte symbols without an id"
        for rank, (l, r) in enumerate(self.merges):
            product = l + r
            if l not in known or r not in known:
                return f"merge {rank} uses a part that no earlier merge makes"
            if product in known:
                return f"merge {rank} makes a symbol that exists already"
            if product not in self.vocab:
                return f"merge {rank} makes a token without an id"
            known.add(product)
        if len(set(self.vocab.values())) != len(self.vocab):
            return "two tokens share an id"
        return None

    def _ids_used(self) -> list[int]:
        return [*self.vocab.values(), *self.added.values()]

    def decode_table(self) -> list[str]:
        """Latin-1 byte string of every id, by id; '' where an id has no token."""
        back = {s: chr(b) for b, s in enumerate(byte_symbols())}
        table = [""] * (max(self._ids_used(), default=-1) + 1)
        for token, i in self.vocab.items():
            table[i] = "".join(back.get(ch, "") for ch in token)
        for token, i in self.added.items():
            table[i] = token.encode("utf-8").decode("latin-1")
        return table


def _parse_merges(items) -> tuple[tuple[str, str], ...]:
    pairs = []
    for item in items:
        parts = item.split(" ") if isinstance(item, str) else list(item)
        if len(parts) != 2:
            raise ValueError(f"a merge needs two parts, got {item!r}")
        pairs.append((parts[0], parts[1]))
    return tuple(pairs)


def _read_text(spark: SparkSession, path: str) -> str:
    """A whole small model file through Spark's own file systems; missing -> error."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one model file")
    return rows[0][0]


def load_model(
    spark: SparkSession,
    model_json: str,
    merges_txt: str | None = None,
    added: dict[str, int] | None = None,
) -> BpeModel:
    """Load ``model.vocab`` and the merges (from the JSON, or one ``left right`` per line)."""
    body = json.loads(_read_text(spark, model_json))["model"]
    if merges_txt is not None:
        lines = _read_text(spark, merges_txt).split("\n")
        merges = _parse_merges(l for l in lines if l and not l.startswith("#version"))
    else:
        merges = _parse_merges(body.get("merges", []))
    added = dict(ADDED_TOKENS if added is None else added)
    vocab = {t: int(i) for t, i in body["vocab"].items() if t not in added}
    return BpeModel(vocab, merges, added)


def save_model(model: BpeModel, folder: str, merges_as_lists: bool = True) -> tuple[str, str]:
    """Write ``model.json`` and ``merges.txt`` (small files, for tests and exchange)."""
    os.makedirs(folder, exist_ok=True)
    as_json, as_text = os.path.join(folder, "model.json"), os.path.join(folder, "merges.txt")
    merges = [list(m) if merges_as_lists else " ".join(m) for m in model.merges]
    with open(as_json, "w", encoding="utf-8") as f:
        json.dump({"model": {"vocab": {**model.added, **model.vocab}, "merges": merges}}, f,
                  ensure_ascii=False)
    with open(as_text, "w", encoding="utf-8") as f:
        f.writelines(f"{l} {r}\n" for l, r in model.merges)
    return as_json, as_text


def write_model(spark: SparkSession, model: BpeModel, path: str, merges_as_lists: bool = True) -> str:
    """The model's JSON as one file in the folder ``path``, written by Spark to any store."""
    merges = [list(m) if merges_as_lists else " ".join(m) for m in model.merges]
    body = json.dumps({"model": {"vocab": {**model.added, **model.vocab}, "merges": merges}}, ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def model_relations(
    spark: SparkSession, model_json: str, added: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:meth:`BpeModel.relations` straight from a model file, without a model in Python.

    Merges are pairs or strings ``left right``; a merge of other than two parts is an error.
    """
    names = ADDED_TOKENS if added is None else added
    text = spark.read.text(model_json, wholetext=True)

    def body(merges: str) -> Column:
        return F.from_json("value", f"model struct<vocab:map<string,int>,merges:array<{merges}>>")["model"]

    entries = text.select(F.explode(body("string")["vocab"]).alias("token", "id"))
    is_added = F.col("token").isin(list(names))
    pairs, strings = body("array<string>")["merges"], body("string")["merges"]
    in_pairs = F.exists(pairs, lambda m: m.isNotNull())
    parts = F.when(in_pairs, pairs).otherwise(F.transform(strings, lambda m: F.split(m, " ", -1)))
    merges = text.select(F.posexplode(parts).alias("rank", "parts")).select(
        "rank", F.when(F.size("parts") == 2, F.col("parts")).otherwise(
            F.raise_error(F.concat(F.lit("a merge needs two parts: "), F.to_json("parts")))).alias("parts"),
    ).select("rank", F.col("parts")[0].alias("left"), F.col("parts")[1].alias("right"))
    return entries.where(~is_added), merges, entries.where(is_added)


def unordered_merges(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges ``(rank, part)`` that use a part which is neither a byte symbol nor made by an earlier merge,
    or whose product (``part``) has no id: one row per fault, none for a sound model."""
    spark = merges.sparkSession
    symbols = spark.createDataFrame([(c, -1) for c in byte_symbols()], "part string, made int")
    product = F.concat("left", "right")
    made = merges.groupBy(product.alias("part")).agg(F.min("rank").alias("made")).unionByName(symbols)
    uses = merges.select("rank", F.explode(F.array("left", "right")).alias("part"))
    early = uses.join(made, "part", "left").where("made is null or made >= rank").select("rank", "part")
    nameless = merges.select("rank", product.alias("part")).join(vocab, F.col("part") == vocab["token"], "left_anti")
    return early.unionByName(nameless)


def model_from_merges(merges, added: dict[str, int] | None = None) -> BpeModel:
    """Vocab by rule: added tokens, then the 256 byte symbols, then merge products."""
    added = dict(ADDED_TOKENS if added is None else added)
    vocab: dict[str, int] = {}
    for token in [*byte_symbols(), *(l + r for l, r in merges)]:
        vocab.setdefault(token, len(added) + len(vocab))
    return BpeModel(vocab, tuple(merges), added)


def toy_model() -> BpeModel:
    """The small model shipped with the package: 461 ids, 200 merges."""
    path = os.path.join(os.path.dirname(__file__), "..", "models", "toy_merges.txt")
    with open(path, encoding="utf-8") as f:
        return model_from_merges(_parse_merges(line.rstrip("\n") for line in f))


def vocab_lookup(df: DataFrame, model: BpeModel, token: str | None = None,
                 id: str | None = None) -> DataFrame:
    """Add ``found_id`` (-1 if absent) and/or ``found_token`` ('' if absent), ``vocab_size``."""
    spark = df.sparkSession
    entries = {**model.vocab, **model.added}
    table = spark.createDataFrame(list(entries.items()), "_t string, _i int")
    out = df
    if token is not None:
        side = table
        out = (out.join(side, F.col(token) == F.col("_t"), "left")
               .withColumn("found_id", F.coalesce("_i", F.lit(-1))).drop("_t", "_i"))
    if id is not None:
        side = table
        out = (out.join(side, F.col(id) == F.col("_i"), "left")
               .withColumn("found_token", F.coalesce("_t", F.lit(""))).drop("_t", "_i"))
    return out.withColumn("vocab_size", F.lit(len(entries)))


def added_names(model: BpeModel, use_added: bool) -> list[str] | None:
    return list(model.added) if use_added and model.added else None


def json_literal(value, ddl: str) -> Column:
    """A nested constant handed over as one JSON literal (folded by the optimizer)."""
    return F.from_json(F.lit(json.dumps(value)), ddl)

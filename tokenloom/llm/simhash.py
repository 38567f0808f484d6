"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits, each vector equally often; table ``v``
keeps the positions whose vector has odd parity with ``v``. The vectors of up to ``radius``
differing positions span too little to meet every ``v``, so some table drops all of them:
each pair within the radius shares that table's masked key. For 64 bits and a radius of 4 these
are 31 tables of 32 bits each, and no pair is missed.

Copies of one fingerprint are one node. A bucket of two nodes is a pair, a bucket up to
``PAIRWISE`` is compared inside its task and gives a spanning forest of links, never all pairs.
Fingerprints of larger buckets are linked through middles instead: two within 4 bits have a
middle within 2 bits of both, and all that share a middle are within 4, so a middle's group
(at most 2,081 fingerprints) is linked as a star. That is exact and linear, so there is no cap.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_rows, place_names, texts_of
from tokenloom.llm.graph import components
from tokenloom.llm.words import split_words, windows, xxh64
from tokenloom.session import materialize

BITS = 64
PAIRWISE = 2048


def simhash(texts: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts; bit 1 where over half of the shingle hashes have it."""
    words = split_words(texts)
    first, last, doc = windows(words, shingle, whole=True)
    out = np.zeros(len(texts), dtype=np.uint64)
    if len(first):
        begin = words.starts[first]
        hashes = xxh64(words.buffer, begin, words.ends[last] - begin)
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        n = np.diff(np.append(cut, len(doc)))
        value = np.zeros(len(cut), dtype=np.uint64)
        for byte in range(8):
            column = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
            bits = np.unpackbits(column[:, None], axis=1, bitorder="little")
            ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
            value |= np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
        out[doc[cut]] = value
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, text_key, fp`` (the 64 bits as a signed long) of whole texts; no word gives 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = simhash(texts_of(batch.column(2)), shingle)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_rows(rows, run, "doc_id long, text_key long, fp long", 2 << 20)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Signed masks of the ``2 ** (radius + 1) - 1`` tables."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(radius)
    vectors = rng.permutation(np.arange(bits) % size) if size <= bits else rng.choice(size, bits, replace=False)
    masks = []
    for v in range(1, size):
        odd = [i for i in range(bits) if int(vectors[i] & v).bit_count() & 1]
        mask = sum(1 << i for i in odd)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the radius connects: every value to one seen before it."""
    fresh, links = np.sort(values), []
    while len(fresh):
        front, fresh = fresh[:1], fresh[1:]
        while len(front) and len(fresh):
            near_at = np.full(len(fresh), -1)
            for k, x in enumerate(front):
                near = (near_at < 0) & (np.bitwise_count((fresh ^ x).view(np.uint64)) <= radius)
                near_at[near] = k
            hit = near_at >= 0
            links += zip(front[near_at[hit]].tolist(), fresh[hit].tolist(), strict=True)
            front, fresh = fresh[hit], fresh[~hit]
    return links


def links_within(nodes: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` whose components are those of all
    pairs within ``radius`` bits. ``nodes`` is read several times: pass a written table."""
    keys = nodes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])).alias("tab", "key")
    )
    buckets = materialize(
        keys.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1"), "buckets",
    )
    pairs = buckets.filter("n = 2").filter(_distance(F.col("a"), F.col("b")) <= radius).select("a", "b")
    members = keys.join(buckets.filter("n > 2").select("tab", "key", "n"), ["tab", "key"])
    members = materialize(members, "members")
    groups = members.filter(F.col("n") <= PAIRWISE).groupBy("tab", "key").agg(F.collect_list("fp").alias("fps"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for fps in batch.column(0):
            found += spanning_links(np.array(fps.as_py(), dtype=np.int64), radius)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    inside = map_rows(groups.select("fps"), compare, "a long, b long")
    return pairs.union(inside).union(_through_middles(members.filter(F.col("n") > PAIRWISE).select("fp").distinct(), radius))


def _through_middles(hot: DataFrame, radius: int) -> DataFrame:
    half = radius // 2
    flips = [0]
    for k in range(1, half + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(BITS), k)]
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    table = hot.sparkSession.createDataFrame([(flips,)], "flips array<long>")
    mids = hot.join(F.broadcast(table)).select(
        "fp", F.explode(F.transform("flips", lambda f: F.col("fp").bitwiseXOR(f))).alias("middle")
    )
    stars = mids.groupBy("middle").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return star.distinct()


def group_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """``fp, component, component_id`` for every fingerprint of a written table: the component's
    name among fingerprints, and the smallest ``doc_id`` in it."""
    if radius % 2:
        raise ValueError("radius must be even")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links_within(nodes, radius))
    grouped = materialize(
        nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", "root"), "grouped"
    )
    # a fingerprint without links is its own component, so only linked ones are gathered
    linked = grouped.filter("root is not null").groupBy("root").agg(
        F.min("rep").alias("component_id"), F.min("fp").alias("component")
    )
    linked = materialize(linked, "components")
    alone = F.col("root").isNull()
    return materialize(
        grouped.join(linked, "root", "left").select(
            "fp", F.when(alone, F.col("fp")).otherwise(F.col("component")).alias("component"),
            F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"),
        ), "named",
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest ``doc_id`` reachable over
    fingerprints that differ in ``radius`` bits or fewer (an even radius). Null, empty and
    blank texts have fingerprint zero and are linked like any other. Repeated rows and ids
    each give a row; a null ``doc_id`` names no component, so one of nulls only is null.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return prints.join(group_fingerprints(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns.

    It is the one with the smallest ``doc_id`` (null last, then by a hash of the text); of rows
    equal in id and text any one stays. Blank and null texts are one group.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    named = prints.join(group_fingerprints(prints, radius).select("fp", "component"), "fp")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("b"))
    best = materialize(best.select(F.col("b.doc_id").alias("_id"), F.col("b.text_key").alias("_key")), "best")
    plain = place_names(docs)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = plain.withColumn("text_key", F.xxhash64(text))
    kept = rows.join(best, rows[doc_id].eqNullSafe(best["_id"]) & (rows["text_key"] == best["_key"]), "left_semi")
    return kept.dropDuplicates([doc_id, "text_key"]).select(*plain.columns).toDF(*docs.columns)

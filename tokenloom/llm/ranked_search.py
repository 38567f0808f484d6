"""Ranked lexical search over impact lists with the Best Position Algorithm.

The corpus is indexed once in slices of some MB of text: a slice holds, for every term, the
documents it is in and how often. Counts over the whole corpus come from the slices by a plain
aggregation, and only then are the impacts known, so a search puts the lists of its terms in
order of impact when it opens a slice.

Inside a slice each query reads its lists in rounds, from the greatest impact down. A document
that comes up is looked up in all other lists at once (direct accesses), which gives its whole
score and marks its place in every list as seen. The best position of a list is the end of
its unbroken run of seen places; as places met by direct access count too, it lies at or
below the last one read. The impacts at the best positions add up to the most that an unseen
document can score, and the query stops when that is strictly below its kth score: an equal
score could still win by its smaller id.

A task carries a query's kth score from slice to slice. A first share of the slices is searched
before the others, and its kth scores are lower bounds for all, so later tasks stop early and
return few rows. Queries go in blocks of bounded size; the rows go in all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import slices, texts_of
from tokenloom.llm.words import TERM_GAPS, split_words, xxh64
from tokenloom.session import materialize

SLICE_BYTES = 8 << 20
SLICE_ROWS = 50_000  # a document's place in its slice fits 16 bits
# terms of the queries that are searched at a time
BLOCK_TERMS = 200_000
# one slice in so many gives the first lower bounds
FIRST_SHARE = 16
DEPTH = 32  # places of each list that the first round reads

INDEX = "turn int, doc_ids array<long>, sizes binary, terms array<long>, dfs array<int>, doc binary, tf binary"
FOUND = "query long, doc_id long, score long"


def index_slices(docs: DataFrame) -> DataFrame:
    """The index of all rows ``doc_id, text`` as a written table, one row per slice.

    ``terms`` are the hashes (signed, rising) of the slice's terms, ``dfs`` how many documents
    each is in; ``doc`` and ``tf`` list these documents and counts term by term. A document
    without terms has size 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            for big in slices(batch, SLICE_BYTES):
                for a in range(0, big.num_rows, SLICE_ROWS):
                    part = big.slice(a, SLICE_ROWS)
                    sizes, terms, dfs, doc, tf = invert(texts_of(part.column(1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([turn % FIRST_SHARE], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                         pa.array([sizes.astype("<u4").tobytes()]), pa.array([terms], pa.list_(pa.int64())),
                         pa.array([dfs], pa.list_(pa.int32())), pa.array([doc.astype("<u2").tobytes()]),
                         pa.array([tf.astype("<u4").tobytes()])],
                        names=["turn", "doc_ids", "sizes", "terms", "dfs", "doc", "tf"],
                    )
                    turn += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, INDEX), "index")


def invert(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(terms per text, distinct terms, texts of each, texts term by term, occurrences)``."""
    words = split_words(texts, gaps=TERM_GAPS)
    h = xxh64(words.buffer, words.starts, words.ends - words.starts).view(np.int64)
    by = np.argsort(h, kind="stable")  # words come text by text, so a term's texts stay in order
    h, doc = h[by], words.doc[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    terms, dfs = np.unique(h, return_counts=True)
    return words.counts, terms, dfs.astype(np.int32), doc, tf


class Lists:
    """A slice's lists of the wanted terms, by impact and by document."""

    def __init__(self, row: dict, wanted: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        ids = np.array([-1 if v is None else v for v in row["doc_ids"]], dtype=np.int64)
        none = np.array([v is None for v in row["doc_ids"]], dtype=bool)
        # places of the documents in the order of their ids, null last, so ties compare by place
        self.by_id = np.lexsort((ids, none))
        self.place = np.empty(len(ids), dtype=np.int64)
        self.place[self.by_id] = np.arange(len(ids))
        self.ids = row["doc_ids"]
        size = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        m = 50 + (50 * size * n_docs) // max(n_terms, 1)
        terms, dfs = np.array(row["terms"], dtype=np.int64), np.array(row["dfs"], dtype=np.int64)
        ends = np.cumsum(dfs)
        at = np.searchsorted(terms, wanted)
        have = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(len(wanted), bool)
        have &= weight > 0
        self.number = np.full(len(wanted), -1)  # of a wanted term's list
        self.number[have] = np.arange(have.sum())
        lengths = dfs[at[have]]
        pick = ranges(ends[at[have]] - lengths, lengths)
        doc = np.frombuffer(row["doc"], "<u2")[pick].astype(np.int64)
        tf = np.frombuffer(row["tf"], "<u4")[pick].astype(np.int64)
        which = np.repeat(np.arange(len(lengths)), lengths)
        impact = weight[have][which] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        self.n = len(ids)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        order = np.lexsort((-impact, which))
        self.doc, self.impact = doc[order], impact[order]
        # direct access: (list, document), rising, and its place in the order of impact
        self.key = which * self.n + doc
        self.at = np.empty(len(order), dtype=np.int64)
        self.at[order] = np.arange(len(order))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of several ranges, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def best_positions(lists: Lists, mine: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(documents, scores, places read)``: all documents of the slice that can be among the ``k``
    best and score ``least`` or more, and some below; ``mine`` numbers the query's lists."""
    a, b = lists.starts[mine], lists.starts[mine + 1]
    read, best = a.copy(), a.copy()  # next place to read, first place after the run of seen ones
    seen = {int(x): np.zeros(int(y - x) + 1, dtype=bool) for x, y in zip(a, b, strict=True)}
    known = np.zeros(lists.n, dtype=bool)
    docs, scores = [], []
    depth, kth, touched = DEPTH, least, 0
    while True:
        upto = np.minimum(read + depth, b)
        doc = np.unique(lists.doc[ranges(read, upto - read)])
        touched += int((upto - read).sum())
        read, depth = np.maximum(read, upto), depth * 2
        doc = doc[~known[doc]]
        if len(doc):
            known[doc] = True
            want = (mine[:, None] * lists.n + doc).ravel()
            at = np.searchsorted(lists.key, want)
            hit = lists.key[np.minimum(at, len(lists.key) - 1)] == want
            place = lists.at[np.minimum(at, len(lists.key) - 1)]
            hit2, place = hit.reshape(len(mine), -1), place.reshape(len(mine), -1)
            scores.append(np.where(hit2, lists.impact[place], 0).sum(axis=0))
            docs.append(doc)
            for i, x in enumerate(a):
                seen[int(x)][place[i][hit2[i]] - x] = True
            if sum(map(len, docs)) >= k:
                all_scores = np.concatenate(scores)
                kth = max(kth, int(np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]))
        for i, x in enumerate(a):
            flags = seen[int(x)]  # its last entry stays False
            best[i] += int(flags[int(best[i] - x) :].argmin())
        # the impact at each best position; nothing unseen is left of a list that is seen to its end
        bound = np.where(best < b, lists.impact[np.maximum(best - 1, 0)] if len(lists.impact) else 0, 0)
        fresh = (best == a) & (best < b)
        bound[fresh] = lists.impact[a[fresh]]
        if int(bound.sum()) < kth or (best >= b).all():
            break
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(docs), np.concatenate(scores), touched) if docs else (none, none, touched)


def top_of(lists: Lists, docs: np.ndarray, scores: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of a slice by score, then by id, with ``least`` or more."""
    keep = np.flatnonzero(scores >= max(least, 1))
    order = keep[np.lexsort((lists.place[docs[keep]], -scores[keep]))][:k]
    return docs[order], scores[order]


def _search(index: DataFrame, block: tuple, k: int, n_docs: int, n_terms: int, floors: dict[int, int]) -> DataFrame:
    """``query, doc_id, score``: of every task, its ``k`` best documents of each query at most."""
    shared = index.sparkSession.sparkContext.broadcast((block, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (queries, wanted, weight), given = shared.value
        least = dict(given)
        found: dict[int, list[tuple[int, bool, int | None]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lists = Lists(batch.slice(i, 1).to_pylist()[0], wanted, weight, n_docs, n_terms)
                if not len(lists.doc):
                    continue
                for query, terms in queries:
                    mine = lists.number[terms]
                    mine = mine[mine >= 0]
                    if not len(mine):
                        continue
                    floor = least.get(query, 0)
                    docs, scores, _ = best_positions(lists, mine, k, floor)
                    docs, scores = top_of(lists, docs, scores, k, floor)
                    if not len(docs):
                        continue
                    ids = [lists.ids[d] for d in docs]
                    best = found.get(query, []) + [(-s, d is None, d) for s, d in zip(scores.tolist(), ids, strict=True)]
                    best.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                    found[query] = best[:k]
                    if len(best) >= k:
                        least[query] = max(floor, -found[query][-1][0])
        rows = [(q, x[2], -x[0]) for q, best in found.items() for x in best]
        for a in range(0, len(rows), 50_000):
            cols = list(zip(*rows[a : a + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query", "doc_id", "score"])

    return index.select("doc_ids", "sizes", "terms", "dfs", "doc", "tf").mapInArrow(run, FOUND)


def query_terms(items: DataFrame) -> DataFrame:
    """``query, terms``: the distinct term hashes of every row ``query, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                words = split_words(texts_of(part.column(1)), gaps=TERM_GAPS)
                h = xxh64(words.buffer, words.starts, words.ends - words.starts).view(np.int64)
                terms = [np.unique(h[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["query", "terms"])

    return items.select("query", "text").mapInArrow(run, "query long, terms array<long>")


def weight_of(df: Column, n_docs: int) -> Column:
    """A term's weight in ``n_docs`` documents that hold it ``df`` times."""
    return F.floor(F.lit(1000.0) * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * df + 1))).cast("long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every row of ``items``.

    Scores are above 0, equal ones go by rising ``doc_id``, a null one last. Null texts have no
    terms: such a document is found by no item, and such an item finds none. Repeated
    documents are documents of their own; repeated rows of ``items`` each give their rows. With no
    documents or no items there is no row.
    """
    spark = docs.sparkSession
    index = index_slices(docs)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sizes = np.frombuffer(raw, "<u4")
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    size = index.select("sizes").mapInArrow(totals, "n long, total long").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    n_docs, n_terms = size["n"], size["total"]
    named = materialize(items.select(
        F.monotonically_increasing_id().alias("query"), F.col("item_id").alias("item_id"), F.col("text").alias("text")), "items")
    asked = materialize(query_terms(named), "asked")
    terms = asked.select("query", F.explode("terms").alias("term"))
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.dfs").alias("df")
    ).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighted = materialize(
        terms.join(counts, "term").select("query", "term", weight_of(F.col("df"), n_docs).alias("w")).filter("w > 0"), "weighted")
    # blocks of queries of bounded size, by the running number of their terms
    sizes = weighted.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    found = None
    for block in _blocks(weighted, sizes):
        first = _search(index.filter("turn = 0"), block, k, n_docs, n_terms, {})
        first = materialize(_best(first, k).drop("rank"), "first")
        floors = {r["query"]: r["least"] for r in first.groupBy("query").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect()}
        rest = _search(index.filter("turn <> 0"), block, k, n_docs, n_terms, floors)
        ranked = materialize(_best(first.union(rest), k), "ranked")
        found = ranked if found is None else found.union(ranked)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long, rank int")
    return found.join(named.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every query; each task drops what its own rows already exceed."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(weighted: DataFrame, sizes: DataFrame) -> Iterator[tuple]:
    """``(queries, terms, weights)`` of some ``BLOCK_TERMS`` terms at a time: queries are dealt to as
    many blocks as that takes by a hash, and a block is what the driver holds."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_blocks = math.ceil(total / BLOCK_TERMS)
    for b in range(n_blocks):
        rows = weighted.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).collect()
        if not rows:
            continue
        query = np.array([r["query"] for r in rows], dtype=np.int64)
        wanted, first, inverse = np.unique(np.array([r["term"] for r in rows], dtype=np.int64), return_index=True, return_inverse=True)
        weight = np.array([r["w"] for r in rows], dtype=np.int64)[first]
        by = np.argsort(query, kind="stable")
        cut = np.flatnonzero(np.diff(query[by], prepend=-1))
        groups = [(int(query[g[0]]), inverse[g]) for g in np.split(by, cut[1:])]
        yield groups, wanted, weight

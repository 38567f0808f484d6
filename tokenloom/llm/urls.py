"""URL filtering by rules, and by two Markov models of characters where no rule fits.

The models of accepted and of rejected URLs have variable order: a context of up to ``ORDER``
bytes backs off to shorter ones by Witten-Bell interpolation. The verdict is the difference of
their log-likelihoods per byte, calibrated on URLs that neither model has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import LOWER, UPPER, lowest, map_rows, texts_of

# The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
_END = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)

VERDICTS = "page_id long, host string, path string, rule string, verdict string, score double"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits a host (or its parent domain) and the start of a path; its verdict."""
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name = F.when(fits, F.lit(rule)).otherwise(F.lit(None).cast("string") if name is None else name)
        verdict = F.when(fits, F.lit(says)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return name, verdict


def contexts(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(context keys by order, symbols, url of each symbol, symbols per url)``.

    A URL's symbols are its bytes and an end. A context never reaches before its URL's start.
    """
    sizes = np.array([len(u) + 1 for u in urls], dtype=np.int64)
    symbol = np.full(int(sizes.sum()), _END, dtype=np.uint64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(symbol), dtype=bool)
    inner[ends] = False
    symbol[inner] = np.frombuffer(b"".join(urls), dtype=np.uint8)
    doc = np.repeat(np.arange(len(urls)), sizes)
    at = np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.zeros((ORDER + 1, len(symbol)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            before = np.concatenate([np.zeros(k, np.uint64), symbol[:-k]])[: len(symbol)] + np.uint64(1)
            before = np.where(at >= k, before, np.uint64(0))  # 0: before the start
            keys[k] = (keys[k - 1] ^ before) * _MIX + np.uint64(k)
            keys[k] ^= keys[k] >> np.uint64(29)
    return keys, symbol, doc, sizes


@dataclass
class Markov:
    """Counts of contexts and of contexts with a symbol, as sorted keys per order."""

    pairs: list[tuple[np.ndarray, np.ndarray]]
    totals: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def fit(urls: list[bytes]) -> Markov:
        keys, symbol, _, _ = contexts(urls)
        pairs, totals = [], []
        for k in range(ORDER + 1):
            both, first, n = np.unique(_with(keys[k], symbol), return_index=True, return_counts=True)
            ctx, inverse, kinds = np.unique(keys[k][first], return_inverse=True, return_counts=True)
            pairs.append((both, n))
            totals.append((ctx, np.bincount(inverse, weights=n, minlength=len(ctx)), kinds))
        return Markov(pairs, totals)

    def log_likelihood(self, keys: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability."""
        p = np.full(len(symbol), 1.0 / (_END + 1))
        for k in range(ORDER + 1):
            both, n = self.pairs[k]
            ctx, total, kinds = self.totals[k]
            count = _lookup(both, n, _with(keys[k], symbol))
            seen, follow = _lookup(ctx, total, keys[k]), _lookup(ctx, kinds, keys[k])
            known = seen > 0
            p[known] = (count[known] + follow[known] * p[known]) / (seen[known] + follow[known])
        return np.log(p)


def _with(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (key + symbol + np.uint64(1)) * _MIX
        return mixed ^ (mixed >> np.uint64(31))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)


def difference(accept: Markov, reject: Markov, urls: list[bytes]) -> np.ndarray:
    """Log-likelihood per symbol under the accepted minus under the rejected URLs' model."""
    keys, symbol, doc, sizes = contexts(urls)
    gap = accept.log_likelihood(keys, symbol) - reject.log_likelihood(keys, symbol)
    return np.bincount(doc, weights=gap, minlength=len(urls)) / sizes


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of ``P(y) = 1 / (1 + exp(-(slope x + bias)))`` by damped Newton steps."""
    theta, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - y) + 1e-3 * theta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def filter_urls(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, max_train: int = 5000,
    url_col: str = "url", id_col: str = "page_id",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    URLs that a rule decides are the labelled ones. Per verdict the ``max_train`` of them with
    the smallest URL hash are taken (a documented bound: the models are some MB at any size of
    the table); every fifth calibrates, the others train. ``score`` is the calibrated
    probability of ``allow`` of host and path; from 0.5 on the method allows. Null URLs and
    those without ``://`` have empty host and path and are judged by their end alone. If a
    verdict has no labelled URL there is no model: ``score`` is null and the method allows.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    name, says = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "says": says})
    counts = {r["says"]: r["n"] for r in rows.groupBy("says").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = {}
    for verdict in ("allow", "block"):
        some = rows.filter(F.col("says") == verdict).select(F.concat("host", "path").alias("u"))
        some = lowest(some, F.xxhash64("u"), max_train, counts.get(verdict, 0))
        sample[verdict] = [r["u"].encode() for r in some.collect()]
    model = None
    if all(sample.values()):
        held = {v: u[::5] for v, u in sample.items()}
        fitted = {v: Markov.fit([x for i, x in enumerate(u) if i % 5] or u) for v, u in sample.items()}
        x = difference(fitted["allow"], fitted["block"], held["allow"] + held["block"])
        y = np.repeat([1.0, 0.0], [len(held["allow"]), len(held["block"])])
        model = (fitted["allow"], fitted["block"], *calibrate(x, y))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        says, score = batch.column(4).to_pylist(), [None] * batch.num_rows
        if shared.value is not None:
            accept, reject, slope, bias = shared.value
            urls = [h + p for h, p in zip(texts_of(batch.column(1)), texts_of(batch.column(2)), strict=True)]
            z = slope * difference(accept, reject, urls) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        verdict = [
            s if s is not None else "block" if p is not None and p < 0.5 else "allow"
            for s, p in zip(says, score, strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
            names=["page_id", "host", "path", "rule", "verdict", "score"],
        )

    return map_rows(rows, judge, VERDICTS, 1 << 20)

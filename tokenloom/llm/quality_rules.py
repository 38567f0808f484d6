"""Quality rules with a suffix array's view of repetition.

The suffix array of a text's words is built by prefix doubling, for all texts of a slice at
once, and only suffixes that are still tied are sorted again. Neighbours' common prefixes come
from the ranks kept of every doubling. The longest repeat that starts at a word is the larger
of its two neighbours' common prefixes; each LCP interval's substring is among these, so their
union is the union of all maximal repeated substrings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenloom.llm.common import map_rows, place_names, plain_columns, texts_of
from tokenloom.llm.words import Words, split_words, xxh64

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = b" \t\n\x0b\x0c\r"

RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, longest_repeat long, kept boolean"
)


def longest_repeats(words: Words) -> np.ndarray:
    """For every word, how many words the longest repeat in its own text has that starts there."""
    n = len(words.starts)
    longest = np.zeros(n, dtype=np.int64)
    if not n:
        return longest
    symbol = xxh64(words.buffer, words.starts, words.ends - words.starts)
    end_of = words.first[1:][words.doc]  # first word after the text
    # level 0: rank by (text, word); a rank is the first place of its tie in the suffix array
    order = np.lexsort((symbol, words.doc))
    changed = (np.diff(symbol[order], prepend=0) != 0) | (np.diff(words.doc[order], prepend=-1) != 0)
    changed[0] = True
    rank = np.empty(n, dtype=np.int64)
    place = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
    rank[order] = place
    suffix_at = order
    levels, step = [rank.copy()], 1
    tied = _tied(place)
    while len(tied):
        at = suffix_at[tied]
        ahead = at + step
        second = np.where(ahead < end_of[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        suffix_at[tied] = at
        new = np.diff(key, prepend=-1) != 0
        place_now = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = place_now
        levels.append(rank.copy())
        step *= 2
        tied = tied[_tied(place_now)]
    # common prefixes of neighbours that share their first word
    pair = np.flatnonzero(levels[0][suffix_at[1:]] == levels[0][suffix_at[:-1]]) + 1
    left, right = suffix_at[pair - 1], suffix_at[pair]
    common = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = left + common, right + common
        ok = np.flatnonzero((i < end_of[left]) & (j < end_of[right]))
        same = ok[levels[k][i[ok]] == levels[k][j[ok]]]
        common[same] += 1 << k
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _tied(place: np.ndarray) -> np.ndarray:
    """Indices whose place is shared with a neighbour."""
    same = place[1:] == place[:-1]
    flag = np.zeros(len(place), dtype=bool)
    flag[1:] |= same
    flag[:-1] |= same
    return np.flatnonzero(flag)


def covered(longest: np.ndarray, least: int, fixed: int | None = None) -> np.ndarray:
    """Words inside a repeat of ``least`` words or more (counted ``fixed`` words long, if given)."""
    start = np.flatnonzero(longest >= least)
    step = np.zeros(len(longest) + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + (longest[start] if fixed is None else fixed), -1)
    return np.cumsum(step[:-1]) > 0


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(_BLANK))
        else:
            seen.add(line)
    return n


def measure(texts: list[bytes], min_words: int) -> dict[str, np.ndarray]:
    """All counts of the rules, one entry per text."""
    words = split_words(texts, fold=False)
    longest = longest_repeats(words)
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = np.isin(raw, np.frombuffer(_BLANK, dtype=np.uint8))
    best = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(best, words.doc, longest)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(~space & ((raw & 0xC0) != 0x80), first),
        "n_symbols": _per_text(_SYMBOL[raw], first),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": _per_text(covered(longest, 3, 3), words.first),
        "covered_words": _per_text(covered(longest, min_words), words.first),
        "longest_repeat": best,
    }


def verdicts(m: dict[str, np.ndarray], max_covered: int, max_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rules, and which are kept."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & (100 * m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)


def quality_rules(
    docs: DataFrame, min_words: int = 6, max_covered: int = 30, max_repeat: int = 40,
) -> DataFrame:
    """One row per document with its counts and the verdict ``kept``.

    A text fails the base rules with under 50 words, or with over half of its words in
    repeated 3-word windows. Otherwise it is kept if repeats of ``min_words`` words or more
    cover ``max_covered`` percent of its words at most, and the longest repeat has
    ``max_repeat`` words at most. A null text has no words; repeated rows give equal rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(texts_of(batch.column(1)), min_words)
        failed, kept = verdicts(m, max_covered, max_repeat)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        cols = [batch.column(0), *[pa.array(m[k]) for k in names], pa.array(failed), pa.array(m["covered_words"]),
                pa.array(m["longest_repeat"]), pa.array(kept)]
        return pa.RecordBatch.from_arrays(
            cols, names=["doc_id", *names, "base_failed", "covered_words", "longest_repeat", "kept"]
        )

    return map_rows(plain_columns(docs, doc_id="doc_id", text="text"), run, RULES, 1 << 20)


def keep_by_rules(
    docs: DataFrame, min_words: int = 6, max_covered: int = 30, max_repeat: int = 40,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(verdicts(measure(texts_of(batch.column(at)), min_words), max_covered, max_repeat)[1]))

    plain = place_names(docs)
    return map_rows(plain, run, plain.schema, 1 << 20).toDF(*docs.columns)

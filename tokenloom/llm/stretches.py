"""Subword ids and word hashes of many texts, each distinct stretch of text encoded once.

A stretch begins at a space before a character that is no white space. The vocabulary's pattern
always begins a piece there, and no word holds a space, so a stretch has the same ids and words
wherever it stands. Each Python worker keeps the stretches it has met, up to a bound, and begins
anew when it knows few of what comes; they are told apart by 64-bit hashes, like the words whose
counts they give.
"""

from __future__ import annotations

import functools

import numpy as np

from tokenloom.llm.encode import encode, encoder
from tokenloom.llm.words import split_words, xxh64

# first bytes of a character that may follow a stretch's space: no white space, no first byte of a wider one
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[0x20, *range(0x09, 0x0E), 0xC2, 0xE1, 0xE2, 0xE3]] = False
# stretches that a worker keeps, and bytes of the longest one
KEPT, KEPT_BYTES = 1 << 19, 64


class _Pool:
    """Runs of values, one after another."""

    def __init__(self, dtype: str):
        self.values, self.at, self.n = np.zeros(0, dtype), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def with_runs(self, values: np.ndarray, n: np.ndarray) -> _Pool:
        out = _Pool(self.values.dtype.str)
        out.at = np.concatenate([self.at, (len(self.values) + np.cumsum(n) - n).astype(np.int32)])
        out.values, out.n = np.concatenate([self.values, values]), np.concatenate([self.n, n.astype(np.int32)])
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs ``rows`` as one array, and where each one ends in it, after a 0."""
        n = self.n[rows]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return self.values[np.repeat(self.at[rows] - ends[:-1], n) + np.arange(ends[-1])], ends


class Stretches:
    def __init__(self, vocabulary: str | None):
        self.vocabulary = vocabulary
        enc = encoder(vocabulary)
        self.id_bytes = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)])
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.words = _Pool("<u2"), _Pool("<u8")

    def _new(self, parts: list[bytes], kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and word hashes of ``parts``, and how many each has. The first ``kept`` begin as a
        stretch does and go to the encoder as one text."""
        whole = encode(b"".join(parts[:kept]).decode(), self.vocabulary)
        ends = np.cumsum([len(p) for p in parts[:kept]], dtype=np.int64)
        done = np.searchsorted(np.cumsum(self.id_bytes[whole]), ends) + 1
        others = [encode(p.decode(), self.vocabulary) for p in parts[kept:]]
        n_ids = np.concatenate([np.diff(done, prepend=0), np.array([len(x) for x in others], np.int64)])
        w = split_words(parts)
        h = xxh64(w.buffer, w.starts, w.ends - w.starts)
        return np.concatenate([whole, *others]).astype("<u2"), n_ids, h, w.counts

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``texts``, ids of each, hashes of all words (A-Z lower-cased), words of each."""
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        stops = np.cumsum(sizes)
        if not data:
            none = np.zeros(len(texts), np.int64)
            return self.ids.values[:0], none, self.words.values[:0], none
        raw = np.frombuffer(data + bytes(8), np.uint8)
        cut = (raw[: len(data)] == 0x20) & _PLAIN[raw[1 : len(data) + 1]]
        filled = np.flatnonzero(sizes)
        cut[stops[filled] - 1] = False  # a text's last space has no character after it
        begins = cut.copy()
        begins[(stops - sizes)[filled]] = True
        at = np.flatnonzero(begins)
        n_bytes = np.diff(at, append=len(data))
        found, where, which = np.unique(xxh64(raw, at, n_bytes), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, found)
        old = np.zeros(len(found), dtype=bool)
        inside = np.flatnonzero(place < len(self.hashes))
        old[inside] = self.hashes[place[inside]] == found[inside]
        rows = np.empty(len(found), dtype=np.int64)
        rows[old] = self.rows[place[old]]
        # the ones to keep first
        new = np.flatnonzero(~old)
        keep = (cut[at] & (n_bytes <= KEPT_BYTES))[where[new]]
        new, kept = np.concatenate([new[keep], new[~keep]]), int(keep.sum())
        known = len(self.ids.n)
        rows[new] = known + np.arange(len(new))
        a = at[where[new]]
        parts = [data[i:j] for i, j in zip(a.tolist(), (a + n_bytes[where[new]]).tolist(), strict=True)]
        ids, n_ids, words, n_words = self._new(parts, kept)
        all_ids, all_words = self.ids.with_runs(ids, n_ids), self.words.with_runs(words, n_words)
        edges = np.searchsorted(at, np.concatenate([stops - sizes, stops[-1:]]))
        rows = rows[which]
        out = []
        for pool in (all_ids, all_words):
            values, ends = pool.take(rows)
            out += [values, np.diff(ends[edges])]
        if known + kept <= KEPT:
            self.ids = self.ids.with_runs(ids[: n_ids[:kept].sum()], n_ids[:kept])
            self.words = self.words.with_runs(words[: n_words[:kept].sum()], n_words[:kept])
            # in order of the hashes, as ``found`` is
            self.hashes = np.insert(self.hashes, place[new[:kept]], found[new[:kept]])
            self.rows = np.insert(self.rows, place[new[:kept]], known + np.arange(kept))
        elif np.mean(old[which]) < 0.5:
            self._clear()
        return tuple(out)


@functools.lru_cache(maxsize=2)
def stretches(vocabulary: str | None) -> Stretches:
    """The worker's own."""
    return Stretches(vocabulary)

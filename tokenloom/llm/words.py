"""Words of many texts at once, as positions in one byte buffer, and hashes of byte ranges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# what ends a term of ranked search: ASCII but for letters and digits
TERM_GAPS = np.zeros(256, dtype=bool)
TERM_GAPS[:128] = [not chr(c).isalnum() for c in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(v)
    for v in (
        11400714785074694791, 14029467366897019727, 1609587929392839161,
        9650029242287828579, 2870177450012600261,
    )
)


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a list of texts, one space apart in ``buffer``."""

    buffer: np.ndarray  # bytes, with room for reading 8 bytes at any place
    starts: np.ndarray  # of every word
    ends: np.ndarray
    doc: np.ndarray  # index of every word's text
    first: np.ndarray  # first word of every text; one more entry closes the last
    n_docs: int

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: list[bytes], fold: bool = True, gaps: np.ndarray = _SPACE) -> Words:
    """Words of ``texts``: runs of bytes that are no ``gaps`` (a table of 256)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", dtype=np.uint8)
    space = gaps[raw]
    before = np.empty_like(space)
    if len(space):
        before[0], before[1:] = True, space[:-1]
    keep = ~(space & before)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    # a text's last separator may go when the text ends in white space, so words are counted
    # by the original places
    word_at = np.flatnonzero(~space & before)
    first = np.concatenate([[0], np.searchsorted(word_at, ends_at)]).astype(np.int64)
    packed = raw[keep]
    gap = space[keep]
    buffer = np.where(gap, np.uint8(32), _FOLD[packed] if fold else packed)
    leads = np.concatenate([[True], gap[:-1]]) if len(gap) else gap
    starts = np.flatnonzero(~gap & leads)
    ends = np.flatnonzero(gap)[-len(starts):] if len(starts) else starts
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(np.concatenate([buffer, np.zeros(8, np.uint8)]), starts, ends, doc, first, len(texts))


def windows(words: Words, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first word, last word, text)`` of every window; ``whole``: shorter texts give one."""
    i = np.arange(len(words.starts))
    last_of_doc = (words.first[1:] - 1)[words.doc]
    keep = i + size - 1 <= last_of_doc
    if whole:
        keep |= i == words.first[:-1][words.doc]
    i = i[keep]
    return i, np.minimum(i + size - 1, last_of_doc[keep]), words.doc[keep]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many ranges of a buffer that goes on for 8 bytes after the last range."""
    n = len(buffer)
    lane8 = np.ndarray((max(n - 7, 0),), "<u8", buffer.data, strides=(1,))
    lane4 = np.ndarray((max(n - 3, 0),), "<u4", buffer.data, strides=(1,))
    s, at, left = np.uint64(seed), starts.astype(np.int64), lengths.astype(np.int64)
    with np.errstate(over="ignore"):
        acc = np.full(len(at), s + _P5, dtype=np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            p, m = at[long].copy(), left[long] // 32
            v = [np.full(len(long), x, dtype=np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(m.max())):
                on = np.flatnonzero(m > k)
                for j in range(4):
                    v[j][on] = _round(v[j][on], lane8[p[on] + 8 * j])
                p[on] += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            acc[long] = h
            at[long], left[long] = p, left[long] % 32
        acc += lengths.astype(np.uint64)
        zero = np.uint64(0)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            acc[on] = _rotl(acc[on] ^ _round(zero, lane8[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        acc[on] = _rotl(acc[on] ^ (lane4[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left >= 1)
            if not len(on):
                break
            acc[on] = _rotl(acc[on] ^ (buffer[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        return acc ^ (acc >> np.uint64(32))

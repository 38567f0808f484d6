"""Subword ids of whole texts by a public byte-level vocabulary, held once per Python worker."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: the added token of byte_bpe_50k.json, which its library finds in the text as well.
ADDED = {"<|endoftext|>": 50_256}


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None, added: bool = False):
    """The vocabulary of ``byte_bpe_50k.json`` in its rank form: the same ids, and several times
    faster than the JSON form (a test holds the two against each other). No string is special
    unless ``added``, which gives this vocabulary's added token its id wherever it stands.
    """
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = path is None or os.path.basename(path) == os.path.basename(vocabulary_path())
    return tiktoken.Encoding(
        os.path.basename(path or "public"), pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks, special_tokens=ADDED if added and own else {},
    )


# Runs of white space (the pattern's class) that the pattern's look-ahead, which backtracks one
# character at a time, is spared from.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def _ordinary(text: str, path: str | None) -> list[int]:
    """Ids of a text without special strings.

    The pattern makes one piece of a run of white space, up to its last character where a word
    follows; a long run is cut out by hand in the same way.
    """
    enc, out, done = encoder(path), [], 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[done : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        done = end
    return out + enc.encode_ordinary(text[done:])


def encode(text: str, path: str | None = None) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers; no string is special."""
    if not _LONG_BLANK.search(text):
        return encoder(path).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(_ordinary(text, path), dtype="<u4")


def encode_added(text: str, path: str | None = None) -> np.ndarray:
    """Like :func:`encode`, with the added token where its string stands, as the JSON form has it."""
    added = encoder(path, True)
    if not _LONG_BLANK.search(text):
        return np.array(added.encode(text, allowed_special="all"), dtype="<u4")
    out: list[int] = []
    for k, part in enumerate(text.split("<|endoftext|>") if added.special_tokens_set else [text]):
        out += [ADDED["<|endoftext|>"]] * (k > 0) + _ordinary(part, path)
    return np.array(out, dtype="<u4")

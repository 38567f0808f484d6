"""Byte-level text expressions: pre-tokenization, byte symbols, id packing.

Everything here is a Catalyst expression, so it stays on the JVM and works in
batch and streaming plans alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the published GPT-2 pre-tokenization pattern. ``(?U)`` gives
# Java's classes their Unicode meaning.
GPT2_PATTERN = (
    r"(?U)'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_symbols() -> list[str]:
    """Printable symbol of every byte value, in byte order.

    Printable Latin-1 bytes stand for themselves; each remaining byte takes the
    next free code point from U+0100 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_LATIN1 = "".join(map(chr, range(256)))


def latin1(col: Column) -> Column:
    """UTF-8 bytes of a string, one character (U+0000..U+00FF) per byte."""
    return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1")


def byte_map(col: Column) -> Column:
    """Replace every UTF-8 byte of a string by its printable symbol."""
    return F.translate(latin1(col), _LATIN1, "".join(byte_symbols()))


def byte_unmap(col: Column) -> Column:
    """Inverse of :func:`byte_map`; returns binary."""
    symbols = byte_symbols()
    # translate() would delete what maps to NUL, so that byte goes separately
    plain = F.translate(col, "".join(symbols[1:]), _LATIN1[1:])
    return F.encode(F.replace(plain, F.lit(symbols[0]), F.lit("\0")), "ISO-8859-1")


def _any_of(tokens: list[str]) -> str:
    ordered = sorted(tokens, key=len, reverse=True)
    return "(?:" + "|".join(re.escape(t) for t in ordered) + ")"


def pretokenize(
    col: Column, pretokenizer: str = "gpt2", added_tokens: list[str] | None = None
) -> Column:
    """Split text into pieces; added tokens are cut out of the text first."""
    if pretokenizer == "gpt2":
        def pieces(c: Column) -> Column:
            return F.regexp_extract_all(c, F.lit(GPT2_PATTERN), F.lit(0))
    elif pretokenizer == "none":
        def pieces(c: Column) -> Column:
            return F.filter(F.array(c), lambda x: x != "")
    else:
        raise ValueError(f"unknown pretokenizer {pretokenizer!r}: use 'gpt2' or 'none'")
    if not added_tokens:
        return pieces(col)
    anyof = _any_of(added_tokens)
    # zero-width cuts before and after each added token: linear, no recursion
    segments = F.filter(F.split(col, f"(?={anyof})|(?<={anyof})"), lambda s: s != "")
    cut = F.flatten(
        F.transform(
            segments,
            lambda s: F.when(s.isin(added_tokens), F.array(s)).otherwise(pieces(s)),
        )
    )
    return F.when(col.rlike(anyof), cut).otherwise(pieces(col))


def pack_u32(ids: Column) -> Column:
    """Array of ids -> binary, 4 bytes each, little-endian."""
    def le_hex(i: Column) -> Column:
        # the low 32 bits, bytes turned round
        h = F.lpad(F.hex(i.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])

    return F.unhex(F.array_join(F.transform(ids, le_hex), ""))


def unpack_u32(col: Column) -> Column:
    """Little-endian binary -> array of unsigned ids; 1-3 trailing bytes are ignored."""
    words = F.filter(
        F.regexp_extract_all(F.hex(col), F.lit(".{1,8}"), F.lit(0)), lambda h: F.length(h) == 8
    )

    def value(h: Column) -> Column:
        turned = F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])
        return F.conv(turned, 16, 10).cast("long")

    return F.transform(words, value)


def frame_u64_count(ids: Column) -> Column:
    """8-byte little-endian element count followed by the packed ids."""
    n = F.size(ids)
    return F.concat(pack_u32(F.array(n, F.lit(0))), pack_u32(ids))

"""Small scalar expressions used by the reports and the index builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024

# Meaning of one character after a backslash in a delimiter option.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\"}


def bytes_to_mb(col: Column) -> Column:
    return col.cast("double") / F.lit(float(MIB))


def int_div(n: Column, d: Column | int) -> Column:
    """Exact integer quotient (``/`` would go through double)."""
    return F.call_function("div", n, F.lit(d) if isinstance(d, int) else d)


def ceil_div(n: Column, d: Column | int) -> Column:
    """Integer ceiling of n / d for non-negative n and positive d."""
    d = F.lit(d) if isinstance(d, int) else d
    return int_div(n + d - 1, d)


def core_list(col: Column) -> Column:
    """``"0-5,7"`` -> sorted distinct ints; reversed ranges are swapped, blanks skipped."""
    parts = F.filter(F.split(col, ","), lambda p: p != "")

    def expand(p: Column) -> Column:
        lo = F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
        hi = F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")).otherwise(lo)
        return F.sequence(F.least(lo, hi), F.greatest(lo, hi))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def unescape_delimiter(text: str) -> str:
    """Decode a delimiter option: known escapes, other ``\\x`` -> ``x``, lone tail kept."""
    out, chars = [], iter(text)
    for ch in chars:
        if ch != "\\":
            out.append(ch)
            continue
        nxt = next(chars, None)
        out.append("\\" if nxt is None else ESCAPES.get(nxt, nxt))
    return "".join(out)


def unescape_delimiter_col(col: Column) -> Column:
    """Column form of :func:`unescape_delimiter`."""
    # one element per plain character or per escape pair, so pairs never overlap
    units = F.regexp_extract_all(col, F.lit(r"(?s)\\.|."), F.lit(0))

    def decode(u: Column) -> Column:
        out = F.when((F.length(u) == 2), F.substring(u, 2, 1)).otherwise(u)
        chain = F.when(F.length(u) == 1, u)
        for name, value in ESCAPES.items():
            chain = chain.when(u == "\\" + name, F.lit(value))
        return chain.otherwise(out)

    return F.array_join(F.transform(units, decode), "")


def decode_status(status: Column) -> Column:
    """Completion status field -> struct of its bit groups and a label."""
    s = status.cast("int")
    sc = s.bitwiseAND(F.lit(0xFF))
    sct = F.shiftright(s, 8).bitwiseAND(F.lit(0x7))
    return F.struct(
        sct.alias("sct"),
        sc.alias("sc"),
        F.shiftright(s, 14).bitwiseAND(F.lit(1)).alias("more"),
        F.shiftright(s, 15).bitwiseAND(F.lit(1)).alias("dnr"),
        F.when(s == 0, F.lit("SUCCESS"))
        .otherwise(
            F.concat(
                F.format_string("SCT=%d SC=0x", sct),
                F.lpad(F.hex(sc), 2, "0"),
                F.format_string(
                    " M=%d DNR=%d",
                    F.shiftright(s, 14).bitwiseAND(F.lit(1)),
                    F.shiftright(s, 15).bitwiseAND(F.lit(1)),
                ),
            )
        )
        .alias("label"),
    )


def status_from_dw3(dw3: Column) -> Column:
    """Status field inside the fourth completion word."""
    return F.shiftrightunsigned(dw3.cast("long"), 17)


def shard_name(shard: Column, total: Column | int | None = None) -> Column:
    """Zero-padded shard label; with a total, the corpus file name of the shard."""
    if total is None:
        return F.format_string("%05d", shard.cast("long"))
    total = F.lit(total) if isinstance(total, int) else total
    return F.format_string("data-%05d-of-%05d.arrow", shard.cast("long"), total.cast("long"))


def tokens_per_hour(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds * 3600.0).otherwise(F.lit(0.0))

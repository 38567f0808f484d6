"""Conversation repair against a plain search over all edits of each conversation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SF

from tokenloom.llm import conversation_repair as cr


def plainly(rows):
    """Report of one conversation from its rows (conv_id, turn, role, text), without divide and conquer."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    counts, flags, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], set()
    for _, role, text in kept:
        bare = text.rstrip(" \t\n\v\f\r")
        flag = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        flags.append(flag)
        if flag:
            counts[flag] += 1
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    # least (cost, letters) with what is said, by state; strings and all
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for q, (cost, letters, said) in list(best.items()):
                way = (cost + 2, letters + "I", (*said, (nxt[q], "")))
                if nxt[q] not in best or way[:2] < best[nxt[q]][:2]:
                    best[nxt[q]] = way
        return best

    for (_, role, text), flag in zip(kept, flags, strict=True):
        new = {}
        for q, (cost, letters, said) in insert(best).items():
            ways = [(q, cost + 3, letters + "D", said)]
            if flag not in ("blank", "duplicate"):
                more = flag == "truncated"
                if role[:1] in after[q]:
                    ways.append((after[q][role[:1]], cost + more, letters + "K", (*said, (role, text))))
                ways.append((nxt[q], cost + 2 + more, letters + "R", (*said, (nxt[q], text))))
            for to, *way in ways:
                if to not in new or tuple(way[:2]) < new[to][:2]:
                    new[to] = tuple(way)
        best = new
    cost, audit, said = min((v for q, v in insert(best).items() if q in ("", "a")), key=lambda v: v[:2])
    names = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{names.get(r, r)}:{t}" for r, t in said)
    turns = [t for t, _, _ in kept if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def check(spark, rows):
    schema = "conv_id long, turn long, role string, text string, cost long, pid int"
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], schema)
    got = {r["conv_id"]: r.asDict() for r in cr.repair_report(df).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(got) == set(groups)
    for conv, mine in groups.items():
        want = {"conv_id": conv, **plainly(mine)}
        assert got[conv] == want, (conv, mine[:6], got[conv], want)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(400):
        for turn in range(rng.choice((0, 1, 2, 3, 5, 9, 14))):
            rows.append((conv, rng.choice((turn, turn, turn, None, 3)), rng.choice(("user", "assistant", "system", "tool", "", "usher", None)),
                         rng.choice(("Yes.", "No!", "and so", "", " \t", "ü?", "a.\n ", None, f"turn {turn}."))))
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "assistant", ""),
                  (1, None, "assistant", "x" * 200_000 + "."), (2, 5, "user", "One."), (2, -3, "system", "Be kind."), (2, -3, "system", "Be kind.")])


def test_long_conversation_in_many_segments(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(("user", "assistant", "user", "assistant", "system")), rng.choice(("So.", "then", f"{t}!"))) for t in range(1500)]
    rows += [(7, 40, "user", "Same.")] * 50 + [(8, t, "user", "Same.") for t in range(60)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_report(df).count() == 0


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 33])
def test_crossings_equal_the_whole_search(size):
    rng = random.Random(size)
    for _ in range(60):
        codes = bytes(rng.choice(range(12)) for _ in range(size))
        for start in range(4):
            cost, _ = cr.forward([cr.TURNS[c] for c in codes], start)
            # all ways with their letters, by state
            best = {start: (0, "")}
            for c in codes:
                new = {}
                for q, (a, letters) in best.items():
                    for to, (b, more) in cr.STEPS[c][q].items():
                        way = (a + b, letters + more)
                        new[to] = min(new.get(to, way), way)
                best = new
            for end, (a, letters) in best.items():
                assert cost[end] == a
                assert "".join(cr.edits(codes, start, end)) == letters

"""Cheapest repair of conversations by Hirschberg's divide and conquer over four states.

A repaired conversation's role initials read ``(s?(ua)+)?``. That is an automaton of four
states: nothing yet, after ``s``, after ``u``, after ``a``. Edits keep, rerole, delete or insert;
each letter of an edit leads from a state to one state, so a sequence of edits is named by its
letters. What a run of rows costs is a four-by-four table of least costs from the state before it
to the state after it.

To find the edits between two given states the run is halved: a forward vector of four costs from
its start and a backward one from its end meet in the middle, the crossing with the least sum
is taken, and both halves are solved in the same way. No table of all rows is kept, so space is
linear. Among equal sums the crossing with the ASCII-least edits wins. For this the forward vector
also ranks its four edit sequences: all end with the edit of the same row, so none is the
beginning of another, and what follows cannot change their order.

The same halving works on segments. Rows are dealt by range over (conversation, turn, role,
text), so a conversation of any length lies in as many tasks as it fills; each task folds its
segments to four-by-four tables, the few tables of a conversation are solved to states at the
segments' borders, and each task then solves its own segments between these.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialize

INF = 1 << 60
NEXT = (2, 2, 3, 2)  # the state after an inserted or reroled turn
ROLE = {2: "user", 3: "assistant"}
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # the state after a kept turn
CLASSES = "sua-"  # initials, other ones last
TAIL = ("", "II", "I", "")  # what closes a conversation in each state, 2 for each
LEGAL = {(0, 1), (1, 2), (2, 1)}

Table = tuple[tuple[int, ...], ...]
Element = tuple[Table, Table]  # costs from state to state, and ranks of the edits of one row of it


def _steps(code: int) -> list[dict[int, tuple[int, str]]]:
    """For one turn: per state before it, ``{state after it: (cost, edits)}``.

    ``code`` is the class of the role's initial, with 4 for truncated and 8 for turns that must go.
    """
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        q, inserted = state, ""
        for _ in range(3):
            ways = [(q, 3, "D")]
            if not code & 8:
                cut = 1 if code & 4 else 0
                if (kept := KEEP[q].get(CLASSES[code & 3])) is not None:
                    ways.append((kept, cut, "K"))
                ways.append((NEXT[q], 2 + cut, "R"))
            for after, cost, letter in ways:
                way = (cost + 2 * len(inserted), inserted + letter)
                best[after] = min(best.get(after, way), way)
            q, inserted = NEXT[q], inserted + "I"
        out.append(best)
    return out


STEPS = [_steps(code) for code in range(12)]


def _element(rows: list[dict[int, tuple[int, object]]]) -> Element:
    costs, ranks = [], []
    for best in rows:
        order = sorted(best, key=lambda q: best[q][1])
        costs.append(tuple(best[q][0] if q in best else INF for q in range(4)))
        ranks.append(tuple(order.index(q) if q in best else 4 for q in range(4)))
    return tuple(costs), tuple(ranks)


TURNS = [_element(rows) for rows in STEPS]


def forward(run: list[Element], state: int) -> tuple[list[int], list[int]]:
    """Least costs from ``state`` to each state after ``run``, and the ranks of their edits."""
    cost, rank = [INF] * 4, [0] * 4
    cost[state] = 0
    for costs, ranks in run:
        best = [min([(cost[q] + costs[q][to], rank[q], ranks[q][to]) for q in range(4)]) for to in range(4)]
        order = sorted(b[1:] for b in best)
        cost = [min(b[0], INF) for b in best]
        rank = [order.index(b[1:]) for b in best]
    return cost, rank


def backward(run: list[Element], state: int) -> list[int]:
    """Least costs from each state before ``run`` to ``state`` after it."""
    cost = [INF] * 4
    cost[state] = 0
    for costs, _ in reversed(run):
        cost = [min(INF, *[row[to] + cost[to] for to in range(4)]) for row in costs]
    return cost


def crossings(run: list[Element], before: int, after: int) -> list[int]:
    """The states after each element of ``run`` on the ASCII-least cheapest way from ``before`` to ``after``."""
    out, todo = [], [(0, len(run), before, after)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low == 1:
            out.append(q)
            continue
        if high == low:
            continue
        middle = (low + high) // 2
        cost, rank = forward(run[low:middle], p)
        rest = backward(run[middle:high], q)
        at = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
        todo += [(middle, high, at, q), (low, middle, p, at)]
    return out


def _fold(codes: bytes) -> list[int]:
    run = [TURNS[c] for c in codes]
    tables = [forward(run, q) for q in range(4)]
    return [v for cost, _ in tables for v in cost] + [v for _, rank in tables for v in rank]


@functools.lru_cache(maxsize=1 << 16)
def _short_fold(codes: bytes) -> list[int]:
    return _fold(codes)


def fold(codes: bytes) -> list[int]:
    """The table of a run of turns: 16 costs and 16 ranks. Short runs are alike and remembered."""
    return _short_fold(codes) if len(codes) <= 32 else _fold(codes)


def unfold(numbers: list[int]) -> Element:
    rows = [tuple(numbers[i : i + 4]) for i in range(0, 32, 4)]
    return tuple(rows[:4]), tuple(rows[4:])


def _edits(codes: bytes, before: int, after: int) -> tuple[str, ...]:
    states = [before, *crossings([TURNS[c] for c in codes], before, after)]
    return tuple(STEPS[c][p][q][1] for c, p, q in zip(codes, states[:-1], states[1:], strict=True))


@functools.lru_cache(maxsize=1 << 16)
def _short_edits(codes: bytes, before: int, after: int) -> tuple[str, ...]:
    return _edits(codes, before, after)


def edits(codes: bytes, before: int, after: int) -> tuple[str, ...]:
    """The edits of each turn between two states, inserts ahead of the turn's own letter."""
    return (_short_edits if len(codes) <= 32 else _edits)(codes, before, after)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: the rows after damage, equal ones as one with their number.

    A null counts as one space, in the hashed name of a row as well. crc32 of ``conv_id:turn``
    modulo 20 drops a row (0), empties its text (1), takes its ``.!?`` out (2), repeats it (3) or
    sets its role to user (4).
    """
    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("fault", fault)
    rows = rows.filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))


def marked(turns: DataFrame) -> DataFrame:
    """``turns`` with ``blank, cut`` and ``seen``: whether an earlier turn has the same role and text."""
    own = [F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))]
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    turns = turns.withColumns({"h1": own[0], "h2": own[1], "last": F.right(bare, F.lit(1))})
    firsts = turns.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x"), F.col("h2").alias("y")).agg(F.min(at).alias("first"))
    joined = turns.join(
        firsts, turns["conv_id"].eqNullSafe(firsts["c"]) & (turns["role"] == firsts["r"])
        & (turns["h1"] == firsts["x"]) & (turns["h2"] == firsts["y"]),
    )
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return joined.select(
        "conv_id", "turn", "role", "text", F.col("times").cast("long").alias("times"), kind.alias("kind"),
        (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("cut"), (at > F.col("first")).alias("seen"),
    )


# a row of a conversation (at >= 0), or its segment in one task (at = -1)
DEALT = (
    "conv_id {0}, pid int, at long, role string, text string, times long, codes binary, fold array<long>, "
    "counts array<long>, turns array<long>"
)


class _Segment:
    """What a task knows of its rows of one conversation."""

    def __init__(self) -> None:
        self.codes, self.rows = bytearray(), 0
        self.blank = self.duplicate = self.truncated = self.distinct = 0
        self.first: int | None = None
        self.last: int | None = None

    def add(self, turn: int | None, kind: int, blank: bool, cut: bool, seen: bool, times: int) -> None:
        gone = blank or seen
        self.codes.append(kind | (8 if gone else 4 if cut else 0))
        self.codes += bytes([kind | 8]) * (times - 1)
        if blank:
            self.blank += times
        else:
            self.duplicate += times - 1 + seen
            self.truncated += cut and not seen
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.rows += 1

    def illegal(self) -> int:
        kinds = [c & 3 for c in self.codes]
        return sum(pair not in LEGAL for pair in zip(kinds[:-1], kinds[1:], strict=True))


def _deal(turns: DataFrame) -> DataFrame:
    """Rows in order over all tasks (``pid``, ``at``), with a row per conversation and task for its segment."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "pid", "at", "role", "text", "times", "codes", "fold", "counts", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, conv, open_ = TaskContext.get().partitionId(), None, None
        done: list[tuple] = []

        def close() -> None:
            if open_ is not None:
                codes = bytes(open_.codes)
                done.append((conv, codes, fold(codes),
                             [open_.blank, open_.duplicate, open_.truncated, open_.illegal(), open_.distinct, codes[0] & 3, codes[-1] & 3],
                             [open_.first, open_.last]))

        def segments(like: pa.DataType) -> pa.RecordBatch:
            n, cols = len(done), list(zip(*done, strict=True))
            empty = [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], like), pa.array([pid] * n, pa.int32()), pa.array([-1] * n, pa.int64()), *empty,
                 pa.array(cols[1], pa.binary()), *[pa.array(c, pa.list_(pa.int64())) for c in cols[2:]]], names=names)

        like = None
        for batch in batches:
            like, n, at = batch.column(0).type, batch.num_rows, []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 5, 6, 7, 8, 4)]
            for c, *values in zip(*columns, strict=True):
                if open_ is None or c != conv:
                    close()
                    conv, open_ = c, _Segment()
                at.append(open_.rows)
                open_.add(*values)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pid] * n, pa.int32()), pa.array(at, pa.int64()), batch.column(2), batch.column(3),
                 batch.column(4), pa.nulls(n, pa.binary()), *[pa.nulls(n, longs) for _ in range(3)]], names=names)
            if done:
                yield segments(like)
                done.clear()
        close()
        if done:
            yield segments(like)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "tie"]
    sorted_ = turns.withColumn("tie", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select("conv_id", "turn", "role", "text", "times", "kind", "blank", "cut", "seen").mapInArrow(
        run, DEALT.format(kind))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
PATH = "array<struct<pid:int,before:int,after:int,tail:string>>"
_LONGEST = (1 << 63) - 1


def _join_segments(parts: list[dict]) -> tuple[list[int], list[dict]]:
    """The report's numbers of one conversation from its segments in order, and each one's border states."""
    run = [unfold(p["fold"]) for p in parts]
    cost, rank = forward(run, 0)
    end = min(range(4), key=lambda s: (cost[s] + 2 * len(TAIL[s]), rank[s]))
    states = [0, *crossings(run, 0, end)]
    counts = [sum(p["counts"][i] for p in parts) for i in range(5)]
    for a, b in zip(parts[:-1], parts[1:], strict=True):
        counts[3] += (a["counts"][6], b["counts"][5]) not in LEGAL
    # a turn that goes on from one segment to the next was counted in both
    dated = [p["turns"] for p in parts if p["turns"][0] is not None]
    distinct = counts[4] - sum(a[1] == b[0] for a, b in zip(dated[:-1], dated[1:], strict=True))
    gaps = dated[-1][1] - dated[0][0] + 1 - distinct if dated else 0
    path = [
        {"pid": p["pid"], "before": states[i], "after": states[i + 1], "tail": TAIL[end] if i == len(parts) - 1 else ""}
        for i, p in enumerate(parts)
    ]
    return [min(gaps, _LONGEST), *counts[:4], cost[end] + 2 * len(TAIL[end])], path


def _paths(dealt: DataFrame) -> DataFrame:
    """Per conversation the report's numbers and the border states of its segments. A list holds a
    segment per task at most, so it is bounded by the number of tasks, not of rows."""
    kind = dealt.schema["conv_id"].dataType.simpleString()
    lists = dealt.filter("at = -1").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pid", "fold", "counts", "turns"))).alias("parts"))
    path = pa.list_(pa.struct([("pid", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("tail", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [_join_segments(parts) for parts in batch.column(1).to_pylist()]
            numbers = [pa.array([s[0][i] for s in solved], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array([s[1] for s in solved], path)],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "path"])

    return lists.mapInArrow(run, f"conv_id {kind}, {REPORT}, path {PATH}")


def _apply(dealt: DataFrame, paths: DataFrame) -> DataFrame:
    """``conv_id, part, place, edit, role, text``: every edit in order, deleted turns included."""
    kind = dealt.schema["conv_id"].dataType.simpleString()
    borders = paths.select(F.col("conv_id").alias("c"), F.explode("path").alias("b"))
    heads = dealt.filter("at = -1").join(borders, dealt["conv_id"].eqNullSafe(borders["c"]) & (dealt["pid"] == F.col("b.pid"))).select(
        "conv_id", "pid", "at", "role", F.col("b.tail").alias("text"), "times", "codes", F.col("b.before").alias("before"), F.col("b.after").alias("after"))
    turns = dealt.filter("at >= 0").select(
        "conv_id", "pid", "at", "role", "text", "times", F.lit(None).cast("binary").alias("codes"),
        F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"))
    rows = heads.union(turns).repartition("conv_id", "pid").sortWithinPartitions("conv_id", "pid", "at")
    names = ["conv_id", "part", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: tuple[str, ...] = ()
        at = place = state = 0
        tail = ""
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for conv, pid, number, role, text, times, codes, before, after in zip(*columns, strict=True):
                if number < 0:
                    todo, at, place, state, tail = edits(codes, before, after), 0, 0, before, text
                else:
                    for letters in todo[at : at + times]:
                        for letter in letters:
                            shown, said = role, text
                            if letter == "K":
                                state = KEEP[state][role[:1]]
                            elif letter != "D":
                                state = NEXT[state]
                                shown, said = ROLE[state], "" if letter == "I" else text
                            out.append((conv, pid, place, letter, shown, said))
                            place += 1
                    at += times
                if at == len(todo):
                    for letter in tail:
                        state = NEXT[state]
                        out.append((conv, pid, place, letter, ROLE[state], ""))
                        place += 1
                    tail = ""
            if out:
                kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, part int, place long, edit string, role string, text string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits and the report of all conversations, both as written tables.

    Edits: ``conv_id, part, place, edit, role, text``, in order of ``part`` and ``place``, with what
    each turn becomes (or was, if deleted). Report: ``conv_id`` and ``gaps, blank, duplicate,
    truncated, illegal, cost``.

    Rows go by turn, null first, ties by role and the text's md5. Repeated rows are duplicates of the
    first. A null ``conv_id`` is a conversation of its own; a null role or text is one space.
    """
    turns = materialize(marked(damaged(conversations)), "turns")
    dealt = materialize(_deal(turns), "dealt")
    paths = materialize(_paths(dealt), "paths")
    return materialize(_apply(dealt, paths), "edits"), paths.drop("path")


def audits(edits: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of the rows :func:`repair` gives.

    A digest of a whole text can only be taken in order, so each conversation streams through one
    task here; nothing but the digest and the letters are held.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, letters = None, None, []

        def line() -> tuple:
            return conv, "".join(letters), digest[0].hexdigest()

        for batch in batches:
            out = []
            for c, edit, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 3, 4, 5)], strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append(line())
                    conv, digest, letters = c, [hashlib.sha256(), ""], []
                letters.append(edit)
                if edit != "D":
                    digest[0].update(f"{digest[1]}{role}:{text}".encode())
                    digest[1] = "\n"
            if out:
                yield _lines(out, batch.column(0).type)
        if digest is not None:
            yield _lines([line()], batch.column(0).type)

    def _lines(out: list[tuple], like: pa.DataType) -> pa.RecordBatch:
        cols = zip(zip(*out, strict=True), [like, pa.string(), pa.string()], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], names=["conv_id", "audit", "repaired_sha256"])

    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return rows.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row for every ``conv_id``: the report of :func:`repair`, the edits' letters and a digest.

    A conversation that damage leaves no row has zeros, no edits, and the digest of nothing.
    """
    edits, report = repair(conversations)
    lines = audits(edits)
    whole = conversations.select(F.col("conv_id").alias("c")).distinct()
    joined = whole.join(report, whole["c"].eqNullSafe(report["conv_id"]), "left").drop("conv_id")
    joined = joined.join(lines, joined["c"].eqNullSafe(lines["conv_id"]), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

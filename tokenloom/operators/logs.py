"""Log analysis: run records, request latency, call totals, thread sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.scalars import int_div
from tokenloom.operators.ordered import running_total, with_path, with_row_blocks
from tokenloom.session import materialize

DEADLINE_US = 5_000_000
LOG_BLOCK_BYTES = 1 << 20

# The marks and labels of the run log, and the fields they set.
BEFORE_MARK = "[RUSAGE] Before BPE"
AFTER_MARK = "[RUSAGE] After BPE"
STAGED_FIELDS = [
    ("User time:", "user_time"),
    ("System time:", "sys_time"),
    ("Max RSS:", "rss"),
    ("Page Faults (soft):", "pagefault_soft"),
    ("Page Faults (hard):", "pagefault_hard"),
    ("Voluntary Context Switches:", "ctx_voluntary"),
    ("Involuntary Context Switches:", "ctx_involuntary"),
]
PERF_MARK = "[PERF]"
TIME_MARK = "토큰화 처리 시간:"
SIZE_MARK = "byte_size"
END_MARK = "[경과시간] spdk 응답 전송 완료"
DIFFERENCES = {
    "cpu_time_diff_ms": "user_time",
    "sys_time_diff_ms": "sys_time",
    "rss_diff_kb": "rss",
    "pagefault_soft_diff": "pagefault_soft",
    "pagefault_hard_diff": "pagefault_hard",
    "ctx_voluntary_diff": "ctx_voluntary",
    "ctx_involuntary_diff": "ctx_involuntary",
}
PLAIN_FIELDS = [
    "bpe_time_us", "output_size_bytes", "instructions", "cpu_cycles", "branch_instructions",
    "branch_misses", "l1d_access", "l1d_miss", "l3_access", "l3_miss",
]
_DOUBLES = ("user_time", "sys_time")


# what a segment's scan tells of a place: the 14 staged and 10 plain fields, then the staged ones
# that were set while the segment had not yet shown their stage
_N_STAGED = len(STAGED_FIELDS)
FIELDS = [f"{s}_{n}" for s in ("before", "after") for _, n in STAGED_FIELDS] + PLAIN_FIELDS
_EARLY = [f"early_{n}" for _, n in STAGED_FIELDS]
_KINDS = {n: "double" if n.endswith(_DOUBLES) else "long" for n in [*FIELDS, *_EARLY]}
_SCAN = "file string, segment long, byte_offset long, cleared boolean, stage int, " + ", ".join(
    f"{n} {k}" for n, k in _KINDS.items())
_BEFORE, _AFTER, _STAGED, _PLAIN, _END = range(5)


def _parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``file, byte_offset, kind, field, raw`` of the marked lines; the first mark that fits decides."""
    n = batch.num_rows
    lines = pc.utf8_trim(batch.column(2), " ")
    kind, field = np.full(n, -1), np.full(n, -1)

    def take(mark: str, k: int, f: int = -1) -> np.ndarray:
        hit = (kind < 0) & pc.fill_null(pc.match_substring(lines, mark), False).to_numpy(zero_copy_only=False)
        kind[hit], field[hit] = k, f
        return np.flatnonzero(hit)

    raw = np.full(n, None, dtype=object)

    def read(at: np.ndarray, pattern: str, text: pa.Array | None = None) -> None:
        got = pc.extract_regex(lines.take(pa.array(at)) if text is None else text, pattern)
        raw[at] = pc.struct_field(got, "v").to_numpy(zero_copy_only=False)

    take(BEFORE_MARK, _BEFORE)
    take(AFTER_MARK, _AFTER)
    staged = np.concatenate([take(mark, _STAGED, i) for i, (mark, _) in enumerate(STAGED_FIELDS)])
    read(staged, r"^[^:]*:\s*(?P<v>[^\s:]+)")
    perf = take(PERF_MARK, _PLAIN)
    text = pc.replace_substring(lines.take(pa.array(perf)), PERF_MARK, "")
    read(perf, r"^[^:]*:(?P<v>[^:]*)$", text)
    names = pc.struct_field(pc.extract_regex(text, r"^(?P<v>[^:]*):[^:]*$"), "v")
    names = pc.replace_substring(pc.utf8_lower(pc.utf8_trim(names, " ")), " ", "_")
    field[perf] = pc.fill_null(pc.index_in(names, pa.array(PLAIN_FIELDS)), -1).to_numpy()
    read(take(TIME_MARK, _PLAIN, PLAIN_FIELDS.index("bpe_time_us")), r"(?P<v>[0-9]+)")
    read(take(SIZE_MARK, _PLAIN, PLAIN_FIELDS.index("output_size_bytes")), r"byte_size: (?P<v>[0-9]+)")
    take(END_MARK, _END)
    keep = np.flatnonzero((kind >= 0) & ((field >= 0) | ~np.isin(kind, (_STAGED, _PLAIN))))
    at = pa.array(keep)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(at), batch.column(1).take(at), pa.array(kind[keep], pa.int32()),
         pa.array(field[keep], pa.int32()), pa.array(raw[keep], pa.string())],
        names=["file", "byte_offset", "kind", "field", "raw"],
    )


def parse_run_lines(lines: DataFrame) -> DataFrame:
    """``file, byte_offset, kind, field, whole, frac`` of the lines that mean something."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _parse_batch(batch)

    rows = lines.select("file", F.col("byte_offset").cast("long").alias("byte_offset"), "value")
    df = rows.mapInArrow(run, "file string, byte_offset long, kind int, field int, raw string")
    double = (F.col("kind") == _STAGED) & (F.col("field") < len(_DOUBLES))
    df = df.withColumns({"whole": F.when(~double, F.col("raw").try_cast("long")), "frac": F.when(double, F.col("raw").try_cast("double"))})
    sets = F.col("kind").isin(_STAGED, _PLAIN)
    return df.where(~sets | F.col("whole").isNotNull() | F.col("frac").isNotNull()).drop("raw")


def _scan_segments(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole segments in order: a row for each end line, and one for the state after each segment."""
    segment = batch.column("segment").to_numpy()
    kind = batch.column("kind").to_numpy()
    field = batch.column("field").fill_null(-1).to_numpy()
    value = {"long": batch.column("whole").fill_null(0).to_numpy(), "double": batch.column("frac").fill_null(0).to_numpy()}
    n, at = len(kind), np.arange(len(kind))
    files = batch.column("file").dictionary_encode().indices.fill_null(-1).to_numpy()
    new = np.ones(n, dtype=bool)
    new[1:] = (segment[1:] != segment[:-1]) | (files[1:] != files[:-1])
    start = np.maximum.accumulate(np.where(new, at, 0))
    clear = np.maximum.accumulate(np.where(kind == _BEFORE, at, -1))
    mark = np.maximum.accumulate(np.where(kind <= _AFTER, at, -1))
    stage = np.where(mark >= start, kind[np.maximum(mark, 0)], -1)
    column = np.where(
        kind == _STAGED, np.where(stage >= 0, stage * _N_STAGED + field, len(FIELDS) + field),
        np.where(kind == _PLAIN, 2 * _N_STAGED + field, -1),
    )
    ends = np.flatnonzero(kind == _END)
    last = np.append(np.flatnonzero(new)[1:], n) - 1
    # a place asks for what was set up to (not at) an end line, or up to and at a segment's last line
    upto = np.concatenate([ends, last + 1])
    own = np.concatenate([ends, last])
    since = np.maximum(start[own], clear[own])
    columns = []
    for j, (_, type_) in enumerate(_KINDS.items()):
        places = np.flatnonzero(column == j)
        k = np.searchsorted(places, upto) - 1
        got = places[np.maximum(k, 0)] if len(places) else np.zeros(len(upto), dtype=np.int64)
        known = (k >= 0) & (got >= since)
        columns.append(pa.array(value[type_][got], mask=~known))
    records = np.concatenate([np.ones(len(ends), dtype=bool), np.zeros(len(last), dtype=bool)])
    return pa.RecordBatch.from_arrays(
        [batch.column("file").take(pa.array(own)), pa.array(segment[own]),
         pa.array(batch.column("byte_offset").to_numpy()[own], mask=~records), pa.array(clear[own] >= start[own]),
         pa.array(stage[own].astype(np.int32), mask=stage[own] < 0), *columns],
        names=[c.split()[0] for c in _SCAN.split(", ")],
    )


def _whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew where a segment ends, so that none is spread over two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        file, segment = batch.column("file"), batch.column("segment")
        first = held and (held[0].column("file")[0], held[0].column("segment")[0])
        if held and (file[batch.num_rows - 1], segment[batch.num_rows - 1]) != first:
            # where this batch's last segment begins
            same = (segment.to_numpy() != segment[-1].as_py()) | np.array([f != file[-1].as_py() for f in file.to_pylist()])
            cut = int(np.flatnonzero(same)[-1]) + 1 if same.any() else 0
            done = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            yield from done.to_batches()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _incoming(states: DataFrame) -> DataFrame:
    """The state before every segment: states are folded in order, one row of memory per file."""
    names = ["file", "segment", "stage_in", *[f"{n}_in" for n in FIELDS]]
    ddl = "file string, segment long, stage_in int, " + ", ".join(f"{n}_in {_KINDS[n]}" for n in FIELDS)
    types = [pa.string(), pa.int64(), pa.int32(), *[pa.float64() if _KINDS[n] == "double" else pa.int64() for n in FIELDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stage, now = object(), None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, stage, now = row["file"], None, dict.fromkeys(FIELDS)
                out.append((file, row["segment"], stage, *[now[n] for n in FIELDS]))
                if row["cleared"]:
                    now = {n: row[n] for n in FIELDS}
                else:
                    early = {} if stage is None else {FIELDS[stage * _N_STAGED + i]: row[e] for i, e in enumerate(_EARLY)}
                    now = {n: next((v for v in (row[n], early.get(n)) if v is not None), now[n]) for n in FIELDS}
                stage = stage if row["stage"] is None else row["stage"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return states.drop("byte_offset").repartition("file").sortWithinPartitions("file", "segment").mapInArrow(run, ddl)


def log_runs(lines: DataFrame) -> DataFrame:
    """One record per end line of ``(file, byte_offset, value)``.

    A log is cut into segments of ``LOG_BLOCK_BYTES``. A segment is scanned once: for each end line
    and for its own end it tells the last value of every field since the last "before" mark, and
    which staged values came before it showed a stage. Such summaries are associative, so a
    fold over them (a row per segment) gives every segment the state it starts with, and its
    records are completed from that.
    """
    parsed = parse_run_lines(lines).withColumn("segment", int_div(F.col("byte_offset").cast("long"), F.lit(LOG_BLOCK_BYTES).cast("long")))
    dealt = parsed.repartition("file", "segment").sortWithinPartitions("file", "segment", "byte_offset")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_segments(batches):
            yield _scan_segments(batch)

    scanned = materialize(dealt.mapInArrow(scan, _SCAN), "log-scan")
    start = _incoming(scanned.where("byte_offset is null"))
    records = scanned.where("byte_offset is not null").join(
        start.withColumnRenamed("file", "_file").withColumnRenamed("segment", "_segment"),
        F.col("file").eqNullSafe(F.col("_file")) & (F.col("segment") == F.col("_segment")))
    goes_on = ~F.col("cleared")
    final = {}
    for j, n in enumerate(FIELDS):
        parts = [F.col(n)]
        if j < 2 * _N_STAGED:
            parts.append(F.when(goes_on & (F.col("stage_in") == j // _N_STAGED), F.col(_EARLY[j % _N_STAGED])))
        final[n] = F.coalesce(*parts, F.when(goes_on, F.col(f"{n}_in"))).alias(n)
    wide = records.select("file", "byte_offset", *final.values())
    zero = F.lit(0)
    return wide.select(
        "file",
        "byte_offset",
        *[
            (F.coalesce(f"after_{f}", zero) - F.coalesce(f"before_{f}", zero)).alias(out)
            for out, f in DIFFERENCES.items()
        ],
        *PLAIN_FIELDS,
    )


def label_runs(records: DataFrame) -> DataFrame:
    """Prefix each record with ``run_1 … run_n`` in log order, per file."""
    df, path = with_path(records, "byte_offset", LOG_BLOCK_BYTES, levels=2)
    df = running_total(df, ["file"], path, ["byte_offset"], {"_n": F.lit(1)}, inclusive=True)
    return df.withColumn("run", F.concat(F.lit("run_"), F.col("_n").cast("string"))).drop("_n", "_p1", "_p2")


def write_log_runs_csv(records: DataFrame, path: str) -> None:
    """Run label first, then the record's columns; one folder per log file."""
    out = label_runs(records)
    cols = ["run", *DIFFERENCES, *PLAIN_FIELDS, "file"]
    out.select(*cols).write.mode("overwrite").partitionBy("file").option("header", True).csv(path)


def parse_request_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write and read marks of a request log as two tables."""
    # The two line formats.
    write = r"\[WRITE-TS\] Req (\d+) slot=(\d+) at (\d+) us"
    read = r"\[READ-TS\]\s+Req (\d+) slot=(\d+) at (\d+) us \(size=(\d+)\)"

    def part(pattern: str, k: int, name: str) -> Column:
        return F.regexp_extract("value", pattern, k).cast("long").alias(name)

    writes = lines.where(F.col("value").rlike(write)).select(
        part(write, 1, "req_id"), part(write, 2, "slot"), part(write, 3, "write_us")
    )
    reads = lines.where(F.col("value").rlike(read)).select(
        part(read, 1, "req_id"), part(read, 3, "read_us"), part(read, 4, "byte_size")
    )
    return writes, reads


def request_latency(writes: DataFrame, reads: DataFrame, deadline_us: int = DEADLINE_US) -> DataFrame:
    """First answer between every request and its deadline; none is a timeout.

    An answer before its request belongs to an earlier use of the id. Answers are
    reduced to one per request (a partial aggregate), so repeated answers never
    multiply rows.
    """
    asked = writes.select("req_id", "write_us").distinct()
    after = F.col("read_us") - F.col("write_us")
    first = asked.join(reads, "req_id").where((after >= 0) & (after <= deadline_us)).groupBy("req_id", "write_us").agg(
        F.min(F.struct("read_us", "byte_size")).alias("_r")
    ).select("req_id", "write_us", "_r.*")
    j = writes.join(first, ["req_id", "write_us"], "left")
    latency = F.col("read_us") - F.col("write_us")
    in_time = F.col("read_us").isNotNull()
    return j.select(
        "req_id", "slot", "write_us",
        F.when(in_time, latency).alias("latency_us"),
        F.when(in_time, F.col("byte_size")).alias("byte_size"),
        (~in_time).alias("timed_out"),
    )


def cumulative_time(
    calls: DataFrame, process: str = "process", time: str = "ts_us", spent: str = "time_us", ties: Sequence[str] = (),
) -> DataFrame:
    """Running total of call times per process.

    Rows go by time and then by ``ties`` (by all other columns, if none are named), so equal times
    have one order. They are dealt to blocks of about equal numbers of rows: a busy hour of one
    process is many blocks, a quiet year is part of one.
    """
    order = [process, time, *(ties or [c for c in calls.columns if c not in (process, time)])]
    placed = with_row_blocks(calls, order)
    return running_total(placed, [process], ["_block"], order[1:], {"total_us": F.col(spent)}, inclusive=True).drop("_block")


def parse_call_log(lines: DataFrame) -> DataFrame:
    """Time and Total of tokenizer call lines."""
    pattern = r"\[LOG\] Time: (\d+) us, Total: (\d+) us"  # fixed value
    return lines.where(F.col("value").rlike(pattern)).withColumns(
        {
            "time_us": F.regexp_extract("value", pattern, 1).cast("long"),
            "logged_total_us": F.regexp_extract("value", pattern, 2).cast("long"),
        }
    )


def sweep_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of ``…/thread=<N>/*`` with the thread count from the folder name."""
    return spark.read.text(root, recursiveFileLookup=False).select("value", F.col("thread").cast("int").alias("thread"))


def sweep_summary(lines: DataFrame) -> DataFrame:
    """Per thread count: return code, elapsed seconds, tokens and throughput."""
    # The closing lines of a run.
    end = r"=== RUN END .* rc=(-?\d+) elapsed=([0-9.]+)s ==="
    whole = r"^\[ALL\] .*tokens=(\d+) .*throughput=([0-9.]+)"

    def last(pattern: str, k: int, kind: str) -> Column:
        return F.max(F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, k).cast(kind)))

    return lines.groupBy("thread").agg(
        last(end, 1, "int").alias("rc"),
        last(end, 2, "double").alias("elapsed_s"),
        last(whole, 1, "long").alias("tokens"),
        last(whole, 2, "double").alias("throughput"),
    ).withColumn("failed", F.coalesce(F.col("rc") != 0, F.lit(True)))


def parse_run_summary(lines: DataFrame) -> DataFrame:
    """Closing lines of block runs: segments, bytes, errors and elapsed time."""
    pattern = r"\[INFO\] segments=(\d+) total_bytes=(\d+) errors=(\d+) elapsed_us=(-?\d+)"  # fixed value
    names = ["segments", "total_bytes", "errors", "elapsed_us"]
    return lines.where(F.col("value").rlike(pattern)).select(
        *[F.regexp_extract("value", pattern, i + 1).cast("long").alias(n) for i, n in enumerate(names)]
    )

"""Ordered scans, ranges, counters, logs and streams against plain Python."""

import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom import api
from tokenloom.functions.scalars import core_list, decode_status, status_from_dw3, unescape_delimiter_col
from tokenloom.operators import blocks, corpus, counters, logs, ranges
from tokenloom.operators.ordered import last_seen, previous_row, running_total, with_path, with_row_blocks
from tokenloom.session import scratch_path
from tokenloom.streaming import streams


# ------------------------------------------------------------------- ordered
@pytest.mark.parametrize("levels", [1, 2])
def test_ordered_scans_equal_one_window(spark, levels):
    rng = random.Random(3)
    # key 0 holds most rows
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 4), p, rng.choice([None, rng.randrange(-5, 50)]))
            for p in rng.sample(range(60_000), 2000)]
    df = spark.createDataFrame(rows, "k long, pos long, v long").repartition(5)
    w = W.partitionBy("k").orderBy("pos")
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    plain = df.select(
        "k", "pos",
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("si"),
        F.last("v", True).over(upto).alias("l"),
        F.lag("pos").over(w).alias("p"),
    )
    d, path = with_path(df, "pos", 7, levels)
    d = running_total(d, ["k"], path, ["pos"], {"s": F.col("v")})
    d = running_total(d, ["k"], path, ["pos"], {"si": F.col("v")}, inclusive=True)
    d = last_seen(d, ["k"], path, ["pos"], {"l": F.col("v")})
    d = previous_row(d, ["k"], path, ["pos"], ["pos"])
    got = d.select("k", "pos", "s", "si", "l", F.col("prev.pos").alias("p"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_max_rows_and_round_robin(spark):
    rows = [(s, b, r, f"{s}{b}{r}") for s in range(3) for b in range(5) for r in range(4) if (s + b + r) % 3]
    df = spark.createDataFrame(rows, "shard long, batch_index long, row_in_batch long, text string").repartition(4)
    for n in (-1, 0, 1, 17, 999):
        got = sorted(tuple(r) for r in corpus.max_rows(df, n).select(*corpus.ORDER, "text").collect())
        assert got == (rows if n < 0 else rows[:n])
    got = corpus.round_robin(df, 4).orderBy(*corpus.ORDER).select("slot").collect()
    assert [r.slot for r in got] == [i % 4 for i in range(len(rows))]
    assert {r.slot for r in corpus.round_robin(df, 0).collect()} == {0}
    idx = corpus.batch_range_index(df, rows=17).collect()
    assert sum(r.num_rows for r in idx) == 17


# -------------------------------------------------------------------- ranges
def test_overlap_join_against_brute_force(spark):
    rng = random.Random(1)
    R = [(i, rng.randrange(1 << 22), rng.choice([0, 1, 5, 700, 5000, 100_000, 1 << 21])) for i in range(300)]
    E = [(i, rng.randrange(1 << 22), rng.randrange(1 << 30), rng.choice([0, 1, 300, 512, 4096, 200_000])) for i in range(300)]
    r = spark.createDataFrame(R, "rid long, start long, length long")
    e = spark.createDataFrame(E, "eid long, logical long, physical long, length long")
    want = []
    for rid, s, n in R:
        for eid, lo, ph, m in E:
            a, b = max(s, lo), min(s + n, lo + m)
            if n and a < b:
                p = ph + a - lo
                want.append((rid, eid, a, b - a, p // 512, -(-(p + b - a) // 512) - p // 512))
    pairs = ranges.overlap_join(r, e)
    got = pairs.select("rid", "eid", "overlap_start", "overlap_length", "slba", "nblocks").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    cover = {x.rid: x.covered for x in ranges.range_coverage(r, pairs, ["rid"]).collect()}
    assert len(cover) == 300 and all(cover[i] == (sum(w[3] for w in want if w[0] == i) >= n) for i, _, n in R)


def test_segment_align_against_single_blocks(spark):
    """Both lists spelled out block by block; blocks at equal positions belong together."""
    rng = random.Random(2)
    A = [(k, i, rng.randrange(1 << 30), rng.choice([0, 1, 7, 256])) for k in range(2) for i in range(200)]
    B = [(k, i, rng.randrange(1 << 30), rng.choice([3, 64, 500])) for k in range(2) for i in range(400)]
    want = []
    for k in range(2):
        blocks_in = [(i, slba + j) for key, i, slba, n in A if key == k for j in range(n)]
        blocks_out = [(i, slba + j) for key, i, slba, n in B if key == k for j in range(n)]
        pieces = {}
        for pos, ((i, x), (o, y)) in enumerate(zip(blocks_in, blocks_out)):
            pieces.setdefault((i, o), []).append((pos, x, y))
        want += [(k, *at[0], len(at)) for at in pieces.values()]
    ddl = "k long, seq long, slba long, nblocks long"
    a, b = spark.createDataFrame(A, ddl), spark.createDataFrame(B, ddl)
    got = ranges.segment_align(a, b, ["k"]).select("k", "pos", "in_slba", "out_slba", "nblocks").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="shorter"):
        ranges.segment_align(a, b.where("seq < 5"), ["k"]).collect()


def test_range_index_checks_coverage(spark, folder):
    df = spark.createDataFrame([(0, b, r, "x" * 300) for b in range(3) for r in range(4)],
                               "shard long, batch_index long, row_in_batch long, text string")
    ddl = "shard long, logical long, physical long, length long"
    whole = spark.createDataFrame([(0, 0, 1024, 2000), (0, 2000, 99 * 512, 5000)], ddl)
    rows = api.build_range_index(df, whole, f"{folder}/idx").orderBy("buffer.batch_index").collect()
    assert [len(r.buffer.lba_extents) for r in rows] == [1, 2, 1]
    assert rows[1].buffer.data_range.asDict() == {"offset": 1200, "length": 1200}
    with pytest.raises(ValueError, match="sparse or hole"):
        api.build_range_index(df, whole.where("logical = 0"))
    assert [r.buffer.lba_extents for r in api.build_range_index(df).collect()] == [[], [], []]


# -------------------------------------------------------------------- blocks
@pytest.mark.parametrize("boundary", ["raw", "char"])
def test_blocks_cut_everywhere(spark, model, boundary):
    texts = ["é😀" * 50, "", None, "plain ascii", "日本" * 33, "z"]
    df = spark.createDataFrame([(0, i // 2, i % 2, t) for i, t in enumerate(texts)],
                               "shard long, batch_index long, row_in_batch long, text string")
    whole = "".join(t or "" for t in texts).encode()
    for size in (4, 7, 64, 100_000):
        got = blocks.cut_blocks(df, block_bytes=size, boundary=boundary).orderBy("block_index").collect()
        assert b"".join(bytes(r.content) for r in got) == whole
        if boundary == "raw":
            assert [r.block_len for r in got] == [len(whole[i : i + size]) for i in range(0, len(whole), size)]
        else:
            assert all(bytes(r.content).decode() for r in got)
    per_batch = blocks.cut_blocks(df, block_bytes=50, scope="batch", delimiter=b"\n")
    assert per_batch.agg(F.sum("block_len")).first()[0] == len(whole) + 5


def test_block_capacity_and_loss(spark, model):
    df = spark.createDataFrame([(0, 0, 0, "@#" * 700)], "shard long, batch_index long, row_in_batch long, text string")
    out = blocks.block_tokenize(blocks.cut_blocks(df, block_bytes=1024), model, 1024).orderBy("block_index").collect()
    assert [(r.block_len, r.capacity) for r in out] == [(1024, 1024), (376, 512)]
    for r in out:
        assert r.kept == min(r.n_tokens, r.capacity // 4) and r.dropped == 0
        assert len(r.output) == r.capacity and len(r.overflow) == 4 * (r.n_tokens - r.kept)
    assert len(out[0].overflow) > 0
    cut = blocks.cut_blocks(df, block_bytes=1024)
    lossy = blocks.block_tokenize(cut, model, 1024, overflow="drop").orderBy("block_index").first()
    assert lossy.dropped == out[0].n_tokens - out[0].kept and "overflow" not in lossy
    with pytest.raises(Exception, match="more ids"):
        blocks.block_tokenize(cut, model, 1024, overflow="error").collect()
    with pytest.raises(ValueError):
        blocks.block_tokenize(cut, model, 1000)


def test_answers_count_only_after_their_request(spark):
    writes = spark.createDataFrame([(1, 0, 10_000_000), (2, 0, 0), (3, 0, 0)], "req_id long, slot long, write_us long")
    reads = spark.createDataFrame(
        [(1, 5_000_000, 4), (1, 10_500_000, 8), (1, 11_000_000, 12), (2, 5_000_001, 4)], "req_id long, read_us long, byte_size long")
    out = {r.req_id: (r.latency_us, r.byte_size, r.timed_out) for r in logs.request_latency(writes, reads).collect()}
    assert out == {1: (500_000, 8, False), 2: (None, None, True), 3: (None, None, True)}


def test_slot_reset_has_no_delta_and_high_slots_no_share(spark):
    snaps = spark.createDataFrame(
        [(0, 0, 1, 100), (0, 0, 2, 5), (0, 1, 2, 7), (0, 70, 2, 9)], "run long, slot long, tick long, resp long")
    rates = counters.slot_rates(snaps, 1000)
    assert {(r.slot, r.tick): r.delta for r in rates.collect()}[0, 2] is None
    fair = {r.tick: r.fairness for r in counters.jain_fairness(rates, ["run", "tick"]).collect()}
    assert fair[2] == pytest.approx(1 / 64)


# ------------------------------------------------------------------ counters
def test_rates_first_tick_and_reset(spark):
    snaps = spark.createDataFrame(
        [(0, 1, 10, 4, 1 << 20, 0), (0, 2, 30, 50, 3 << 20, 0), (0, 3, 5, 50, 3 << 20, 0), (0, 4, 6, 60, 4 << 20, 0)],
        "run long, tick long, req long, resp long, bytes_in long, bytes_out long")
    r = counters.counter_rates(snaps, 500).orderBy("tick").collect()
    assert [x.req_per_s for x in r] == [20.0, 40.0, None, 2.0]
    assert [x.counter_reset for x in r] == [False, False, True, False]
    assert [x.outstanding for x in r] == [6, 0, 0, 0] and r[0].in_mbps == 2.0
    fast = counters.counter_rates(snaps, 1).orderBy("tick").first()
    assert fast.req_per_s == 100.0  # the interval is never below 100 ms


def test_cpu_net_block_first_tick_is_zero(spark):
    cpu = spark.createDataFrame(
        [(0, t, c, 10 * t, 0, 0, 30 * t if t < 3 else 60, 0, 0, 0, 0) for t in (1, 2, 3) for c in (0, 1)],
        "run long, tick long, core long, " + ", ".join(f"{c} long" for c in counters.CPU_FIELDS))
    got = {(r.tick, r.core): r.busy_pct for r in api.monitor(cpu, kind="cpu", cores="1-0").collect()}
    assert got[(1, 0)] == 0.0 and got[(2, 1)] == 25.0 and got[(3, 0)] == 100.0
    both = counters.cpu_busy_all(cpu).orderBy("tick").collect()
    assert [r.cpu_busy_true_all for r in both] == [0.0, 25.0, 100.0]
    net = spark.createDataFrame([(0, "e", 1, 5, 5, 1, 1), (0, "e", 2, 5 + (1 << 20), 5, 4, 1)],
                                "run long, iface string, tick long, rx_bytes long, tx_bytes long, rx_drop long, tx_drop long")
    n = counters.net_rates(net, 1000).orderBy("tick").collect()
    assert [(r.rx_mbps, r.rx_drop_delta) for r in n] == [(0.0, 0), (1.0, 3)]
    blk = spark.createDataFrame([(0, "d", 1, 0, 0, 0, 3), (0, "d", 2, 4096, 0, 5000, 2)],
                                "run long, dev string, tick long, read_sectors long, write_sectors long, io_ticks_ms long, in_flight long")
    b = counters.block_rates(blk, 1000).orderBy("tick").collect()
    assert [(r.read_mbps, r.util_pct, r.in_flight) for r in b] == [(0.0, 0.0, 3), (2.0, 100.0, 2)]


def test_fairness_counts_idle_slots(spark):
    d = spark.createDataFrame([(1, 5), (1, 5), (2, 0), (3, None)], "tick long, delta long")
    got = {r.tick: r.fairness for r in counters.jain_fairness(d, ["tick"]).collect()}
    assert got == {1: 2 / 64, 2: 0.0, 3: 0.0}


def test_slots_without_a_worker(spark):
    q = spark.createDataFrame([(1, 10, 3, 100), (2, 20, 64, 50), (3, 30, 70, 7)], "req_id long, ts_us long, slot long, total_len long")
    p = spark.createDataFrame([(1, 15, 3, 8, 5), (2, 25, 64, 0, 5)], "req_id long, ts_us long, slot long, byte_size long, latency_us long")
    t = counters.runtime_totals(q, p).first()
    assert (t.req_total, t.resp_total, t.outstanding, t.bytes_in, t.last_slot, t.last_latency_us) == (3, 1, 2, 157, 70, 5)
    assert [tuple(r) for r in counters.slot_counters(q, p).select("slot", "req", "resp").collect()] == [(3, 1, 1)]


def test_worker_profile(spark):
    ddl = "worker string, shards long, tokens long, " + ", ".join(f"{s} long" for s in counters.STAGES)
    df = spark.createDataFrame([("w-2", 1, 50, *[0] * 7), ("w-10", 1, 100, *[1_000_000] * 7), (None, 1, 1, *[0] * 7)], ddl)
    got = {r.worker: r for r in counters.worker_profile(df).collect()}
    assert got["w-10"].tokens_per_hour == pytest.approx(100 / 7 * 3600) and got["w-2"].tokens_per_hour == 0.0
    assert got["ALL"].tokens == 151 and got[None].tokens == 1


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(core_list(F.lit("5-3,,9,4"))) == [3, 4, 5, 9] and one(core_list(F.lit("0-5,7"))) == [0, 1, 2, 3, 4, 5, 7]
    assert one(decode_status(F.lit(0))).label == "SUCCESS"
    s = one(decode_status(F.lit(0xC281)))
    assert (s.sct, s.sc, s.more, s.dnr, s.label) == (2, 0x81, 1, 1, "SCT=2 SC=0x81 M=1 DNR=1")
    assert one(status_from_dw3(F.lit(0x4002 << 17 | 0x1FFFF))) == 0x4002
    assert one(unescape_delimiter_col(F.lit("a\\n\\\\n\\x\\"))) == "a\n\\nx\\"


# ---------------------------------------------------------------------- logs
def run_log_text(blocks_):
    out = []
    for before, values, perf, ends in blocks_:
        if before:
            out.append(logs.BEFORE_MARK)
        out += [f"  User time: {values} ms", f"Max RSS: {values} KB"]
        out += [logs.AFTER_MARK, f"User time: {values * 3} ms", f"Voluntary Context Switches: {values}",
                f"Involuntary Context Switches: {values + 1}"]
        if perf:
            out += [f"[PERF] CPU Cycles: {values}", "[PERF] too: many: colons 5"]
        out += [f"byte_size: {values * 4}"] + [f"{logs.END_MARK}: 3 us"] * ends
    return "\n".join(out) + "\n"


def test_run_log_file(spark, folder):
    text = run_log_text([(False, 7, True, 1), (True, 2, True, 2), (False, 5, False, 1), (True, 4, False, 1)])
    open(f"{folder}/r.log", "w", encoding="utf-8").write(text)
    got = api.parse_runtime_log(spark, f"{folder}/r.log", f"{folder}/csv").orderBy("byte_offset").collect()
    assert [r.run for r in got] == [f"run_{i}" for i in range(1, 6)]
    # block 1 has no stage before its "after" mark: "before" counts as 0
    assert [r.cpu_time_diff_ms for r in got] == [21.0, 4.0, 4.0, 13.0, 8.0]
    assert [r.rss_diff_kb for r in got] == [0, -2, -2, 3, -4]
    assert [r.cpu_cycles for r in got] == [7, 2, 2, 2, None]
    assert [r.output_size_bytes for r in got] == [28, 8, 8, 20, 16]
    assert [r.ctx_involuntary_diff for r in got] == [8, 3, 3, 6, 5]
    assert any(n.startswith("file=") for n in os.listdir(f"{folder}/csv"))


def test_request_latency_edges(spark):
    lines = [
        "[WRITE-TS] Req 1 slot=2 at 100 us", "[READ-TS]  Req 1 slot=2 at 5000100 us (size=8)",
        "[WRITE-TS] Req 2 slot=3 at 100 us", "[READ-TS]  Req 2 slot=3 at 5000101 us (size=8)",
        "[WRITE-TS] Req 3 slot=0 at 100 us", "[WRITE-TS] Req 4 slot=0 at 7 us",
        "[READ-TS]  Req 4 slot=0 at 9 us (size=4)", "[READ-TS]  Req 4 slot=0 at 8 us (size=12)", "noise",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.req_id: r for r in logs.request_latency(*logs.parse_request_log(df)).collect()}
    assert (got[1].latency_us, got[1].timed_out) == (5_000_000, False)
    assert got[2].timed_out and got[2].latency_us is None and got[3].timed_out
    assert (got[4].latency_us, got[4].byte_size) == (1, 12) and len(got) == 4


def test_call_log_and_totals(spark):
    df = spark.createDataFrame([("[LOG] Time: 5 us, Total: 12 us",), ("other",)], "value string")
    assert [(r.time_us, r.logged_total_us) for r in logs.parse_call_log(df).collect()] == [(5, 12)]


def test_run_summary_lines(spark):
    df = spark.createDataFrame([("[INFO] segments=3 total_bytes=1536 errors=0 elapsed_us=77",), ("x",)], "value string")
    assert [tuple(r) for r in logs.parse_run_summary(df).collect()] == [(3, 1536, 0, 77)]


def test_profile_tokenize(spark, model):
    rows = [(i % 3, 0, i // 3, "the end" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "shard long, batch_index long, row_in_batch long, text string").repartition(4)
    got = {r.worker: r for r in api.profile_tokenize(spark, df).collect()}
    whole = got.pop("ALL")
    assert whole.tokens == sum(r.tokens for r in got.values()) == 45 * 4
    assert len(got) > 1 and all(r.total_s > 0 for r in got.values())


# ------------------------------------------------------------------- streams
def test_stream_rates_across_batches(spark):
    streams.use_rocksdb(spark)
    path = scratch_path(spark, "snaps")
    ddl = "run long, tick long, req long, resp long, bytes_in long, bytes_out long"
    parts = [[(0, 1, 10, 1, 0, 0), (1, 1, 5, 5, 0, 0)], [(0, 3, 5, 2, 0, 0), (0, 2, 30, 2, 0, 0)]]
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for part in parts:  # a restart from the checkpoint between the two
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
        stream = api.monitor(spark.readStream.schema(ddl).parquet(path), 1000)
        table = streams.run_available(stream, out, state)
    got = {(r.run, r.tick): (r.req_per_s, r.counter_reset) for r in table.collect()}
    assert got == {(0, 1): (10.0, False), (1, 1): (5.0, False), (0, 2): (20.0, False), (0, 3): (None, True)}


def test_request_timeout_edges(spark):
    base = 1_700_000_000
    q = [(1, base, 0), (2, base, 1), (3, base, 2), (9, base + 9_000, 3)]
    p = [(1, base + 5, 8), (2, base + 6, 8), (9, base + 9_000, 8)]  # exactly at, and after, the deadline
    qp, pp = scratch_path(spark, "q"), scratch_path(spark, "p")
    qs = "req_id long, ts timestamp, slot long"
    ps = "req_id long, ts timestamp, byte_size long"
    spark.createDataFrame(q, "req_id long, s long, slot long").selectExpr("req_id", "timestamp_seconds(s) ts", "slot").write.parquet(qp)
    spark.createDataFrame(p, "req_id long, s long, byte_size long").selectExpr("req_id", "timestamp_seconds(s) ts", "byte_size").write.parquet(pp)
    out = streams.run_to_table(streams.request_timeout(
        spark.readStream.schema(qs).parquet(qp), spark.readStream.schema(ps).parquet(pp)), "t")
    got = {r.req_id: (r.latency_us, r.timed_out) for r in out.collect()}
    assert got == {1: (5_000_000, False), 2: (None, True), 3: (None, True), 9: (0, False)}


def test_late_snapshot_is_no_reset(spark, folder):
    schema = "run long, tick long, req long, resp long, bytes_in long, bytes_out long"
    for k, row in enumerate([(0, 1, 10, 5, 0, 0), (0, 3, 30, 9, 0, 0), (0, 2, 20, 7, 0, 0), (0, 4, 50, 11, 0, 0)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(f"{folder}/in/{k}")
    streams.use_rocksdb(spark)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")
    out = {r.tick: (r.req_per_s, r.counter_reset) for r in streams.run_to_table(streams.stream_counter_rates(files, 1000), "late").collect()}
    assert out == {1: (10.0, False), 3: (20.0, False), 2: (None, False), 4: (20.0, False)}


def test_answers_are_taken_once(spark):
    base, us = 1_700_000_000, 1_000_000
    q = [(1, 0, 0), (1, 2 * us, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (4, 6 * us, 4), (9, 9_000 * us, 9)]
    p = [
        (1, 3 * us, 10), (1, 4 * us, 11), (1, 4 * us + 1, 12),  # two open requests of one id, a third answer is too many
        (2, -us, 20), (2, us, 21), (2, us, 22),  # a stale answer before a valid one that comes twice
        (3, -us, 30), (3, 5 * us + 1, 31),  # only stale and late ones
        (4, 6 * us, 40), (9, 9_000 * us, 90),  # the id's second use has the answer
    ]
    qp, pp = scratch_path(spark, "q"), scratch_path(spark, "p")
    at = f"timestamp_micros({base * us} + t) as ts"
    for k in (0, 1):  # answers may arrive before their requests, in other batches
        spark.createDataFrame(p[k::2], "req_id long, t long, byte_size long").selectExpr("req_id", at, "byte_size").coalesce(1).write.mode("append").parquet(pp)
        spark.createDataFrame(q[1 - k :: 2], "req_id long, t long, slot long").selectExpr("req_id", at, "slot").coalesce(1).write.mode("append").parquet(qp)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    qs, ps = "req_id long, ts timestamp, slot long", "req_id long, ts timestamp, byte_size long"
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = streams.request_timeout(read(qs, qp), read(ps, pp), lateness="1 hour", buckets=2, wait=True)
    got = streams.run_available(stream, out, state)
    # a further request of a new id moves the watermark past everything, after a restart
    spark.createDataFrame([(8, 99_000 * us, 0)], "req_id long, t long, slot long").selectExpr("req_id", at, "slot").coalesce(1).write.mode("append").parquet(qp)
    spark.createDataFrame([(8, 99_000 * us, 0)], "req_id long, t long, byte_size long").selectExpr("req_id", at, "byte_size").coalesce(1).write.mode("append").parquet(pp)
    got = streams.run_available(stream, out, state)
    rows = sorted(((r.req_id, r.slot, r.latency_us, r.timed_out) for r in got.where("req_id < 8").collect()), key=repr)
    assert rows == sorted([
        (1, 0, 3 * us, False), (1, 1, 2 * us, False), (2, 2, us, False), (3, 3, None, True), (4, 4, None, True), (4, 4, 0, False),
    ], key=repr)


def test_take_once_waits_for_the_watermark():
    rows = [(1, 0, True, 5, None), (1, 30, False, None, 7), (2, 0, True, 6, None), (3, 10, False, None, 1)]
    done, kept = streams.take_once(list(rows), 50, 20)
    assert done == [] and sorted(kept, key=repr) == sorted(rows[:3], key=repr)  # the answer of 3 has no request to come
    done, kept = streams.take_once(kept, 50, 30)
    assert done == [(1, 0, 5, 30, 7, False)] and kept == [rows[2]]
    assert streams.take_once(kept, 50, 50) == ([(2, 0, 6, None, None, True)], [])


def test_log_runs_over_segment_borders(spark, monkeypatch):
    """Segments of a few lines give the records of one walk over the file."""
    import random

    rng = random.Random(4)
    names = [m for m, _ in logs.STAGED_FIELDS]
    lines = []
    for _ in range(900):
        pick = rng.randrange(14)
        lines.append(
            logs.BEFORE_MARK if pick == 0 else logs.AFTER_MARK if pick == 1 else logs.END_MARK if pick < 4
            else f"  {rng.choice(names)} {rng.choice(['7', '12', 'x', '3.5', ''])} KB" if pick < 9
            else f"[PERF] {rng.choice(['CPU Cycles', 'L1D Miss', 'Other', 'a: b'])}: {rng.randrange(99)}" if pick < 12
            else f"{logs.TIME_MARK} {rng.randrange(99)} us" if pick == 12 else f"byte_size: {rng.randrange(99)}")
    want, now, stage = [], {}, None
    for i, line in enumerate(lines):
        line = line.strip(" ")
        named = next((f for m, f in logs.STAGED_FIELDS if m in line), None)
        if logs.BEFORE_MARK in line:
            now, stage = {}, "before"
        elif logs.AFTER_MARK in line:
            stage = "after"
        elif named:
            raw = (line.split(":")[1].split() or [""])[0]
            digits = raw.replace(".", "", 1) if named.endswith("_time") else raw
            number = float(raw) if digits.isdigit() else None
            if stage and number is not None:
                now[f"{stage}_{named}"] = number
        elif "[PERF]" in line:
            parts = line.replace("[PERF]", "").split(":")
            if len(parts) == 2:
                now[parts[0].strip().lower().replace(" ", "_")] = int(parts[1])
        elif logs.TIME_MARK in line:
            now["bpe_time_us"] = int(line.split()[-2])
        elif "byte_size" in line:
            now["output_size_bytes"] = int(line.split()[-1])
        elif logs.END_MARK in line:
            want.append((i, *[now.get(f"after_{f}", 0) - now.get(f"before_{f}", 0) for f in logs.DIFFERENCES.values()],
                         *[now.get(f) for f in logs.PLAIN_FIELDS]))
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, byte_offset long, value string").repartition(3)
    for size in (1, 3, 17, 5000):
        monkeypatch.setattr(logs, "LOG_BLOCK_BYTES", size)
        got = sorted(tuple(r)[1:] for r in logs.log_runs(df).collect())
        assert got == want


def test_cumulative_time_of_a_busy_hour(spark):
    """A third of a million calls inside one hour of one process: many blocks, ties in one order."""
    n = 300_000
    df = spark.range(n).selectExpr(
        "if(id % 3 < 2, 0, id % 50) as process", "1700000000000000 + (id * 7919) % 3600000000 div 40 * 40 as ts_us", "id % 97 as time_us", "id")
    out = logs.cumulative_time(df, ties=["id"])
    w = F.expr("sum(time_us) over (partition by process order by ts_us, id rows unbounded preceding)")
    wrong = out.join(df.select("id", w.alias("want")), "id").where("total_us <> want")
    assert out.count() == n and wrong.count() == 0
    blocks = with_row_blocks(df.repartition(8), ["process", "ts_us", "id"]).where("process = 0").groupBy("_block").count().collect()
    assert len(blocks) > 1 and max(r["count"] for r in blocks) < n / 2


def test_max_rows_reads_no_text_behind_the_cut(spark, folder):
    rows = [(s, b, r, f"{s}/{b}/{r}") for s in range(4) for b in range(5) for r in range(s + b)]
    df = spark.createDataFrame(rows, "shard long, batch_index long, row_in_batch long, text string")
    df.sortWithinPartitions("shard", "batch_index").write.parquet(folder + "/c")
    table = spark.read.parquet(folder + "/c")
    for n in (0, 1, 7, 23, len(rows) - 1, len(rows), len(rows) + 5):
        assert sorted(map(tuple, corpus.max_rows(table, n).collect())) == sorted(rows)[:n]
    plan = corpus.max_rows(table, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(shard)") == 3 and "LessThan(shard" in plan and "LessThan(batch_index" in plan

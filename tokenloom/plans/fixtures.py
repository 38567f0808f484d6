"""Inputs of the registered queries, derived from the given tables by Spark.

Each function has a twin CTE of the same name in ``oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.logs import AFTER_MARK, BEFORE_MARK, END_MARK, TIME_MARK
from tokenloom.operators.counters import CPU_FIELDS, MONITOR_COLUMNS, SLOT_COLUMNS, SLOTS
from tokenloom.operators.ordered import last_seen, running_total, with_path
from tokenloom.session import materialize, spread

SHARDS = 8
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def us() -> Column:
    """Microseconds of the zone-free column ``ts``, whatever the session's zone."""
    return F.expr(US)


def tasks(spark: SparkSession) -> int:
    """Tasks that the queries deal heavy rows of one small file to: the session's own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Sharded corpus: every document, then added null and empty rows under further ids.

    Places follow from the unique id. About every 17th document brings a null row
    and every 19th an empty one; no text is lost.
    """
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    n = docs.count()
    nulls = (n + 13) // 17
    added = docs.select(
        F.explode(F.array_compact(F.array(
            F.when(F.expr("doc_id % 17 = 3"), F.struct(
                F.expr(f"{n}L + doc_id div 17").alias("doc_id"), F.lit(None).cast("string").alias("text"))),
            F.when(F.expr("doc_id % 19 = 5"), F.struct(
                F.expr(f"{n + nulls}L + doc_id div 19").alias("doc_id"), F.lit("").alias("text"))),
        ))).alias("a"), "source", "lang",
    ).select("a.doc_id", "source", "lang", "a.text")
    return docs.unionByName(added).selectExpr(
        "doc_id", "source", "lang",
        f"doc_id % {SHARDS} as shard",
        f"(doc_id div {SHARDS}) div 50 as batch_index",
        f"(doc_id div {SHARDS}) % 50 as row_in_batch",
        "text",
    )


def bounded_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus in shards of 256 rows: what a task can write as one Arrow file."""
    return corpus(spark, sf).selectExpr(
        "doc_id div 256 as shard", "(doc_id % 256) div 50 as batch_index",
        "(doc_id % 256) % 50 as row_in_batch", "text", "doc_id",
    )


def requests(spark: SparkSession, sf: str, slots: int = 64) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("req_id"),
        us().alias("ts_us"),
        (F.col("user_id") % slots).alias("slot"),
        ((F.col("event_id") * 7919) % 131072 + 1).alias("total_len"),
        (F.col("user_id") % 3).alias("run"),
    )


def responses(spark: SparkSession, sf: str, slots: int = 64) -> DataFrame:
    latency = F.when(F.col("event_id") % 101 == 0, F.lit(5_000_000).cast("long")).otherwise(
        (F.col("event_id") * 104729) % 6_000_000
    )
    return table(spark, sf, "events").where("event_id % 10 <> 0").select(
        F.col("event_id").alias("req_id"),
        (us() + latency).alias("ts_us"),
        (F.col("user_id") % slots).alias("slot"),
        (((F.col("event_id") * 6007) % 32768) * 4).alias("byte_size"),
        (F.col("user_id") % 3).alias("run"),
        latency.alias("latency_us"),
    )


def _tick(ts: str = "ts_us") -> Column:
    return F.call_function("div", F.col(ts), F.lit(HOUR_US)).alias("tick")


def _cumulate(per_tick: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    df, path = with_path(per_tick, "tick", 4096)
    out = running_total(df, keys, path, ["tick"], {f"c_{c}": F.col(c) for c in cols}, inclusive=True)
    return out.select(*keys, "tick", *[F.col(f"c_{c}").alias(c) for c in cols])


def snapshots(spark: SparkSession, sf: str, one_run: bool = False) -> DataFrame:
    """Cumulative counters per run (or of all runs as one) and hour."""
    q = requests(spark, sf).select(
        "run", _tick(), F.lit(1).alias("req"), F.lit(0).alias("resp"),
        F.col("total_len").alias("bytes_in"), F.lit(0).cast("long").alias("bytes_out"))
    p = responses(spark, sf).select(
        "run", _tick(), F.lit(0).alias("req"), F.lit(1).alias("resp"),
        F.lit(0).cast("long").alias("bytes_in"), F.col("byte_size").alias("bytes_out"))
    cols = ["req", "resp", "bytes_in", "bytes_out"]
    both = q.unionByName(p)
    if one_run:
        both = both.withColumn("run", F.lit(0).cast("long"))
    per = both.groupBy("run", "tick").agg(*[F.sum(c).alias(c) for c in cols])
    return _cumulate(per, ["run"], cols)


def slot_snapshots(spark: SparkSession, sf: str, one_run: bool = False) -> DataFrame:
    rows = responses(spark, sf)
    if one_run:
        rows = rows.withColumn("run", F.lit(0).cast("long"))
    per = rows.groupBy("run", "slot", _tick()).agg(F.count(F.lit(1)).alias("resp"))
    return _cumulate(per, ["run", "slot"], ["resp"])


def host_cpu(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(us().alias("ts_us"), "user_id", "event_id")
    per = e.groupBy((F.col("user_id") % 6).alias("core"), _tick()).agg(
        F.sum(F.col("event_id") % 13).alias("user_t"), F.sum(F.col("event_id") % 5).alias("system_t"),
        F.sum(F.col("event_id") % 17).alias("idle_t"), F.sum(F.col("event_id") % 3).alias("iowait_t"))
    zero = F.lit(0).cast("long")
    return _cumulate(per, ["core"], ["user_t", "system_t", "idle_t", "iowait_t"]).withColumns(
        {c: zero for c in ("nice_t", "irq_t", "softirq_t", "steal_t")}
    ).withColumn("run", zero)


def host_net(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(us().alias("ts_us"), "user_id", "event_id")
    per = e.groupBy(F.concat(F.lit("eth"), F.col("user_id") % 2).alias("iface"), _tick()).agg(
        F.sum(F.col("event_id") % 1500 * 1000).alias("rx_bytes"),
        F.sum(F.col("event_id") % 900 * 1000).alias("tx_bytes"),
        F.sum(F.col("event_id") % 2).alias("rx_drop"), F.sum(F.col("event_id") % 3).alias("tx_drop"))
    return _cumulate(per, ["iface"], ["rx_bytes", "tx_bytes", "rx_drop", "tx_drop"]).withColumn(
        "run", F.lit(0).cast("long"))


def host_block(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(us().alias("ts_us"), "user_id", "event_id")
    per = e.groupBy(F.concat(F.lit("nvme"), F.col("user_id") % 2).alias("dev"), _tick()).agg(
        F.sum(F.col("event_id") % 2048).alias("read_sectors"),
        F.sum(F.col("event_id") % 1024).alias("write_sectors"),
        F.sum(F.col("event_id") % 900).alias("io_ticks_ms"))
    out = _cumulate(per, ["dev"], ["read_sectors", "write_sectors", "io_ticks_ms"])
    return out.withColumn("in_flight", F.col("tick") % 7).withColumn("run", F.lit(0).cast("long"))


def stages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('shard-worker-', l_suppkey % 12) as worker", "1L as shards",
        "(l_orderkey * 31 + l_linenumber) % 5000 as tokens",
        "(l_orderkey * 7) % 1000 as read_us", "(l_partkey * 11) % 1000 as decode_us",
        "(l_orderkey * 13) % 9000 as tokenize_us", "(l_partkey * 17) % 500 as pack_us",
        "(l_suppkey * 19) % 300 as write_us", "l_linenumber % 50 as flush_us",
        "l_linenumber % 70 as fsync_us", "l_suppkey",
    )


def extents(spark: SparkSession, sf: str, holes: bool = True) -> DataFrame:
    """Extents over each shard's text bytes; every 23rd may be missing."""
    df = table(spark, sf, "documents").selectExpr(
        f"doc_id % {SHARDS} as shard", f"doc_id div {SHARDS} as seq",
        f"(doc_id div {SHARDS}) * 20000 as logical", "((doc_id * 7919) % 1009) * 20480 as physical",
        "20000L as length",
    )
    return df.where("seq % 23 <> 7") if holes else df


def completions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as user_data", "case when event_id % 29 = 0 then -5 else 0 end as res",
        "case when event_id % 4 = 0 then (event_id * 40503) % 65536 else 0 end as status_field",
        "concat('out-', user_id % 5, '.bin') as out_path", "event_id % 256 + 1 as nblocks",
        f"{US} as start_us", f"{US} + (event_id * 31) % 5000 as end_us",
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    w = requests(spark, sf).select(
        F.format_string("[WRITE-TS] Req %d slot=%d at %d us", "req_id", "slot", "ts_us").alias("value"))
    r = responses(spark, sf).select(
        F.format_string("[READ-TS]  Req %d slot=%d at %d us (size=%d)", "req_id", "slot", "ts_us", "byte_size").alias("value"))
    return w.unionByName(r)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """One block of lines per event, in four files; ``byte_offset`` gives the order."""
    e = F.col("event_id")

    def n(k: int) -> Column:
        return ((e * k) % 1000).cast("string")

    def usage(a: int) -> list[Column]:
        return [
            F.concat(F.lit("  User time: "), n(a), F.lit(".5 ms")),
            F.concat(F.lit("  System time: "), n(a + 2), F.lit(".25 ms")),
            F.concat(F.lit("  Max RSS: "), n(a + 4), F.lit(" KB")),
            F.concat(F.lit("  Page Faults (soft): "), n(a + 6)),
            F.concat(F.lit("  Page Faults (hard): "), n(a + 8)),
            F.concat(F.lit("  Voluntary Context Switches: "), n(a + 10)),
            F.concat(F.lit("  Involuntary Context Switches: "), n(a + 12)),
        ]

    perf = ["Instructions", "CPU Cycles", "Branch Instructions", "Branch Misses",
            "L1D Access", "L1D Miss", "L3 Access", "L3 Miss"]
    none = F.lit(None).cast("string")
    lines = [
        F.when(e % 7 != 0, F.lit(BEFORE_MARK)).otherwise(none),
        *usage(101),
        F.lit(AFTER_MARK),
        *usage(211),
        *[F.when(e % 11 != 0, F.concat(F.lit(f"[PERF] {p}: "), n(307 + 2 * i))).otherwise(none)
          for i, p in enumerate(perf)],
        F.concat(F.lit(TIME_MARK + " "), n(401), F.lit(" us")),
        F.concat(F.lit("byte_size: "), n(409)),
        F.concat(F.lit(END_MARK + ": "), n(419), F.lit(" us")),
    ]
    return (
        spread(table(spark, sf, "events").select("event_id", "user_id"), tasks(spark), "event_id")  # one small file, many lines
        .select((F.col("user_id") % 4).cast("string").alias("file"), e, F.posexplode(F.array(*lines)).alias("k", "value"))
        .where("value is not null")
        .select("file", (e * 64 + F.col("k")).alias("byte_offset"), "value")
    )


def sweep_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Closing lines of runs with 2, 4 … 64 threads; the run with 10 threads fails."""
    per = stages(spark, sf).groupBy(((F.col("l_suppkey") % 32 + 1) * 2).alias("thread")).agg(
        F.sum("shards").alias("s"), F.sum("tokens").alias("t"), F.sum("tokenize_us").alias("us"))
    ms = F.call_function("div", F.col("us"), F.lit(1000))
    rate = F.call_function("div", F.col("t") * 3600, F.col("s"))
    whole = F.format_string("[ALL] shards=%d tokens=%d batch_read=0.000s throughput=%d.00", "s", "t", rate)
    end = F.format_string("=== RUN END 2024-01-01T00:00:00 rc=%d elapsed=%d.%03ds ===",
                          F.when(F.col("thread") == 10, 1).otherwise(0),
                          F.call_function("div", ms, F.lit(1000)), ms % 1000)
    return per.select("thread", F.explode(F.array(whole, end)).alias("value"))


def monitor_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the monitor samples, one row per hour: core 0, eth0 and nvme0 beside all requests.

    A family without a row in an hour keeps its last values; -1 until it has one.
    """
    base = snapshots(spark, sf, one_run=True)
    counts = responses(spark, sf).where(f"slot < {SLOTS}").groupBy("slot", _tick()).agg(F.count(F.lit(1)).alias("resp"))
    grid = base.select("run", "tick", F.explode(F.expr(f"sequence(0L, {SLOTS - 1}L)")).alias("slot"))
    grid = grid.join(counts, ["slot", "tick"], "left").select("run", "slot", "tick", F.coalesce("resp", F.lit(0)).alias("resp"))
    # one bounded list of a number per slot
    slots = _cumulate(grid, ["run", "slot"], ["resp"]).groupBy("run", "tick").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "resp"))).alias("slots"))
    cpu = host_cpu(spark, sf).where("core = 0")
    cpu = cpu.select("run", "tick", sum((F.col(c) for c in CPU_FIELDS[1:]), F.col(CPU_FIELDS[0])).alias("cpu_total"),
                     (F.col("idle_t") + F.col("iowait_t")).alias("cpu_idle"))
    net = host_net(spark, sf).where("iface = 'eth0'").drop("iface")
    blk = host_block(spark, sf).where("dev = 'nvme0'").drop("dev")
    last = responses(spark, sf).groupBy(F.lit(0).cast("long").alias("run"), _tick()).agg(
        F.max("ts_us").alias("ts_us"), F.max_by("latency_us", F.struct("ts_us", "req_id")).alias("last_latency_us"))
    wide = base.join(slots, ["run", "tick"], "left").join(last, ["run", "tick"], "left")
    families = {"cpu": cpu, "net": net, "blk": blk}
    for name, side in families.items():
        own = [c for c in side.columns if c in MONITOR_COLUMNS]
        more = [c for c in side.columns if c == "in_flight"]
        wide = wide.join(side.select("run", "tick", F.struct(*own).alias(name), *more), ["run", "tick"], "left")
    df, path = with_path(materialize(wide, "wide"), "tick", 4096)
    filled = last_seen(df, ["run"], path, ["tick"], {f"l_{n}": F.col(n) for n in families})
    shown = [f"coalesce(l_{n}.{c}, -1) as {c}" for n, side in families.items() for c in side.columns if c in MONITOR_COLUMNS]
    return filled.selectExpr(
        "run", "tick", "ts_us", "last_latency_us", "in_flight", *[c for c in base.columns if c in MONITOR_COLUMNS],
        *[f"slots[{i}L] as {c}" for i, c in enumerate(SLOT_COLUMNS)], *shown,
    )

"""Runtime counters: totals, rates, utilisation, fairness, worker and status reports.

Rates follow cumulative snapshots. At a falling counter (a restart) the rate of
that tick is null and ``counter_reset`` is true.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.scalars import bytes_to_mb, decode_status, tokens_per_hour
from tokenloom.operators.ordered import previous_row, with_path

SLOTS = 64
MIN_INTERVAL_MS = 100
SECTOR = 512
TICKS_PER_BLOCK = 4096

CPU_FIELDS = ["user_t", "nice_t", "system_t", "idle_t", "iowait_t", "irq_t", "softirq_t", "steal_t"]
STAGES = ["read_us", "decode_us", "tokenize_us", "pack_us", "write_us", "flush_us", "fsync_us"]


def nominal_interval(interval_ms: int) -> int:
    return max(MIN_INTERVAL_MS, interval_ms)


def outstanding(req: Column, resp: Column) -> Column:
    return F.greatest(req - resp, F.lit(0))


# ------------------------------------------------------------------- totals
def slot_counters(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Per slot with any activity; only the first 64 slots have counters."""
    req = requests.where(F.col("slot") < SLOTS).groupBy("slot").agg(
        F.count(F.lit(1)).alias("req"), F.sum("total_len").alias("bytes_in")
    )
    resp = responses.where(F.col("slot") < SLOTS).groupBy("slot").agg(
        F.count(F.lit(1)).alias("resp"), F.sum("byte_size").alias("bytes_out")
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("req", "resp", "bytes_in", "bytes_out")}
    return (
        req.join(resp, "slot", "full").withColumns(zero)
        .withColumn("outstanding", outstanding(F.col("req"), F.col("resp")))
    )


def runtime_totals(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Global totals and the latest event. A request whose slot has no worker is
    counted, its empty reply is not, so it stays outstanding.

    ``responses`` carries ``latency_us``. One row, from partial aggregates only.
    """
    served = responses.where(F.col("slot") < SLOTS)
    newest = F.struct("ts_us", "req_id")
    req = requests.agg(
        F.count(F.lit(1)).alias("req_total"),
        F.coalesce(F.sum("total_len"), F.lit(0)).alias("bytes_in"),
        F.min("ts_us").alias("start_ts_us"),
        F.max("ts_us").alias("_req_ts"),
        F.max_by("req_id", newest).alias("last_req_id"),
        F.max_by("slot", newest).alias("last_slot"),
    ).withColumn("_one", F.lit(1))
    resp = served.agg(
        F.count(F.lit(1)).alias("resp_total"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes_out"),
        F.max("ts_us").alias("_resp_ts"),
        F.max_by("latency_us", newest).alias("last_latency_us"),
        F.max_by("byte_size", newest).alias("last_resp_bytes"),
    ).withColumn("_one", F.lit(1))
    return (
        req.join(resp, "_one")
        .withColumn("last_ts_us", F.greatest("_req_ts", "_resp_ts"))
        .withColumn("outstanding", outstanding(F.col("req_total"), F.col("resp_total")))
        .drop("_one", "_req_ts", "_resp_ts")
    )


# -------------------------------------------------------------------- rates
def _deltas(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], first_is_zero: bool) -> DataFrame:
    """Add ``d_<column>``, ``first`` and ``counter_reset``.

    ``first_is_zero``: the first tick counts from 0; otherwise its delta is null.
    On a stream the previous row is kept as state.
    """
    if df.isStreaming:
        from tokenloom.streaming.streams import stream_deltas

        return stream_deltas(df, keys, time, columns, first_is_zero)
    df, path = with_path(df, time, TICKS_PER_BLOCK)
    df = previous_row(df, keys, path, [time], columns, "_prev").drop("_p2")
    start = F.lit(0) if first_is_zero else F.lit(None).cast("long")
    out = df.withColumn("first", F.col("_prev").isNull())
    out = out.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.col(f"_prev.{c}"), start) for c in columns})
    any_fall = F.lit(False)
    for c in columns:
        any_fall = any_fall | F.coalesce(F.col(f"d_{c}") < 0, F.lit(False))
    return out.withColumn("counter_reset", any_fall).drop("_prev")


def _steady(value: Column) -> Column:
    """A rate, or null at the tick of a counter reset."""
    return F.when(~F.col("counter_reset"), value)


def counter_rates(df: DataFrame, interval_ms: int, time: str = "tick", keys: Sequence[str] = ("run",)) -> DataFrame:
    """Request and byte rates of global counters ``req, resp, bytes_in, bytes_out``.

    The first tick counts from 0 and so shows the whole total.
    """
    per_s = 1000.0 / nominal_interval(interval_ms)
    d = _deltas(df, list(keys), time, ["req", "resp", "bytes_in", "bytes_out"], True)
    return d.select(
        *keys, time, "req", "resp", "bytes_in", "bytes_out",
        outstanding(F.col("req"), F.col("resp")).alias("outstanding"),
        _steady(F.col("d_req") * per_s).alias("req_per_s"),
        _steady(F.col("d_resp") * per_s).alias("resp_per_s"),
        _steady(bytes_to_mb(F.col("d_bytes_in")) * per_s).alias("in_mbps"),
        _steady(bytes_to_mb(F.col("d_bytes_out")) * per_s).alias("out_mbps"),
        "counter_reset",
    )


def slot_rates(df: DataFrame, interval_ms: int, time: str = "tick", keys: Sequence[str] = ("run",)) -> DataFrame:
    per_s = 1000.0 / nominal_interval(interval_ms)
    d = _deltas(df, [*keys, "slot"], time, ["resp"], True)
    return d.select(
        *keys, time, "slot", "resp", _steady(F.col("d_resp")).alias("delta"),
        _steady(F.col("d_resp") * per_s).alias("resp_per_s"), "counter_reset",
    )


def jain_fairness(deltas: DataFrame, by: Sequence[str], value: str = "delta", n: int = SLOTS) -> DataFrame:
    """(sum x)^2 / (n * sum x^2) with fixed n: idle slots count as 0, no row needed;
    slots from ``n`` on do not count."""
    if "slot" in deltas.columns:
        deltas = deltas.where(F.col("slot") < n)
    x = F.coalesce(F.col(value), F.lit(0)).cast("double")
    s = deltas.groupBy(*by).agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    return s.withColumn("fairness", jain_formula(F.col("_s"), F.col("_q"), n)).drop("_s", "_q")


def jain_formula(total: Column, squares: Column, n: int = SLOTS) -> Column:
    return F.when(squares == 0, F.lit(0.0)).otherwise(total * total / (squares * float(n)))


def _cpu_deltas(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    total = sum((F.col(c) for c in CPU_FIELDS[1:]), F.col(CPU_FIELDS[0]))
    df = df.withColumn("total", total).withColumn("idle", F.col("idle_t") + F.col("iowait_t"))
    return _deltas(df, [*keys, "core"], time, ["total", "idle"], False)


def _busy(total: Column, idle: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(100.0 * (total - idle) / total)


def cpu_busy(
    df: DataFrame, cores: Sequence[int] | None = None, time: str = "tick", keys: Sequence[str] = ("run",)
) -> DataFrame:
    """Busy share per core; 0 at the first tick and where the total stands still."""
    if cores is not None:
        df = df.where(F.col("core").isin(list(cores)))
    d = _cpu_deltas(df, time, keys)
    pct = F.when(F.col("first"), F.lit(0.0)).otherwise(_steady(_busy(F.col("d_total"), F.col("d_idle"))))
    return d.select(*keys, time, "core", pct.alias("busy_pct"), "counter_reset")


def cpu_busy_all(df: DataFrame, time: str = "tick", keys: Sequence[str] = ("run",)) -> DataFrame:
    """True all-core share from the summed differences of the cores, beside
    ``cpu_busy_core0``, which is what the CSV column holds."""
    d = _cpu_deltas(df, time, keys)
    total, idle = (F.coalesce(_steady(F.col(c)), F.lit(0)) for c in ("d_total", "d_idle"))
    first = F.when(F.col("first"), F.lit(0.0)).otherwise(_steady(_busy(F.col("d_total"), F.col("d_idle"))))
    return (
        d.groupBy(*keys, time)
        .agg(
            F.sum(total).alias("_t"), F.sum(idle).alias("_i"),
            F.max(F.when(F.col("core") == 0, first)).alias("cpu_busy_core0"),
        )
        .select(*keys, time, _busy(F.col("_t"), F.col("_i")).alias("cpu_busy_true_all"), "cpu_busy_core0")
    )


def net_rates(df: DataFrame, interval_ms: int, time: str = "tick", keys: Sequence[str] = ("run", "iface")) -> DataFrame:
    per_s = 1000.0 / nominal_interval(interval_ms)
    d = _deltas(df, list(keys), time, ["rx_bytes", "tx_bytes", "rx_drop", "tx_drop"], False)

    def shown(v: Column, zero) -> Column:
        return F.when(F.col("first"), F.lit(zero)).otherwise(_steady(v))

    return d.select(
        *keys, time,
        shown(bytes_to_mb(F.col("d_rx_bytes")) * per_s, 0.0).alias("rx_mbps"),
        shown(bytes_to_mb(F.col("d_tx_bytes")) * per_s, 0.0).alias("tx_mbps"),
        shown(F.col("d_rx_drop"), 0).alias("rx_drop_delta"),
        shown(F.col("d_tx_drop"), 0).alias("tx_drop_delta"),
        "counter_reset",
    )


def block_rates(df: DataFrame, interval_ms: int, time: str = "tick", keys: Sequence[str] = ("run", "dev")) -> DataFrame:
    ms = nominal_interval(interval_ms)
    per_s = 1000.0 / ms
    d = _deltas(df, list(keys), time, ["read_sectors", "write_sectors", "io_ticks_ms"], False)

    def shown(v: Column) -> Column:
        return F.when(F.col("first"), F.lit(0.0)).otherwise(_steady(v))

    return d.select(
        *keys, time,
        shown(bytes_to_mb(F.col("d_read_sectors") * SECTOR) * per_s).alias("read_mbps"),
        shown(bytes_to_mb(F.col("d_write_sectors") * SECTOR) * per_s).alias("write_mbps"),
        shown(F.least(F.lit(100.0), F.col("d_io_ticks_ms") * (100.0 / ms))).alias("util_pct"),
        "in_flight",
        "counter_reset",
    )


# The columns of the monitor CSV, in order.
METRICS_COLUMNS = [
    "ts_us", "req_total", "resp_total", "outstanding", "last_latency_us", "req_per_s",
    "resp_per_s", "in_MBps", "out_MBps", "fairness_resp", "cpu_busy_all", "net_rx_MBps",
    "net_tx_MBps", "net_rx_drop_delta", "net_tx_drop_delta", "blk_read_MBps",
    "blk_write_MBps", "blk_util_pct", "blk_in_flight",
]


def metrics_table(
    rates: DataFrame, fairness: DataFrame, cpu: DataFrame, net: DataFrame, blk: DataFrame,
    latest: DataFrame, time: str = "tick", keys: Sequence[str] = ("run",),
) -> DataFrame:
    """The monitor's 19 columns per run and tick; families without a row at a tick show 0.

    Every table has the key columns, and one row per key and tick (one interface, one device), so
    that no row is multiplied.
    """
    by = [*keys, time]
    f = fairness.select(*by, F.col("fairness").alias("fairness_resp"))
    c = cpu.select(*by, F.col("cpu_busy_core0").alias("cpu_busy_all"))
    n = net.select(
        *by, F.col("rx_mbps").alias("net_rx_MBps"), F.col("tx_mbps").alias("net_tx_MBps"),
        F.col("rx_drop_delta").alias("net_rx_drop_delta"), F.col("tx_drop_delta").alias("net_tx_drop_delta"),
    )
    b = blk.select(
        *by, F.col("read_mbps").alias("blk_read_MBps"), F.col("write_mbps").alias("blk_write_MBps"),
        F.col("util_pct").alias("blk_util_pct"), F.col("in_flight").alias("blk_in_flight"),
    )
    wide = rates.select(
        *by, F.col("req").alias("req_total"), F.col("resp").alias("resp_total"), "outstanding",
        "req_per_s", "resp_per_s", F.col("in_mbps").alias("in_MBps"), F.col("out_mbps").alias("out_MBps"),
    )
    for side in (f, c, n, b, latest.select(*by, "ts_us", "last_latency_us")):
        wide = wide.join(side, by, "left")
    return _csv_columns(wide)


def _csv_columns(wide: DataFrame) -> DataFrame:
    doubles = [name for name, kind in wide.dtypes if kind == "double"]
    wide = wide.withColumns({d: F.round(F.coalesce(d, F.lit(0.0)), 3) for d in doubles})
    ints = [name for name in METRICS_COLUMNS if name not in doubles]
    return wide.withColumns({i: F.coalesce(i, F.lit(0)).cast("long") for i in ints}).select(*METRICS_COLUMNS)


SLOT_COLUMNS = [f"slot_{i}" for i in range(SLOTS)]
_HOST = {
    "cpu": ["cpu_total", "cpu_idle"], "net": ["rx_bytes", "tx_bytes", "rx_drop", "tx_drop"],
    "blk": ["read_sectors", "write_sectors", "io_ticks_ms"],
}
_GLOBAL = ["req", "resp", "bytes_in", "bytes_out"]
# one row of everything the monitor samples at a tick, cumulative; -1: that family is not there (yet)
MONITOR_COLUMNS = [*_GLOBAL, *SLOT_COLUMNS, *[c for names in _HOST.values() for c in names]]


def monitor_rows(snapshots: DataFrame, interval_ms: int, time: str = "tick", keys: Sequence[str] = ("run",)) -> DataFrame:
    """The monitor's 19 columns from whole snapshots, of a table or an endless stream.

    A snapshot holds ``MONITOR_COLUMNS`` with ``ts_us``, ``last_latency_us`` and ``in_flight``. All its
    families come in one row, so nothing is joined and a stream keeps one row of state per key.
    Request and slot rates count from 0 at the first tick; host families show 0 there and at a reset.
    """
    ms = nominal_interval(interval_ms)
    per_s = 1000.0 / ms
    d = _deltas(snapshots, list(keys), time, MONITOR_COLUMNS, True)

    def delta(c: str) -> Column:
        return F.col(f"d_{c}")

    def family(names: list[str], host: bool) -> Column:
        """Whether the differences of these columns count."""
        falls = F.lit(False)
        for c in names:
            falls = falls | F.coalesce(delta(c) < 0, F.lit(True))
        fresh = F.col("first") | (F.col(names[0]) - delta(names[0]) < 0) | (F.col(names[0]) < 0)
        return ~falls & ~fresh if host else ~falls

    def shown(names: list[str], host: bool, value: Column) -> Column:
        return F.when(family(names, host), value)

    slots = ", ".join(f"double(greatest(coalesce(d_{c}, 0), 0))" for c in SLOT_COLUMNS)
    d = d.withColumn("_x", F.expr(f"array({slots})")).withColumns({
        "_s": F.expr("aggregate(_x, 0D, (a, x) -> a + x)"), "_q": F.expr("aggregate(_x, 0D, (a, x) -> a + x * x)")})
    rates = lambda c: shown(_GLOBAL, False, delta(c) * per_s)
    host = lambda kind, value: shown(_HOST[kind], True, value)
    return _csv_columns(d.select(
        *keys, time, "ts_us", "last_latency_us", F.col("req").alias("req_total"), F.col("resp").alias("resp_total"),
        outstanding(F.col("req"), F.col("resp")).alias("outstanding"),
        rates("req").alias("req_per_s"), rates("resp").alias("resp_per_s"),
        shown(_GLOBAL, False, bytes_to_mb(delta("bytes_in")) * per_s).alias("in_MBps"),
        shown(_GLOBAL, False, bytes_to_mb(delta("bytes_out")) * per_s).alias("out_MBps"),
        jain_formula(F.col("_s"), F.col("_q")).alias("fairness_resp"),
        host("cpu", _busy(delta("cpu_total"), delta("cpu_idle"))).alias("cpu_busy_all"),
        host("net", bytes_to_mb(delta("rx_bytes")) * per_s).alias("net_rx_MBps"),
        host("net", bytes_to_mb(delta("tx_bytes")) * per_s).alias("net_tx_MBps"),
        host("net", delta("rx_drop")).alias("net_rx_drop_delta"), host("net", delta("tx_drop")).alias("net_tx_drop_delta"),
        host("blk", bytes_to_mb(delta("read_sectors") * SECTOR) * per_s).alias("blk_read_MBps"),
        host("blk", bytes_to_mb(delta("write_sectors") * SECTOR) * per_s).alias("blk_write_MBps"),
        host("blk", F.least(F.lit(100.0), delta("io_ticks_ms") * (100.0 / ms))).alias("blk_util_pct"),
        F.col("in_flight").alias("blk_in_flight"),
    ))


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Truncate and write; doubles always show three decimals."""
    shown = [
        F.format_string("%.3f", F.col(n)).alias(n) if kind == "double" else F.col(n)
        for n, kind in metrics.dtypes
    ]
    metrics.select(*shown).write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------ reports
def worker_profile(stages: DataFrame) -> DataFrame:
    """Per worker and ``ALL``: sums of the stage times (worker time, not wall time)."""
    sums = stages.rollup("worker").agg(
        F.grouping("worker").alias("_all"),
        F.sum("shards").alias("shards"),
        F.sum("tokens").alias("tokens"),
        *[F.sum(c).alias(c) for c in STAGES],
    )
    total = sum((F.col(c) for c in STAGES[1:]), F.col(STAGES[0])) / 1e6
    seconds = [(F.col(c) / 1e6).alias(c.replace("_us", "_s")) for c in STAGES]
    return sums.select(
        F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("worker")).alias("worker"),
        "shards", "tokens", *seconds, total.alias("total_s"),
        tokens_per_hour(F.col("tokens"), total).alias("tokens_per_hour"),
    )


def completion_breakdown(completions: DataFrame) -> DataFrame:
    """Completions per decoded status; an error has res < 0 or a non-zero status."""
    d = completions.withColumn("d", decode_status(F.col("status_field")))
    error = (F.col("res") < 0) | (F.col("status_field") != 0)
    return d.groupBy(F.col("d.sct").alias("sct"), F.col("d.sc").alias("sc")).agg(
        F.count(F.lit(1)).alias("completions"),
        F.sum(F.when(error, 1).otherwise(0)).alias("errors"),
    )


def run_summary(jobs: DataFrame, by: Sequence[str] = ("out_path",)) -> DataFrame:
    """Per run: pieces, bytes, errors and elapsed time from job rows."""
    error = (F.col("res") < 0) | (F.col("status_field") != 0)
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.col("nblocks") * SECTOR).alias("total_bytes"),
        F.sum(F.when(error, 1).otherwise(0)).alias("errors"),
        (F.max("end_us") - F.min("start_us")).alias("elapsed_us"),
    )

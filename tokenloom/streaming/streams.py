"""Structured Streaming forms: tokenization, request deadlines, windowed and
snapshot monitoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tokenloom.operators.bpe import bpe_encode
from tokenloom.operators.corpus import nonempty_rows
from tokenloom.operators.counters import counter_rates, jain_formula, write_metrics_csv
from tokenloom.operators.tokens import packed_rows, placed_tokens
from tokenloom.session import scratch_path
from tokenloom.sources.files import resolve
from tokenloom.sources.model import BpeModel
from tokenloom.sources.sinks import write_positioned

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available now into parquet at ``path``; return that table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    return run_available(stream, scratch_path(spark, label), scratch_path(spark, f"{label}-state"))


def stream_tokenize(texts: DataFrame, model: BpeModel, text: str = "text", **options) -> DataFrame:
    """Encode each arriving text; stateless, so any batch form applies."""
    return bpe_encode(nonempty_rows(texts, text), model, text, **options)


OPEN = "req_id bigint, ts_us bigint, is_request boolean, slot bigint, byte_size bigint"
TAKEN = "req_id bigint, ts_us bigint, slot bigint, latency_us bigint, byte_size bigint, timed_out boolean"


def take_once(rows: list[tuple], deadline_us: int, watermark_us: int, wait: bool = True) -> tuple[list[tuple], list[tuple]]:
    """``(results, rows still open)`` of the ``OPEN`` rows of any number of request ids.

    Each request takes the earliest answer of its id from its own time to its deadline that no
    earlier request has taken. What comes later than the watermark may still be preceded by
    something that has not arrived; with ``wait`` nothing after it is decided, without, what has
    arrived decides. An answer that no request can take any more is dropped.
    """
    done, kept = [], []
    rows.sort(key=lambda r: (r[0], r[1], not r[2]))
    a = 0
    while a < len(rows):
        b = a
        while b < len(rows) and rows[b][0] == rows[a][0]:
            b += 1
        asked = [r for r in rows[a:b] if r[2]]
        answers = [r for r in rows[a:b] if not r[2]]
        a = b
        while asked:
            req_id, at, _, slot, _ = asked[0]
            fits = next((i for i, r in enumerate(answers) if at <= r[1] <= at + deadline_us), None)
            if fits is not None and (not wait or answers[fits][1] <= watermark_us):
                answer = answers.pop(fits)
                done.append((req_id, at, slot, answer[1] - at, answer[4], False))
            elif at + deadline_us <= watermark_us:
                done.append((req_id, at, slot, None, None, True))
            else:
                break
            asked.pop(0)
        first = asked[0][1] if asked else None
        # every request up to the watermark is known: older answers have none left to meet
        kept += asked + [r for r in answers if r[1] > watermark_us or (first is not None and r[1] >= first)]
    return done, kept


def _make_take_once(deadline_us: int, wait: bool) -> StatefulProcessor:
    class TakeOnce(StatefulProcessor):
        """The open requests and untaken answers of one bucket of ids, with a timer for the next decision."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", OPEN)

        def _step(self, rows: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs()
            if self.open.exists():
                rows = [tuple(r) for r in self.open.get()] + rows
            done, kept = take_once(rows, deadline_us, watermark * 1000, wait)
            if kept:
                self.open.put(kept)
            else:
                self.open.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            due = [r[1] + deadline_us if r[2] else r[1] for r in kept]
            if due:
                self.handle.registerTimer(max(-(-min(due) // 1000), watermark + 1))
            if done:
                columns = [c.split()[0] for c in TAKEN.split(", ")]
                out = pd.DataFrame(done, columns=columns)
                yield out.astype({c: "Int64" for c in columns[:-1]} | {"timed_out": bool})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            names = [c.split()[0] for c in OPEN.split(", ")]
            fresh = []
            for part in rows:
                fresh += [
                    tuple(None if pd.isna(v) else bool(v) if n == "is_request" else int(v) for n, v in zip(names, r, strict=True))
                    for r in part[names].itertuples(index=False, name=None)
                ]
            yield from self._step(fresh, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self._step([], timerValues)

        def close(self) -> None:
            pass

    return TakeOnce()


def request_timeout(
    requests: DataFrame, responses: DataFrame, deadline: str = "5 seconds",
    lateness: str = "10 seconds", buckets: int = 64, wait: bool = False,
) -> DataFrame:
    """Each request with its answer, or ``timed_out`` once the deadline has passed.

    ``requests(req_id, ts, slot, total_len)`` and ``responses(req_id, ts, byte_size)``. A request
    takes one answer between its time and its deadline, the earliest that has arrived, and an answer
    is taken once. Repeated answers give no row, and a stale one, from before its request, does not
    stand in the way of a valid one. With ``wait`` a request is decided only when the watermark
    shows that no earlier answer can come, so the order of arrival changes nothing.

    State is keyed by a bucket of ids and holds what is inside the deadline and the lateness; a
    timer wakes a bucket at its next decision. ``buckets`` only sets how finely state is dealt to
    tasks: raise it with the rate of requests, never on a running query. Turns the RocksDB state store on,
    which keyed state with timers needs.
    """
    use_rocksdb(requests.sparkSession)
    us = requests.sparkSession.range(1).select(F.expr(f"cast(interval {deadline} as interval second)").alias("i")).select(
        F.expr("timestampdiff(MICROSECOND, timestamp'2000-01-01', timestamp'2000-01-01' + i)")).first()[0]
    null = F.lit(None).cast("long")
    asked = requests.select("req_id", "ts", F.lit(True).alias("is_request"), F.col("slot").cast("long").alias("slot"), null.alias("byte_size"))
    given = responses.select("req_id", "ts", F.lit(False).alias("is_request"), null.alias("slot"), F.col("byte_size").cast("long").alias("byte_size"))
    both = asked.unionByName(given).withWatermark("ts", lateness).select(
        F.pmod("req_id", F.lit(buckets)).alias("bucket"), "ts", F.col("req_id").cast("long").alias("req_id"),
        F.unix_micros("ts").alias("ts_us"), "is_request", "slot", "byte_size",
    )
    out = both.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_make_take_once(us, wait), outputStructType=TAKEN, outputMode="Append", timeMode="EventTime",
    )
    return out.select("req_id", F.timestamp_micros("ts_us").alias("ts"), "slot", "latency_us", "byte_size", "timed_out")


def windowed_monitor(events: DataFrame, interval_s: int, lateness: str = "10 seconds") -> DataFrame:
    """Rates and fairness per tumbling interval.

    ``events(ts, slot, kind 'req'|'resp', bytes)``. Counts per interval and slot
    first, then per interval: a busy slot is reduced before it meets the others.
    """
    def when(kind: str, value):
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0))

    span = f"{interval_s} seconds"
    # answers of a slot beyond the table count nowhere
    known = (F.col("kind") == "req") | (F.col("slot") < 64)
    per_slot = events.where(known).withWatermark("ts", lateness).groupBy(F.window("ts", span), "slot").agg(
        when("req", 1).alias("req"), when("resp", 1).alias("resp"),
        when("req", F.col("bytes")).alias("bytes_in"), when("resp", F.col("bytes")).alias("bytes_out"),
    )
    x = F.col("resp").cast("double")
    whole = per_slot.groupBy(F.window(F.window_time("window"), span)).agg(
        F.sum("req").alias("req"), F.sum("resp").alias("resp"),
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"),
        F.sum(x).alias("_s"), F.sum(x * x).alias("_q"),
    )
    mb = 1024.0 * 1024.0 * interval_s
    return whole.select(
        F.col("window.start").alias("start"),
        "req", "resp",
        (F.col("req") / float(interval_s)).alias("req_per_s"),
        (F.col("resp") / float(interval_s)).alias("resp_per_s"),
        (F.col("bytes_in") / mb).alias("in_mbps"),
        (F.col("bytes_out") / mb).alias("out_mbps"),
        jain_formula(F.col("_s"), F.col("_q")).alias("fairness"),
    )


def _make_deltas(time: str, columns: list[str], first_is_zero: bool) -> StatefulProcessor:
    names = list(columns)

    class Deltas(StatefulProcessor):
        """Keeps the newest snapshot of one key; one that comes after a newer has no differences."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.newest = handle.getValueState("newest", ", ".join(f"{c} bigint" for c in [time, *names]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            # one key's snapshots of one micro-batch; the source's maxFilesPerTrigger bounds them
            snaps = pd.concat(list(rows), ignore_index=True).sort_values(time, ignore_index=True)
            newest, *before = self.newest.get() if self.newest.exists() else (None, *[None] * len(names))
            late = snaps[time] <= newest if newest is not None else pd.Series(False, index=snaps.index)
            n_late = int(late.sum())
            delta = snaps[names].astype("Int64").diff()
            delta.iloc[:n_late] = pd.NA
            first = pd.Series(False, index=snaps.index)
            if n_late < len(snaps):
                if newest is not None:
                    delta.iloc[n_late] = [int(v) - int(w) for v, w in zip(snaps[names].iloc[n_late], before, strict=True)]
                else:
                    first.iloc[0] = True
                    delta.iloc[0] = [int(v) if first_is_zero else pd.NA for v in snaps[names].iloc[0]]
                self.newest.update(tuple(int(v) for v in snaps[[time, *names]].iloc[-1]))
            for c in names:
                snaps[f"d_{c}"] = delta[c]
            snaps["first"] = first
            snaps["counter_reset"] = (delta < 0).fillna(False).any(axis=1).astype(bool)
            yield snaps

        def close(self) -> None:
            pass

    return Deltas()


def stream_deltas(
    snapshots: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], first_is_zero: bool
) -> DataFrame:
    """The snapshots with ``d_<column>``, ``first`` and ``counter_reset``, on an endless stream.

    State is the newest snapshot of every key. A late one gets null differences
    and changes no state. Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    longs = snapshots.select(*[F.col(n).cast("long").alias(n) if n in columns or n == time else n for n in snapshots.columns])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in longs.schema.fields]
    fields += [f"`d_{c}` bigint" for c in columns] + ["first boolean", "counter_reset boolean"]
    return longs.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_make_deltas(time, list(columns), first_is_zero),
        outputStructType=", ".join(fields), outputMode="Append", timeMode="None",
    )


def stream_counter_rates(snapshots: DataFrame, interval_ms: int) -> DataFrame:
    """Counter rates on an endless stream ``(run, tick, req, resp, bytes_in, bytes_out)``."""
    return counter_rates(snapshots, interval_ms)


def write_metrics_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The monitor's CSV of an endless stream of :func:`counters.monitor_rows`, started.

    A micro-batch is written to a folder of its number, which a repeated one replaces, so every
    row is there once after any restart. Read it with :func:`read_metrics`.
    """
    def write(batch: DataFrame, number: int) -> None:
        write_metrics_csv(batch, f"{path}/batch={number:012d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the CSV folders that a stream has written."""
    table = spark.read.schema(schema).option("header", True).option("basePath", path).csv(f"{path}/batch=*")
    return table.select(*[f.name for f in schema.fields])


def lengths_before(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """``shard, base``: bytes that the epochs before ``epoch`` have written to each shard's token file."""
    filesystem, root = resolve(f"{path}/_lengths")
    found = filesystem.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    known = [int(f.base_name.removeprefix("epoch=")) for f in found if f.base_name.startswith("epoch=")]
    earlier = [n for n in known if n < epoch]
    if not earlier:
        return spark.createDataFrame([], "shard bigint, base bigint")
    return spark.read.schema("shard bigint, base bigint").parquet(f"{path}/_lengths/epoch={max(earlier):012d}")


def append_token_bins(encoded: DataFrame, path: str, epoch: int) -> None:
    """Adds the encoded rows of one micro-batch to the shards' token files, once.

    A shard goes on where the epochs before left it: their lengths are kept per epoch in
    ``_lengths``. A repeated epoch finds the same lengths and replaces what it wrote. Within an
    epoch rows go in corpus order, and epochs follow each other.
    """
    spark = encoded.sparkSession
    # the rows of this epoch, encoded once; dropped when the epoch is done
    scratch = scratch_path(spark, "packed")
    rows = packed_rows(encoded)
    rows.write.parquet(scratch)
    once = spark.read.schema(rows.schema).parquet(scratch)
    base = lengths_before(spark, path, epoch)
    placed = placed_tokens(once, base)
    write_positioned(placed, path, append=True)
    own = once.groupBy("shard").agg(F.sum(F.octet_length("packed")).cast("long").alias("own"))
    total = base.join(own, "shard", "full").select("shard", (F.coalesce("base", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("base"))
    total.write.mode("overwrite").parquet(f"{path}/_lengths/epoch={epoch:012d}")
    filesystem, place = resolve(scratch)
    filesystem.delete_dir(place)


def write_token_stream(texts: DataFrame, model: BpeModel, path: str, checkpoint: str, text: str = "text", **trigger) -> StreamingQuery:
    """Token files of an endless stream of corpus rows ``shard, batch_index, row_in_batch, text``, started.

    The files equal those that :func:`write_token_bins` makes of all rows, if the rows of a shard
    arrive in order; after any restart each row is there once.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        append_token_bins(bpe_encode(batch, model, text, packed=True), path, epoch)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

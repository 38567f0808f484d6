"""Sources and sinks: round trips, splits, broken and empty files, arguments."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom import api
from tokenloom.functions.scalars import unescape_delimiter
from tokenloom.streaming import streams
from tokenloom.operators import bpe, corpus, counters, tokens
from tokenloom.sources.sinks import write_positioned


def corpus_rows(n=200, shards=3, batch=7):
    rows = []
    for i in range(n):
        s, k = i % shards, i // shards
        text = None if i % 11 == 3 else "" if i % 13 == 4 else f"row {i} the end é " * (i % 5 + 1)
        rows.append((s, k // batch, k % batch, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "shard long, batch_index long, row_in_batch long, text string")


def write_shards(folder, rows, container, kind=pa.string()):
    os.makedirs(folder, exist_ok=True)
    schema = pa.schema([pa.field("other", pa.int64()), pa.field("text", kind)])
    shards = sorted({r[0] for r in rows})
    for s in shards:
        path = f"{folder}/data-{s:05d}-of-{len(shards):05d}.arrow"
        make = pa.ipc.new_file if container == "file" else pa.ipc.new_stream
        with pa.OSFile(path, "wb") as sink, make(sink, schema) as w:
            for b in sorted({r[1] for r in rows if r[0] == s}):
                texts = [r[3] for r in rows if r[0] == s and r[1] == b]
                if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
                    texts = [t if t is None else t.encode() for t in texts]
                w.write_batch(pa.record_batch([pa.array([1] * len(texts)), pa.array(texts, kind)], schema))


@pytest.mark.parametrize("container,kind", [
    ("file", pa.string()), ("stream", pa.large_string()), ("stream", pa.binary()), ("file", pa.large_binary()),
])
def test_arrow_scan(spark, folder, container, kind):
    rows = corpus_rows()
    write_shards(f"{folder}/c", rows, container, kind)
    df = spark.read.format("arrow_ipc").option("splitBytes", 1000).load(f"{folder}/c")
    assert df.rdd.getNumPartitions() > 3
    expect = "binary" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "string"
    assert df.dtypes[-1] == ("text", expect)
    got = [tuple(r) for r in df.withColumn("text", F.col("text").cast("string")).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def _write_stream(path, batches, schema, legacy=False):
    options = pa.ipc.IpcWriteOptions(use_legacy_format=legacy)
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, schema, options=options) as w:
        for b in batches:
            w.write_batch(b)


@pytest.mark.parametrize("legacy", [False, True])
def test_messages_of_a_stream(folder, legacy):
    """Headers alone give the batches that the library's own reader finds, with dictionaries between them."""
    from tokenloom.sources import arrow_stream as stream

    schema = pa.schema([("tag", pa.dictionary(pa.int32(), pa.string())), ("text", pa.large_string()), ("n", pa.int64())])
    batches = [
        pa.record_batch([
            pa.array([f"t{i}", "u"] * (k + 1)).dictionary_encode(),
            pa.array([None if j % 3 == 2 else f"{i} {j} é" * (i % 7) for j in range(2 * (k + 1))], pa.large_string()),
            pa.array(range(2 * (k + 1))),
        ], schema)
        for i, k in enumerate([0, 4, 0, 300, 1, 2000, 3, 3])
    ]
    _write_stream(f"{folder}/s.arrow", batches, schema, legacy)
    whole = list(pa.ipc.open_stream(f"{folder}/s.arrow"))
    size = os.path.getsize(f"{folder}/s.arrow")
    with pa.OSFile(f"{folder}/s.arrow") as f:
        assert sum(is_batch for is_batch, _, _ in stream.messages(f, size)) == len(batches)
        for step in (1, 500, 20_000, size):
            got = [x for r in stream.cut_ranges(f, size, step) for x in stream.range_batches(f, r, 1)]
            assert [i for i, _ in got] == list(range(len(batches)))
            assert [b.column(0).to_pylist() for _, b in got] == [b.column("text").to_pylist() for b in whole]
        for parts in (1, 2, 5, 50):
            cuts = [size * p // parts for p in range(parts + 1)]
            found = [stream.find_range(f, size, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
            got = [i for r in found if r for i, _ in stream.range_batches(f, r, 1)]
            assert got == list(range(len(batches)))
    content = open(f"{folder}/s.arrow", "rb").read()
    with pytest.raises(ValueError, match="cut at byte"):
        list(stream.messages(pa.BufferReader(content[: size // 2]), size // 2))


def test_one_stream_is_read_by_several_tasks(spark, folder):
    rows = corpus_rows(400, 1)
    write_shards(f"{folder}/c", rows, "stream")
    os.makedirs(f"{folder}/e")
    _write_stream(f"{folder}/e/none.arrow", [], pa.schema([("text", pa.string())]))
    index = api.index_streams(spark, f"{folder}/c", f"{folder}/index", 4000)
    plain = spark.read.format("arrow_ipc").option("splitBytes", 4000).load(f"{folder}/c")
    for df in (plain, api.corpus_frame(spark, f"{folder}/c", ranges=f"{folder}/index")):
        tasks = df.withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in tasks}) > 3
        assert sorted((tuple(r)[:4] for r in tasks), key=repr) == sorted(rows, key=repr)
    assert index.count() > 3 and api.index_streams(spark, f"{folder}/e", f"{folder}/none").count() == 0
    assert spark.read.format("arrow_ipc").load(f"{folder}/e").count() == 0
    write_shards(f"{folder}/c", corpus_rows(300, 1), "stream")
    with pytest.raises(Exception, match="its ranges were made"):
        api.corpus_frame(spark, f"{folder}/c", ranges=f"{folder}/index").count()


def test_arrow_scan_errors_and_shards(spark, folder):
    rows = corpus_rows()
    write_shards(f"{folder}/c", rows, "file")
    def load(**o):
        return spark.read.format("arrow_ipc").options(**o).load(f"{folder}/c").count()

    with pytest.raises(Exception, match="no column"):
        load(column="missing")
    with pytest.raises(Exception, match="not string or binary"):
        load(column="other")
    for bad in (0, 4):
        with pytest.raises(Exception, match="shards must be"):
            load(shards=bad)
    assert load(shards=2) == sum(r[0] < 2 for r in rows)
    with pytest.raises(Exception):
        spark.read.format("arrow_ipc").load(f"{folder}/nothing").count()


@pytest.mark.parametrize("container", ["file", "stream"])
def test_arrow_writer(spark, folder, container):
    rows = corpus_rows()
    df = frame(spark, rows).repartition("shard").sortWithinPartitions(*corpus.ORDER)
    df.write.format("arrow_ipc").options(total=3, container=container).mode("append").save(f"{folder}/w")
    back = spark.read.format("arrow_ipc").load(f"{folder}/w")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
    assert sorted(os.listdir(f"{folder}/w")) == [f"data-0000{i}-of-00003.arrow" for i in range(3)]


def expected_bins(spark, rows, model):
    got = bpe.bpe_encode(frame(spark, rows), model).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.shard, r.batch_index, r.row_in_batch)):
        out.setdefault(f"{r.shard:05d}.bin", b"")
        out[f"{r.shard:05d}.bin"] += b"".join(i.to_bytes(4, "little") for i in (r.ids or []))
    return out


@pytest.mark.parametrize("layout", ["file", "parts"])
def test_token_bins(spark, folder, model, layout):
    rows = corpus_rows() + [(7, 0, 0, None), (7, 0, 1, "")]  # shard 7 has no usable row
    want = expected_bins(spark, rows, model)
    assert want["00007.bin"] == b""
    enc = bpe.bpe_encode(frame(spark, rows).repartition(5), model)
    for _ in range(2):  # a rerun replaces
        tokens.write_token_bins(enc, f"{folder}/b", layout=layout)
    assert sorted(os.listdir(f"{folder}/b")) == sorted(want)
    for name, data in want.items():
        path = f"{folder}/b/{name}"
        if layout == "parts":
            got = b"".join(open(f"{path}/{p}", "rb").read() for p in sorted(os.listdir(path)))
        else:
            got = open(path, "rb").read()
        assert got == data
    scan = spark.read.format("token_bin").load(f"{folder}/b").orderBy("path", "pos").collect()
    flat = b"".join(r.token_id.to_bytes(4, "little") for r in scan)
    assert flat == b"".join(want[n] for n in sorted(want))


def test_rerun_with_less_data_leaves_no_tail(spark, folder, model):
    enc = bpe.bpe_encode(frame(spark, corpus_rows(200, 1)), model)
    tokens.write_token_bins(enc, folder, layout="file")
    tokens.write_token_bins(enc.where("batch_index < 2"), folder, layout="file")
    want = expected_bins(spark, [r for r in corpus_rows(200, 1) if r[1] < 2], model)["00000.bin"]
    assert open(f"{folder}/00000.bin", "rb").read() == want


def test_token_file_edges(spark, folder):
    files = {
        "a.bin": b"", "b.bin": b"xyz", "c.bin": (7).to_bytes(4, "little") + b"xy",
        "d.bin": b"\0" * 40, "e.bin": b"".join(i.to_bytes(4, "little") for i in (2**31, 2**32 - 1, 0, 5)),
        "f.bin": b"".join(i.to_bytes(4, "little") for i in range(1, 101)),
    }
    for name, data in files.items():
        open(f"{folder}/{name}", "wb").write(data)
    scan = spark.read.format("token_bin").option("splitBytes", 16).load(folder)
    assert scan.where("path like '%f.bin'").orderBy("pos").select("token_id").rdd.flatMap(list).collect() == list(range(1, 101))
    summary, ends = api.summarize_tokens(spark, folder, 64)
    by = {os.path.basename(r.path): r for r in summary.collect()}
    assert [by[n].tokens for n in sorted(by)] == [0, 0, 1, 10, 4, 100]
    assert by["a.bin"].zeros is None and by["b.bin"].size_bytes == 3
    assert (by["d.bin"].zeros, by["d.bin"].zero_ratio, by["d.bin"].max_id) == (10, 1.0, 0)
    assert (by["e.bin"].min_id, by["e.bin"].max_id, by["e.bin"].nonzero) == (0, 2**32 - 1, 3)
    tail = ends.where("path like '%f.bin' and part = 'TAIL'").orderBy("pos").collect()
    assert [r.token_id for r in tail] == list(range(37, 101))
    assert ends.where("part = 'TAIL' and path not like '%f.bin'").count() == 0
    assert api.summarize_tokens(spark, folder, -3)[1].count() == 0


def test_log_lines_at_every_split(spark, folder):
    text = "first\n\nthird é\r\n" + "x" * 50 + "\nlast without end"
    open(f"{folder}/l.log", "w", encoding="utf-8", newline="").write(text)
    raw = text.encode()
    want, at = [], 0
    for line in raw.split(b"\n"):
        want.append((at, line.rstrip(b"\r").decode()))
        at += len(line) + 1
    for split in (3, 16, 1000):
        df = spark.read.format("log_lines").option("splitBytes", split).load(f"{folder}/l.log")
        assert [(r.byte_offset, r.value) for r in df.orderBy("byte_offset").collect()] == want


def test_byte_blocks(spark, folder):
    data = os.urandom(10_000)
    open(f"{folder}/x.txt", "wb").write(data)
    open(f"{folder}/empty.txt", "wb").write(b"")
    df = spark.read.format("byte_blocks").option("blockBytes", 4096).load(folder)
    got = df.orderBy("block_index").collect()
    assert [r.length for r in got] == [4096, 4096, 1808] and b"".join(bytes(r.content) for r in got) == data


@pytest.mark.parametrize("delim,limits", [("\\n", (-1, 10)), ("", (0,)), ("\\0-", (10_000,))])
def test_dump_text(spark, folder, delim, limits):
    rows = corpus_rows()
    ordered = sorted(rows, key=lambda r: r[:3])
    for limit in limits:
        out = api.dump_text(spark, frame(spark, rows).repartition(4), f"{folder}/o{limit}.txt", layout="file",
                            index_path=f"{folder}/o{limit}.idx", delimiter=delim, max_rows=limit)
        taken = ordered if limit < 0 else ordered[:limit]
        d = unescape_delimiter(delim).encode()
        want = b"".join((r[3] or "").encode() + d for r in taken)
        assert out == {"rows": len(taken), "output_bytes": len(want)}
        if taken:
            assert open(f"{folder}/o{limit}.txt", "rb").read() == want
            lines = [tuple(map(int, x.split("\t"))) for x in open(f"{folder}/o{limit}.idx")]
            at = 0
            for (o, n), r in zip(lines, taken, strict=True):
                assert (o, n) == (at, len((r[3] or "").encode()))
                at += n + len(d)


def test_unescape_delimiter():
    cases = {r"\n": "\n", r"\t\r": "\t\r", r"\0": "\0", r"\\n": "\\n", r"\q": "q", "a\\": "a\\", "": ""}
    assert {k: unescape_delimiter(k) for k in cases} == cases


def test_positioned_sink_out_of_order(spark, folder):
    parts = [("f", i * 3, bytearray([i, i, i])) for i in range(50)]
    df = spark.createDataFrame(parts[::-1], "file string, offset long, data binary").repartition(7)
    for layout in ("file", "parts"):
        write_positioned(df, f"{folder}/{layout}", layout)
    want = b"".join(bytes(p[2]) for p in parts)
    assert open(f"{folder}/file/f", "rb").read() == want
    got = b"".join(open(f"{folder}/parts/f/{p}", "rb").read() for p in sorted(os.listdir(f"{folder}/parts/f")))
    assert got == want


def test_tokenize_corpus(spark, folder, model):
    rows = corpus_rows()
    write_shards(f"{folder}/c", rows, "stream")
    stats = api.tokenize_corpus(spark, f"{folder}/c", layout="file")
    want = expected_bins(spark, rows, model)
    assert stats["output"] == f"{folder}/c.bin" and stats["rows"] == len(rows)
    assert stats["tokens"] * 4 == sum(map(len, want.values()))
    assert {n: open(f"{folder}/c.bin/{n}", "rb").read() for n in want} == want
    two = api.tokenize_corpus(spark, f"{folder}/c", f"{folder}/two", shards=2, layout="file")
    assert two["shards"] == 2 and sorted(os.listdir(f"{folder}/two")) == ["00000.bin", "00001.bin"]
    with pytest.raises(Exception, match="shards must be"):
        api.tokenize_corpus(spark, f"{folder}/c", f"{folder}/three", shards=9)
    with pytest.raises(ValueError, match="mode"):
        api.tokenize_corpus(spark, f"{folder}/c", mode="pages")
    blocks = api.tokenize_corpus(spark, f"{folder}/c", f"{folder}/blk", mode="blocks", block_bytes=512, layout="file")
    assert blocks["total_bytes"] == sum(len((r[3] or "").encode()) for r in rows)
    for name in os.listdir(f"{folder}/blk"):
        assert name.endswith(".overflow") or os.path.getsize(f"{folder}/blk/{name}") % 512 == 0


def test_tokenize_raw_file(spark, folder):
    open(f"{folder}/raw.txt", "wb").write(b"the end of the " * 1000)
    stats = api.tokenize_corpus(spark, f"{folder}/raw.txt", mode="blocks", block_bytes=4096, layout="file")
    assert stats["total_bytes"] == 15_000 and stats["blocks"] == 4
    assert os.path.getsize(f"{folder}/raw.txt.bin/00000.bin") == 4096 * 3 + 3072


def test_empty_shards_and_large_numbers_keep_their_names(spark, folder):
    """In parts: a shard without ids is listed, and six-digit shards stay apart."""
    rows = [(100_000, 0, 0, [7]), (100_007, 0, 0, [8]), (123_456, 0, 0, None)]
    df = spark.createDataFrame(rows, "shard long, batch_index long, row_in_batch long, ids array<long>")
    tokens.write_token_bins(df, f"{folder}/t")
    files = {r.path.rsplit("/", 1)[1]: r.size_bytes for r in tokens.token_files(spark, f"{folder}/t").collect()}
    assert files == {"100000.bin": 4, "100007.bin": 4, "123456.bin": 0}


def test_shard_numbers_come_from_file_names(spark, folder):

    os.makedirs(f"{folder}/a")
    for n in (3, 99_999, 100_000):
        table = pa.table({"text": [str(n)]})
        with pa.OSFile(f"{folder}/a/data-{n:05d}-of-200000.arrow", "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
    scan = lambda **o: {r.shard: r.text for r in spark.read.format("arrow_ipc").options(column="text", **o).load(f"{folder}/a").collect()}
    assert scan() == {n: str(n) for n in (3, 99_999, 100_000)}
    assert scan(shards=2) == {3: "3", 99_999: "99999"}


def test_token_stream_is_exactly_once(spark, folder, model):
    """A repeated epoch, also one that stopped before its lengths were kept, adds nothing."""
    import shutil

    rows = corpus_rows(90, 3)
    df = spark.createDataFrame(rows, "shard long, batch_index long, row_in_batch long, text string")
    enc = bpe.bpe_encode(df, model)
    half = max(r[1] for r in rows) // 2
    streams.append_token_bins(enc.where(f"batch_index <= {half}"), folder, 0)
    for _ in range(2):
        streams.append_token_bins(enc.where(f"batch_index > {half}"), folder, 4)
    shutil.move(f"{folder}/_lengths/epoch={4:012d}", f"{folder}/_lengths-lost")
    streams.append_token_bins(enc.where(f"batch_index > {half}").repartition(5), folder, 4)
    got = {n: b"".join(open(f"{folder}/{n}/{p}", "rb").read() for p in sorted(os.listdir(f"{folder}/{n}")) if p.startswith("part-"))
           for n in os.listdir(folder) if n.endswith(".bin")}
    assert got == expected_bins(spark, rows, model)


def test_metrics_stream_after_a_restart(spark, folder):
    """Two runs with their own counters at the same ticks; the second start repeats no row."""
    streams.use_rocksdb(spark)
    names = ["run", "tick", "ts_us", "last_latency_us", "in_flight", *counters.MONITOR_COLUMNS]
    ddl = ", ".join(f"{n} long" for n in names)

    def row(run, tick, **more):
        return tuple({"run": run, "tick": tick, "ts_us": tick * 10, "last_latency_us": 3, "in_flight": 1, **more}.get(n, -1 if n[:2] in ("cp", "rx", "tx") else 0) for n in names)

    parts = [[row(0, 1, req=10, slot_0=4), row(1, 1, req=5, cpu_total=100, cpu_idle=50)],
             [row(0, 2, req=30, slot_0=6, slot_1=2), row(1, 2, req=4, cpu_total=200, cpu_idle=50)]]
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = counters.monitor_rows(spark.readStream.schema(ddl).parquet(f"{folder}/in"), 1000)
        streams.write_metrics_stream(rows, f"{folder}/csv", f"{folder}/state").awaitTermination()
    got = streams.read_metrics(spark, f"{folder}/csv", rows.schema)
    shown = sorted((r.ts_us, r.req_total, r.req_per_s, r.fairness_resp, r.cpu_busy_all) for r in got.collect())
    # one slot alone has a share of 1/64; a falling counter shows 0; a family's first tick shows 0
    assert shown == [(10, 5, 5.0, 0.0, 0.0), (10, 10, 10.0, 0.016, 0.0), (20, 4, 0.0, 0.0, 100.0), (20, 30, 20.0, 0.031, 0.0)]


def test_monitor_csv_of_tables_and_streams(spark, folder):
    """The same snapshots as a table and as a stream give the same CSV rows; a second start adds none."""
    streams.use_rocksdb(spark)
    names = ["run", "tick", "ts_us", "last_latency_us", "in_flight", *counters.MONITOR_COLUMNS]
    ddl = ", ".join(f"{n} long" for n in names)
    rows = [tuple({"run": run, "tick": t, "ts_us": 100 * t + run}.get(n, (t * (i + 2) + run) * 1000 + t * t) for i, n in enumerate(names))
            for run in (0, 1) for t in range(1, 6)]
    table = spark.createDataFrame(rows, ddl)
    table.coalesce(1).write.parquet(f"{folder}/in")
    shown = api.monitor(table, 1000, kind="all", csv=f"{folder}/table")
    assert shown.columns == counters.METRICS_COLUMNS
    written = spark.read.schema(shown.schema).option("header", True).csv(f"{folder}/table").collect()
    assert sorted(map(tuple, written)) == sorted(map(tuple, shown.collect())) and len(written) == 10
    for _ in range(2):
        endless = spark.readStream.schema(ddl).parquet(f"{folder}/in")
        api.monitor(endless, 1000, kind="all", csv=f"{folder}/stream", checkpoint=f"{folder}/state").awaitTermination()
    got = streams.read_metrics(spark, f"{folder}/stream", shown.schema).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, written))
    with pytest.raises(ValueError, match="checkpoint"):
        api.monitor(endless, 1000, kind="all", csv=f"{folder}/more")
    with pytest.raises(ValueError, match="kind 'all'"):
        api.monitor(table, 1000, csv=f"{folder}/more")


def test_shard_of_many_tasks_is_written_in_parts(spark, folder):
    """No task needs a whole shard; order, nulls and six-digit numbers come back."""
    df = spark.range(600).selectExpr(
        "if(id < 500, 7, 100003) as shard", "id div 10 as batch_index", "id % 10 as row_in_batch",
        "if(id % 7 = 0, null, 'text ' || id) as text")
    dealt = df.repartitionByRange(6, "shard", "batch_index").sortWithinPartitions("shard", "batch_index", "row_in_batch")
    dealt.write.format("arrow_ipc").mode("append").options(total=200000, layout="parts").save(f"{folder}/p")
    assert len(os.listdir(f"{folder}/p/data-00007-of-200000.arrow")) > 3
    back = spark.read.format("arrow_ipc").load(f"{folder}/p")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(Exception, match="layout"):
        dealt.write.format("arrow_ipc").mode("append").options(total=9, layout="rows").save(f"{folder}/q")


def test_blocks_are_encoded_in_one_step(spark, model):
    """Output and overflow are cuts of the packed ids; no list of ids goes back to Python."""
    from tokenloom.operators import blocks

    cut = blocks.cut_blocks(frame(spark, corpus_rows()), block_bytes=512, boundary="char")
    out = blocks.block_tokenize(cut, model, 512)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    ids = bpe.bpe_encode(cut.selectExpr("shard", "block_index", "cast(content as string) as text"), model)
    want = {(r.shard, r.block_index): b"".join(i.to_bytes(4, "little") for i in r.ids) for r in ids.collect()}
    got = out.collect()
    assert len(got) == len(want) and any(len(r.overflow) for r in got)
    assert all(bytes(r.output)[: 4 * r.kept] + bytes(r.overflow) == want[r.shard, r.block_index] for r in got)
    assert all(r.n_tokens * 4 == len(want[r.shard, r.block_index]) and len(r.output) == r.capacity for r in got)


def test_chunks_are_summed_by_path(spark, folder):
    """File names are cut from the sums, never from the row of a token."""
    from tokenloom.plans import corpus_queries

    os.makedirs(f"{folder}/b")
    for name in ("00001.bin", "00002.bin"):
        with open(f"{folder}/b/{name}", "wb") as f:
            f.write(b"".join(i.to_bytes(4, "little") for i in range(5000)))
    sums = corpus_queries._chunk_sums(spark.read.format("token_bin").load(f"{folder}/b"))
    got = sorted(map(tuple, sums.select("file", "chunk", "n", "id_sum").collect()))
    first, rest = sum(range(4096)), sum(range(4096, 5000))
    assert got == [(f"0000{i}.bin", k, n, t) for i in (1, 2) for k, n, t in ((0, 4096, first), (1, 904, rest))]
    assert "Aggregate [path" in sums._jdf.queryExecution().optimizedPlan().toString()

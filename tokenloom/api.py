"""Entry points: tokenize a corpus, dump text, index ranges, look at token files,
watch counters, read run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.registry import register_functions
from tokenloom.functions.scalars import core_list, shard_name
from tokenloom.operators import blocks, bpe, corpus, counters, logs, ranges, tokens
from tokenloom.session import materialize, spread
from tokenloom.sources.files import SPLIT_BYTES
from tokenloom.sources.model import BpeModel, load_model, toy_model
from tokenloom.sources.register import register_sources
from tokenloom.sources.sinks import write_positioned
from tokenloom.streaming import streams

__all__ = [
    "build_range_index", "corpus_frame", "dump_text", "index_streams", "load_model", "monitor", "parse_runtime_log",
    "profile_tokenize", "register_functions", "register_sources", "summarize_tokens", "tokenize_corpus", "toy_model",
]


def corpus_frame(
    spark: SparkSession, source: DataFrame | str, column: str = "text", shards: int | None = None,
    ranges: str | None = None,
) -> DataFrame:
    """A corpus from a DataFrame or from a file or folder of Arrow IPC shards.

    ``shards=n`` takes the first n shards; n must be 1 up to their number. ``ranges`` is an index
    of raw streams by :func:`index_streams`.
    """
    if isinstance(source, DataFrame):
        if column not in source.columns:
            raise ValueError(f"no column {column!r}; the corpus has {source.columns}")
        kind = source.schema[column].dataType.simpleString()
        if kind not in ("string", "binary"):
            raise ValueError(f"column {column!r} is {kind}, not string or binary")
        if shards is None:
            return source
        if shards < 1:
            raise ValueError(f"shards must be at least 1, got {shards}")
        return source.where(F.col("shard") < shards)
    register_sources(spark)
    reader = spark.read.format("arrow_ipc").option("column", column)
    if shards is not None:
        reader = reader.option("shards", shards)
    if ranges is not None:
        reader = reader.option("ranges", ranges)
    return reader.load(source)


def index_streams(spark: SparkSession, source: str, output: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the ranges of all raw Arrow streams of a folder, found by their headers, and return them.

    Worth it for streams of many gigabytes: without it each task looks at the headers before its share.
    """
    register_sources(spark)
    found = spark.read.format("arrow_stream_ranges").option("splitBytes", split_bytes).load(source)
    found.write.mode("overwrite").parquet(output)
    return spark.read.schema(found.schema).parquet(output)


def tokenize_corpus(
    spark: SparkSession,
    source: DataFrame | str,
    output: str | None = None,
    column: str = "text",
    model: BpeModel | None = None,
    mode: str = "rows",
    block_bytes: int = blocks.BLOCK_BYTES,
    shards: int | None = None,
    strategy: str = "auto",
    layout: str = "parts",
    partitions: int | None = None,
    **options,
) -> dict:
    """Tokenize a corpus into one ``.bin`` token file per shard; return the totals.

    ``mode='rows'`` encodes row by row. ``mode='blocks'`` cuts each shard's bytes
    into blocks and writes an equally large, zero-padded block for each; a path
    that is not Arrow is then taken as raw bytes, one shard per file. Output goes
    to ``<source>.bin`` unless named.
    """
    if mode not in ("rows", "blocks"):
        raise ValueError("mode is 'rows' or 'blocks'")
    if output is None:
        if not isinstance(source, str):
            raise ValueError("an output path is needed for a DataFrame corpus")
        output = f"{source.rstrip('/')}.bin"
    model = model or toy_model()
    register_sources(spark)
    pretok = {k: options.pop(k) for k in ("pretokenizer", "use_added") if k in options}
    if mode == "rows":
        rows = corpus_frame(spark, source, column, shards)
        rows = spread(rows, partitions).withColumn(column, F.col(column).cast("string"))
        encoded = bpe.bpe_encode(rows, model, column, strategy=strategy, packed=True, **pretok)
        # encoded once; the counts come from the written table
        packed = materialize(tokens.packed_rows(encoded), "packed")
        write_positioned(tokens.placed_tokens(packed), output, layout)
        size = F.octet_length("packed")
        totals = packed.agg(
            F.countDistinct("shard").alias("shards"),
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.when(size > 0, 1)), F.lit(0)).alias("rows_encoded"),
            F.coalesce(F.sum(size / 4).cast("long"), F.lit(0)).alias("tokens"),
        ).first()
        return {**totals.asDict(), "output": output}
    if isinstance(source, str) and not _is_arrow(spark, source):
        if shards is not None:
            raise ValueError("shards applies to Arrow corpora and DataFrames")
        cut = raw_blocks(spark, source, block_bytes)
    else:
        cut = blocks.cut_blocks(corpus_frame(spark, source, column, shards), column, block_bytes, **options)
        if options.get("scope") == "batch":
            raise ValueError("scope='batch' gives blocks of many lengths: use cut_blocks and block_tokenize")
    done = materialize(blocks.block_tokenize(cut, model, block_bytes, strategy, **pretok), "blocks")
    tokens.write_block_bins(done, output, block_bytes, layout)
    totals = done.agg(
        F.countDistinct("shard").alias("shards"), F.count(F.lit(1)).alias("blocks"),
        F.sum("block_len").alias("total_bytes"), F.sum("kept").alias("tokens"),
        F.sum("dropped").alias("dropped"),
    ).first()
    return {**totals.asDict(), "output": output}


def _is_arrow(spark: SparkSession, path: str) -> bool:
    from tokenloom.sources.files import list_files

    return any(name.endswith(".arrow") for name, _ in list_files(path))


def raw_blocks(spark: SparkSession, path: str, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Blocks of raw files, one shard per file in name order."""
    from tokenloom.sources.files import list_files

    register_sources(spark)
    names = spark.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(list_files(path))], "shard bigint, path string")
    scan = spark.read.format("byte_blocks").option("blockBytes", block_bytes).load(path)
    return scan.join(names, "path").select(
        "shard", "block_index", F.col("length").alias("block_len"), "content")


def dump_text(
    spark: SparkSession,
    source: DataFrame | str,
    output: str,
    column: str = "text",
    index_path: str | None = None,
    delimiter: str = "\n",
    max_rows: int = -1,
    layout: str = "parts",
) -> dict:
    """Write each row and the delimiter to the file ``output``; null rows stay as
    empty rows. ``index_path`` names a file of ``offset \\t length`` lines."""
    rows = corpus_frame(spark, source, column)
    placed = corpus.dump_rows(rows, column, delimiter, max_rows)
    _write_one(placed.select("offset", "data"), output, layout)
    if index_path:
        line = F.concat(F.col("offset").cast("string"), F.lit("\t"), F.col("len").cast("string"))
        index = placed.select(*corpus.ORDER, line.alias("text"))
        _write_one(corpus.dump_rows(index).select("offset", "data"), index_path, layout)
    return corpus.dump_stats(rows, column, delimiter, max_rows).first().asDict()


def _write_one(placed: DataFrame, path: str, layout: str) -> None:
    register_sources(placed.sparkSession)
    folder, _, name = path.rstrip("/").rpartition("/")
    write_positioned(placed.withColumn("file", F.lit(name)), folder or ".", layout)


def build_range_index(
    df: DataFrame,
    extents: DataFrame | None = None,
    output: str | None = None,
    column: str = "text",
    max_rows: int = -1,
    total_shards: int | None = None,
    check: bool = True,
) -> DataFrame:
    """Byte range of every record batch and, with ``extents(shard, logical,
    physical, length)``, the device blocks behind it.

    A range the extents do not cover fully is an error unless ``check=False``.
    With ``output``, one JSON record per batch is written there.
    """
    index = corpus.batch_range_index(df, column, max_rows)
    ranges_df = index.select(
        "shard", "batch_index", F.col("data_offset").alias("start"), F.col("data_length").alias("length"))
    if extents is None:
        pairs = ranges_df.where("false").select(
            "shard", "batch_index", F.lit(0).cast("long").alias("overlap_start"),
            F.lit(0).cast("long").alias("slba"), F.lit(0).cast("long").alias("nblocks"))
    else:
        pairs = ranges.overlap_join(ranges_df, extents, ["shard"])
        if check:
            cover = ranges.range_coverage(ranges_df, pairs, ["shard", "batch_index"])
            bad = cover.where("not covered").select("shard", "batch_index").take(1)
            if bad:
                raise ValueError(f"range not fully covered by extents (sparse or hole): {bad[0].asDict()}")
    name = shard_name(F.col("shard"), total_shards)
    rows = ranges.range_index_rows(index, pairs, name, column)
    if output:
        rows.drop("shard").write.mode("overwrite").json(output)
    return rows


def summarize_tokens(spark: SparkSession, path: str, limit: int = 64) -> tuple[DataFrame, DataFrame]:
    """Per-file summary, and the first and last ``limit`` ids of each file."""
    register_sources(spark)
    return tokens.token_file_summary(spark, path), tokens.head_tail(spark, path, limit)


def profile_tokenize(
    spark: SparkSession, source: DataFrame | str, column: str = "text", model: BpeModel | None = None
) -> DataFrame:
    """Stage times of encoding a corpus, per task and for all: the worker report."""
    rows = corpus.nonempty_rows(corpus_frame(spark, source, column), column)
    return counters.worker_profile(bpe.stage_times(rows, model or toy_model(), column))


def parse_cores(spark: SparkSession, spec: str) -> list[int]:
    return spark.range(1).select(core_list(F.lit(spec)).alias("c")).first()["c"]


def monitor(
    snapshots: DataFrame, interval_ms: int = 1000, cores: str | Sequence[int] = "0-5",
    kind: str = "requests", time: str = "tick", csv: str | None = None, checkpoint: str | None = None, **trigger,
) -> DataFrame | StreamingQuery:
    """Rates of cumulative snapshots; ``kind`` is requests, slots, cpu, net, block or all.

    A stream of snapshots gives a stream (with the RocksDB state store, see
    ``streams.use_rocksdb``). ``all`` gives the monitor's 19 columns from whole snapshots
    (:func:`counters.monitor_rows`), and ``csv`` writes them: a table's into that folder, in place of what
    was there, and returned as well; a stream's batch by batch, each row once after any restart with the
    same ``checkpoint``, as the started query. ``trigger`` is the stream's (default: what is there now).
    """
    if csv is not None and kind != "all":
        raise ValueError("the CSV holds the columns of kind 'all'")
    if kind == "all":
        rows = counters.monitor_rows(snapshots, interval_ms, time)
        if csv is None:
            return rows
        if not snapshots.isStreaming:
            counters.write_metrics_csv(rows, csv)
            return rows
        if checkpoint is None:
            raise ValueError("a stream's CSV needs a checkpoint folder")
        return streams.write_metrics_stream(rows, csv, checkpoint, **trigger)
    if kind == "cpu":
        chosen = parse_cores(snapshots.sparkSession, cores) if isinstance(cores, str) else list(cores)
        return counters.cpu_busy(snapshots, chosen, time)
    table = {
        "requests": counters.counter_rates, "slots": counters.slot_rates,
        "net": counters.net_rates, "block": counters.block_rates,
    }
    if kind not in table:
        raise ValueError(f"unknown kind {kind!r}")
    return table[kind](snapshots, interval_ms, time)


def parse_runtime_log(spark: SparkSession, path: str, output: str | None = None) -> DataFrame:
    """Difference records of the runs in one or more log files, labelled in log order."""
    register_sources(spark)
    records = logs.log_runs(spark.read.format("log_lines").load(path))
    if output:
        logs.write_log_runs_csv(records, output)
    return logs.label_runs(records)

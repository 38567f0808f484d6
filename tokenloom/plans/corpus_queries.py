"""Registered queries over the corpus: scans, sinks, tokenization, offsets, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import bytelevel, scalars
from tokenloom.operators import blocks, bpe, corpus, ranges, tokens
from tokenloom.plans import fixtures as fx
from tokenloom.plans import oracle_views as ov
from tokenloom.plans.registry import ORACLES, query
from tokenloom.session import materialize, scratch_path, spread
from tokenloom.sources.model import model_relations, toy_model, vocab_lookup, write_model
from tokenloom.sources.register import register_sources
from tokenloom.sources.sinks import write_positioned
from tokenloom.streaming import streams

CHUNK = 4096
BLOCK = 16384


def text_ids(ids: Column) -> Column:
    return F.array_join(ids, " ")


def encoded(spark: SparkSession, sf: str, strategy: str = "arrow", packed: bool = False) -> DataFrame:
    rows = corpus.nonempty_rows(spread(fx.corpus(spark, sf), key="doc_id"))
    return bpe.bpe_encode(rows, toy_model(), strategy=strategy, packed=packed)


def ids_text_sql(name: str = "ids") -> str:
    return f"array_to_string({name}, ' ')"


# ------------------------------------------------------------ rows and order
@query("null_to_empty", f"with {ov.CORPUS} select doc_id, coalesce(text, '') as text from corpus")
def null_to_empty(spark, sf):
    return corpus.null_to_empty(fx.corpus(spark, sf)).select("doc_id", "text")


@query("nonempty_rows", f"with {ov.CORPUS} select doc_id, text from corpus where text <> ''")
def nonempty_rows(spark, sf):
    return corpus.nonempty_rows(fx.corpus(spark, sf)).select("doc_id", "text")


@query("row_offset_index", f"""with {ov.CORPUS}
select shard, batch_index, row_in_batch, cast({ov.LEN} as bigint) as len,
  cast(coalesce(sum({ov.LEN} + 1) over (partition by shard order by batch_index, row_in_batch
    rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from corpus""")
def row_offset_index(spark, sf):
    out = corpus.row_offsets(fx.corpus(spark, sf), delimiter_bytes=1)
    return out.select(*corpus.ORDER, "offset", "len")


@query("text_dump", f"""with {ov.CORPUS}
select shard, batch_index, row_in_batch, cast({ov.LEN} as bigint) as len,
  cast(coalesce(sum({ov.LEN} + 1) over (order by shard, batch_index, row_in_batch
    rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
  md5(coalesce(text, '') || chr(10)) as data_md5 from corpus""")
def text_dump(spark, sf):
    placed = corpus.dump_rows(fx.corpus(spark, sf), delimiter=r"\n")
    return placed.select(*corpus.ORDER, "offset", "len", F.md5("data").alias("data_md5"))


@query("text_dump_stats", f"""with {ov.CORPUS}
select count(*) as rows, cast(sum({ov.LEN} + 1) as bigint) as output_bytes from corpus""")
def text_dump_stats(spark, sf):
    return corpus.dump_stats(fx.corpus(spark, sf), delimiter=r"\n")


@query("max_rows", f"""with {ov.CORPUS}
select doc_id, shard, batch_index, row_in_batch from corpus
order by shard, batch_index, row_in_batch limit 300""")
def max_rows(spark, sf):
    return corpus.max_rows(fx.corpus(spark, sf), 300).select("doc_id", *corpus.ORDER)


@query("round_robin", f"""with {ov.CORPUS}
select doc_id, (row_number() over (order by shard, batch_index, row_in_batch) - 1) % 5 as slot from corpus""")
def round_robin(spark, sf):
    return corpus.round_robin(fx.corpus(spark, sf), 5).select("doc_id", "slot")


@query("shard_name", f"""with {ov.CORPUS}
select shard, printf('data-%05d-of-%05d.arrow', shard, 8) as shard_file,
  printf('%05d.bin', shard) as token_file, count(*) as rows
from corpus group by all""")
def shard_name(spark, sf):
    return fx.corpus(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).select(
        "shard",
        scalars.shard_name(F.col("shard"), 8).alias("shard_file"),
        F.concat(scalars.shard_name(F.col("shard")), F.lit(".bin")).alias("token_file"),
        "rows",
    )


# -------------------------------------------------------------- tokenization
@query("pretokenize", f"""with {ov.CORPUS}
select doc_id, len(w) as n_pieces, md5(array_to_string(w, chr(31))) as pieces_md5
from (select doc_id, {ov.words('text')} as w from corpus where text <> '')""")
def pretokenize(spark, sf):
    rows = corpus.nonempty_rows(spread(fx.corpus(spark, sf), key="doc_id"))
    w = bytelevel.pretokenize(F.col("text"))
    return rows.select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").alias("n_pieces"), F.md5(F.array_join("w", "\x1f")).alias("pieces_md5")
    )


_BYTE_SYMBOL = (
    "case when b <= 32 then chr(256 + b) when b between 127 and 160 then chr(162 + b) "
    "when b = 173 then chr(323) else chr(b) end"
)


def _mapped_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        f"lambda h: ('0x' || h)::int), lambda b: {_BYTE_SYMBOL}), '')"
    )


@query("byte_map", f"""with {ov.CORPUS}
select doc_id, md5({_mapped_sql('text')}) as mapped_md5 from corpus where text <> ''""")
def byte_map(spark, sf):
    rows = corpus.nonempty_rows(fx.corpus(spark, sf))
    return rows.select("doc_id", F.md5(bytelevel.byte_map(F.col("text"))).alias("mapped_md5"))


_ENCODE_SQL = f"with {ov.ENCODED} select doc_id, len(ids) as n_tokens, {ids_text_sql()} as ids from encoded"


@query("bpe_encode", _ENCODE_SQL)
def bpe_encode(spark, sf):
    return encoded(spark, sf).select("doc_id", F.size("ids").alias("n_tokens"), text_ids("ids").alias("ids"))


@query("bpe_encode_fold", _ENCODE_SQL)
def bpe_encode_fold(spark, sf):
    """The same ids from Catalyst expressions alone."""
    return encoded(spark, sf, "fold").select(
        "doc_id", F.size("ids").alias("n_tokens"), text_ids("ids").alias("ids"))


_TAGGED_SQL = "'[CLS]' || replace(text, ' the ', ' [MASK]') || '[SEP]'"


_ADDED_SQL = f"""with {ov.CORPUS}
select doc_id, len(ids) as n_tokens, {ids_text_sql()} as ids
from (select doc_id, {ov.ids('t', True)} as ids
      from (select doc_id, {_TAGGED_SQL} as t from corpus where text <> ''))"""


@query("added_tokens", _ADDED_SQL)
def added_tokens(spark, sf, strategy="fold"):
    rows = corpus.nonempty_rows(spread(fx.corpus(spark, sf), key="doc_id"))
    tagged = F.concat(F.lit("[CLS]"), F.replace("text", F.lit(" the "), F.lit(" [MASK]")), F.lit("[SEP]"))
    enc = bpe.bpe_encode(rows.withColumn("text", tagged), toy_model(), strategy=strategy)
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), text_ids("ids").alias("ids"))


@query("added_tokens_arrow", _ADDED_SQL)
def added_tokens_arrow(spark, sf):
    """The same ids from the Arrow way of encoding."""
    return added_tokens(spark, sf, "arrow")


@query("token_counts", f"""with {ov.ENCODED}
select shard, count(*) as rows, cast(sum(len(ids)) as bigint) as tokens from encoded group by shard""")
def token_counts(spark, sf):
    return tokens.token_counts(encoded(spark, sf), ["shard"])


@query("tokens_by_source", f"""with {ov.ENCODED}
select source, count(*) as rows, cast(sum(len(ids)) as bigint) as tokens from encoded group by source""")
def tokens_by_source(spark, sf):
    return tokens.token_counts(encoded(spark, sf), ["source"])


@query("flatten_pack", f"""with {ov.ENCODED}
select shard, batch_index, cast(sum(len(ids)) as bigint) as n_tokens,
  md5(unhex(string_agg({ov.hex_u32('ids')}, '' order by row_in_batch))) as packed_md5
from encoded group by shard, batch_index""")
def flatten_pack(spark, sf):
    return bpe.flatten_pack(encoded(spark, sf, packed=True)).select(
        "shard", "batch_index", "n_tokens", F.md5("packed").alias("packed_md5"))


@query("skip_empty_batches", f"""with {ov.ENCODED}
select doc_id // 8 as batch_index, shard, cast(sum(len(ids)) as bigint) as n_tokens
from encoded group by all having sum(len(ids)) > 0""")
def skip_empty_batches(spark, sf):
    """One-row batches: those of null and empty rows must give no buffer."""
    rows = spread(fx.corpus(spark, sf), key="doc_id").withColumn(
        "batch_index", F.expr(f"doc_id div {fx.SHARDS}")).withColumn("row_in_batch", F.lit(0))
    enc = bpe.bpe_encode(rows, toy_model())
    return bpe.flatten_pack(enc).select("batch_index", "shard", "n_tokens")


@query("bpe_decode", f"with {ov.CORPUS} select doc_id, text from corpus where text <> ''")
def bpe_decode(spark, sf):
    enc = encoded(spark, sf)
    return enc.select("doc_id", bpe.bpe_decode(F.col("ids"), toy_model()).alias("text"))


@query("token_text_write", f"""with {ov.ENCODED}
select {ids_text_sql()} || ' ' as value from encoded""")
def token_text_write(spark, sf):
    path = scratch_path(spark, "token-text")
    encoded(spark, sf).select(bpe.ids_to_text(F.col("ids")).alias("value")).write.text(path)
    return spark.read.text(path)


# ----------------------------------------------------------------- blocks
# Two hex digits are a byte. ``{cut}`` turns a byte's place in the text into the place where the block starts.
_PLACED_SQL = f"""{ov.CORPUS}, placed as (
  select shard, x, n, cast(coalesce(sum(n) over (partition by shard
    order by batch_index, row_in_batch rows between unbounded preceding and 1 preceding), 0) as bigint) as o
  from (select *, hex(encode(text)) as x, octet_length(encode(text)) as n from corpus where text <> ''))"""


def _blocks_sql(cut: str) -> str:
    return f"""{_PLACED_SQL}, borders as (
  select *, greatest(k * {BLOCK} - o, 0) as lo, least((k + 1) * {BLOCK} - o, n) as hi
  from (select *, unnest(range(o // {BLOCK}, (o + n - 1) // {BLOCK} + 1)) as k from placed)),
pieces as (
  select shard, k as block_index, o, substr(x, cast(2 * a + 1 as bigint), cast(2 * (b - a) as bigint)) as h
  from (select *, {cut.format(at='lo')} as a, {cut.format(at='hi')} as b from borders)),
blocks as (
  select shard, block_index, string_agg(h, '' order by o) as content from pieces where h <> '' group by all)"""


def _tail(at: str) -> str:
    return f"substr(x, cast(2 * ({at}) + 1 as bigint), 1) in ('8', '9', 'A', 'B')"


_CHAR_START = (
    "case when {at} <= 0 or {at} >= n then {at} when not " + _tail("{at}") + " then {at} when not " + _tail("{at} - 1")
    + " then {at} - 1 when not " + _tail("{at} - 2") + " then {at} - 2 else {at} - 3 end"
)
_RAW_BLOCKS_SQL, _CHAR_BLOCKS_SQL = _blocks_sql("{at}"), _blocks_sql(_CHAR_START)
_BLOCK_TOKENS_SQL = f"""{_CHAR_BLOCKS_SQL}, tokenized as (
  select *, least(len(ids), capacity // 4) as kept
  from (select shard, block_index, n as block_len,
          case when n >= {BLOCK} then {BLOCK} else (n + 511) // 512 * 512 end as capacity, {ov.ids('t')} as ids
        from (select shard, block_index, length(content) // 2 as n, decode(unhex(content)) as t from blocks))),
output as (
  select *, rpad({ov.hex_u32('ids[1:kept]')}, cast(2 * capacity as int), '0') as output_hex from tokenized)"""


def char_blocks(spark, sf) -> DataFrame:
    """Blocks whose borders leave characters whole."""
    return blocks.cut_blocks(fx.corpus(spark, sf), block_bytes=BLOCK, boundary="char")


@query("cut_blocks", f"""with {_RAW_BLOCKS_SQL}
select shard, block_index, length(content) // 2 as block_len, md5(unhex(content)) as content_md5 from blocks""")
def cut_blocks(spark, sf):
    out = blocks.cut_blocks(fx.corpus(spark, sf), block_bytes=BLOCK)
    return out.select("shard", "block_index", "block_len", F.md5("content").alias("content_md5"))


@query("cut_blocks_char", f"""with {_CHAR_BLOCKS_SQL}
select shard, block_index, length(content) // 2 as block_len, md5(unhex(content)) as content_md5 from blocks""")
def cut_blocks_char(spark, sf):
    return char_blocks(spark, sf).select("shard", "block_index", "block_len", F.md5("content").alias("content_md5"))


@query("block_tokenize", f"""with {_BLOCK_TOKENS_SQL}
select shard, block_index, block_len, cast(capacity as bigint) as capacity, len(ids) as n_tokens,
  cast(kept as bigint) as kept, 0 as dropped, md5(output_hex) as output_md5,
  md5({ov.hex_u32('ids[kept + 1:len(ids)]')}) as overflow_md5 from output""")
def block_tokenize(spark, sf):
    out = blocks.block_tokenize(char_blocks(spark, sf), toy_model(), BLOCK)
    return out.select("shard", "block_index", "block_len", "capacity", "n_tokens", "kept", "dropped",
                      F.md5(F.hex("output")).alias("output_md5"), F.md5(F.hex("overflow")).alias("overflow_md5"))


@query("block_tokenize_all", f"""with {_BLOCK_TOKENS_SQL}
select shard, cast(sum(len(ids)) as bigint) as n_ids, cast(sum(kept) as bigint) as kept,
  cast(sum(list_sum(ids)) as bigint) as id_sum, cast(sum(len(ids) - kept) as bigint) as overflow from output group by shard""")
def block_tokenize_all(spark, sf):
    """Written and read back: the ids of both files of a shard are all ids of its blocks."""
    register_sources(spark)
    path = scratch_path(spark, "block-bins")
    out = materialize(blocks.block_tokenize(char_blocks(spark, sf), toy_model(), BLOCK), "blocks")
    tokens.write_block_bins(out, path, BLOCK)

    def read(suffix):
        ids = spark.read.format("token_bin").option("suffix", suffix).load(path)
        # a shard's number is cut from the path once per file, not once per token
        sums = ids.groupBy("path").agg(F.sum("token_id").alias("id_sum"), F.count(F.lit(1)).alias("ids"))
        name = F.element_at(F.split("path", "/"), -1)
        return sums.select(F.regexp_extract(name, r"^(\d+)", 1).cast("long").alias("shard"), "id_sum",
                           F.when(F.lit(suffix == ".overflow"), F.col("ids")).otherwise(0).alias("overflow"))

    # padding zeros add nothing to the sum; the ids themselves are counted from the table
    sums = read(".bin").union(read(".overflow")).groupBy("shard").agg(
        F.sum("id_sum").alias("id_sum"), F.sum("overflow").alias("overflow"))
    counts = out.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"), F.sum("kept").alias("kept"))
    return sums.join(counts, "shard").select("shard", "n_ids", "kept", "id_sum", "overflow")


@query("shard_identity", f"""with {ov.CORPUS}
select 99990 + 7 * shard as shard, printf('%05d.bin', 99990 + 7 * shard) as file,
  cast(sum({ov.LEN}) as bigint) as size_bytes, count(*) as rows from corpus group by shard""")
def shard_identity(spark, sf):
    """Shards numbered past 99,999 with gaps, written as Arrow and as positioned files, and read back."""
    register_sources(spark)
    shards, bins = scratch_path(spark, "shards"), scratch_path(spark, "bins")
    rows = fx.corpus(spark, sf).withColumn("shard", 99990 + 7 * F.col("shard"))
    ordered = rows.select("shard", "batch_index", "row_in_batch", "text").repartitionByRange(
        "shard", "batch_index").sortWithinPartitions(*corpus.ORDER)
    ordered.write.format("arrow_ipc").mode("append").options(total=999999, layout="parts").save(shards)
    back = spark.read.format("arrow_ipc").option("column", "text").load(shards)
    packed = back.select(*corpus.ORDER, F.coalesce(F.encode("text", "UTF-8"), F.lit(bytearray())).alias("packed"))
    write_positioned(tokens.placed_tokens(materialize(packed, "packed")), bins)
    sizes = tokens.token_files(spark, bins).select(_file_name(), "size_bytes")
    counts = back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("file", F.concat(scalars.shard_name(F.col("shard")), F.lit(".bin"))).join(sizes, "file")


# ------------------------------------------------------- files and round trips
@query("arrow_scan", f"""with {ov.BOUNDED}
select shard, batch_index, row_in_batch, text from bounded""")
def arrow_scan(spark, sf):
    register_sources(spark)
    path = scratch_path(spark, "arrow")
    rows = fx.bounded_shards(spark, sf).repartition("shard").sortWithinPartitions(*corpus.ORDER)
    rows.write.format("arrow_ipc").mode("append").option("total", 99999).save(path)
    return spark.read.format("arrow_ipc").option("column", "text").load(path)


@query("arrow_stream_scan", f"""with {ov.BOUNDED}
select shard, batch_index, row_in_batch, text from bounded""")
def arrow_stream_scan(spark, sf):
    """The shards as raw streams, indexed by their headers and read in ranges."""
    register_sources(spark)
    path, index = scratch_path(spark, "streams"), scratch_path(spark, "ranges")
    rows = fx.bounded_shards(spark, sf).repartition("shard").sortWithinPartitions(*corpus.ORDER)
    rows.write.format("arrow_ipc").mode("append").options(total=99999, container="stream").save(path)
    spark.read.format("arrow_stream_ranges").option("splitBytes", 4 << 20).load(path).write.parquet(index)
    return spark.read.format("arrow_ipc").options(column="text", ranges=index).load(path)


@query("byte_block_scan", f"""with {ov.CORPUS}, whole as (
  select string_agg(hex(encode(coalesce(text, '') || chr(10))), '' order by shard, batch_index, row_in_batch) as x from corpus),
cut as (
  select k, substr(x, k * {2 * BLOCK} + 1, {2 * BLOCK}) as h
  from (select x, unnest(range(0, (length(x) - 1) // {2 * BLOCK} + 1)) as k from whole))
select k as block_index, k * {BLOCK} as "offset", length(h) // 2 as length, md5(unhex(h)) as content_md5 from cut""")
def byte_block_scan(spark, sf):
    register_sources(spark)
    path = scratch_path(spark, "dump")
    placed = corpus.dump_rows(fx.corpus(spark, sf))
    write_positioned(placed.withColumn("file", F.lit("corpus.txt")), path, "file")
    scan = spark.read.format("byte_blocks").option("blockBytes", BLOCK).load(path)
    return scan.select("block_index", "offset", "length", F.md5("content").alias("content_md5"))


def _bins(spark, sf, layout: str = "parts") -> str:
    register_sources(spark)
    path = scratch_path(spark, "bins")
    rows = spread(fx.corpus(spark, sf), key="doc_id")
    tokens.write_token_bins(bpe.bpe_encode(rows, toy_model(), packed=True), path, layout=layout)
    return path


def _file_name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1).alias("file")


_SHARD_HEX = f"""{ov.ENCODED}, bins as (
  select shard, string_agg({ov.hex_u32('ids')}, '' order by batch_index, row_in_batch) as h
  from encoded group by shard)"""
_FILE_SQL = "printf('%05d.bin', shard)"


@query("token_bin_write", f"""with {_SHARD_HEX}
select {_FILE_SQL} as file, k as block_index, length(substr(h, k * 131072 + 1, 131072)) // 2 as length,
  md5(unhex(substr(h, k * 131072 + 1, 131072))) as content_md5
from (select shard, h, unnest(range(0, (length(h) - 1) // 131072 + 1)) as k from bins)""")
def token_bin_write(spark, sf):
    scan = spark.read.format("byte_blocks").option("blockBytes", 65536).load(_bins(spark, sf, "file"))
    return scan.select(_file_name(), "block_index", "length", F.md5("content").alias("content_md5"))


_TOKEN_ROWS = f"""{ov.ENCODED}, in_order as (
  select shard, ids, cast(coalesce(sum(len(ids)) over (partition by shard order by batch_index, row_in_batch
    rows between unbounded preceding and 1 preceding), 0) as bigint) as o from encoded),
tokens as (
  select {_FILE_SQL} as file, o + k - 1 as pos, ids[k] as token_id
  from (select shard, ids, o, unnest(range(1, len(ids) + 1)) as k from in_order))"""


@query("token_bin_scan", f"""with {_TOKEN_ROWS}
select file, pos // {CHUNK} as chunk, count(*) as n, cast(sum(token_id) as bigint) as id_sum,
  cast(sum(token_id * (pos % {CHUNK} + 1)) as bigint) as placed_sum from tokens group by all""")
def token_bin_scan(spark, sf):
    return _chunk_sums(spark.read.format("token_bin").load(_bins(spark, sf)))


def _chunk_sums(scan: DataFrame) -> DataFrame:
    """Sums per file and chunk; a file's name is cut from its path once per chunk, not once per token."""
    chunk = scalars.int_div(F.col("pos"), F.lit(CHUNK).cast("long"))
    sums = scan.groupBy("path", chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("id_sum"),
        F.sum(F.col("token_id") * (F.col("pos") % CHUNK + 1)).alias("placed_sum"))
    return sums.select(_file_name(), "chunk", "n", "id_sum", "placed_sum")


@query("stream_token_bins", ORACLES["token_bin_scan"])
def stream_token_bins(spark, sf):
    """The corpus arrives in three parts, each a run of its own that goes on from the checkpoint."""
    register_sources(spark)
    rows = fx.corpus(spark, sf).select(*corpus.ORDER, "text")
    last = rows.agg(F.max("batch_index")).first()[0]
    source, out, state = (scratch_path(spark, n) for n in ("texts", "stream-bins", "stream-bins-state"))
    for k in range(3):
        low, high = (last + 1) * k // 3, (last + 1) * (k + 1) // 3
        part = rows.where((F.col("batch_index") >= low) & (F.col("batch_index") < high))
        spread(part, fx.tasks(spark), "batch_index").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        streams.write_token_stream(stream, toy_model(), out, state).awaitTermination()
    return _chunk_sums(spark.read.format("token_bin").load(out))


@query("head_tail", f"""with {_TOKEN_ROWS}, sized as (
  select *, count(*) over (partition by file) as n from tokens)
select file, 'HEAD' as part, pos, token_id from sized where pos < 64
union all select file, 'TAIL', pos, token_id from sized where n > 64 and pos >= n - 64""")
def head_tail(spark, sf):
    return tokens.head_tail(spark, _bins(spark, sf), 64).select(_file_name(), "part", "pos", "token_id")


@query("token_file_summary", f"""with {_BLOCK_TOKENS_SQL}, per as (
  select shard, cast(sum(capacity) as bigint) as size_bytes,
    cast(sum(len(list_filter(ids[1:kept], lambda i: i <> 0))) as bigint) as nonzero,
    min(list_min(ids[1:kept])) as lo, max(list_max(ids[1:kept])) as hi,
    bool_or(kept * 4 < capacity) as padded from output group by shard)
select {_FILE_SQL} as file, size_bytes, size_bytes // 4 as tokens, nonzero,
  size_bytes // 4 - nonzero as zeros, round((size_bytes // 4 - nonzero) / (size_bytes // 4), 6) as zero_ratio,
  case when padded then 0 else lo end as min_id, hi as max_id from per""")
def token_file_summary(spark, sf):
    """Files of the block path: their zero padding counts as zeros."""
    register_sources(spark)
    path = scratch_path(spark, "block-bins")
    out = materialize(blocks.block_tokenize(char_blocks(spark, sf), toy_model(), BLOCK), "blocks")
    tokens.write_block_bins(out, path, BLOCK)
    summary = tokens.token_file_summary(spark, path)
    return summary.withColumn("zero_ratio", F.round("zero_ratio", 6)).select(
        _file_name(), *[c for c in summary.columns if c != "path"])


def _vocab_values() -> str:
    m = toy_model()
    rows = [(i, t) for t, i in {**m.added, **m.vocab}.items()]
    return ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in rows)


def _merge_values() -> str:
    return ", ".join(
        "({}, '{}')".format(r, (a + b).replace("'", "''")) for r, (a, b) in enumerate(toy_model().merges))


@query("bpe_model_load", f"""with {ov.ENCODED}, vocab(id, token) as (values {_vocab_values()}),
merges(rank, token) as (values {_merge_values()}),
uses as (select id, count(*) as n from (select unnest(ids) as id from encoded) group by id)
select cast(v.id as bigint) as id, v.token, cast(coalesce(m.rank, -1) as bigint) as merge_rank, coalesce(u.n, 0) as uses
from vocab v left join merges m on m.token = v.token left join uses u on u.id = v.id""")
def bpe_model_load(spark, sf):
    """A model's file as relations, with how often the corpus uses each entry; both notations of
    the merges are written and read, and only merges that both give take part."""
    folder = scratch_path(spark, "model")
    vocab, merges, added = model_relations(spark, write_model(spark, toy_model(), f"{folder}/lists"))
    _, again, _ = model_relations(spark, write_model(spark, toy_model(), f"{folder}/text", merges_as_lists=False))
    merges = merges.join(again, ["rank", "left", "right"])
    uses = encoded(spark, sf).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    made = merges.select(F.concat("left", "right").alias("token"), F.col("rank").alias("merge_rank"))
    return (
        vocab.unionByName(added).join(made, "token", "left").join(uses, "id", "left")
        .select("id", "token", F.coalesce("merge_rank", F.lit(-1)).alias("merge_rank"), F.coalesce("uses", F.lit(0)).alias("uses"))
    )


@query("vocab_lookup", f"""with {ov.CORPUS}, vocab(id, token) as (values {_vocab_values()}),
pieces as (
  select {_mapped_sql('w')} as token
  from (select unnest({ov.words('text')}) as w from corpus where text <> ''))
select cast(coalesce(v.id, -1) as bigint) as found_id, count(*) as pieces, cast(461 as bigint) as vocab_size
from pieces p left join vocab v on v.token = p.token group by all""")
def vocab_lookup_query(spark, sf):
    """Which whole pieces are tokens of their own (-1: none)."""
    rows = corpus.nonempty_rows(spread(fx.corpus(spark, sf), key="doc_id"))
    pieces = rows.select(F.explode(bytelevel.pretokenize(F.col("text"))).alias("w"))
    counted = pieces.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = vocab_lookup(counted.withColumn("token", bytelevel.byte_map(F.col("w"))), toy_model(), token="token")
    return found.groupBy("found_id", "vocab_size").agg(F.sum("n").alias("pieces"))


@query("vocab_lookup_ids", f"""with vocab(id, token) as (values {_vocab_values()})
select event_id, coalesce(v.token, '') as found_token
from events e left join vocab v on v.id = e.event_id % 600""")
def vocab_lookup_ids(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", (F.col("event_id") % 600).cast("int").alias("token_id"))
    return vocab_lookup(ev, toy_model(), id="token_id").select("event_id", "found_token")


# ------------------------------------------------------------------- ranges
def _ranges(spark, sf) -> DataFrame:
    idx = corpus.batch_range_index(fx.corpus(spark, sf))
    return idx.select("shard", "batch_index", F.col("data_offset").alias("start"), F.col("data_length").alias("length"))


@query("batch_range_index", f"with {ov.RANGES} select shard, batch_index, num_rows, data_offset, data_length from ranges")
def batch_range_index(spark, sf):
    return corpus.batch_range_index(fx.corpus(spark, sf))


def _pairs_sql(holes: bool) -> str:
    return f"""{ov.RANGES}, {ov.extents(holes)}, pairs as (
  select r.shard, batch_index, seq, greatest(data_offset, logical) as overlap_start,
    least(data_offset + data_length, logical + length) - greatest(data_offset, logical) as overlap_length,
    physical + greatest(data_offset, logical) - logical as phys
  from ranges r join extents e on r.shard = e.shard and logical + length > data_offset
    and logical < data_offset + data_length and data_length > 0),
placed as (
  select *, phys // 512 as slba, (phys + overlap_length + 511) // 512 - phys // 512 as nblocks from pairs)"""


@query("range_overlap", f"""with {_pairs_sql(True)}
select shard, batch_index, seq, overlap_start, overlap_length, slba, nblocks from placed""")
def range_overlap(spark, sf):
    pairs = ranges.overlap_join(_ranges(spark, sf), fx.extents(spark, sf), ["shard"])
    return pairs.select("shard", "batch_index", "seq", "overlap_start", "overlap_length", "slba", "nblocks")


@query("range_coverage", f"""with {_pairs_sql(True)}
select r.shard, r.batch_index, cast(coalesce(sum(overlap_length), 0) as bigint) as covered_bytes,
  coalesce(sum(overlap_length), 0) >= any_value(data_length) as covered
from ranges r left join placed p on p.shard = r.shard and p.batch_index = r.batch_index group by all""")
def range_coverage(spark, sf):
    r = _ranges(spark, sf)
    pairs = ranges.overlap_join(r, fx.extents(spark, sf), ["shard"])
    out = ranges.range_coverage(r, pairs, ["shard", "batch_index"])
    return out.select("shard", "batch_index", "covered_bytes", "covered")


@query("range_index_json", f"""with {_pairs_sql(False)}, ext as (
  select shard, batch_index, string_agg(slba || '+' || nblocks, ' ' order by overlap_start) as lba
  from placed group by all)
select printf('data-%05d-of-%05d.arrow', r.shard, 8) as arrow_path, 'text' as "column", r.batch_index,
  num_rows, data_offset as "offset", data_length as length, coalesce(lba, '') as lba_extents
from ranges r left join ext on ext.shard = r.shard and ext.batch_index = r.batch_index""")
def range_index_json(spark, sf):
    index = corpus.batch_range_index(fx.corpus(spark, sf))
    pairs = ranges.overlap_join(_ranges(spark, sf), fx.extents(spark, sf, holes=False), ["shard"])
    rows = ranges.range_index_rows(index, pairs, scalars.shard_name(F.col("shard"), 8)).drop("shard")
    path = scratch_path(spark, "range-index")
    rows.write.json(path)
    back = spark.read.schema(rows.schema).json(path)
    lba = F.transform("buffer.lba_extents", lambda x: F.concat_ws("+", x["slba"], x["nblocks"]))
    return back.select("arrow_path", "column", "buffer.batch_index", "buffer.num_rows",
                       "buffer.data_range.offset", "buffer.data_range.length",
                       F.array_join(lba, " ").alias("lba_extents"))


@query("split_segments", f"""with {ov.extents()}
select shard, seq, physical // 512 + k as slba, least((length + 511) // 512 - k, 16) as nblocks
from (select *, unnest(range(0, (length + 511) // 512, 16)) as k from extents)""")
def split_segments(spark, sf):
    return ranges.split_segments(fx.extents(spark, sf), 16, ["shard", "seq"])


@query("segment_align", f"""with {ov.extents()}, i as (
  select shard, physical // 512 as slba, (length + 511) // 512 as n,
    sum((length + 511) // 512) over (partition by shard order by seq) as fin from extents),
o as (
  select shard, seq * 1000 as slba, 41 + seq % 5 as n,
    sum(41 + seq % 5) over (partition by shard order by seq) as fin
  from (select doc_id % 8 as shard, doc_id // 8 as seq from documents))
select i.shard, cast(greatest(i.fin - i.n, o.fin - o.n) as bigint) as pos,
  cast(i.slba + greatest(i.fin - i.n, o.fin - o.n) - (i.fin - i.n) as bigint) as in_slba,
  cast(o.slba + greatest(i.fin - i.n, o.fin - o.n) - (o.fin - o.n) as bigint) as out_slba,
  cast(least(i.fin, o.fin) - greatest(i.fin - i.n, o.fin - o.n) as bigint) as nblocks
from i join o on i.shard = o.shard and i.fin > o.fin - o.n and o.fin > i.fin - i.n""")
def segment_align(spark, sf):
    ins = fx.extents(spark, sf).select(
        "shard", "seq", scalars.int_div(F.col("physical"), F.lit(512).cast("long")).alias("slba"),
        scalars.ceil_div(F.col("length"), F.lit(512).cast("long")).alias("nblocks"))
    outs = fx.table(spark, sf, "documents").selectExpr(
        "doc_id % 8 as shard", "doc_id div 8 as seq", "(doc_id div 8) * 1000 as slba",
        "41 + (doc_id div 8) % 5 as nblocks")
    return ranges.segment_align(ins, outs, ["shard"])


# -------------------------------------------------------------- id packing
_THREE = "[l_orderkey, l_partkey, cast(l_linenumber as bigint)]"
_LE = (
    "array_to_string(list_transform({x}, lambda i: printf('%02X%02X%02X%02X', i & 255, (i >> 8) & 255, "
    "(i >> 16) & 255, (i >> 24) & 255)), '')"
)


def _three() -> Column:
    return F.array(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long"))


@query("pack_u32", f"select l_orderkey, l_linenumber::bigint as l_linenumber, {_LE.format(x=_THREE)} as packed from lineitem")
def pack_u32(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.hex(bytelevel.pack_u32(_three())).alias("packed"))


@query("unpack_u32", f"""select l_orderkey, l_linenumber::bigint as l_linenumber,
  array_to_string({_THREE}, ' ') as ids from lineitem""")
def unpack_u32(spark, sf):
    """One to three trailing bytes are ignored."""
    tail = F.substring(F.lit(bytearray(b"\1\2\3")), 1, 3)
    packed = F.concat(bytelevel.pack_u32(_three()), F.substr(tail, F.lit(1), (F.col("l_linenumber") % 4).cast("int")))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(bytelevel.unpack_u32(packed), " ").alias("ids"))


@query("frame_u64_count", f"""select l_orderkey, l_linenumber::bigint as l_linenumber,
  '0300000000000000' || {_LE.format(x=_THREE)} as frame from lineitem""")
def frame_u64_count(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.hex(bytelevel.frame_u64_count(_three())).alias("frame"))

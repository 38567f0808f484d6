"""DuckDB twins of the fixtures, and the BPE of the toy model in plain SQL."""

from __future__ import annotations

from tokenloom.sources.model import ADDED_TOKENS, BORDER, PRIVATE_BASE, BpeModel, toy_model

CORPUS = """doc_count as (select count(*) as n from documents),
all_rows as (
  select doc_id, source, lang, text from documents
  union all
  select n + doc_id // 17, source, lang, null from documents, doc_count where doc_id % 17 = 3
  union all
  select n + (n + 13) // 17 + doc_id // 19, source, lang, '' from documents, doc_count where doc_id % 19 = 5),
corpus as (
  select doc_id, source, lang, doc_id % 8 as shard, (doc_id // 8) // 50 as batch_index,
    (doc_id // 8) % 50 as row_in_batch, text
  from all_rows)"""
BOUNDED = CORPUS + """, bounded as (
  select doc_id // 256 as shard, (doc_id % 256) // 50 as batch_index,
    (doc_id % 256) % 50 as row_in_batch, text, doc_id from corpus)"""
LEN = "coalesce(octet_length(encode(text)), 0)"


def requests(slots: int = 64) -> str:
    return f"""requests as (
  select event_id as req_id, epoch_us(ts) as ts_us, user_id % {slots} as slot,
    (event_id * 7919) % 131072 + 1 as total_len, user_id % 3 as run from events)"""


def responses(slots: int = 64) -> str:
    return f"""responses as (
  select event_id as req_id, epoch_us(ts) + latency_us as ts_us, user_id % {slots} as slot,
    ((event_id * 6007) % 32768) * 4 as byte_size, user_id % 3 as run, latency_us
  from (select *, case when event_id % 101 = 0 then 5000000
                       else (event_id * 104729) % 6000000 end as latency_us
        from events where event_id % 10 <> 0))"""


TRAFFIC = f"{requests()}, {responses()}"
SNAPSHOTS = TRAFFIC + """, per_tick as (
  select run, tick, sum(req) as req, sum(resp) as resp, sum(bi) as bytes_in, sum(bo) as bytes_out
  from (select run, ts_us // 3600000000 as tick, 1 as req, 0 as resp, total_len as bi, 0 as bo from requests
        union all
        select run, ts_us // 3600000000, 0, 1, 0, byte_size from responses) group by all),
snapshots as (
  select run, tick, cast(sum(req) over w as bigint) as req, cast(sum(resp) over w as bigint) as resp,
    cast(sum(bytes_in) over w as bigint) as bytes_in, cast(sum(bytes_out) over w as bigint) as bytes_out
  from per_tick window w as (partition by run order by tick))"""
def one_run(views: str) -> str:
    """The same views with all runs taken as one."""
    return views.replace("user_id % 3 as run", "0 as run")


SLOT_SNAPSHOTS_ONLY = """slot_snapshots as (
  select run, slot, tick, cast(sum(n) over (partition by run, slot order by tick) as bigint) as resp
  from (select run, slot, ts_us // 3600000000 as tick, count(*) as n from responses group by all))"""
SLOT_SNAPSHOTS = f"{TRAFFIC}, {SLOT_SNAPSHOTS_ONLY}"


def _host(name: str, key: str, cols: dict[str, str]) -> str:
    per = ", ".join(f"sum({e}) as {c}" for c, e in cols.items())
    cum = ", ".join(f"cast(sum({c}) over w as bigint) as {c}" for c in cols)
    k = key.split(" as ")[-1]
    return f"""{name} as (
  select 0 as run, {k}, tick, {cum}
  from (select {key}, epoch_us(ts) // 3600000000 as tick, {per} from events group by all)
  window w as (partition by {k} order by tick))"""


HOST_CPU = _host("host_cpu", "user_id % 6 as core", {
    "user_t": "event_id % 13", "system_t": "event_id % 5", "idle_t": "event_id % 17", "iowait_t": "event_id % 3"})
HOST_NET = _host("host_net", "'eth' || (user_id % 2) as iface", {
    "rx_bytes": "event_id % 1500 * 1000", "tx_bytes": "event_id % 900 * 1000",
    "rx_drop": "event_id % 2", "tx_drop": "event_id % 3"})
HOST_BLOCK = _host("host_block", "'nvme' || (user_id % 2) as dev", {
    "read_sectors": "event_id % 2048", "write_sectors": "event_id % 1024", "io_ticks_ms": "event_id % 900"})
STAGES = """stages as (
  select 'shard-worker-' || (l_suppkey % 12) as worker, 1 as shards,
    (l_orderkey * 31 + l_linenumber) % 5000 as tokens, (l_orderkey * 7) % 1000 as read_us,
    (l_partkey * 11) % 1000 as decode_us, (l_orderkey * 13) % 9000 as tokenize_us,
    (l_partkey * 17) % 500 as pack_us, (l_suppkey * 19) % 300 as write_us,
    l_linenumber % 50 as flush_us, l_linenumber % 70 as fsync_us, l_suppkey from lineitem)"""


def extents(holes: bool = True) -> str:
    keep = "where (doc_id // 8) % 23 <> 7" if holes else ""
    return f"""extents as (
  select doc_id % 8 as shard, doc_id // 8 as seq, (doc_id // 8) * 20000 as logical,
    ((doc_id * 7919) % 1009) * 20480 as physical, 20000 as length from documents {keep})"""


RANGES = CORPUS + f""", ranges as (
  select shard, batch_index, num_rows, data_length,
    cast(coalesce(sum(data_length) over (partition by shard order by batch_index
      rows between unbounded preceding and 1 preceding), 0) as bigint) as data_offset
  from (select shard, batch_index, count(*) as num_rows, cast(sum({LEN}) as bigint) as data_length
        from corpus group by all))"""
COMPLETIONS = """completions as (
  select event_id as user_data, case when event_id % 29 = 0 then -5 else 0 end as res,
    case when event_id % 4 = 0 then (event_id * 40503) % 65536 else 0 end as status_field,
    'out-' || (user_id % 5) || '.bin' as out_path, event_id % 256 + 1 as nblocks,
    epoch_us(ts) as start_us, epoch_us(ts) + (event_id * 31) % 5000 as end_us from events)"""


# ---------------------------------------------------------------- BPE in SQL
def words(text: str, marker: str = "chr(3)") -> str:
    """Pieces of a text. RE2 has no look-ahead: a mark goes before the last blank
    of each run of blanks that a non-blank follows."""
    marked = f"regexp_replace({text}, '(\\s+)(\\s)(\\S)', '\\1' || {marker} || '\\2\\3', 'g')"
    pattern = ("''(?:s|t|re|ve|m|ll|d)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x03]+|\\s+")
    return f"regexp_extract_all({marked}, '{pattern}')"


def words_added(text: str) -> str:
    """Pieces with the added tokens cut out first."""
    cut = text
    for token in ADDED_TOKENS:
        cut = f"replace({cut}, '{token}', chr(1) || '{token}' || chr(1))"
    names = ", ".join(f"'{t}'" for t in ADDED_TOKENS)
    return (
        f"flatten(list_transform(list_filter(string_split({cut}, chr(1)), lambda s: s <> ''), "
        f"lambda s: case when s in ({names}) then [s] else {words('s')} end))"
    )


def symbols(pieces: str, added: bool = False) -> str:
    byte = f"chr({PRIVATE_BASE + len(ADDED_TOKENS)} + ('0x' || h)::int)"
    mapped = f"array_to_string(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: {byte}), '')"
    if added:
        whens = " ".join(f"when '{t}' then chr({PRIVATE_BASE + i})" for t, i in ADDED_TOKENS.items())
        mapped = f"case w {whens} else {mapped} end"
    return f"array_to_string(list_transform({pieces}, lambda w: {mapped}), '{BORDER}')"


def merge_list(model: BpeModel) -> str:
    def ch(token: str) -> str:
        return chr(PRIVATE_BASE + model.vocab[token])

    return "[" + ", ".join(
        f"{{'p': '{ch(l)}{ch(r)}', 'r': '{ch(l + r)}'}}" for l, r in model.merges
    ) + "]"


def ids(text: str, added: bool = False) -> str:
    """List of ids of a non-null text."""
    start = symbols(words_added(text) if added else words(text), added)
    folded = (
        f"list_reduce({merge_list(toy_model())}, lambda a, y: "
        f"{{'p': '', 'r': replace(a.r, y.p, y.r)}}, {{'p': '', 'r': {start}}}).r"
    )
    chars = f"list_filter(string_split(replace({folded}, '{BORDER}', ''), ''), lambda z: z <> '')"
    return f"list_transform({chars}, lambda z: cast(unicode(z) - {PRIVATE_BASE} as bigint))"


def hex_u32(id_list: str) -> str:
    """Little-endian hex of ids below 65536."""
    return (
        f"array_to_string(list_transform({id_list}, lambda i: "
        f"printf('%02X%02X0000', i % 256, i // 256)), '')"
    )


ENCODED = CORPUS + f""", encoded as (
  select doc_id, source, shard, batch_index, row_in_batch, text, {ids('text')} as ids
  from corpus where text is not null and text <> '')"""

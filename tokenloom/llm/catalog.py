"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.chat import perspectives
from tokenloom.llm.common import LOWER, UPPER
from tokenloom.llm.conversation_repair import repair_report
from tokenloom.llm.cotraining import score_quality
from tokenloom.llm.decontaminate import decontaminate
from tokenloom.llm.html_text import extract
from tokenloom.llm.langid import identify
from tokenloom.llm.lm_scoring import lm_scores
from tokenloom.llm.packing import best_two_fit
from tokenloom.llm.quality_rules import quality_rules
from tokenloom.llm.ranked_search import ranked_search
from tokenloom.llm.repeats import repeat_report
from tokenloom.llm.simhash import near_duplicates
from tokenloom.llm.urls import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_best_two_fit")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit(table(spark, sf_dir, "documents"))


def _repeated(size: int) -> str:
    """Places of words that lie in a window of ``size`` words found twice in the text."""
    return f"""
    select distinct doc_id, i + unnest(range({size})) as i from (
        select doc_id, i, count(*) over (partition by doc_id, win) as n from (
            select doc_id, i, n_words, string_agg(word, ' ') over (
                partition by doc_id order by i rows between current row and {size - 1} following) as win
            from place) where i + {size} <= n_words) where n > 1"""


@query(
    "op6_suffix_array_rules",
    f"""
    with word as (
        select doc_id, coalesce(text, '') as text,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
        from documents),
    place as (
        select doc_id, len(w) as n_words, unnest(w) as word, unnest(range(len(w))) as i from word),
    triple as ({_repeated(3)}), six as ({_repeated(6)}), long as ({_repeated(41)}),
    line as (
        select doc_id, count(*) - count(distinct line) as dups from (
            select doc_id, unnest(string_split(text, chr(10))) as line from word)
        where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
    counted as (
        select doc_id, len(w) as n_words,
            length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
            coalesce(dups, 0) as n_dup_lines,
            coalesce(a.n, 0) as n_repeat_words, coalesce(b.n, 0) as covered_words, c.n is not null as too_long
        from word left join line using (doc_id)
        left join (select doc_id, count(*) as n from triple group by doc_id) a using (doc_id)
        left join (select doc_id, count(*) as n from six group by doc_id) b using (doc_id)
        left join (select doc_id, count(*) as n from long group by doc_id) c using (doc_id))
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
        n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
        covered_words::bigint as covered_words,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * covered_words <= 30 * n_words
            and not too_long as kept
    from counted""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query("op10_template_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op2_chat_perspectives",
    """
    with turn as (
        select conv_id, turn, coalesce(role, 'unknown') as role,
            replace(coalesce(text, ''), '<|im_', '<| im_') as body,
            row_number() over (partition by conv_id order by turn nulls last, role, md5(body)) - 1 as place
        from conversations),
    side as (
        select t.*, s.role as speaker, t.role = s.role as own, t.place // 64 as part,
            case when t.role = 'system' then '<|im_start|>system' when t.role = s.role then '<|im_start|>assistant'
                else '<|im_start|>user name=' || regexp_replace(t.role, '[\\r\\n<>|]', ' ', 'g') end || chr(10) as head
        from turn t join (select distinct conv_id, role from turn where role <> 'system') s using (conv_id)),
    placed as (
        select *, coalesce(sum(length(head) + length(body) + 11) over (
            partition by conv_id, speaker, part order by place rows between unbounded preceding and 1 preceding), 0)
            + length(head) as pos
        from side)
    select conv_id, speaker, part::bigint as part, count(*) as n_turns, count(*) filter (own) as n_trained,
        string_agg(head || body || '<|im_end|>' || chr(10), '' order by place) as text,
        coalesce(string_agg(pos::bigint || '-' || (pos + length(body) + 10)::bigint, ',' order by place)
            filter (own), '') as mask
    from placed group by conv_id, speaker, part""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


@query("op9_markov_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


@query("op3_ftrl_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op8_cotraining_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_columnwise_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


@query("op7_attention_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op11_best_position_search",
    f"""
    with doc as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') as t
        from documents),
    sized as (select doc_id, len(t) as n from doc where len(t) > 0),
    whole as (select count(*) as n_docs, coalesce(sum(n), 0)::bigint as n_terms from sized),
    posting as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from doc) group by all),
    asked as (
        select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) as term
        from benchmark),
    weighted as (
        select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1)))::bigint as w
        from (select term, count(*) as df from posting group by term), whole),
    scored as (
        select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))))::bigint as score
        from asked join weighted using (term) join posting using (term) join sized using (doc_id), whole
        group by item_id, doc_id)
    select item_id, rank::int as rank, doc_id, score from (
        select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
    where rank <= 50""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


# the given pages hold their text in one article of headings and paragraphs
@query(
    "op13_line_block_text",
    """
    with block as (
        select page_id, url, list_transform(
            string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>'),
            lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(
                regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)),
                '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) as b
        from pages),
    joined as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) as text from block)
    select page_id, url, text, length(text) as n_chars from joined""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

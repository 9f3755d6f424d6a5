"""Registered queries of the operators in this subpackage, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import (
    chat,
    language,
    lexical,
    mixing,
    neighbours,
    packing,
    repetition,
    sharding,
    simhash,
    syncmers,
    toxicity,
    warc,
    whitening,
)
from evenkeel.llm.common import id_rest, table
from evenkeel.session import pinned

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.placed(docs, "doc_id").select("doc_id", "slot", "shard")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.scored(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        (id_rest("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placement(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judged(repetition.measured(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(id_rest("doc_id", 3) != 1))
    return language.predicted(docs, model).select(
        "doc_id", (id_rest("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = pinned(simhash.fingerprinted(table(spark, sf_dir, "documents")))
    return simhash.near_duplicates(prints).select(
        "doc_id", simhash.hexed(F.col("simhash")).alias("fingerprint"), "component_id"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def records(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages``: per page a first response, for some a later one with another body, two revisits
    and an early one."""
    n = F.col("page_id")
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def at(hours) -> F.Column:
        return F.timestamp_add("HOUR", (hours + n % 97).cast("int"), begin)

    def headers(tag, date, extra) -> F.Column:
        pairs = F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), extra, F.lit("cache-control"),
            F.concat(F.lit("max-age="), (n % 60).cast("string")),
        )
        return F.map_filter(pairs, lambda k, v: v.isNotNull())

    tag = F.when(n % 5 != 0, F.concat(F.lit('"'), F.md5("html"), F.lit('"')))
    changed = F.concat(F.lit('"'), F.md5(F.concat("html", F.lit("2"))), F.lit('"'))
    date = F.when(n % 7 != 0, F.concat(F.lit("day "), (n % 30).cast("string")))
    none = F.lit(None).cast("string")
    html, response, revisit = F.lit("text/html"), F.lit("response"), F.lit("revisit")
    ok, gone, same = F.lit(200), F.lit(404), F.lit(304)
    first = [n * 8, at(F.lit(100)), response, F.when(n % 17 == 0, gone).otherwise(ok), headers(tag, date, html), F.col("html")]
    again = [n * 8 + 1, at(F.lit(400)), response, ok, headers(changed, none, html), F.concat("html", F.lit("2"))]
    soon = [n * 8 + 2, at(F.lit(200)), revisit, same, headers(tag, date, F.lit("text/plain")), none]
    late = [n * 8 + 3, at(F.lit(600)), revisit, same, headers(F.when(n % 2 == 0, tag).otherwise(changed), date, none), none]
    early = [n * 8 + 4, at(F.lit(0)), revisit, same, headers(tag, date, none), none]
    names = ["record_id", "ts", "kind", "status", "headers", "body"]

    def row(values: list) -> F.Column:
        return F.struct(*(v.alias(name) for name, v in zip(names, values, strict=True)))

    some = F.when(n % 3 == 0, F.array(*map(row, (first, again, soon, late, early)))).otherwise(
        F.array(*map(row, (first, soon, late, early)))
    )
    return pages.select("url", F.explode(some).alias("r")).select("url", "r.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolved(records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return got.select(
        "record_id",
        "page",
        "base_id",
        "outcome",
        F.array_join(lines, "\n").alias("headers"),
        F.md5("body").alias("body_md5"),
        F.length("body").cast("long").alias("body_chars"),
    )


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digest(own.unionByName(extra))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, "vec_id", "embedding", F.col("id") % 20 == 0, 20)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical.ranked(docs, items, 50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_syncmers": op9_syncmers,
    "op10_chat": op10_chat,
    "op11_neighbours": op11_neighbours,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
    "pipeline": pipeline,
}

# A repeat of n words is a window of n words that occurs twice; the union of such windows is the union of all longer
# repeats, and a repeat above 100 words is a window of 101 that occurs twice.
_OP4 = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d
), pos as (
  select rid, ws, unnest(range(1, len(ws) + 1)) as i from w
), windows as (
  select rid, i, n, case when i + n - 1 <= len(ws) then md5(array_to_string(ws[i:i + n - 1], ' ')) end as g
  from pos, (values (3), (20), (101)) as sizes(n)
), twice as (
  select rid, n, i from (select *, count(*) over (partition by rid, n, g) as c from windows where g is not null)
  where c > 1
), covered as (
  select rid, n, count(distinct i + k) as c from twice, lateral (select unnest(range(n)) as k) group by rid, n
), lines as (
  select rid, sum(c - 1) as dup from (
    select rid, line, count(*) as c from (select rid, unnest(string_split(text, chr(10))) as line from d)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid, line
  ) group by rid
), m as (
  select doc_id, len(ws) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(dup, 0) as n_dup_lines, coalesce(c3.c, 0) as n_repeat_words,
    coalesce(c20.c, 0) as covered, c101.c is not null as too_long
  from w
  left join lines using (rid)
  left join covered c3 on c3.rid = w.rid and c3.n = 3
  left join covered c20 on c20.rid = w.rid and c20.n = 20
  left join covered c101 on c101.rid = w.rid and c101.n = 101
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and covered <= 0.3 * n_words and not too_long as kept
from m
"""

_URL = r"regexp_replace(trim(url), '#.*$', '')"
_SITE = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_OP8 = rf"""
with p as (
  select page_id as n, url, html,
    case when page_id % 5 <> 0 then '"' || md5(html) || '"' end as tag,
    '"' || md5(html || '2') || '"' as changed,
    case when page_id % 7 <> 0 then 'day ' || (page_id % 30) end as day
  from pages
), r as (
  select n * 8 as record_id, url, n % 97 + 100 as ts, 'response' as kind,
    case when n % 17 = 0 then 404 else 200 end as status, tag, day, 'text/html' as type, n % 60 as age, html as body from p
  union all
  select n * 8 + 1, url, n % 97 + 400, 'response', 200, changed, null, 'text/html', n % 60, html || '2' from p where n % 3 = 0
  union all
  select n * 8 + 2, url, n % 97 + 200, 'revisit', 304, tag, day, 'text/plain', n % 60, null from p
  union all
  select n * 8 + 3, url, n % 97 + 600, 'revisit', 304, case when n % 2 = 0 then tag else changed end, day, null, n % 60, null
  from p
  union all
  select n * 8 + 4, url, n % 97, 'revisit', 304, tag, day, null, n % 60, null from p
), c as (
  select *, '//' || lower(regexp_extract({_URL}, '{_SITE}(?:[^/?@]*@)?([^/?:]*)', 1))
    || case when regexp_extract({_URL}, '{_SITE}(?:[^/?@]*@)?[^/?:]*:(\d+)', 1) in ('', '80', '443') then ''
       else ':' || regexp_extract({_URL}, '{_SITE}(?:[^/?@]*@)?[^/?:]*:(\d+)', 1) end
    || regexp_replace(regexp_extract({_URL}, '{_SITE}[^/?]*([^?]*)', 1), '/+$', '')
    || case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end as page
  from (
    select *, list_sort(list_filter(string_split(regexp_extract({_URL}, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and string_split(x, '=')[1] not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term',
        'utm_content', 'gclid', 'fbclid', 'ref'))) as q
    from r
  )
), seen as (
  select *, last_value(case when kind = 'response' and status = 200 then
      {{'id': record_id, 'tag': tag, 'day': day, 'type': type, 'age': age, 'body': body}} end ignore nulls)
    over (partition by page order by ts, record_id rows between unbounded preceding and 1 preceding) as base
  from c
), told as (
  select *, case when base is null then 'no_earlier_response'
    when tag is not null and base.tag is not null then
      case when tag = base.tag then 'resolved' else 'validator_differs' end
    when day is not null and base.day is not null then
      case when day = base.day then 'resolved' else 'validator_differs' end
    else 'no_validator' end as outcome
  from seen where kind = 'revisit'
)
select record_id, page, base.id as base_id, outcome,
  case when outcome = 'resolved' then concat_ws(chr(10),
    'cache-control: max-age=' || age, 'content-type: ' || base.type,
    'etag: ' || coalesce(tag, base.tag), 'last-modified: ' || coalesce(day, base.day)) end as headers,
  case when outcome = 'resolved' then md5(base.body) end as body_md5,
  case when outcome = 'resolved' then length(base.body) end as body_chars
from told
"""

_OP10 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f as (
  select *,
    7 + case role when 'user' then 15 when 'system' then 17 when 'assistant' then 0
      else 8 + 2 * octet_length(encode(role)) end as frame,
    regexp_matches(text, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|ROLE )') as guarded,
    length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|ROLE )', '\1\\\2\3', 'g')) as safe_chars
  from t
), c as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
    sum(frame + case when guarded then safe_chars else length(text) end) as formatted_chars
  from f group by conv_id
)
select conv_id, n_turns::bigint as n_turns, sha256(told) as turns_sha256, length(loss)::bigint as loss_chars,
  sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars
from c
"""

_OP11 = r"""
with v as (
  select distinct vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0 and vec_id is not null
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
)
select query_id, place::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
where place <= 20
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP13 = rf"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') as ts from documents
), sizes as (
  select rid, doc_id, len(ts)::bigint as n from d where len(ts) > 0
), total as (
  select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes
), tf as (
  select rid, term, count(*)::bigint as tf from (select rid, unnest(ts) as term from d) group by rid, term
), w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, total group by term, n_docs
), asked as (
  select distinct item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) as term from benchmark
), scored as (
  select item_id, rid, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))))::bigint as score
  from asked join w using (term) join tf using (term) join sizes using (rid), total group by item_id, rid, doc_id
)
select item_id, place::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0
) where place <= 50
"""

ORACLES: dict[str, str] = {
    "op4_quality_rules": _OP4,
    "op8_warc": _OP8,
    "op10_chat": _OP10,
    "op11_neighbours": _OP11,
    "op13_lexical": _OP13,
}

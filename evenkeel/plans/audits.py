"""Registered text audits and their SQL twins.

DuckDB's patterns have no look-ahead and no back-references, so the twins state
those rules in another way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import planaudit, queryaudit, submissions
from evenkeel.plans.fixtures import RELATIONS, relation, with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_KEYWORDS = _listed(queryaudit.DANGEROUS)
_ANY = "|".join(queryaudit.DANGEROUS)
AUDITED = f"""
    a as (select id, trim(sql_text, ' ' || chr(9) || chr(10) || chr(13)) as q from qlog),
    b as (select *, upper(q) as u,
                 regexp_replace(regexp_replace(upper(q), '^/\\*(.|\\n)*?\\*/', ''), '^--.*\\n', '') as bare,
                 regexp_replace(regexp_replace(q, '''[^'']*''', '', 'g'), '"[^"]*"', '', 'g') as plain from a),
    c as (select *, case when q = '' then 'INVALID' when starts_with(bare, 'SELECT') then 'SELECT'
                         when starts_with(bare, 'WITH') then 'WITH'
                         else coalesce(nullif(regexp_extract(bare, '^(\\w+)', 1), ''), 'INVALID') end as query_type
          from b),
    d as (select *, case when q = '' then ['{queryaudit.EMPTY}'] else list_concat(
            case when query_type in ('SELECT', 'WITH') then [] else ['{queryaudit.BAD_START}' || query_type] end,
            list_transform(list_filter({_KEYWORDS}, lambda k: regexp_matches(u, '\\b' || k || '\\b')),
                           lambda k: 'Dangerous keyword ''' || k || ''' detected'),
            case when regexp_matches(u, '(?s)\\bSELECT\\b.*\\bINTO\\b') then ['{queryaudit.SELECT_INTO}'] else [] end,
            case when length(plain) - length(replace(plain, ';', '')) > 1
                 then ['{queryaudit.MULTI_STATEMENT}'] else [] end,
            case when len(list_filter(list_concat(regexp_extract_all(u, '(?s)/\\*.*?\\*/'),
                                                  regexp_extract_all(u, '--[^\\n]*')),
                                      lambda t: regexp_matches(t, '{_ANY}'))) > 0
                 then ['{queryaudit.HIDDEN_IN_COMMENT}'] else [] end,
            case when len(list_filter(string_split(u, 'UNION')[2:], lambda t: regexp_matches(t, '\\b({_ANY})\\b'))) > 0
                 then ['{queryaudit.UNION_INJECTION}'] else [] end) end as found
          from c)"""


@query(
    "query_audit",
    f"""{with_("qlog")}, {AUDITED}
    select id, query_type, array_to_string(found, '|') as violations, len(found) = 0 as is_safe,
           case when len(found) = 0 then regexp_replace(q, ';+$', '') end as sanitized_query from d""",
)
def query_audit(spark, sf_dir):
    rows = queryaudit.audit_queries(relation(spark, sf_dir, "qlog"))
    return rows.drop("sql_text").withColumn("violations", F.array_join("violations", "|"))


_COUNTERS = """select count(*) as total_checks, {blocked} as blocked_checks,
    (count(*) - {blocked}) / count(*) * 100 as success_rate"""


@query(
    "query_audit_stats",
    f"""{with_("qlog")}, {AUDITED}
    {_COUNTERS.format(blocked="count(*) filter (where len(found) > 0 and q <> '')")} from d""",
)
def query_audit_stats(spark, sf_dir):
    return queryaudit.query_stats(queryaudit.audit_queries(relation(spark, sf_dir, "qlog")))


def _number(*patterns: str) -> str:
    tries = ", ".join(f"nullif(regexp_extract(plan, '{p}', 1), '')" for p in patterns)
    return f"coalesce(cast(coalesce({tries}) as double), 0)"


def _rows_text(words: tuple[str, str]) -> str:
    return f"case when r > 1000000 then ['{words[0]}' || format('{{:,}}', cast(r as bigint)) || '{words[1]}'] else [] end"


def _hint(condition: str, text: str) -> str:
    return f"case when {condition} then ['{text}'] else [] end"


_p = planaudit
PLANS = f"""
    o as (select *, {_number('[|]\\s*(\\d+)\\s*\\(\\d+%?\\)', '(?i)Cost\\s*[:=]\\s*(\\d+)')} as raw,
                 {_number('[|]\\s*(\\d+)\\s*[|]\\s*\\d+\\s*\\(', '(?i)Cardinality\\s*[:=]\\s*(\\d+)',
                          '(?i)Rows\\s*[:=]\\s*(\\d+)')} as r,
                 contains(plan, 'CARTESIAN') as cart, contains(plan, 'TABLE ACCESS FULL') as scan
          from plog where engine = 'oracle'),
    o2 as (select id, r, case when cart then raw * 10 else raw end as cost, scan,
                  list_concat({_hint('scan', _p.FULL_SCAN)}, {_hint('cart', _p.CARTESIAN)},
                              {_rows_text(_p.HIGH_ROWS)}) as advice from o),
    o3 as (select id, case when r > 1000000 then cost / 1000 * (r / 1000000) else cost / 1000 end as sec,
                  r, cost, scan, advice from o2),
    m as (select *, regexp_extract_all(plan, '(?i)rows[:\\s]+(\\d+)', 1) as ns, contains(plan, 'ALL') as scan,
                 contains(plan, 'Using filesort') as srt, contains(plan, 'Using temporary') as tmp
          from plog where engine = 'mysql'),
    m2 as (select id, coalesce(list_product(list_transform(ns, lambda n: cast(n as double))), 0) as r,
                  (case when srt then 1000.0 else 0.0 end + case when tmp then 500.0 else 0.0 end)::double as cost, scan,
                  list_concat({_hint('scan', _p.FULL_SCAN)}, {_hint('srt', _p.FILESORT)}, {_hint('tmp', _p.TEMPORARY)},
                              {_hint("scan and contains(plan, 'NULL')", _p.NO_INDEX)}) as advice from m),
    m3 as (select id, r / 1000000 + cost / 1000 as sec, r, cost, scan, advice from m2),
    g as (select *, {_number('(?i)Total Cost["\\s:]+([0-9.]+)', '(?i)cost["\\s:=]+[0-9.]+\\.\\.([0-9.]+)')} as cost,
                 {_number('(?i)Plan Rows["\\s:]+(\\d+)', '(?i)rows["\\s:=]+(\\d+)')} as r,
                 contains(plan, 'Seq Scan') as scan
          from plog where engine = 'postgresql'),
    g3 as (select id, case when r > 1000000 then cost / 10000 * ((r / 1000000) * 0.5::double) else cost / 10000 end
                        as sec, r, cost, scan,
                  list_concat({_hint('scan', _p.SEQ_SCAN)},
                              {_hint("contains(plan, 'Nested Loop') and r > 10000", _p.NESTED_LOOP)},
                              {_hint("contains(plan, 'Sort')", _p.SORT)},
                              {_rows_text(_p.HIGH_ROWS_LIMIT)}) as advice from g),
    z as (select * from o3 union all select * from m3 union all select * from g3)"""


@query(
    "plan_audit",
    f"""{with_("plog")}, {PLANS}
    select id, sec as estimated_time_sec, r as estimated_rows, cost as estimated_cost,
           scan as has_full_table_scan, array_to_string(advice, '|') as recommendations,
           case when sec > 300 then 'excessive' when sec > 180 then 'high' when sec > 60 then 'medium' else 'low' end
             as cost_level, sec <= 300 as is_acceptable
    from z""",
)
def plan_audit(spark, sf_dir):
    rows = planaudit.audit_plans(relation(spark, sf_dir, "plog")).drop("engine", "plan")
    return rows.withColumn("recommendations", F.array_join("recommendations", "|"))


@query(
    "plan_audit_stats",
    f"""{with_("plog")}, {PLANS} {_COUNTERS.format(blocked="count(*) filter (where sec > 300)")} from z""",
)
def plan_audit_stats(spark, sf_dir):
    return queryaudit.plan_stats(planaudit.audit_plans(relation(spark, sf_dir, "plog")))


# A run of more than 20 equal characters that are not line breaks, on texts short
# enough to pass the length rules.
_REPEATED = """(length(low) <= 5201 and len(list_filter(range(1, length(low) - 19), lambda i:
    substr(low, i, 1) = substr(low, i + 20, 1) and substr(low, i, 1) <> chr(10)
    and substr(low, i, 21) = repeat(substr(low, i, 1), 21))) > 0)"""
_LINKS = "len(regexp_extract_all(low, 'https?://'))"
_OWN_LINKS = "len(regexp_extract_all(low, 'https?://github\\.com'))"
VALID = f"""
    t as (select *, title || ' ' || description as raw, lower(title || ' ' || description) as low from notes),
    v as (select *, case
            when length(title) > 200 then 'title too long' when length(title) < 5 then 'title too short'
            when length(description) > 5000 then 'description too long'
            when length(description) < 10 then 'description too short'
            when {_REPEATED} then 'repeated characters'
            when {_LINKS} > {_OWN_LINKS} then 'external links'
            when regexp_matches(low, '(^|[^\\pL\\pN_])(buy|sell|click here|subscribe|download now)([^\\pL\\pN_]|$)')
              then 'promotional content'
            when regexp_matches(raw, '[A-Z]{{50,}}') then 'excessive caps' end as invalid_reason
          from t)"""


@query("content_validation", f"{with_('notes')}, {VALID} select id, invalid_reason from v")
def content_validation(spark, sf_dir):
    return submissions.validate(relation(spark, sf_dir, "notes")).select("id", "invalid_reason")


def _count_in(words) -> str:
    return f"len(list_filter({_listed(words)}, lambda w: contains(low, w)))"


def _absent(elements) -> str:
    tests = [
        f"case when {' or '.join(f'contains(low, {w!r})' for w in e.split())} then [] else ['{e}'] end" for e in elements
    ]
    return f"list_concat({', '.join(tests)})"


QUALITY = f"""
    q1 as (select *, {_count_in(submissions.VAGUE_WORDS)} as vague, length(description) < 50 as short,
                  case issue_type {" ".join(f"when '{k}' then {_absent(e)}" for k, e in submissions.REQUIRED.items())}
                       else [] end as missing,
                  regexp_matches(description, '(^|[^\\pL\\pN_])[a-z][a-z\\s]{{30,}}[.!?]') as uncap,
                  not contains(description, '.') and length(description) > 50 as unbroken,
                  {_count_in(submissions.STRUCTURE_WORDS)} > 0 as structured,
                  regexp_matches(description, '1\\.|2\\.|step 1|step 2|\\n-|\\n\\*') as steps,
                  {_count_in(submissions.EXAMPLE_WORDS)} > 0 as examples
           from t),
    q2 as (select *, cast(greatest(0, least(10,
             7 - case when vague > 3 then 2 * least(vague, 3) else 0 end - case when short then 3 else 0 end
               - case when len(missing) > 0 then 3 else 0 end - case when uncap then 1 else 0 end
               - case when unbroken then 1 else 0 end + case when structured then 2 else 0 end
               + case when steps then 2 else 0 end + case when examples then 2 else 0 end)) as double) as quality_score
           from q1)"""
_TEXTS = "t as (select *, title || ' ' || description as raw, lower(title || ' ' || description) as low from notes)"


@query(
    "quality_score",
    f"""{with_("notes")}, {_TEXTS}, {QUALITY}
    select id, quality_score,
           case when quality_score >= 7 then 'low' when quality_score >= 4 then 'medium' else 'high' end as severity,
           quality_score < 7 as needs_improvement, case when vague > 3 then vague else 0 end as vague_word_count,
           array_to_string(list_concat(
             case when vague > 3 then ['Contains ' || cast(vague as varchar) || ' vague words (something, maybe, etc.)']
                  else [] end,
             {_hint("short", submissions.SHORT[0])},
             case when len(missing) > 0 then ['Missing key information: ' || array_to_string(missing, ', ')] else [] end,
             {_hint("uncap", submissions.UNCAPITALISED[0])}, {_hint("unbroken", submissions.NO_BREAKS[0])}), '|')
             as issues_found
    from q2""",
)
def quality_score(spark, sf_dir):
    rows = submissions.quality(relation(spark, sf_dir, "notes"))
    found = F.array_join("issues_found", "|").alias("issues_found")
    return rows.select("id", "quality_score", "severity", "needs_improvement", "vague_word_count", found)


def _whole(words) -> str:
    return f"len(list_intersect(regexp_extract_all(low, '[\\pL\\pN_]+'), {_listed(words)}))"


RELEVANT = f"""
    r0 as (select id, {_whole(submissions.TOPIC_WORDS)} as n_on, regexp_extract_all(low, '[\\pL\\pN_]+') as ws from t),
    r1 as (select id, n_on, list_filter({_listed(submissions.OFFTOPIC_WORDS)}, lambda w: list_contains(ws, w)) as off,
                  len(off) as n_off from r0),
    r2 as (select id, case when n_off > 0 then 'offtopic' when n_on >= 2 then 'relevant' when n_on = 1 then 'unclear'
                           else 'irrelevant' end as category,
                  cast(case when n_off > 0 then 0.9 when n_on >= 2 then 0.8 when n_on = 1 then 0.6 else 0.9 end
                       as double) as confidence,
                  case when n_off > 0 then '{submissions.OFFTOPIC_REASON}' || array_to_string(off, ', ')
                       else '{submissions.TOPIC_REASON}' || n_on end as relevance_reason from r1)"""


@query("relevance_class", f"{with_('notes')}, {_TEXTS}, {RELEVANT} select id, category, confidence, relevance_reason from r2")
def relevance_class(spark, sf_dir):
    return submissions.relevance(relation(spark, sf_dir, "notes")).select("id", "category", "confidence", "relevance_reason")


@query(
    "issue_labels",
    f"""{with_("notes")}, {_TEXTS}, {QUALITY}
    select id, issue_type || '|user-submitted' || case when quality_score >= 7 then '|good-quality'
           when quality_score < 4 then '|needs-clarification' else '' end as labels from q2""",
)
def issue_labels(spark, sf_dir):
    rows = submissions.quality(relation(spark, sf_dir, "notes"))
    tags = submissions.labels(F.col("issue_type"), F.col("quality_score"))
    return rows.select("id", F.array_join(tags, "|").alias("labels"))


# One row at a time in order of time; the list holds what was accepted.
_ACCEPTED = """len(list_filter(held, lambda a: a.{who} = x.{who}_id and a.t > x.created_at - interval '{span}')) >= {most}"""
_FULL = " or ".join(
    _ACCEPTED.format(who=who, span=span, most=most)
    for who, span, most in (
        ("session", "1 hour", 8), ("session", "24 hours", 60), ("client", "1 hour", 14), ("client", "24 hours", 100)
    )
)


@query(
    "submission_funnel",
    f"""with recursive notes as ({RELATIONS["renotes"]}), {VALID}, {QUALITY}, {RELEVANT},
    x0 as materialized (select row_number() over (order by v.created_at, v.id) as n, v.id, v.session_id, v.client_id, v.created_at,
                  md5(v.low) as copy, quality_score < 7 as poor,
                  case when invalid_reason is not null then 'content' when category <> 'relevant' then 'relevance' end
                    as stop
           from v join q2 using (id) join r2 using (id)),
    walk as (
      select 0::bigint as n, null::varchar as stage,
             []::struct(session varchar, client varchar, copy varchar, t timestamp)[] as held
      union all
      select n, stage, case when stage = 'accepted' then list_append(
                 list_filter(held, lambda a: a.t > created_at - interval '24 hours'),
                 {{'session': session_id, 'client': client_id, 'copy': copy, 't': created_at}}) else held end
      from (select x.n, x.session_id, x.client_id, x.copy, x.created_at, held,
                   case when {_FULL} then 'rate' when stop is not null then stop
                        when len(list_filter(held, lambda a: a.session = x.session_id and a.copy = x.copy
                                 and a.t > x.created_at - interval '30 minutes')) > 0 then 'duplicate'
                        when poor then 'quality' else 'accepted' end as stage
            from walk join x0 x on x.n = walk.n + 1) step)
    select stage, count(*) as submissions from walk where n > 0 group by stage""",
)
def submission_funnel(spark, sf_dir):
    limits = {"session": (8, 60), "client": (14, 100)}
    return submissions.funnel(submissions.stages(relation(spark, sf_dir, "renotes"), limits=limits, min_score=7.0))

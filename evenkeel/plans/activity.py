"""Registered submission-log queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import clock, text
from evenkeel.operators import activity, replay, searchindex
from evenkeel.plans.fixtures import latest, relation, relations, with_
from evenkeel.session import workspace
from evenkeel.sources.snapshots import PERIOD, SnapshotTable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_HOUR = "range between interval '59 minutes 59.999999 seconds' preceding and current row"
_DAY = "range between interval '23 hours 59 minutes 59.999999 seconds' preceding and current row"
_AS_OF = "hi as (select max(created_at) as as_of from subm)"


def _narrow(spark, sf_dir, *more: str):
    """The submissions without their texts: running aggregates write all columns they are given."""
    return relation(spark, sf_dir, "subm").select("id", "session_id", "created_at", *more)


@query(
    "trailing_counts",
    f"""{with_("subm")}, c as (
    select id,
           count(*) over (partition by session_id order by created_at {_HOUR}) as session_1h,
           count(*) over (partition by session_id order by created_at {_DAY}) as session_24h,
           count(*) over (partition by client_id order by created_at {_HOUR}) as client_1h,
           count(*) over (partition by client_id order by created_at {_DAY}) as client_24h
    from subm)
    select *, session_1h > 1 as over_session_1h, session_24h > 4 as over_session_24h,
           client_1h > 3 as over_client_1h, client_24h > 40 as over_client_24h from c""",
)
def trailing_counts(spark, sf_dir):
    rows = activity.rate_limits(_narrow(spark, sf_dir, "client_id"), session_limits=(1, 4), client_limits=(3, 40))
    counts = ["session_1h", "session_24h", "client_1h", "client_24h"]
    return rows.select("id", *counts, *[f"over_{c}" for c in counts])


@query(
    "rate_limit_wait",
    f"""{with_("subm")}, o as (
    select id, created_at, min(created_at) over (partition by session_id order by created_at {_HOUR}) as oldest
    from subm)
    select id, oldest,
           60 - cast(floor((epoch_us(created_at) - epoch_us(oldest)) / 60000000) as bigint) as wait_minutes from o""",
)
def rate_limit_wait(spark, sf_dir):
    return activity.wait_minutes(_narrow(spark, sf_dir)).select("id", "oldest", "wait_minutes")


@query(
    "duplicate_within_gap",
    f"""{with_("subm")}, p as (
    select id, session_id, created_at,
           lag(created_at) over (partition by session_id, submission_type order by created_at, id) as previous
    from subm)
    select id, previous, coalesce(created_at - previous < interval 30 minutes, false) as is_duplicate from p""",
)
def duplicate_within_gap(spark, sf_dir):
    rows = activity.duplicates_within(_narrow(spark, sf_dir, "submission_type"), keys=["session_id", "submission_type"])
    return rows.select("id", "previous", "is_duplicate")


@query(
    "duplicate_content",
    f"""{with_("subm")}, p as (
    select id, created_at, lag(created_at) over (partition by session_id, content_hash order by created_at, id)
             as previous from subm)
    select id, previous, coalesce(created_at - previous < interval 30 minutes, false) as is_duplicate from p""",
)
def duplicate_content(spark, sf_dir):
    rows = activity.duplicates_within(_narrow(spark, sf_dir, "content_hash"))
    return rows.select("id", "previous", "is_duplicate")


LIMITS = replay.Limits(spans=(("hour", clock.HOUR, 1), ("day", clock.DAY, 2)))
BLOCKING = replay.Limits(spans=(("hour", 6 * clock.HOUR, 2), ("day", clock.DAY, 3)), block_at=2, block_span=clock.DAY)


def replay_sql(key: str, decision: str, keep: str = "true", block: str = "null::bigint") -> str:
    """A recursive walk over each key's rows that carries the admitted times."""
    return f"""{with_("subm").replace("with ", "with recursive ", 1)},
    o as (select id, {key} as key, created_at, epoch_us(created_at) as us,
                 row_number() over (partition by {key} order by created_at, id) as n from subm),
    f as (
      select id, key, created_at, n, 'admitted' as decision, [us] as times, {block.format(times="[us]", at="us")} as until
      from o where n = 1
      union all
      select id, key, created_at, n, decision,
             case when decision = 'admitted' then list_append(times, us) else times end,
             case when decision = 'admitted'
                  then coalesce({block.format(times="list_append(times, us)", at="us")}, until) else until end
      from (select o.id, o.key, o.created_at, o.n, o.us, f.times, f.until, {decision} as decision
            from f join o on o.key = f.key and o.n = f.n + 1))
    select id, key as session_id, created_at, decision from f where {keep}"""


def _within(hours: float, times: str = "f.times", at: str = "o.us") -> str:
    return f"len(list_filter({times}, lambda x: x > {at} - {int(hours * clock.HOUR)}))"


@query(
    "admission_replay",
    replay_sql(
        "session_id",
        f"case when {_within(1)} >= 1 then 'hour' when {_within(24)} >= 2 then 'day' else 'admitted' end",
    ),
)
def admission_replay(spark, sf_dir):
    return replay.replay(relation(spark, sf_dir, "subm"), ["session_id"], "created_at", "id", LIMITS)


@query(
    "admission_replay_blocks",
    replay_sql(
        "session_id",
        f"""case when o.us < coalesce(f.until, 0) then 'blocked' when {_within(6)} >= 2 then 'hour'
                 when {_within(24)} >= 3 then 'day' else 'admitted' end""",
        block=f"case when {_within(6, '{times}', '{at}')} >= 2 then {{at}} + {clock.DAY} end",
    ),
)
def admission_replay_blocks(spark, sf_dir):
    return replay.replay(relation(spark, sf_dir, "subm"), ["session_id"], "created_at", "id", BLOCKING)


@query(
    "duplicate_replay",
    replay_sql(
        "session_id || ':' || submission_type",
        f"case when {_within(12)} >= 1 then 'duplicate' else 'admitted' end",
    ).replace("key as session_id", "key as copy"),
)
def duplicate_replay(spark, sf_dir):
    once = replay.Limits(spans=(("duplicate", 12 * clock.HOUR, 1),))
    copies = relation(spark, sf_dir, "subm").withColumn(
        "copy", text.composite_id(F.col("session_id"), F.col("submission_type"))
    )
    return replay.replay(copies, ["copy"], "created_at", "id", once)


@query(
    "blocked_submissions",
    f"""{with_("subm", "blocks")}, b as (
      select s.id, s.created_at, max(b.unblock_at) as blocked_until
      from subm s join blocks b on b.identifier = s.session_id and b.identifier_type = 'session'
       and s.created_at >= b.blocked_at and s.created_at < b.unblock_at
      group by s.id, s.created_at)
    select id, blocked_until,
           cast(floor((epoch_us(blocked_until) - epoch_us(created_at)) / 3600000000) as bigint) as hours_left from b""",
)
def blocked_submissions(spark, sf_dir):
    rows = activity.with_block(_narrow(spark, sf_dir), relation(spark, sf_dir, "blocks"))
    return rows.where(F.col("blocked_until").isNotNull()).select("id", "blocked_until", "hours_left")


@query(
    "blocks_upsert",
    f"""{with_("blocks")}, n as (
      select *, row_number() over (partition by identifier order by blocked_at desc, unblock_at desc) as rn from blocks)
    select identifier, identifier_type, blocked_at, unblock_at, reason from n where rn = 1""",
)
def blocks_upsert(spark, sf_dir):
    blocks = relation(spark, sf_dir, "blocks")
    middle = blocks.select(F.expr("timestampadd(HOUR, 360, min(blocked_at))")).scalar()
    before, after = blocks.where(F.col("blocked_at") < middle), blocks.where(F.col("blocked_at") >= middle)
    table = SnapshotTable(spark, workspace(spark) + "/blocks", keys=["identifier"])
    for rows in (before, after):
        table.upsert(rows, "blocked_at", ["blocked_at", "unblock_at", "reason"])
    return table.read().drop(PERIOD)


@query(
    "active_blocks",
    f"""{with_("subm", "blocks")}, {_AS_OF}, n as (
      select *, row_number() over (partition by identifier order by blocked_at desc) as rn from blocks)
    select identifier, blocked_at, unblock_at,
           cast(round(cast((epoch_us(unblock_at) - epoch_us(as_of)) / 3600000000.0 as decimal(24,8)), 1) as double)
             as hours_remaining
    from n, hi where rn = 1 and unblock_at > as_of""",
)
def active_blocks(spark, sf_dir):
    subm, blocks = relations(spark, sf_dir, "subm", "blocks")
    rows = activity.active_blocks(activity.latest_blocks(blocks), latest(subm))
    return rows.select("identifier", "blocked_at", "unblock_at", "hours_remaining")


_MEAN = "cast(round(cast(avg(quality_score) as decimal(24,8)), 1) as double)"
_DAY_COUNT = "count(*) filter (where created_at > as_of - interval 24 hours) as last_24h"
_HOUR_COUNT = "count(*) filter (where created_at > as_of - interval 1 hour) as last_hour"


@query(
    "dashboard_summary",
    f"""{with_("subm")}, {_AS_OF}
    select count(*) as total_submissions, {_DAY_COUNT}, {_HOUR_COUNT},
           count(distinct session_id) as unique_sessions, count(distinct client_id) as unique_clients,
           {_MEAN} as avg_quality_score,
           count(*) filter (where submission_type = 'bug') as bug_count,
           count(*) filter (where submission_type = 'feature') as feature_count,
           count(*) filter (where submission_type = 'improvement') as improvement_count,
           count(*) filter (where status = 'created') as successfully_created,
           count(*) filter (where status = 'failed') as failed_submissions,
           count(*) filter (where status = 'submitted') as pending_submissions
    from subm, hi""",
)
def dashboard_summary(spark, sf_dir):
    subm = relation(spark, sf_dir, "subm")
    return activity.dashboard(subm, latest(subm))


@query(
    "client_report",
    f"""{with_("subm")}, {_AS_OF}
    select client_id, count(*) as total_submissions, {_DAY_COUNT}, {_HOUR_COUNT}, {_MEAN} as avg_quality,
           count(distinct session_id) as unique_sessions, min(created_at) as first_submission,
           max(created_at) as last_submission
    from subm, hi group by client_id""",
)
def client_report(spark, sf_dir):
    subm = relation(spark, sf_dir, "subm")
    return activity.client_report(subm, latest(subm))


@query(
    "issue_summary",
    f"""{with_("subm")}, c as (
    select count(issue_number) as total_created,
           count(issue_number) filter (where submission_type = 'bug') as bugs,
           count(issue_number) filter (where submission_type = 'feature') as features,
           count(issue_number) filter (where submission_type = 'improvement') as improvements,
           count(*) filter (where status = 'failed') as failed,
           count(*) filter (where status = 'submitted') as pending from subm)
    select *, round(100.0 * total_created / (total_created + failed), 1) as success_rate from c""",
)
def issue_summary(spark, sf_dir):
    return activity.issue_summary(relation(spark, sf_dir, "subm"))


@query(
    "top_contributors",
    f"""{with_("subm")}, {_AS_OF}
    select client_id, count(*) as submission_count, {_MEAN} as avg_quality, max(created_at) as last_submission
    from subm, hi where created_at > as_of - interval 30 days
    group by client_id order by submission_count desc, client_id limit 10""",
)
def top_contributors(spark, sf_dir):
    subm = relation(spark, sf_dir, "subm")
    return activity.top_contributors(subm, latest(subm))


@query(
    "quota_stats",
    f"""{with_("subm", "blocks")}, {_AS_OF}, u as (
      select session_id as identifier,
             count(*) filter (where created_at > as_of - interval 24 hours) as used_today,
             count(*) filter (where created_at > as_of - interval 1 hour) as used_this_hour
      from subm, hi group by session_id)
    select identifier, used_today, used_this_hour, greatest(0, 10 - used_today) as remaining_today,
           greatest(0, 3 - used_this_hour) as remaining_this_hour,
           exists (select 1 from blocks b, hi where b.identifier = u.identifier and unblock_at > as_of) as is_blocked
    from u""",
)
def quota_stats(spark, sf_dir):
    subm, blocks = relations(spark, sf_dir, "subm", "blocks")
    return activity.quota_stats(subm, blocks, latest(subm))


_NEWEST = "order by created_at desc, id desc limit 20"
_LABEL = "'#' || cast(issue_number as varchar)"


@query(
    "recent_submissions",
    f"""{with_("subm")}
    select id, substr(session_id, 1, 16) || '...' as session_label, client_id, submission_type, title,
           case when length(substr(description, 1, 200)) >= 200 then substr(description, 1, 200) || '...'
                else substr(description, 1, 200) end as description_preview,
           quality_score, {_LABEL} as issue, status, created_at
    from subm where status = 'created' and submission_type = 'bug' {_NEWEST}""",
)
def recent_submissions(spark, sf_dir):
    return activity.recent_submissions(relation(spark, sf_dir, "subm"), status="created", submission_type="bug")


@query(
    "recent_issues",
    f"""{with_("subm")}
    select id, submission_type, title, coalesce({_LABEL}, 'N/A') as issue, quality_score, status, created_at
    from subm where status in ('created', 'failed') {_NEWEST}""",
)
def recent_issues(spark, sf_dir):
    return activity.recent_issues(relation(spark, sf_dir, "subm"))


@query(
    "recent_by_client",
    f"""{with_("subm")}
    select id, session_id, submission_type, title, quality_score, cast(issue_number as varchar) as issue_number,
           status, created_at from subm where client_id = '3' {_NEWEST}""",
)
def recent_by_client(spark, sf_dir):
    rows = activity.recent_by_client(relation(spark, sf_dir, "subm"), "3")
    return rows.withColumn("issue_number", F.col("issue_number").cast("string"))


@query(
    "search_submissions",
    f"""{with_("notes")}
    select id, issue_type, title from notes
    where contains(lower(concat_ws(' ', title, description)), 'query')
      and contains(lower(concat_ws(' ', title, description)), 'slow') and issue_type = 'bug'
    order by created_at desc, id desc limit 10""",
)
def search_submissions(spark, sf_dir):
    notes = relation(spark, sf_dir, "notes")
    order = [F.desc("created_at"), F.desc("id")]
    return activity.search(notes, "query slow", order, issue_type="bug").select("id", "issue_type", "title")


@query("indexed_search", ORACLES["search_submissions"])
def indexed_search(spark, sf_dir):
    """The same search through an index by terms and recency."""
    notes = relation(spark, sf_dir, "notes").select("id", "issue_type", "title", "description", "created_at")
    path = searchindex.build(notes, workspace(spark) + "/index", ["title", "description"], "created_at", block=64, folders=16)
    return searchindex.Index(spark, path).search("query slow", issue_type="bug").select("id", "issue_type", "title")


@query(
    "client_fingerprint",
    """select event_id,
       coalesce(nullif(substr(case when event_id % 3 = 0 then props else '' end, 1, 64), ''),
                nullif(substr(case when event_id % 5 = 0 then event_type end, 1, 64), ''),
                'fp_' || substr(sha256(cast(user_id as varchar) || ':' || event_type), 1, 32)) as fingerprint
       from events""",
)
def client_fingerprint(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    header = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("")
    connection = F.when(F.col("event_id") % 5 == 0, F.col("event_type"))
    mark = text.client_fingerprint(header, connection, F.col("user_id").cast("string"), F.col("event_type"))
    return events.select("event_id", mark.alias("fingerprint"))


@query(
    "scalar_surface",
    """select event_id, coalesce(nullif(event_type, 'click'), 'none') as not_click,
       case when value > 10 then 'high' else 'low' end as band, cast(user_id as varchar) as user_text,
       upper(trim('  ' || event_type || ' ')) as shouted, length(props) as n_props,
       md5(lower(event_type || ' ' || props)) as content_hash,
       'c' || cast(user_id % 10 as varchar) || ':' || cast(user_id as varchar) as identifier,
       'c' || cast(user_id % 10 as varchar) as client_part, cast(user_id as varchar) as session_part,
       case when length(props) > 7 then substr(props, 1, 7) || '...' else props end as preview,
       regexp_matches(props, '"k": [0-9]*7') as has_seven, regexp_extract(props, '([0-9]+)', 1) as k,
       len(regexp_extract_all(props, '[0-9]')) as n_digits,
       least(10, greatest(0, round(value, 0))) as clamped,
       case when user_id > 0 then value / user_id else 0 end as ratio,
       epoch_us(ts) // 1000 - epoch_us(timestamp '2024-01-01') // 1000 as since_ms,
       ts - interval 90 minutes as earlier, strftime(ts, '%Y-%m-%d') as day, date_trunc('hour', ts) as hour,
       len([event_type, 'x']) as n_items, event_type = 'view' as is_view
       from events""",
)
def scalar_surface(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, kind, props = F.col("user_id"), F.col("event_type"), F.col("props")
    client = F.concat(F.lit("c"), (user % 10).cast("string"))
    identifier = text.composite_id(client, user.cast("string"))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return events.select(
        "event_id",
        F.coalesce(F.nullif(kind, F.lit("click")), F.lit("none")).alias("not_click"),
        F.when(F.col("value") > 10, "high").otherwise("low").alias("band"),
        user.cast("string").alias("user_text"),
        F.upper(F.trim(F.concat(F.lit("  "), kind, F.lit(" ")))).alias("shouted"),
        F.length(props).cast("long").alias("n_props"),
        text.content_hash(kind, props).alias("content_hash"),
        identifier.alias("identifier"),
        text.client_of(identifier).alias("client_part"),
        text.session_of(identifier).alias("session_part"),
        text.preview(props, 7).alias("preview"),
        props.rlike('"k": [0-9]*7').alias("has_seven"),
        F.regexp_extract(props, "([0-9]+)", 1).alias("k"),
        F.regexp_count(props, F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.round("value", 0))).alias("clamped"),
        F.when(user > 0, F.col("value") / user).otherwise(0.0).alias("ratio"),
        F.floor(F.timestamp_diff("MICROSECOND", start, F.col("ts")) / 1000).cast("long").alias("since_ms"),
        (F.col("ts") - F.expr("interval 90 minutes")).alias("earlier"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.cardinality(F.array(kind, F.lit("x"))).cast("long").alias("n_items"),
        F.array_contains(F.array(kind), "view").alias("is_view"),
    )

"""Registered run-history queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import history
from evenkeel.plans.fixtures import latest, relation, relations, with_
from evenkeel.session import pinned, workspace
from evenkeel.sources.snapshots import SnapshotTable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_AS_OF = "hi as (select max(created_at) as as_of from {})"


@query(
    "session_state",
    f"""{with_("status_events")}
    select session_id, arg_max(status, event_ts) as status, min(event_ts) as created_at,
           min(event_ts) filter (where status = 'running') as started_at,
           max(event_ts) filter (where status in ('completed', 'failed')) as completed_at,
           cast((epoch_us(max(event_ts) filter (where status in ('completed', 'failed')))
                 - epoch_us(min(event_ts) filter (where status = 'running'))) // 1000 as varchar) as execution_time_ms
    from status_events group by session_id""",
)
def session_state(spark, sf_dir):
    rows = history.session_state(relation(spark, sf_dir, "status_events"))
    return rows.withColumn("execution_time_ms", F.col("execution_time_ms").cast("string"))


@query(
    "active_sessions",
    f"""{with_("sess")} select session_id, client_id, status, created_at from sess
    where status in ('pending', 'running') and client_id = '7' order by created_at desc, session_id""",
)
def active_sessions(spark, sf_dir):
    rows = history.active_sessions(relation(spark, sf_dir, "sess"), client_id="7")
    return rows.select("session_id", "client_id", "status", "created_at")


@query(
    "recent_completions",
    f"""{with_("sess")} select session_id, status, completed_at from sess
    where status in ('completed', 'failed') order by completed_at desc, session_id limit 50""",
)
def recent_completions(spark, sf_dir):
    return history.recent_completions(relation(spark, sf_dir, "sess")).select("session_id", "status", "completed_at")


@query(
    "audit_join",
    f"""{with_("sess", "files")}
    select distinct s.client_id, f.file_path, f.downloaded_at
    from files f join sess s on f.session_id = s.session_id
    where f.file_path like '%customer%' and f.downloaded_at >= timestamp '1998-01-01'""",
)
def audit_join(spark, sf_dir):
    since = F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    return history.file_audit(*relations(spark, sf_dir, "sess", "files"), "%customer%", since)


@query(
    "retention_counts",
    f"""{with_("sess", "files")}, {_AS_OF.format("sess")},
    gone as (select session_id from sess, hi where status = 'completed' and completed_at < as_of - interval 30 days)
    select (select count(*) from gone) as deleted_sessions,
           (select count(*) from files where session_id in (select session_id from gone)) as deleted_files""",
)
def retention_counts(spark, sf_dir):
    sess, files = relations(spark, sf_dir, "sess", "files")
    return history.retention_counts(sess, files, latest(sess))


@query(
    "retained_rows",
    f"""{with_("sess", "files")}, {_AS_OF.format("sess")},
    gone as (select session_id from sess, hi where status = 'completed' and completed_at < as_of - interval 30 days)
    select 'sessions' as table_name, count(*) as n_rows from sess
    where session_id not in (select session_id from gone)
    union all
    select 'files', count(*) from files where session_id not in (select session_id from gone)""",
)
def retained_rows(spark, sf_dir):
    """Sessions and files in a store with snapshots, by month, after its retention: counted from what is read back."""
    sess, files = relations(spark, sf_dir, "sess", "files")
    gone = pinned(history.expired_sessions(sess, latest(sess)))
    root, counts = workspace(spark), []
    for name, rows, ts in (("files", files, "downloaded_at"), ("sessions", sess, "created_at")):
        table = SnapshotTable(spark, f"{root}/{name}", grain="month")
        table.append(rows, ts)
        table.remove(gone, "session_id")
        counts.append(table.read().agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(name)))
    return counts[0].unionByName(counts[1])


@query(
    "session_summary",
    f"""{with_("sess", "files")}, r as (
      select session_id, count(*) filter (where file_role = 'source') as source_files,
             count(*) filter (where file_role = 'target') as target_files,
             cast(coalesce(sum(row_count) filter (where file_role = 'source'), 0) as bigint) as source_rows,
             cast(coalesce(sum(row_count) filter (where file_role = 'target'), 0) as bigint) as target_rows,
             max(file_path) filter (where file_role = 'source') as source_file,
             max(file_path) filter (where file_role = 'target') as target_file
      from files group by session_id),
    j as (select s.session_id, s.status, s.match_score, coalesce(source_files, 0) as source_files,
                 coalesce(target_files, 0) as target_files, coalesce(source_rows, 0) as source_rows,
                 coalesce(target_rows, 0) as target_rows, source_file, target_file
          from sess s left join r on s.session_id = r.session_id)
    select *, case when status in ('completed', 'failed') then status
                   when source_files > 0 and target_files > 0 then 'comparing'
                   when source_files > 0 then 'awaiting target' else 'awaiting source' end as current_step from j""",
)
def session_summary(spark, sf_dir):
    sess, files = relations(spark, sf_dir, "sess", "files")
    results = sess.select("session_id", "match_score", F.col("completed_at").alias("created_at"))
    rows = history.session_summary(sess, files, results)
    counts = ["source_files", "target_files", "source_rows", "target_rows"]
    return rows.select("session_id", "status", "match_score", *counts, "source_file", "target_file", "current_step")


def _report(by_day: bool) -> str:
    day = "cast(created_at as date) as run_date," if by_day else ""
    key, group = ("run_date,", "group by run_date") if by_day else ("", "")
    inner = "run_date, client_id" if by_day else "client_id"
    return f"""{with_("sess")}, {_AS_OF.format("sess")},
    r as (select {day} client_id, match_score from sess, hi where created_at >= as_of - interval 7 days),
    c as (select {inner}, count(*) as n, count(*) filter (where match_score >= 95) as p,
                 count(*) filter (where match_score < 80) as f, sum(cast(match_score as decimal(12,4))) as s
          from r group by {inner})
    select {key} cast(sum(n) as bigint) as runs, cast(sum(p) as bigint) as passed, cast(sum(f) as bigint) as failed,
           cast(round(cast(sum(s) / sum(n) as decimal(24,8)), 2) as double) as mean_score,
           first(client_id order by n desc, client_id desc) as most_active_client, max(n) as most_active_runs
    from c {group}"""


@query("run_report_7d", _report(by_day=False))
def run_report_7d(spark, sf_dir):
    sess = relation(spark, sf_dir, "sess")
    return history.run_report(sess, latest(sess))


@query("run_trend_7d", _report(by_day=True))
def run_trend_7d(spark, sf_dir):
    sess = relation(spark, sf_dir, "sess")
    return history.run_report(sess, latest(sess), by_day=True)


def _mean(column: str) -> str:
    return f"cast(round(cast(avg({column}) as decimal(24,8)), 2) as double)"


@query(
    "run_performance_30d",
    f"""{with_("runs")}, {_AS_OF.format("runs")}
    select {_mean("comparison_time_sec")} as avg_time_sec, {_mean("total_rows")} as avg_rows,
           {_mean("size_mb")} as avg_size_mb, count(*) as total_runs
    from runs, hi where created_at >= as_of - interval 30 days""",
)
def run_performance_30d(spark, sf_dir):
    runs = relation(spark, sf_dir, "runs")
    return history.run_performance(runs, latest(runs))


@query(
    "usage_by_client",
    f"""{with_("calls")} select client_id, tool_name, count(*) as calls, max(created_at) as last_used
    from calls group by client_id, tool_name""",
)
def usage_by_client(spark, sf_dir):
    return history.usage(relation(spark, sf_dir, "calls"), "client_id", "tool_name")


@query(
    "audit_json",
    f"""{with_("calls")} select id, session_id, client_id, tool_name, success, created_at,
    '{{"user_id":' || cast(user_id as varchar) || ',"event_type":"' || event_type || '"}}' as request_metadata
    from calls""",
)
def audit_json(spark, sf_dir):
    return history.audit_entries(relation(spark, sf_dir, "calls"), ["user_id", "event_type"])

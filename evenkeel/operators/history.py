"""Run history: session state, retention, trends and usage over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import clock, scores

PASS_SCORE = 95.0
FAIL_SCORE = 80.0


def session_state(events: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Current status per session and how long it ran, from its status events."""
    started = F.min(F.when(F.col("status") == "running", F.col(ts)))
    finished = F.max(F.when(F.col("status").isin("completed", "failed"), F.col(ts)))
    grouped = events.groupBy("session_id").agg(
        F.max_by("status", F.struct(ts, "status")).alias("status"),
        F.min(ts).alias("created_at"),
        started.alias("started_at"),
        finished.alias("completed_at"),
    )
    ran = F.floor(F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1000)
    return grouped.withColumn("execution_time_ms", ran.cast("long"))


def active_sessions(
    state: DataFrame, client_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Sessions not yet finished, newest first."""
    rows = state.where(F.col("status").isin("pending", "running"))
    if client_id is not None:
        rows = rows.where(F.col("client_id") == client_id)
    rows = rows.orderBy(F.desc("created_at"), "session_id")
    return rows if limit is None else rows.limit(limit)


def recent_completions(state: DataFrame, limit: int = 50) -> DataFrame:
    """The sessions that finished last."""
    done = state.where(F.col("status").isin("completed", "failed"))
    return done.orderBy(F.desc("completed_at"), "session_id").limit(limit)


def file_audit(sessions: DataFrame, files: DataFrame, like: str, since: Column) -> DataFrame:
    """Who fetched files whose path matches ``like`` since a date, once each.

    Equal file rows are folded before the join, so a session with very many
    files joins few rows.
    """
    fetched = (
        files.where(F.col("file_path").like(like) & (F.col("downloaded_at") >= since))
        .select("session_id", "file_path", "downloaded_at")
        .distinct()
    )
    return (
        fetched.join(sessions.select("session_id", "client_id"), "session_id")
        .select("client_id", "file_path", "downloaded_at")
        .distinct()
    )


def expired_sessions(sessions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Ids of sessions that completed more than ``days`` before ``as_of``."""
    age = F.timestamp_diff("MICROSECOND", F.col("completed_at"), as_of)
    return sessions.where((F.col("status") == "completed") & (age > days * clock.DAY)).select("session_id")


def retained(sessions: DataFrame, files: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Sessions and files that stay after removing expired sessions and their files."""
    gone = expired_sessions(sessions, as_of, days)
    return sessions.join(gone, "session_id", "left_anti"), files.join(gone, "session_id", "left_anti")


def retention_counts(sessions: DataFrame, files: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """How many sessions and files the retention rule removes.

    Files are counted per session before they meet the expired ids.
    """
    gone = expired_sessions(sessions, as_of, days)
    per_session = files.groupBy("session_id").agg(F.count("*").alias("n_files"))
    return gone.join(per_session, "session_id", "left").agg(
        F.count("*").alias("deleted_sessions"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("deleted_files"),
    )


def session_summary(sessions: DataFrame, files: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Each session with its files by role, its result and the step it is at.

    Files collapse to one row per session before the join.
    """

    def of(role: str, value: str) -> Column:
        return F.when(F.col("file_role") == role, F.col(value))

    by_role = files.groupBy("session_id").agg(
        *[F.count_if(F.col("file_role") == role).alias(f"{role}_files") for role in ("source", "target")],
        *[F.coalesce(F.sum(of(role, "row_count")), F.lit(0)).alias(f"{role}_rows") for role in ("source", "target")],
        *[F.max(of(role, "file_path")).alias(f"{role}_file") for role in ("source", "target")],
    )
    rows = sessions.join(by_role, "session_id", "left")
    if results is not None:
        newest = results.groupBy("session_id").agg(
            F.max_by("match_score", F.struct("created_at", "match_score")).alias("match_score")
        )
        rows = rows.drop("match_score").join(newest, "session_id", "left")
    counts = {f"{r}_{n}": F.coalesce(F.col(f"{r}_{n}"), F.lit(0)) for r in ("source", "target") for n in ("files", "rows")}
    step = (
        F.when(F.col("status").isin("completed", "failed"), F.col("status"))
        .when((F.col("source_files") > 0) & (F.col("target_files") > 0), "comparing")
        .when(F.col("source_files") > 0, "awaiting target")
        .otherwise("awaiting source")
    )
    return rows.withColumns(counts).withColumn("current_step", step)


def _recent(ts: str, as_of: Column, days: int) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(ts), as_of) <= days * clock.DAY


def run_report(
    runs: DataFrame, as_of: Column, days: int = 7, by_day: bool = False, ts: str = "created_at"
) -> DataFrame:
    """Runs, passes, failures, mean score and the most active client of recent days.

    Counts are taken per (day, client) first; the report folds those few rows.
    """
    day = F.to_date(ts).alias("run_date")
    score = F.col("match_score").cast("decimal(12,4)")
    parts = (
        runs.where(_recent(ts, as_of, days))
        .groupBy(*([day] if by_day else []), "client_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("match_score") >= PASS_SCORE).alias("p"),
            F.count_if(F.col("match_score") < FAIL_SCORE).alias("f"),
            F.sum(score).alias("s"),
        )
    )
    mean = F.round((F.sum("s") / F.sum("n")).cast("decimal(24,8)"), 2).cast("double")
    busiest = F.struct(F.col("n"), F.col("client_id"))
    folded = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("runs"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("failed"),
        mean.alias("mean_score"),
        F.max_by("client_id", busiest).alias("most_active_client"),
        F.max("n").alias("most_active_runs"),
    ]
    return parts.groupBy("run_date").agg(*folded) if by_day else parts.agg(*folded)


def run_performance(runs: DataFrame, as_of: Column, days: int = 30, ts: str = "created_at") -> DataFrame:
    """Mean time, rows and size of recent comparisons."""
    return runs.where(_recent(ts, as_of, days)).agg(
        scores.rounded_mean(F.col("comparison_time_sec"), 2).alias("avg_time_sec"),
        scores.rounded_mean(F.col("total_rows"), 2).alias("avg_rows"),
        scores.rounded_mean(F.col("size_mb"), 2).alias("avg_size_mb"),
        F.count("*").alias("total_runs"),
    )


def usage(audit: DataFrame, *by: str, ts: str = "created_at") -> DataFrame:
    """Calls and last use per client, tool or whatever ``by`` names."""
    return audit.groupBy(*(by or ("client_id",))).agg(
        F.count("*").alias("calls"), F.max(ts).alias("last_used")
    )


def audit_entries(calls: DataFrame, metadata: list[str]) -> DataFrame:
    """Audit rows whose request details are folded into one JSON column."""
    rest = [c for c in calls.columns if c not in metadata]
    return calls.select(*rest, F.to_json(F.struct(*metadata)).alias("request_metadata"))

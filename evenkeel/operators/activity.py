"""Per-key limits, duplicates, blocks and dashboards over a submission log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import clock, scores, text
from evenkeel.operators.normalize import where_equal
from evenkeel.operators.running import Fold, running

# Submissions a session or a client may make, and the other limits.
SESSION_PER_HOUR = 3
SESSION_PER_DAY = 10
CLIENT_PER_HOUR = 20
CLIENT_PER_DAY = 50
DUPLICATE_MINUTES = 30
BLOCK_HOURS = 24


def _timeline(df: DataFrame, key: str, ts: str, spans: Mapping[str, int]) -> DataFrame:
    """Events as +1 and, one span later, as -1 of that span.

    The running sum at a time t is then the number of events in (t-span, t].
    """
    at = clock.micros(df, ts)
    own = F.struct(*df.columns)
    none = F.when(F.lit(False), own)

    def mark(time: Column, row: Column, steps: Sequence[Column]) -> Column:
        cells = [s.cast("long").alias(f"_d_{n}") for n, s in zip(spans, steps)]
        return F.struct(time.alias("_at"), *cells, row.alias("_own"))

    marks = [mark(at, own, [F.lit(1)] * len(spans))]
    for i, width in enumerate(spans.values()):
        marks.append(mark(at + width, none, [F.lit(-1 if i == j else 0) for j in range(len(spans))]))
    return df.select(F.col(key).alias("_key"), F.explode(F.array(*marks)).alias("m")).select("_key", "m.*")


def trailing_counts(df: DataFrame, key: str, ts: str, spans: Mapping[str, int]) -> DataFrame:
    """Add, per named span, the number of rows of the key in (t-span, t].

    A sliding frame would be re-summed for every row; this is one running sum,
    cut into parts so that no key is tied to one task.
    """
    marks = _timeline(df, key, ts, spans)
    folds = {n: Fold("sum", f"_d_{n}") for n in spans}
    counted = running(marks, ["_key"], "_at", folds)
    return counted.where(F.col("_own").isNotNull()).select("_own.*", *spans)


def oldest_in_span(df: DataFrame, key: str, ts: str, width: int, name: str = "oldest") -> DataFrame:
    """Add the time of the oldest row of the key in (t-width, t].

    Seen from the future backwards: among the rows that expire after t, the first.
    """
    at = clock.micros(df, ts)
    own = F.struct(*df.columns)
    none = F.when(F.lit(False), own)
    marks = F.array(
        F.struct((-(at + 1)).alias("_at"), F.lit(None).cast("long").alias("_seen"), own.alias("_own")),
        F.struct((-(at + width)).alias("_at"), at.alias("_seen"), none.alias("_own")),
    )
    rows = df.select(F.col(key).alias("_key"), F.explode(marks).alias("m")).select("_key", "m.*")
    found = running(rows, ["_key"], "_at", {"_oldest": Fold("min", "_seen")})
    oldest = clock.from_micros(df, ts, F.col("_oldest")).alias(name)
    return found.where(F.col("_own").isNotNull()).select("_own.*", oldest)


def rate_limits(
    df: DataFrame,
    ts: str = "created_at",
    session: str = "session_id",
    client: str = "client_id",
    session_limits: tuple[int, int] = (SESSION_PER_HOUR, SESSION_PER_DAY),
    client_limits: tuple[int, int] = (CLIENT_PER_HOUR, CLIENT_PER_DAY),
) -> DataFrame:
    """Trailing counts per session and client with a flag per exceeded limit."""
    spans = {"session_1h": clock.HOUR, "session_24h": clock.DAY}
    counted = trailing_counts(df, session, ts, spans)
    spans = {"client_1h": clock.HOUR, "client_24h": clock.DAY}
    counted = trailing_counts(counted, client, ts, spans)
    limits = {
        "session_1h": session_limits[0],
        "session_24h": session_limits[1],
        "client_1h": client_limits[0],
        "client_24h": client_limits[1],
    }
    return counted.withColumns({f"over_{n}": F.col(n) > limit for n, limit in limits.items()})


def wait_minutes(df: DataFrame, key: str = "session_id", ts: str = "created_at") -> DataFrame:
    """Add the oldest row in the trailing hour and the minutes until it leaves."""
    found = oldest_in_span(df, key, ts, clock.HOUR)
    gone = F.timestamp_diff("MICROSECOND", F.col("oldest"), F.col(ts))
    return found.withColumn("wait_minutes", F.lit(60) - F.floor(gone / clock.MINUTE).cast("long"))


def since_previous(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str = "previous"
) -> DataFrame:
    """Add the time of the previous row with the same ``keys``."""
    rows = df.withColumn("_at", clock.micros(df, ts))
    seen = running(rows, keys, "_at", {"_previous": Fold("max", "_at")}, after=[tie])
    return seen.select(*df.columns, clock.from_micros(df, ts, F.col("_previous")).alias(name))


def duplicates_within(
    df: DataFrame,
    keys: Sequence[str] = ("session_id", "content_hash"),
    ts: str = "created_at",
    tie: str = "id",
    minutes: int = DUPLICATE_MINUTES,
) -> DataFrame:
    """Flag rows whose previous identical row is less than ``minutes`` old."""
    found = since_previous(df, keys, ts, tie)
    gap = F.timestamp_diff("MICROSECOND", F.col("previous"), F.col(ts))
    close = F.coalesce(gap < minutes * clock.MINUTE, F.lit(False))
    return found.withColumn("is_duplicate", close).withColumn(
        "minutes_since", F.floor(gap / clock.MINUTE).cast("long")
    )


def with_block(
    df: DataFrame,
    blocks: DataFrame,
    key: str = "session_id",
    ts: str = "created_at",
    identifier_type: str = "session",
) -> DataFrame:
    """Add ``blocked_until`` (NULL when free) and ``hours_left``.

    A row is blocked when a block that began at or before it ends after it, that
    is when the latest end among the begun blocks lies ahead. Blocks and rows go
    through one running maximum, so no pairs of rows and blocks are formed.
    """
    active = blocks.where(F.col("identifier_type") == identifier_type)
    begun = active.select(
        F.col("identifier").alias("_key"),
        clock.micros(active, "blocked_at").alias("_at"),
        clock.micros(active, "unblock_at").alias("_end"),
    )
    rows = df.select(F.col(key).alias("_key"), clock.micros(df, ts).alias("_at"), F.struct(*df.columns).alias("_own"))
    both = rows.unionByName(begun, allowMissingColumns=True)
    seen = running(both, ["_key"], "_at", {"_until": Fold("max", "_end")})
    ahead = F.when(F.col("_until") > F.col("_at"), F.col("_until"))
    return seen.where(F.col("_own").isNotNull()).select(
        "_own.*",
        clock.from_micros(df, ts, ahead).alias("blocked_until"),
        F.floor((ahead - F.col("_at")) / clock.HOUR).cast("long").alias("hours_left"),
    )


def latest_blocks(blocks: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """The block table after upserting ``changes``: the newest row per identifier."""
    rows = blocks if changes is None else blocks.unionByName(changes)
    kept = [c for c in rows.columns if c != "identifier"]
    newest = F.max_by(F.struct(*kept), F.struct("blocked_at", "unblock_at", "reason"))
    return rows.groupBy("identifier").agg(newest.alias("b")).select("identifier", "b.*")


def active_blocks(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Blocks still running at ``as_of`` with the hours that remain."""
    left = F.timestamp_diff("MICROSECOND", as_of, F.col("unblock_at")) / clock.HOUR
    return (
        blocks.where(F.col("unblock_at") > as_of)
        .withColumn("hours_remaining", F.round(left.cast("decimal(24,8)"), 1).cast("double"))
        .withColumn("identifier_label", text.preview(F.col("identifier"), 20))
        .orderBy(F.desc("blocked_at"), "identifier")
    )


def _since(ts: str, as_of: Column, us: int) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(ts), as_of) < us


def dashboard(df: DataFrame, as_of: Column, ts: str = "created_at") -> DataFrame:
    """One row of totals over the submission log as seen at ``as_of``."""
    return df.agg(
        F.count("*").alias("total_submissions"),
        F.count_if(_since(ts, as_of, clock.DAY)).alias("last_24h"),
        F.count_if(_since(ts, as_of, clock.HOUR)).alias("last_hour"),
        F.countDistinct("session_id").alias("unique_sessions"),
        F.countDistinct("client_id").alias("unique_clients"),
        scores.rounded_mean(F.col("quality_score")).alias("avg_quality_score"),
        *[
            F.count_if(F.col("submission_type") == kind).alias(f"{kind}_count")
            for kind in ("bug", "feature", "improvement")
        ],
        F.count_if(F.col("status") == "created").alias("successfully_created"),
        F.count_if(F.col("status") == "failed").alias("failed_submissions"),
        F.count_if(F.col("status") == "submitted").alias("pending_submissions"),
    )


def client_report(df: DataFrame, as_of: Column, ts: str = "created_at") -> DataFrame:
    """Totals, recent counts, mean quality and first/last time per client."""
    return df.groupBy("client_id").agg(
        F.count("*").alias("total_submissions"),
        F.count_if(_since(ts, as_of, clock.DAY)).alias("last_24h"),
        F.count_if(_since(ts, as_of, clock.HOUR)).alias("last_hour"),
        scores.rounded_mean(F.col("quality_score")).alias("avg_quality"),
        F.countDistinct("session_id").alias("unique_sessions"),
        F.min(ts).alias("first_submission"),
        F.max(ts).alias("last_submission"),
    )


def issue_summary(df: DataFrame) -> DataFrame:
    """Created issues by type, failures and the success rate."""
    made = F.col("issue_number").isNotNull()
    counts = df.agg(
        F.count_if(made).alias("total_created"),
        *[
            F.count_if(made & (F.col("submission_type") == kind)).alias(f"{kind}s")
            for kind in ("bug", "feature", "improvement")
        ],
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "submitted").alias("pending"),
    )
    tried = F.col("total_created") + F.col("failed")
    return counts.withColumn("success_rate", scores.percent(F.col("total_created"), tried, 1))


def top_contributors(
    df: DataFrame, as_of: Column, ts: str = "created_at", days: int = 30, limit: int = 10
) -> DataFrame:
    """Clients with most submissions in the last ``days``."""
    return (
        df.where(_since(ts, as_of, days * clock.DAY))
        .groupBy("client_id")
        .agg(
            F.count("*").alias("submission_count"),
            scores.rounded_mean(F.col("quality_score")).alias("avg_quality"),
            F.max(ts).alias("last_submission"),
        )
        .orderBy(F.desc("submission_count"), "client_id")
        .limit(limit)
    )


def quota_stats(
    df: DataFrame,
    blocks: DataFrame,
    as_of: Column,
    key: str = "session_id",
    ts: str = "created_at",
    identifier_type: str = "session",
    per_hour: int = SESSION_PER_HOUR,
    per_day: int = SESSION_PER_DAY,
) -> DataFrame:
    """Used and remaining submissions per key at ``as_of``, and whether it is blocked."""
    used = df.groupBy(F.col(key).alias("identifier")).agg(
        F.count_if(_since(ts, as_of, clock.DAY)).alias("used_today"),
        F.count_if(_since(ts, as_of, clock.HOUR)).alias("used_this_hour"),
    )
    blocked = (
        blocks.where((F.col("identifier_type") == identifier_type) & (F.col("unblock_at") > as_of))
        .select("identifier")
        .distinct()
        .withColumn("_blocked", F.lit(True))
    )

    def left(limit: int, used_up: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col(used_up))

    return used.join(blocked, "identifier", "left").select(
        "identifier",
        "used_today",
        "used_this_hour",
        left(per_day, "used_today").alias("remaining_today"),
        left(per_hour, "used_this_hour").alias("remaining_this_hour"),
        F.coalesce("_blocked", F.lit(False)).alias("is_blocked"),
    )


def recent_submissions(
    df: DataFrame,
    ts: str = "created_at",
    status: str | None = None,
    submission_type: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """The newest submissions with a 200-character preview of the description."""
    rows = where_equal(df, status=status, submission_type=submission_type)
    return rows.orderBy(F.desc(ts), F.desc("id")).limit(limit).select(
        "id",
        F.concat(F.substring("session_id", 1, 16), F.lit("...")).alias("session_label"),
        "client_id",
        "submission_type",
        "title",
        text.shortened(F.col("description"), 200).alias("description_preview"),
        "quality_score",
        F.concat(F.lit("#"), F.col("issue_number").cast("string")).alias("issue"),
        "status",
        ts,
    )


def recent_issues(
    df: DataFrame, ts: str = "created_at", include_failed: bool = True, limit: int = 20
) -> DataFrame:
    """The newest submissions that became an issue, or failed to."""
    wanted = ["created", "failed"] if include_failed else ["created"]
    rows = df.where(F.col("status").isin(wanted)).orderBy(F.desc(ts), F.desc("id")).limit(limit)
    return rows.select(
        "id",
        "submission_type",
        "title",
        F.coalesce(F.concat(F.lit("#"), F.col("issue_number").cast("string")), F.lit("N/A")).alias("issue"),
        "quality_score",
        "status",
        ts,
    )


def recent_by_client(df: DataFrame, client_id: str, ts: str = "created_at", limit: int = 20) -> DataFrame:
    """The newest submissions of one client."""
    rows = df.where(F.col("client_id") == client_id).orderBy(F.desc(ts), F.desc("id")).limit(limit)
    return rows.select(
        "id", "session_id", "submission_type", "title", "quality_score", "issue_number", "status", ts
    )


def search(
    df: DataFrame, query: str, order: Sequence[Column], limit: int = 10, **equal: str | None
) -> DataFrame:
    """Rows whose title or description contains every word of ``query``."""
    content = F.lower(F.concat_ws(" ", "title", "description"))
    hits = [content.contains(word) for word in query.lower().split()]
    rows = where_equal(df, **equal)
    if hits:
        rows = rows.where(reduce(lambda a, b: a & b, hits))
    return rows.orderBy(*order).limit(limit)

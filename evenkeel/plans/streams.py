"""Registered streaming queries; each has the SQL of its batch twin.

They read the events table as a file stream. A last row far in the future closes
all windows, so the append output is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import clock
from evenkeel.operators import diff
from evenkeel.plans import activity, oracles
from evenkeel.plans.fixtures import relation, relations, with_
from evenkeel.session import rocksdb_state, workspace
from evenkeel.spec import CompareSpec
from evenkeel.streaming import feeds, limits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CLOSING = "2100-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _events(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The events as a stream with zoned times, followed by one closing row."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = feeds.file_stream(spark, f"{sf_dir}/events.parquet*", schema)
    last = spark.createDataFrame([(-1, -1, "closing", CLOSING)], "event_id long, user_id long, event_type string, ts string")
    last.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{path}/closing")
    columns = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    closing = feeds.file_stream(spark, f"{path}/closing", columns)
    names = ["event_id", "user_id", "event_type", "ts"]
    both = events.select(*names).unionByName(closing.select(*names))
    return both.withColumn("ts", F.col("ts").cast("timestamp"))


_TOLERANCE = 10 * clock.SECOND
_LATER = """case when event_id % 29 = 0 then ts + interval 30 seconds
                 when event_id % 17 = 0 then ts + interval 5 seconds else ts end"""


@query(
    "stream_diff",
    f"""with a as (select event_id, ts, event_type from events where event_id % 89 <> 0),
    b as (select event_id, {_LATER} as ts,
                 case when event_id % 41 = 0 then 'changed' else event_type end as event_type
          from events where event_id % 97 <> 0)
    select coalesce(a.event_id, b.event_id) as event_id, coalesce(a.ts, b.ts) as ts,
           case when b.event_id is null then 'missing_in_target' when a.event_id is null then 'missing_in_source'
                when a.event_type = b.event_type then 'match' else 'value_mismatch' end as row_status
    from a full outer join b on a.event_id = b.event_id
     and b.ts between a.ts - interval 10 seconds and a.ts + interval 10 seconds""",
)
def stream_diff(spark, sf_dir):
    path = workspace(spark)
    source = _events(spark, sf_dir, f"{path}/a").where(F.col("event_id") % 89 != 0)
    late = F.expr(_LATER)
    target = (
        _events(spark, sf_dir, f"{path}/b")
        .where(F.col("event_id") % 97 != 0)
        .withColumn("event_type", F.when(F.col("event_id") % 41 == 0, "changed").otherwise(F.col("event_type")))
        .withColumn("ts", late)
    )
    spec = CompareSpec(keys=("event_id",), columns=("event_type",))
    found = feeds.drain(feeds.stream_diff(source, target, spec, "ts", _TOLERANCE), path)
    return found.where(F.col("event_id") >= 0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_static_diff",
    f"""{with_("src", "tgt")}, {oracles.statuses("src", "tgt", ["o_orderkey"],
        oracles.same("o_custkey", "o_orderstatus", "o_totalprice"))}
    select o_orderkey, row_status from j where n_target > 0""",
)
def stream_static_diff(spark, sf_dir):
    source = relation(spark, sf_dir, "src")
    schema = spark.table("orders").schema
    orders = feeds.file_stream(spark, f"{sf_dir}/orders.parquet*", schema)
    status = F.when(F.col("o_orderkey") % 41 == 0, "X").otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 31 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))
    target = orders.where(F.col("o_orderkey") % 97 != 0).select(
        "o_orderkey", "o_custkey", status.alias("o_orderstatus"), price.alias("o_totalprice")
    )
    spec = CompareSpec(keys=("o_orderkey",))
    found = feeds.drain_batches(target, workspace(spark), feeds.against_source(source, spec))
    return found.select("o_orderkey", "row_status")


@query(
    "stream_compare",
    """with a as (select event_id, event_type from events where event_id % 89 <> 0
               union all select event_id, event_type from events where event_id % 89 <> 0 and event_id % 23 = 0),
    b as (select event_id, case when event_id % 41 = 0 then 'changed' else event_type end as event_type
          from events where event_id % 97 <> 0
          union all select event_id, event_type from events where event_id % 97 <> 0 and event_id % 31 = 0),
    ca as (select event_id, count(*) as n, min(event_type) as v from a group by event_id),
    cb as (select event_id, count(*) as n, min(event_type) as v from b group by event_id)
    select coalesce(ca.event_id, cb.event_id) as event_id, coalesce(ca.n, 0)::bigint as n_source,
           coalesce(cb.n, 0)::bigint as n_target,
           case when cb.n is null then 'missing_in_target' when ca.n is null then 'missing_in_source'
                when ca.n > 1 or cb.n > 1 then 'duplicate_key' when ca.v = cb.v then 'match' else 'value_mismatch' end
             as row_status
    from ca full outer join cb on ca.event_id = cb.event_id""",
)
def stream_compare(spark, sf_dir):
    """Two streams in which some keys come twice within seconds."""
    path = workspace(spark)

    def side(name, kept, again, value):
        rows = _events(spark, sf_dir, f"{path}/{name}").where(F.col("event_id") % kept != 0)
        times = F.array(F.lit(0), F.when((F.col("event_id") % again == 0) & (F.col("event_id") > 0), 3))
        twice = rows.withColumn("later", F.explode(F.filter(times, lambda t: t.isNotNull())))
        first = F.when(F.col("later") == 0, value).otherwise(F.col("event_type"))
        return twice.withColumn("event_type", first).withColumn("ts", F.timestamp_add("SECOND", F.col("later"), F.col("ts"))).drop("later")

    source = side("a", 89, 23, F.col("event_type"))
    target = side("b", 97, 31, F.when(F.col("event_id") % 41 == 0, "changed").otherwise(F.col("event_type")))
    spec = CompareSpec(keys=("event_id",), columns=("event_type",))
    return feeds.drain(feeds.stream_compare(source, target, spec, "ts", "10 seconds"), path).where("event_id >= 0")


@query(
    "stream_arriving_diff",
    f"""{with_("src", "tgt")}, {oracles.statuses("src", "tgt", ["o_orderkey"],
        oracles.same("o_custkey", "o_orderstatus", "o_totalprice"))}
    select o_orderkey, n_source, n_target, row_status from j""",
)
def stream_arriving_diff(spark, sf_dir):
    """A target that comes in four parts: after the last, the rows of the whole compare."""
    path = workspace(spark)
    source, target = relations(spark, sf_dir, "src", "tgt")
    target.repartition(4, "o_orderkey").write.parquet(f"{path}/in")
    stream = feeds.file_stream(spark, f"{path}/in", target.schema, files_per_batch=1)
    _, whole = feeds.drain_arriving(stream, source, CompareSpec(keys=("o_orderkey",)), path)
    return whole


@query(
    "sliding_counts",
    """with w as (
      select user_id, ts, time_bucket(interval 10 minutes, ts) - to_minutes(10 * i) as window_start
      from events, range(6) r(i))
    select user_id, window_start, window_start + interval 1 hour as window_end, count(*) as n
    from w group by all""",
)
def sliding_counts(spark, sf_dir):
    path = workspace(spark)
    counts = feeds.drain(feeds.windowed_counts(_events(spark, sf_dir, path), "user_id", "ts"), path)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return counts.where(F.col("user_id") >= 0).withColumns(times)


@query(
    "tumbling_counts",
    """select event_type, time_bucket(interval 1 hour, ts) as window_start,
       time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, count(*) as n from events group by all""",
)
def tumbling_counts(spark, sf_dir):
    path = workspace(spark)
    events = _events(spark, sf_dir, path)
    counts = feeds.drain(feeds.windowed_counts(events, "event_type", "ts", "1 hour", "1 hour"), path)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return counts.where(F.col("event_type") != "closing").withColumns(times)


@query(
    "activity_sessions",
    """with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
    g as (select *, sum(case when before is null or ts >= before + interval 30 minutes then 1 else 0 end)
                      over (partition by user_id order by ts) as spell from p)
    select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n
    from g group by user_id, spell""",
)
def activity_sessions(spark, sf_dir):
    path = workspace(spark)
    spells = feeds.drain(feeds.activity_sessions(_events(spark, sf_dir, path), "user_id", "ts"), path)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return spells.where(F.col("user_id") >= 0).withColumns(times)


_BATCHES = 4


def _submissions(spark: SparkSession, sf_dir: str, path: str) -> tuple[DataFrame, str]:
    """The submissions as files by ranges of time, one a micro-batch, each with some rows of the range before it, then
    a closing row of its own; and how late a row can be, which is two ranges."""
    log = relation(spark, sf_dir, "subm").select("id", "session_id", "submission_type", "created_at")
    low, high = log.agg(F.min("created_at"), F.max("created_at")).first()
    width = (high - low) / _BATCHES
    turn = F.lit(0)
    for n in range(1, _BATCHES):
        turn = turn + F.when(F.col("created_at") >= F.lit(low + n * width), 1).otherwise(0)
    late = (F.col("id") % 19 == 0) & (turn < _BATCHES - 1)  # rows that come one file late
    dealt = log.withColumn("turn", F.when(late, turn + 1).otherwise(turn))
    closing = spark.sql(f"select -1L as id, 'closing' as session_id, 'closing' as submission_type, timestamp_ntz '{CLOSING}' as created_at")
    for n in range(_BATCHES):
        dealt.where(F.col("turn") == n).drop("turn").repartition(1).write.parquet(f"{path}/in/turn={n}")
    closing.coalesce(1).write.parquet(f"{path}/in/turn={_BATCHES}")
    return feeds.file_stream(spark, f"{path}/in/*", closing.schema, files_per_batch=1), f"{(2 * width).days + 1} days"


_DECIDED = activity.ORACLES["admission_replay"].replace("select id, key as session_id, created_at, decision", "select id, key as session_id, decision")


@query("stream_admissions", _DECIDED)
def stream_admissions(spark, sf_dir):
    path = workspace(spark)
    stream, delay = _submissions(spark, sf_dir, path)
    rows = limits.stream_limits(stream, ["session_id"], "created_at", "id", activity.LIMITS, delay, clock.DAY)
    with rocksdb_state(spark):
        return feeds.drain(rows, path).drop("at_us")


@query(
    "stream_distinct",
    activity.ORACLES["duplicate_replay"].replace("select id, key as copy, created_at, decision", "select id, decision"),
)
def stream_distinct(spark, sf_dir):
    keys = ["session_id", "submission_type"]
    path = workspace(spark)
    stream, delay = _submissions(spark, sf_dir, path)
    rows = limits.stream_distinct(stream, keys, "created_at", "id", 12 * 60, delay, clock.DAY)
    with rocksdb_state(spark):
        return feeds.drain(rows, path).select("id", "decision")

_FILES = 4


@query(
    "stream_late_rows",
    """select event_type, time_bucket(interval 1 hour, ts) as window_start, count(*) as n from events group by all""",
)
def stream_late_rows(spark, sf_dir):
    """The first tenth of the events comes a second time, after the watermark has passed it: it is not counted again."""
    path = workspace(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    late = events.where(F.col("ts") < F.lit(low + (high - low) / 10))

    def marks(ts):
        return spark.range(0, _FILES, 1, _FILES).select(F.lit("closing").alias("event_type"), F.lit(ts).cast("timestamp").alias("ts"))

    # Rows are late by the watermark that the batch before last has set: one batch lies between.
    for part, rows in enumerate((events.repartition(_FILES), marks(high), late.repartition(_FILES), marks(CLOSING))):
        rows.write.parquet(f"{path}/in/part={part}")
    stream = feeds.file_stream(spark, f"{path}/in/*", events.schema, files_per_batch=_FILES)
    counts = feeds.drain(feeds.windowed_counts(stream, "event_type", "ts", "1 hour", "1 hour"), path)
    rows = counts.where(F.col("event_type") != "closing")
    return rows.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "observed_progress",
    f"""{with_("src", "tgt")}, {oracles.statuses("src", "tgt", ["o_orderkey"],
        oracles.same("o_custkey", "o_orderstatus", "o_totalprice"))}
    select count(*) as rows, count(*) filter (where row_status <> 'match') as mismatches from j""",
)
def observed_progress(spark, sf_dir):
    """Counters that fill while the rows of a compare are written."""
    statuses = diff.row_statuses(*relations(spark, sf_dir, "src", "tgt"), CompareSpec(keys=("o_orderkey",)))
    rows, progress = feeds.observed(statuses)
    rows.write.parquet(f"{workspace(spark)}/observed")
    return spark.createDataFrame([(progress.get["rows"], progress.get["mismatches"])], "rows long, mismatches long")

"""Streams fed file by file, late rows and progress."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from evenkeel.functions import clock
from evenkeel.operators import diff, replay
from evenkeel.plans import streams
from evenkeel.session import workspace
from evenkeel.spec import CompareSpec
from evenkeel.streaming import feeds, limits
from oracle import connect, differences

START = datetime(2024, 1, 1)


def write_files(spark, path, batches, schema):
    """One file per batch; their ages keep the order in which they are read."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return f"{path}/*"


SUBMITTED = "id long, session_id string, created_at timestamp_ntz"
CLOSING = [(-1, "closing", START + timedelta(days=900))]


def _stream(spark, path, batches):
    return feeds.file_stream(spark, write_files(spark, path, [*batches, CLOSING], SUBMITTED), SUBMITTED, files_per_batch=1)


def _decisions(df):
    return {r["id"]: r["decision"] for r in df.collect() if r["id"] != -1}


@pytest.mark.parametrize(
    "rule",
    [
        replay.Limits(spans=(("hour", clock.HOUR, 2), ("day", clock.DAY, 5))),
        replay.Limits(spans=(("hour", clock.HOUR, 2), ("day", clock.DAY, 5)), block_at=2, block_span=3 * clock.HOUR),
    ],
)
def test_limits_hold_however_rows_arrive(spark, tmp_path, rule):
    rows = [(i, f"s{i % 3}", START + timedelta(minutes=5 * (i // 2))) for i in range(80)]
    rows += [(100, None, START), (101, None, START), (102, "s1", None)]
    shuffled = random.Random(5).sample(rows, len(rows))
    batches = [shuffled[:10], shuffled[10:50], shuffled[50:]]
    stream = _stream(spark, str(tmp_path / "in"), batches)
    decided = limits.stream_limits(stream, ["session_id"], "created_at", "id", rule, slot=10 * clock.MINUTE)
    got = _decisions(feeds.drain(decided, workspace(spark)))
    twin = replay.replay(spark.createDataFrame(rows[:-1], SUBMITTED), ["session_id"], "created_at", "id", rule)
    assert got == _decisions(twin) and len(got) == 82


def test_a_stream_goes_on_where_a_replay_ended(spark, tmp_path):
    rule = replay.Limits(spans=(("hour", clock.HOUR, 3), ("day", clock.DAY, 5)), block_at=2, block_span=5 * clock.HOUR)
    rows = [(i, f"s{i % 2}", START + timedelta(minutes=23 * i)) for i in range(60)]
    whole = _decisions(replay.replay(spark.createDataFrame(rows, SUBMITTED), ["session_id"], "created_at", "id", rule))
    earlier = replay.replay(spark.createDataFrame(rows[:30], SUBMITTED), ["session_id"], "created_at", "id", rule)
    seed = limits.states_after(earlier, ["session_id"], "created_at", rule)
    stream = _stream(spark, str(tmp_path / "in"), [rows[30:45], rows[45:]])
    rest = limits.stream_limits(stream, ["session_id"], "created_at", "id", rule, seed=seed)
    assert {**_decisions(earlier), **_decisions(feeds.drain(rest, workspace(spark)))} == whole
    assert {"admitted", "blocked"} <= set(whole.values())


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "k string, ts timestamp"
    batches = [
        [("a", START + timedelta(minutes=m)) for m in (0, 5, 300)],
        [("a", START + timedelta(minutes=310))],
        [("a", START + timedelta(minutes=1)), ("a", START + timedelta(minutes=900))],
    ]
    path = write_files(spark, str(tmp_path / "in"), batches, schema)
    listener = feeds.ProgressListener()
    spark.streams.addListener(listener)
    stream = feeds.file_stream(spark, path, schema, files_per_batch=1)
    counts = feeds.drain(feeds.windowed_counts(stream, "k", "ts", "1 hour", "1 hour"), workspace(spark))
    got = {r["window_start"]: r["n"] for r in counts.collect()}
    spark.streams.removeListener(listener)
    assert got[START] == 2
    run = next(iter(listener.rows))
    assert listener.late[run] == 1 and listener.rows[run] == 6


def test_results_do_not_depend_on_batches(spark, tmp_path):
    schema = "k long, v string"
    source = spark.createDataFrame([(1, "x"), (2, "b"), (3, "c"), (3, "c")], schema)
    rows = [(1, "x"), (1, "y"), (2, "b"), (3, "c"), (None, "n")]
    found = []
    for n, batches in enumerate(([rows], [rows[:1], rows[1:3], rows[3:]])):
        path = write_files(spark, str(tmp_path / f"in{n}"), batches, schema)
        stream = feeds.file_stream(spark, path, schema, files_per_batch=1)
        each = feeds.against_source(source, CompareSpec(keys=("k",)))
        got = feeds.drain_batches(stream, workspace(spark), each).select("k", "target_v", "row_status").collect()
        found.append(sorted(map(tuple, got), key=str))
    assert found[0] == found[1]
    assert found[0] == sorted(
        [(1, "x", "match"), (1, "y", "value_mismatch"), (2, "b", "match"), (3, "c", "duplicate_key"), (None, "n", "missing_in_source")],
        key=str,
    )


def test_stream_diff_honours_the_spec(spark, tmp_path):
    schema = "k string, ts timestamp, v string"
    end = START + timedelta(days=1)
    left = [("a", START, "  x"), (None, START, "n"), ("c", None, "y"), ("zz", end, "")]
    right = [("A ", START, "X"), (None, START, "n"), ("d", None, "y"), ("zz", end, "")]
    sides = [
        feeds.file_stream(spark, write_files(spark, str(tmp_path / n), [rows], schema), schema)
        for n, rows in (("l", left), ("r", right))
    ]
    spec = CompareSpec(keys=("k",), columns=("v",), trim=True, case_sensitive=False, null_safe_keys=True)
    got = feeds.drain(feeds.stream_diff(*sides, spec, "ts", clock.MINUTE), workspace(spark))
    status = {r["k"]: r["row_status"] for r in got.collect()}
    assert status == {"a": "match", None: "match", "c": "missing_in_target", "d": "missing_in_source", "zz": "match"}
    for bad in (CompareSpec(keys=("k",), duplicates="ordinal"), CompareSpec(keys=("k",), exact=False)):
        with pytest.raises(ValueError):
            feeds.stream_diff(*sides, bad, "ts", clock.MINUTE)


def test_batches_against_a_fixed_source(spark, tmp_path):
    schema = "k long, v string"
    path = write_files(spark, str(tmp_path / "in"), [[(1, "a"), (2, "x")], [(9, "z")]], schema)
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema)
    stream = feeds.file_stream(spark, path, schema, files_per_batch=1)
    each = feeds.against_source(source, CompareSpec(keys=("k",)))
    got = feeds.drain_batches(stream, workspace(spark), each)
    assert {r["k"]: r["row_status"] for r in got.collect()} == {1: "match", 2: "value_mismatch", 9: "missing_in_source"}


ROWS = [("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), (None, "n"), ("e", None), ("f", "6"), ("f", "6"), ("f", "6"), ("g", "7")]
OTHERS = [("a", "1"), ("b", "2"), ("b", "2"), ("c", "x"), (None, "n"), ("d", "4"), ("e", None), ("f", "6"), ("h", "8"), ("h", "8")]


@pytest.mark.parametrize("null_safe", [False, True])
def test_repeats_in_two_streams_give_the_batch_statuses(spark, tmp_path, null_safe):
    spec = CompareSpec(keys=("k",), columns=("v",), null_safe_keys=null_safe)
    schema = "k string, ts timestamp, v string"
    end = [("closing", START + timedelta(days=9), "")]
    sides = []
    for name, rows in (("l", ROWS), ("r", OTHERS)):
        timed = [(k, START + timedelta(seconds=i), v) for i, (k, v) in enumerate(rows)]
        path = write_files(spark, str(tmp_path / name), [timed[5:], timed[:5], end], schema)
        sides.append(feeds.file_stream(spark, path, schema, files_per_batch=1))
    found = feeds.drain(feeds.stream_compare(*sides, spec, "ts", "1 minute", "1 hour"), workspace(spark))
    got = sorted(map(str, found.where("k is null or k != 'closing'").collect()))
    batch = [spark.createDataFrame(rows, "k string, v string") for rows in (ROWS, OTHERS)]
    assert got == sorted(map(str, diff.row_statuses(*batch, spec).collect()))


def test_an_arriving_target_ends_with_the_batch_compare(spark, tmp_path):
    spec, schema = CompareSpec(keys=("k",)), "k string, v string"
    source = spark.createDataFrame(ROWS, schema)
    want = sorted(map(str, diff.row_statuses(source, spark.createDataFrame(OTHERS, schema), spec).collect()))
    for n, batches in enumerate(([OTHERS], [OTHERS[:2], OTHERS[2:9], OTHERS[9:]])):
        path = write_files(spark, str(tmp_path / f"in{n}"), batches, schema)
        stream = feeds.file_stream(spark, path, schema, files_per_batch=1)
        running, whole = feeds.drain_arriving(stream, source, spec, workspace(spark))
        assert running.count() == len(OTHERS)
        assert sorted(map(str, whole.collect())) == want
    assert any("missing_in_target" in r for r in want) and any("duplicate_key" in r for r in want)


def test_observed_progress(spark):
    a = spark.range(100).selectExpr("id as k", "id as v")
    b = spark.range(100).selectExpr("id as k", "if(id < 10, -1, id) as v")
    rows, progress = feeds.observed(diff.row_statuses(a, b, CompareSpec(keys=("k",))), "seen")
    rows.write.format("noop").mode("overwrite").save()
    assert progress.get == {"rows": 100, "mismatches": 10}


@pytest.mark.parametrize("minutes,kept", [(30, [0, 3]), (10, [0, 1, 3])])
def test_copies_are_suppressed_from_the_last_accepted(spark, tmp_path, minutes, kept):
    rows = [(i, "h", START + timedelta(minutes=m)) for i, m in enumerate((0, 20, 25, 50))]
    stream = _stream(spark, str(tmp_path / "in"), [rows[2:], rows[:2]])
    got = feeds.drain(limits.stream_distinct(stream, ["session_id"], "created_at", "id", minutes), workspace(spark))
    assert sorted(r["id"] for r in got.where(F.col("decision") == "admitted").collect()) == kept


class _StateCalls(StreamingQueryListener):
    """Timers that stateful processors have set; each costs the calls that read, decide and keep what it is for."""

    timers = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.timers += sum(op.customMetrics.get("numRegisteredTimers", 0) for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def test_keys_of_a_group_share_their_timers(spark, tmp_path):
    rule = replay.Limits(spans=(("hour", clock.HOUR, 1), ("day", clock.DAY, 2)))
    rows = [(i, f"s{i % 2500}", START + timedelta(minutes=30 * (i // 2500), seconds=i % 60)) for i in range(10_000)]
    calls = _StateCalls()
    spark.streams.addListener(calls)
    stream = _stream(spark, str(tmp_path / "in"), [rows[5_000:], rows[:5_000]])
    decided = limits.stream_limits(stream, ["session_id"], "created_at", "id", rule, slot=clock.DAY)
    got = _decisions(feeds.drain(decided, workspace(spark)))
    spark.streams.removeListener(calls)
    twin = replay.replay(spark.createDataFrame(rows, SUBMITTED), ["session_id"], "created_at", "id", rule)
    assert got == _decisions(twin) and len(got) == 10_000
    assert 0 < calls.timers <= 2 * (limits.GROUPS + 1)  # the end of the slot, and when it is forgotten


def test_copies_of_a_group_share_their_timers(spark, tmp_path):
    schema = "id long, session_id string, submission_type string, created_at timestamp_ntz"
    rows = [(i, f"s{i % 1400 // 2}", "ab"[i % 2], START + timedelta(hours=11 * (i // 1400))) for i in range(4_200)]
    end = [(-1, "closing", "", START + timedelta(days=900))]
    calls = _StateCalls()
    spark.streams.addListener(calls)
    path = write_files(spark, str(tmp_path / "in"), [rows, end], schema)
    stream = feeds.file_stream(spark, path, schema, files_per_batch=1)
    found = limits.stream_distinct(stream, ["session_id", "submission_type"], "created_at", "id", 12 * 60, slot=clock.DAY)
    got = _decisions(feeds.drain(found, workspace(spark)))
    spark.streams.removeListener(calls)
    assert got == {i: ("admitted", "duplicate", "admitted")[i // 1400] for i in range(4_200)}
    assert 0 < calls.timers <= 2 * (limits.GROUPS + 1)


def test_keys_and_ties_of_other_types(spark, tmp_path):
    rule = replay.Limits(spans=(("hour", clock.HOUR, 1),))
    schema = "id string, user long, score double, created_at timestamp_ntz"
    nan = float("nan")
    rows = [("b", 1, nan, START), (None, 1, nan, START), ("c", 1, nan, START + timedelta(hours=1)), ("d", 2**60 + 1, -0.0, START)]
    rows += [("e", 2**60 + 1, 0.0, START), ("f", 2**60, 0.0, START), ("g", None, 0.0, START)]
    end = [("closing", -1, 0.0, START + timedelta(days=900))]
    path = write_files(spark, str(tmp_path / "in"), [rows, end], schema)
    stream = feeds.file_stream(spark, path, schema, files_per_batch=1)
    decided = limits.stream_limits(stream, ["user", "score"], "created_at", "id", rule)
    got = feeds.drain(decided, workspace(spark)).where("id is null or id <> 'closing'").collect()
    assert {(r["id"], r["user"]): r["decision"] for r in got} == {
        (None, 1): "admitted", ("b", 1): "hour", ("c", 1): "admitted", ("d", 2**60 + 1): "admitted", ("e", 2**60 + 1): "hour",
        ("f", 2**60): "admitted", ("g", None): "admitted",
    }


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
builder = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2")
spark = builder.config("spark.checkpoint.dir", {out!r}).getOrCreate()
from evenkeel.plans import streams
for name in ("stream_admissions", "stream_distinct"):
    streams.QUERIES[name](spark, {sf!r}).write.parquet({out!r} + "/" + name)
assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
"""


def test_limits_run_in_a_plain_session_of_another_folder(spark, sf_dir, tmp_path):
    """With Spark's own settings, and where only the driver's Python knows the package."""
    root, out = str(Path(streams.__file__).parents[2]), str(tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ELSEWHERE.format(root=root, out=out, sf=sf_dir)
    ran = subprocess.run([sys.executable, "-c", code], cwd=out, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stderr[-3000:]
    for name in ("stream_admissions", "stream_distinct"):
        assert differences(spark.read.parquet(f"{out}/{name}"), connect(sf_dir), streams.ORACLES[name]) == []

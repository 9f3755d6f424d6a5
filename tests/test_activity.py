"""Limits and duplicates against plain Python folds, also on split hot keys."""

import random
from collections import Counter
from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.functions import clock
from evenkeel.operators import activity, admission, links, replay, running, searchindex

quick = partial(settings, deadline=None, max_examples=6, suppress_health_check=list(HealthCheck))
START = datetime(2024, 1, 1)
LIMITS = [
    replay.Limits(spans=(("hour", clock.HOUR, 3), ("day", clock.DAY, 10))),
    replay.Limits(spans=(("hour", clock.HOUR, 2), ("day", clock.DAY, 5)), block_at=2, block_span=3 * clock.HOUR),
    replay.Limits(spans=(("duplicate", 30 * clock.MINUTE, 1),)),
]


def log(spark, minutes, keys=2):
    data = [(i, f"s{(i * i) % keys}", START + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    return data, spark.createDataFrame(data, "id long, session_id string, created_at timestamp_ntz")


def by_hand(data, limits):
    """The limiter as it reads: one list of admitted times per key."""
    admitted, until, out = {}, {}, {}
    for i, key, at in sorted(data, key=lambda r: (r[2], r[0])):
        us = int((at - START) / timedelta(microseconds=1))
        times = admitted.setdefault(key, [])
        decision = "blocked" if us < until.get(key, -1) else None
        for name, width, most in limits.spans:
            if decision is None and sum(1 for t in times if us - t < width) >= most:
                decision = name
        if decision is None:
            decision = "admitted"
            times.append(us)
            first = limits.spans[0][1]
            if limits.block_at and sum(1 for t in times if us - t < first) >= limits.block_at:
                until[key] = us + limits.block_span
        out[i] = decision
    return out


minutes = st.lists(st.integers(0, 4000), min_size=1, max_size=60)


@pytest.mark.parametrize("limits", LIMITS)
@quick()
@given(minutes=minutes)
def test_replay_equals_the_fold(spark, limits, minutes):
    data, df = log(spark, minutes)
    want = by_hand(data, limits)
    got = replay.replay(df, ["session_id"], "created_at", "id", limits)
    assert {r["id"]: r["decision"] for r in got.collect()} == want


@pytest.mark.parametrize("limits", LIMITS)
def test_hot_keys_get_the_same_decisions(spark, limits):
    rng = np.random.default_rng(7)
    data, df = log(spark, rng.integers(0, 1500, 300).tolist(), keys=3)
    want = by_hand(data, limits)
    got = replay.replay(df.repartition(7), ["session_id"], "created_at", "id", limits)
    assert {r["id"]: r["decision"] for r in got.collect()} == want


@pytest.fixture
def twelve_parts(spark):
    """Twelve partitions a shuffle, however small."""
    change = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {c: spark.conf.get(c) for c in change}
    for c, v in change.items():
        spark.conf.set(c, v)
    yield
    for c, v in kept.items():
        spark.conf.set(c, v)


def _hot(seed, rows=900, every=7):
    """Most rows have one key, which is busy throughout or rests now and then; some times are equal."""
    r = random.Random(seed)
    at, minutes = 0, []
    for _ in range(rows):
        at += r.choice([0, 1, 1, 2, every]) if r.random() < 0.99 else r.choice([40, 300, 2000])
        minutes.append(at)
    return [("h" if r.random() < 0.8 else f"k{r.randint(0, 9)}", m) for m in minutes]


@pytest.mark.parametrize("rounds", [0, 1, 3])
@pytest.mark.parametrize("limits", LIMITS)
def test_a_hot_key_spreads_over_stretches(spark, twelve_parts, monkeypatch, limits, rounds):
    monkeypatch.setattr(replay, "ROUNDS", rounds)
    for seed in (1, 2):
        some = _hot(seed)
        data = [(i, key, START + timedelta(minutes=m)) for i, (key, m) in enumerate(some)]
        df = spark.createDataFrame(data, "id long, session_id string, created_at timestamp")
        got = replay.replay(df, ["session_id"], "created_at", "id", limits).withColumn("task", F.spark_partition_id()).collect()
        assert {r["id"]: r["decision"] for r in got} == by_hand(data, limits)
        sizes = Counter(r["task"] for r in got)
        assert len(sizes) == 12 and max(sizes.values()) <= 2 * len(data) / 12


def test_only_stretches_that_began_wrong_run_again(spark, twelve_parts, monkeypatch):
    ran = []
    exits = replay._exits
    monkeypatch.setattr(replay, "_exits", lambda s, k, l, tasks: ran.append(len(tasks)) or exits(s, k, l, tasks))
    # Rests of two days: every stretch begins with nothing that still counts, or forgets it at the next rest.
    data = [(i, "h", START + timedelta(days=2 * (i // 20), minutes=i % 20)) for i in range(600)]
    df = spark.createDataFrame(data, "id long, session_id string, created_at timestamp")
    got = replay.replay(df, ["session_id"], "created_at", "id", LIMITS[0])
    assert {r["id"]: r["decision"] for r in got.collect()} == by_hand(data, LIMITS[0])
    assert ran[0] == 11 and sum(ran[1:]) <= 11 and len(ran) <= 2


def test_rows_without_a_key_are_admitted(spark):
    df = spark.createDataFrame([(1, None, START), (2, None, START)], "id long, session_id string, created_at timestamp_ntz")
    once = replay.Limits(spans=(("hour", clock.HOUR, 1),))
    got = replay.replay(df, ["session_id"], "created_at", "id", once)
    assert Counter(r["decision"] for r in got.collect()) == {"admitted": 2}


@quick()
@given(minutes=minutes)
def test_trailing_counts(spark, minutes):
    data, df = log(spark, minutes)
    spans = {"h": clock.HOUR, "d": clock.DAY}
    for parts in (1, 3):  # a key in one part and over several
        got = {
            r["id"]: (r["h"], r["d"])
            for r in activity.trailing_counts(df.repartition(parts), "session_id", "created_at", spans).collect()
        }
        for i, key, at in data:
            ages = [at - t for _, k, t in data if k == key and t <= at]
            want = tuple(sum(a < timedelta(hours=n) for a in ages) for n in (1, 24))
            assert got[i] == want


@quick()
@given(minutes=minutes)
def test_oldest_and_previous(spark, minutes):
    data, df = log(spark, minutes)
    oldest = {r["id"]: r["oldest"] for r in activity.oldest_in_span(df, "session_id", "created_at", clock.HOUR).collect()}
    found = activity.since_previous(df, ["session_id"], "created_at", "id")
    previous = {r["id"]: r["previous"] for r in found.collect()}
    for i, key, at in data:
        same = [(t, j) for j, k, t in data if k == key]
        assert oldest[i] == min(t for t, _ in same if at - timedelta(hours=1) < t <= at)
        assert previous[i] == max((t for t, j in same if (t, j) < (at, i)), default=None)


def test_block_ends_are_exclusive(spark):
    data, df = log(spark, [0, 59, 60, 119, 120], keys=1)
    blocks = spark.createDataFrame(
        [("s0", "session", START + timedelta(minutes=60), START + timedelta(minutes=120), "r")],
        "identifier string, identifier_type string, blocked_at timestamp_ntz, unblock_at timestamp_ntz, reason string",
    )
    got = {r["id"]: r["blocked_until"] is not None for r in activity.with_block(df, blocks).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False}


@pytest.mark.parametrize("after", [[], ["id"]])
def test_a_hot_key_spreads_over_parts(spark, after):
    """One key holds most rows; equal times, NULL keys and each kind of fold agree with a plain window."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(3000).selectExpr(
        "id", "if(id % 10 = 0, null, if(id % 3 = 0, cast(id % 7 as string), 'hot')) as k", "(id * 7919) % 1000 as at", "id % 13 as v"
    )
    folds = {"s": running.Fold("sum", "v"), "lo": running.Fold("min", "v"), "hi": running.Fold("max", "v")}
    got = running.running(df, ["k"], "at", folds, after=after)
    parts = got.select(F.spark_partition_id().alias("p"), "k").where("k = 'hot'").distinct().count()
    rows = got.collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    w = Window.partitionBy("k").orderBy("at", *after)
    w = w.rowsBetween(Window.unboundedPreceding, -1) if after else w.rangeBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w), F.min("v").over(w), F.max("v").over(w)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, want))
    assert parts > 1


def test_wait_minutes(spark):
    _, df = log(spark, [0, 10, 59, 61], keys=1)
    got = {r["id"]: r["wait_minutes"] for r in activity.wait_minutes(df).collect()}
    assert got == {0: 60, 1: 50, 2: 1, 3: 9}


QUOTA = admission.Quota(session=(2, 5), client=(4, 12), duplicate_minutes=30)


def accepted_by_hand(rows, quota):
    """The whole log as one list: accepted (session, client, copy, time)."""
    held, out = [], {}
    for i, session, client, at, copy, stop, poor in sorted(rows, key=lambda r: (r[3], r[0])):

        def used(place, value, hours):
            return sum(value is not None and a[place] == value and at - a[3] < timedelta(hours=hours) for a in held)

        full = [
            used(place, value, hours) >= most
            for place, value, limits in ((0, session, quota.session), (1, client, quota.client))
            for hours, most in zip((1, 24), limits)
        ]
        again = any(
            session is not None and a[0] == session and a[2] == copy and at - a[3] < timedelta(minutes=quota.duplicate_minutes)
            for a in held
        )
        out[i] = "rate" if any(full) else stop or ("duplicate" if again else "quality" if poor else "accepted")
        if out[i] == "accepted":
            held.append((session, client, copy, at))
    return out


@pytest.mark.parametrize("shared", [True, False])
def test_admissions_under_session_and_client_limits(spark, shared):
    rng = np.random.default_rng(4)
    rows = []
    for i, minute in enumerate(rng.integers(0, 2600, 400).tolist()):
        session = int(rng.integers(0, 9))
        client = int(rng.integers(0, 3)) if shared else session % 3
        rows.append(
            (i, None if i % 23 == 0 else f"s{session}", None if i % 19 == 0 else f"c{client}",
             START + timedelta(minutes=minute), str(rng.integers(0, 3)), ["content", "relevance", None, None, None][i % 5], i % 7 == 0)
        )
    schema = "id long, session_id string, client_id string, created_at timestamp_ntz, content_hash string, stop string, poor boolean"
    got = admission.decided(spark.createDataFrame(rows, schema).repartition(5), QUOTA, "created_at")
    want = accepted_by_hand(rows, QUOTA)
    assert {r["id"]: r["stage"] for r in got.collect()} == want
    assert set(want.values()) == {"rate", "content", "relevance", "duplicate", "quality", "accepted"}


def test_linked_groups(spark):
    pairs = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("x", "9"), ("y", "9"), ("z", "8"), ("d", "3"), ("c", "3")]
    got = admission.linked(spark.createDataFrame(pairs, "l string, r string"), "l", "r")
    assert {r["l"]: r["group"] for r in got.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)]
    found, rounds = links.components(spark.createDataFrame(chain[::2] + chain[1::2], "a string, b string"))
    assert {r["root"] for r in found.collect()} == {"n0000"} and found.count() == 1001
    assert rounds < 15
    rest = [("hub", f"x{i}") for i in range(300)] + [("x5", "y"), ("z", "z"), (None, "q"), ("p", None), ("u", "v"), ("v", "u")]
    found, rounds = links.components(spark.createDataFrame(rest, "a string, b string"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert groups.pop("hub") == {"hub", "y", *(f"x{i}" for i in range(300))}
    assert groups == {"z": {"z"}, "q": {"q"}, "p": {"p"}, "u": {"u", "v"}} and rounds <= 4
    assert links.components(spark.createDataFrame([], "a string, b string"))[0].count() == 0


def test_a_hot_node_is_split(spark):
    """One node with most links: the join of a round is dealt to several tasks."""
    change = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    kept = {c: spark.conf.get(c, None) for c in change}
    star = spark.range(1, 300_000).selectExpr("if(id % 10 < 7, 0, id) as a", "id * 7 as b").repartition(8)
    try:
        for c, v in change.items():
            spark.conf.set(c, v)
        found = links._large_star(star)
        found.write.format("noop").mode("overwrite").save()
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in kept.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert "skew=true" in plan


def test_pieces_of_hot_and_other_keys(spark, twelve_parts):
    r = random.Random(4)
    rows = [("h" if r.random() < 0.7 else f"k{r.randint(0, 5)}", r.choice([r.randint(0, 60), r.randint(0, 9000)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, at long, tie long")
    got = {x["tie"]: x["piece"] for x in admission.pieces(df, ["g"], "at", "tie", 25).collect()}
    last, want = {}, {}
    for g, at, tie in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        before, piece = last.get(g, (None, 0))
        piece += before is None or at - before >= 25
        last[g] = at, piece
        want[tie] = piece
    assert got == want


def test_a_group_is_cut_where_it_rests(spark, twelve_parts):
    rng = np.random.default_rng(9)
    rows = [
        (i, f"s{i % 3}", f"c{i % 2}", START + timedelta(days=int(3 * (i // 30)), minutes=int(m)), str(m % 3), None, False)
        for i, m in enumerate(rng.integers(0, 1500, 600).tolist())
    ]
    schema = "id long, session_id string, client_id string, created_at timestamp_ntz, content_hash string, stop string, poor boolean"
    got = admission.decided(spark.createDataFrame(rows, schema), QUOTA, "created_at")
    got = got.withColumn("task", F.spark_partition_id()).collect()
    assert {r["id"]: r["stage"] for r in got} == accepted_by_hand(rows, QUOTA)
    # One group of 600 rows, which fills twenty pieces.
    sizes = Counter(r["task"] for r in got)
    assert len(sizes) >= 6 and max(sizes.values()) <= 180 and all(n % 30 == 0 for n in sizes.values())


def test_rejected_rows_use_no_quota(spark):
    rows = [(i, "s", "c", START + timedelta(minutes=20 * i), str(i), None, False) for i in range(12)]
    schema = "id long, session_id string, client_id string, created_at timestamp_ntz, content_hash string, stop string, poor boolean"
    quota = admission.Quota(session=(2, 10), client=(20, 50), duplicate_minutes=30)
    got = admission.decided(spark.createDataFrame(rows, schema), quota, "created_at")
    assert Counter(r["stage"] for r in got.collect()) == {"accepted": 8, "rate": 4}


def test_indexed_search_equals_reading_all(spark, tmp_path):
    r = random.Random(8)
    words = ["query", "slow", "queries", "index", "plan", "slowly", "Table", "x"]
    rows = [
        (i, " ".join(r.choices(words, k=2)), None if i % 17 == 0 else "\n".join(r.choices(words, k=r.randint(0, 4))),
         r.choice(["bug", "feature"]), START + timedelta(minutes=r.randint(0, 400)))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "id long, title string, description string, issue_type string, created_at timestamp_ntz")
    path = searchindex.build(df, str(tmp_path / "index"), ["title", "description"], "created_at", block=16, folders=8)
    index = searchindex.Index(spark, path)
    order = [F.desc("created_at"), F.desc("id")]
    for query, equal in (("query slow", {"issue_type": "bug"}), ("QUER", {}), ("able index", {}), ("x x", {"issue_type": None}), ("nowhere", {}), ("", {}), ("slow nowhere", {})):
        want = [row["id"] for row in activity.search(df, query, order, **equal).select("id").collect()]
        assert [row["id"] for row in index.search(query, **equal).collect()] == want, query
    # Only folders of the word's terms are read.
    folders = {f.split("folder=")[1].split("/")[0] for f in index.postings("able").inputFiles()}
    assert folders == {str(folder) for folder, _ in index.terms("able")} and len(folders) == 1
    empty = searchindex.build(df.limit(0), str(tmp_path / "none"), ["title", "description"], "created_at")
    assert searchindex.Index(spark, empty).search("query").count() == 0


def test_postings_of_a_folder_are_laid_out_by_several_tasks(spark, tmp_path, monkeypatch, twelve_parts):
    """A folder was the work of one task, however many rows there were."""
    monkeypatch.setattr(searchindex, "FILE_ROWS", 20, raising=False)
    rows = [(i, f"query {i % 7}", "slow plan", "bug", START + timedelta(minutes=i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, title string, description string, issue_type string, created_at timestamp_ntz")
    path = searchindex.build(df, str(tmp_path / "index"), ["title", "description"], "created_at", block=8, folders=2)
    found = spark.read.parquet(f"{path}/postings").withColumn("file", F.input_file_name())
    files = {r["folder"]: r["n"] for r in found.groupBy("folder").agg(F.countDistinct("file").alias("n")).collect()}
    assert max(files.values()) >= 4
    assert found.count() == 400 * 4 and found.select("term", "rank").distinct().count() == 400 * 4
    assert [r["id"] for r in searchindex.Index(spark, path).search("query 3").collect()] == [i for i in range(399, 0, -1) if i % 7 == 3][:10]

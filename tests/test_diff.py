"""Compare semantics: NULLs, repeated keys, options and invariants."""

import random
from collections import Counter
from functools import partial

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.operators import diff, digests, keys, normalize, renames, report, resumable, rowindex
from evenkeel.spec import CompareSpec, fold_case, within

SCHEMA = "k long, a string, b double"
K = CompareSpec(keys=("k",))
quick = partial(settings, deadline=None, max_examples=12, suppress_health_check=list(HealthCheck))

rows = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(0, 6)),
        st.sampled_from(["x", "y", None]),
        st.sampled_from([0.5, 1.5, None]),
    ),
    max_size=14,
)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def status_of(df, key="k"):
    return {r[key]: r["row_status"] for r in df.collect()}


def expected_statuses(source, target):
    """Row counts per status, by brute force over keys."""
    out = Counter()
    a, b = Counter(r[0] for r in source), Counter(r[0] for r in target)
    values = [{r[0]: r[1:] for r in side} for side in (source, target)]
    for key in set(a) | set(b):
        if key is None:
            out["missing_in_target"] += a[key]
            out["missing_in_source"] += b[key]
        elif not b[key]:
            out["missing_in_target"] += a[key]
        elif not a[key]:
            out["missing_in_source"] += b[key]
        elif a[key] > 1 or b[key] > 1:
            out["dup_source"] += a[key]
            out["dup_target"] += b[key]
        else:
            out["match" if values[0][key] == values[1][key] else "value_mismatch"] += 1
    return out


@quick()
@given(source=rows, target=rows)
def test_summary_matches_brute_force(spark, source, target):
    got = report.summary(frame(spark, source), frame(spark, target), K).first().asDict()
    want = expected_statuses(source, target)
    assert got["total_rows_source"] == len(source) and got["total_rows_target"] == len(target)
    assert got["matching_rows"] == want["match"] and got["mismatched_rows"] == want["value_mismatch"]
    assert got["missing_in_target"] == want["missing_in_target"]
    assert got["missing_in_source"] == want["missing_in_source"]
    assert got["duplicate_rows_source"] == want["dup_source"]
    assert got["duplicate_rows_target"] == want["dup_target"]
    left = got["matching_rows"] + got["mismatched_rows"] + got["missing_in_target"] + got["duplicate_rows_source"]
    assert left == len(source)


@quick()
@given(source=rows, target=rows)
def test_diff_mirrors(spark, source, target):
    a, b = frame(spark, source), frame(spark, target)
    there, back = report.summary(a, b, K).first(), report.summary(b, a, K).first()
    assert there["missing_in_target"] == back["missing_in_source"]
    assert there["mismatched_rows"] == back["mismatched_rows"]
    assert there["matching_rows"] == back["matching_rows"]


@quick()
@given(source=rows, target=rows)
def test_multiset_diff_is_except_all_both_ways(spark, source, target):
    a, b = frame(spark, source), frame(spark, target)
    got = Counter()
    for r in diff.multiset_diff(a, b).collect():
        got[(r["side"], r["k"], r["a"], r["b"])] += r["copies"]
    want = Counter()
    for side, rest in (("source_only", a.exceptAll(b)), ("target_only", b.exceptAll(a))):
        for r in rest.collect():
            want[(side, *r)] += 1
    assert got == want


@quick()
@given(source=rows, target=rows)
def test_ordinal_pairs_nth_with_nth(spark, source, target):
    spec = CompareSpec(keys=("k",), duplicates="ordinal", null_safe_keys=True)
    got = Counter(r["row_status"] for r in diff.row_statuses(frame(spark, source), frame(spark, target), spec).collect())
    want = Counter()
    for key in {r[0] for r in source} | {r[0] for r in target}:
        a = sorted((r for r in source if r[0] == key), key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0))
        b = sorted((r for r in target if r[0] == key), key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0))
        for i in range(max(len(a), len(b))):
            if i >= len(b):
                want["missing_in_target"] += 1
            elif i >= len(a):
                want["missing_in_source"] += 1
            else:
                want["match" if a[i] == b[i] else "value_mismatch"] += 1
    assert got == want


def test_same_relation_is_identical(spark):
    df = frame(spark, [(1, "x", 0.5), (2, None, None)])
    got = report.summary(df, df, K).first()
    assert got["match_status"] == "identical" and got["match_score"] == 100.0 and got["rating"] == "Excellent"


def test_empty_sides_score_zero(spark):
    got = report.summary(frame(spark, []), frame(spark, []), K).first()
    assert got["match_score"] == 0.0 and got["match_status"] == "identical"


def test_null_keys_are_unmatched_or_matched_as_asked(spark):
    a, b = frame(spark, [(None, "x", 1.0)]), frame(spark, [(None, "x", 1.0)])
    plain = sorted(r["row_status"] for r in diff.keyed_diff(a, b, K).collect())
    assert plain == ["missing_in_source", "missing_in_target"]
    safe = CompareSpec(keys=("k",), null_safe_keys=True)
    assert status_of(diff.keyed_diff(a, b, safe)) == {None: "match"}


def test_repeated_key_is_not_multiplied(spark):
    a, b = frame(spark, [(1, "x", 1.0)] * 3), frame(spark, [(1, "x", 1.0)] * 2)
    got = diff.keyed_diff(a, b, K).collect()
    assert [(r["n_source"], r["n_target"], r["row_status"]) for r in got] == [(3, 2, "duplicate_key")]
    assert diff.value_diff(a, b, K).count() == 0


def test_value_diff_names_the_missing_side(spark):
    a = frame(spark, [(1, None, 1.0), (2, "x", None), (3, "x", 1.0)])
    b = frame(spark, [(1, "y", 1.0), (2, "x", 2.0), (3, "NULL", 1.25)])
    got = {(r["k"], r["column_name"]): r["difference_type"] for r in diff.value_diff(a, b, K).collect()}
    assert got == {
        (1, "a"): "MISSING_SOURCE",
        (2, "b"): "MISSING_SOURCE",
        (3, "a"): "VALUE_MISMATCH",
        (3, "b"): "VALUE_MISMATCH",
    }


def test_options_change_what_differs(spark):
    a, b = frame(spark, [(1, " Ab ", 1.0), (2, "q", None)]), frame(spark, [(1, "aB", 1.004), (2, "q", 7.0)])
    strict = status_of(diff.row_statuses(a, b, K))
    assert set(strict.values()) == {"value_mismatch"}
    loose = CompareSpec(
        keys=("k",), trim=True, case_sensitive=False, ignore_nulls=True, comparators={"b": within(0.01)}
    )
    assert set(status_of(diff.row_statuses(a, b, loose)).values()) == {"match"}
    folded = CompareSpec(keys=("k",), columns=("a",), trim=True, comparators={"a": fold_case})
    assert set(status_of(diff.row_statuses(a, b, folded)).values()) == {"match"}


def test_digest_agrees_with_values(spark):
    a, b = frame(spark, [(1, "x", 1.0), (2, "y", 2.0)]), frame(spark, [(1, "x", 1.0), (2, "y", 2.5)])
    fast = CompareSpec(keys=("k",), exact=False)
    assert status_of(diff.row_statuses(a, b, fast)) == status_of(diff.row_statuses(a, b, K))
    with pytest.raises(ValueError):
        CompareSpec(keys=("k",), exact=False, ignore_nulls=True)


def test_unknown_columns_are_named(spark):
    df = frame(spark, [])
    with pytest.raises(ValueError, match="nope"):
        diff.keyed_diff(df, df, CompareSpec(keys=("nope",)))


def test_missing_rows_keep_their_copies(spark):
    a = frame(spark, [(1, "x", 1.0)] * 3 + [(2, "y", 1.0), (None, "n", 1.0)])
    b = frame(spark, [(2, "z", 1.0)] * 4 + [(None, "m", 1.0)])
    plain = diff.missing_in_target(a, b, K).collect()
    assert Counter(r["k"] for r in plain) == {1: 3, None: 1}
    safe = diff.missing_in_target(a, b, CompareSpec(keys=("k",), null_safe_keys=True)).collect()
    assert Counter(r["k"] for r in safe) == {1: 3}


def test_composite_key_and_missing_rows(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "year int, month int, v string")
    b = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "year int, month int, v string")
    spec = CompareSpec(keys=("year", "month"))
    got = {(r["year"], r["month"]): r["row_status"] for r in diff.missing_rows(a, b, spec).collect()}
    assert got == {(1, 2): "missing_in_target", (2, 2): "missing_in_source"}


def test_row_index_numbers_every_row_once(spark):
    df = spark.range(500).selectExpr("id % 7 as g", "id % 3 as h")
    got = rowindex.with_row_index(df, ["g"]).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 501))
    assert [(r["g"], r["h"]) for r in got] == sorted((r["g"], r["h"]) for r in got)


def test_ordinals_of_hot_and_null_keys(spark):
    df = spark.range(400).selectExpr("case when id % 3 = 0 then 1 when id % 5 = 0 then null else id end as k", "id % 11 as v")
    got = rowindex.with_ordinal(df, ["k"]).collect()
    want = Counter()
    by_key = {}
    for r in df.collect():
        by_key.setdefault(r["k"], []).append(r["v"])
    for k, values in by_key.items():
        want.update((k, v, n) for n, v in enumerate(sorted(values), 1))
    assert Counter(map(tuple, got)) == want


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 < 7, 1, id) as k", "id as v")
    # Small partitions would be put together.
    change = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    change["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    kept = {c: spark.conf.get(c) for c in change}
    try:
        for c, v in change.items():
            spark.conf.set(c, v)
        got = rowindex.with_ordinal(df, ["k"]).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        ordinals = got.where("k = 1").agg(F.max("ordinal"), F.count_distinct("ordinal")).first()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / 16
    assert tuple(ordinals) == (14_000, 14_000)


KINDS = [None, float("nan"), float("inf"), 0.0, -0.0, 1.0, 1.0000001]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 4]), st.sampled_from(KINDS), st.sampled_from([None, "", " ", "x"])), max_size=8),
    right=st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 4]), st.sampled_from(KINDS), st.sampled_from([None, "", " ", "x"])), max_size=8),
)
def test_digest_equals_exact_with_nulls_and_repeats(spark, left, right):
    a = spark.createDataFrame(left, "k int, v double, t string")
    b = spark.createDataFrame(right, "k long, v double, t string")
    sides = []
    for exact in (True, False):
        rows = diff.row_statuses(a, b, CompareSpec(keys=("k",), exact=exact)).collect()
        sides.append(Counter(map(tuple, rows)))
    assert sides[0] == sides[1]
    assert sum(r["n_source"] * c for r, c in Counter(rows).items()) == len(left)


def test_digest_tells_null_places_and_widens_types(spark):
    a = spark.createDataFrame([(1, None, "x", 5), (2, "x", "y", 5)], "k int, a string, b string, n int")
    b = spark.createDataFrame([(1, "x", None, 5), (2, "x", "y", 5)], "k int, a string, b string, n long")
    got = {r["k"]: r["row_status"] for r in diff.row_statuses(a, b, CompareSpec(keys=("k",), exact=False)).collect()}
    assert got == {1: "value_mismatch", 2: "match"}


def test_keys_are_trimmed_and_folded(spark):
    a = spark.createDataFrame([("a ", 1), ("B", 2)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    spec = CompareSpec(keys=("k",), trim=True, case_sensitive=False)
    assert {r["row_status"] for r in diff.row_statuses(a, b, spec).collect()} == {"match"}
    assert diff.missing_rows(a, b, spec).count() == 0
    assert diff.missing_rows(a, b, CompareSpec(keys=("k",))).count() == 4


def test_repeated_keys_have_no_column_status(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "k int, v string")
    got = {r["k"]: (r["n_source"], r["n_target"], r["v_diff_type"]) for r in diff.wide_diff(a, b, CompareSpec(keys=("k",))).collect()}
    assert got == {1: (2, 1, None), 2: (1, 0, "MISSING_TARGET"), 3: (0, 1, "MISSING_SOURCE")}


def test_segments_of_repeated_keys(spark):
    a = spark.createDataFrame([(1, "S", 1), (1, "S", 2)], "k int, seg string, v int")
    b = spark.createDataFrame([(1, "T", 1)], "k int, seg string, v int")
    got = report.summary_by(a, b, CompareSpec(keys=("k",), columns=("v",)), "seg").collect()
    assert [(r["segment"], r["duplicate_rows_source"], r["duplicate_rows_target"]) for r in got] == [("S", 2, 1)]
    by_column = report.mismatches_by_column(a, b, CompareSpec(keys=("k",), columns=("v",), exact=False))
    assert by_column.columns == ["column_name", "mismatch_count"]


def test_each_side_is_read_once(spark, tmp_path):
    spark.range(20).selectExpr("id as k", "id as v").write.csv(str(tmp_path / "x"), header=True)
    side = spark.read.csv(str(tmp_path / "x"), header=True, schema="k long, v long")
    plan = diff.row_statuses(side, side.withColumn("v", F.col("v") + 1), CompareSpec(keys=("k",)))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 2


def test_key_profile_counts(spark):
    got = keys.key_profile(frame(spark, [(1, "x", 1.0)] * 3 + [(2, "x", 1.0), (None, "x", 1.0)]), ["k"]).first()
    assert got.asDict() == {
        "total_rows": 5,
        "null_key_rows": 1,
        "distinct_keys": 2,
        "duplicate_groups": 1,
        "duplicate_rows": 3,
        "surplus_rows": 2,
    }


def test_schema_diff(spark):
    a = spark.createDataFrame([], "id long, name string, old int")
    b = spark.createDataFrame([], "id string, name string, new int")
    got = {r["column_name"]: r["status"] for r in normalize.schema_diff(a, b).collect()}
    assert got == {"id": "type_changed", "name": "common", "old": "source_only", "new": "target_only"}


def test_digests_find_the_ranges_that_differ(spark, tmp_path):
    a = spark.range(100_000).selectExpr("id - 50000 as k", "id % 97 as v", "cast(id as string) as w")
    b = a.where("k != 7").withColumn("v", F.expr("if(k between 20000 and 20040, v + 1, v)")).union(spark.sql("select 60000L, 1L, 'x'"))
    spec = CompareSpec(keys=("k",))
    found = digests.differing(a, b, spec, fan=16, few=200)
    assert found.levels >= 3 and found.equal_rows > 190_000
    inside = [n for low, high in found.ranges() for n in (low, high)]
    assert all(any(low <= k <= high for low, high in found.ranges()) for k in (7, 20_000, 20_040, 60_000)) and len(inside) <= 20
    for df, name in ((a, "a"), (b, "b")):
        df.repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / name))
    files = [spark.read.parquet(str(tmp_path / n)) for n in "ab"]
    near = digests.within(files[0], "k", found)
    assert near.count() < 1_000
    assert "PushedFilters: [Or" in near._jdf.queryExecution().executedPlan().toString()
    assert digests.summary(*files, spec, fan=16, few=200).collect() == report.summary(*files, spec).collect()


@pytest.mark.parametrize("null_safe", [False, True])
def test_digest_summary_equals_the_exact_one(spark, null_safe):
    r = random.Random(6)
    rows = [(r.choice([None, r.randint(-40, 2000)]), r.choice([None, "x", "y"]), r.choice([None, 1.5, float("nan"), -0.0])) for _ in range(900)]
    other = [(k, j, 0.0 if v == 0 else v) for k, j, v in rows if k is None or k % 50] + [(5, "x", 1.5), (5, "x", 1.5)]
    schema = "k int, j string, v double"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, "k long, j string, v double")
    for keys in (("k",), ("k", "j")):
        spec = CompareSpec(keys=keys, null_safe_keys=null_safe)
        for how in ({"fan": 4, "few": 10}, {"fan": 1000}, {"fan": 8, "most": 2}):
            assert digests.summary(a, b, spec, **how).collect() == report.summary(a, b, spec).collect()
        assert digests.summary(a, a, spec).collect() == report.summary(a, a, spec).collect()
    nothing = a.limit(0)
    assert digests.summary(nothing, nothing, CompareSpec(keys=("k",))).collect() == report.summary(nothing, nothing, CompareSpec(keys=("k",))).collect()


def test_digests_over_dates_and_times(spark):
    a = spark.range(3000).selectExpr("date_add(date'1969-01-01', cast(id as int)) as d", "timestamp_micros(id * 86400000000 - 1) as t", "id as v")
    b = a.withColumn("v", F.expr("if(v = 2000, 0, v)"))
    for key in ("d", "t"):
        spec = CompareSpec(keys=(key,))
        assert digests.summary(a, b, spec, unique_keys=True, fan=8, few=10).collect() == report.summary(a, b, spec).collect()
    with pytest.raises(ValueError, match="ranges need"):
        digests.differing(a.selectExpr("cast(d as string) as d", "v"), b.selectExpr("cast(d as string) as d", "v"), CompareSpec(keys=("d",)))


def test_renamed_columns_are_found_by_their_values(spark):
    a = spark.range(3000).selectExpr("id as order_id", "id % 7 as kind", "concat('name ', id % 900) as name", "id * 0.5 as price", "id % 2 = 0 as flag")
    b = a.where("order_id % 3 > 0").selectExpr("price as cost", "cast(order_id as string) as ref", "concat(name, ' ') as label", "cast(kind as int) as kind", "flag as is_even")
    sets = [{c: {str(v).strip().removesuffix(".0") for r in df.collect() if (v := r[c]) is not None} for c in df.columns} for df in (a, b)]
    exact = {(x, y): len(m & n) / len(m | n) for x, m in sets[0].items() for y, n in sets[1].items() if m & n}
    got = {(r["source_column"], r["target_column"]): r["overlap"] for r in renames.column_likeness(a, b).collect()}
    lower = {k: v for k, v in got.items() if "flag" not in k[0]}
    assert lower == pytest.approx({k: v for k, v in exact.items() if "flag" not in k[0]})
    proposed = renames.proposed_mapping(a, b)
    assert renames.as_mapping(proposed) == {"cost": "price", "ref": "order_id", "label": "name", "is_even": "flag"}
    aligned = normalize.renamed(b, renames.as_mapping(proposed)).withColumn("order_id", F.col("order_id").cast("long"))
    assert report.summary(a, aligned, CompareSpec(keys=("order_id",), trim=True)).first()["missing_in_target"] == 1000
    # Many values: an estimate.
    c = spark.range(60_000).selectExpr("id as x")
    d = spark.range(30_000, 90_000).selectExpr("id as y")
    assert renames.column_likeness(c, d).first()["overlap"] == pytest.approx(1 / 3, abs=0.03)
    assert renames.proposed_mapping(a.limit(0), b) == []


def test_a_stopped_compare_goes_on(spark, tmp_path):
    rows = [(None if i % 40 == 0 else i, "x" if i % 11 else "y", None if i % 13 else 1.0) for i in range(400)]
    other = [(k, a, 2.0 if k and k % 9 == 0 else b) for k, a, b in rows if k is None or k % 17] + [(999, "z", 0.5), (5, "x", 0.5)]
    a, b = (spark.createDataFrame(r, SCHEMA) for r in (rows, other))
    want = diff.row_statuses(a, b, K)

    def fresh():
        return resumable.ResumableCompare(a, b, K, str(tmp_path / "run"), units=5)

    first = fresh()
    assert first.progress().first()["finished"] == 0 and first.rows() is None
    done = list(first.run(2))
    assert [d["unit"] for d in done] == [0, 1]
    so_far = first.progress().first()
    assert so_far["finished"] == 2 and so_far["units"] == 6
    assert so_far["mismatches"] == first.rows().where("row_status != 'match'").count() > 0
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "run" / "rows").rglob("*.parquet")}
    # A unit that was stopped while it wrote leaves rows without counters.
    (tmp_path / "run" / "rows" / "unit=2").mkdir()
    (tmp_path / "run" / "rows" / "unit=2" / "part-00000-half.parquet").write_bytes(b"half")
    again = fresh()
    assert [d["unit"] for d in again.run()] == [2, 3, 4, 5] and list(fresh().run()) == []
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    keys = ["k", "n_source", "n_target", "row_status"]
    assert Counter(map(tuple, again.rows().select(keys).collect())) == Counter(map(tuple, want.select(keys).collect()))
    total = again.progress().first()
    assert (total["rows_source"], total["rows_target"]) == (len(rows), len(other))

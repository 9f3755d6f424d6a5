"""Rules of the text audits as tables of cases."""

from evenkeel.operators import planaudit, queryaudit, submissions

SAFE = [
    "SELECT * FROM users",
    "with c as (select 1) select * from c",
    "  SELECT 1;  ",
    "SELECT updated_at, inserted_date FROM t",
    "SELECT 'a; b; c' FROM t",
    "/* a note */SELECT 1",
    "-- a note\nSELECT 1",
    "SELECT a FROM t UNION SELECT b FROM u",
    "SELECT 1; SELECT 2",
    "SELECTED things",
]
BLOCKED = {
    "DROP TABLE t": ["DROP", "must start"],
    "SELECT a INTO b FROM t": ["SELECT INTO"],
    "SELECT 1; SELECT 2; SELECT 3": ["Multi-statement"],
    "SELECT * FROM t /* updated_at */": ["Suspicious comments"],
    "SELECT 1 -- drop it": ["'DROP'", "Suspicious comments"],
    "SELECT 'please delete' FROM t": ["'DELETE'"],
    "SELECT REPLACE(a, 'x', 'y') FROM t": ["'REPLACE'"],
    "SELECT a FROM t UNION DELETE FROM u": ["UNION with dangerous"],
    "/* a note */ SELECT 1": ["Found: INVALID"],
    "EXPLAIN SELECT 1": ["Found: EXPLAIN"],
}


def audited(spark, texts, **how):
    df = spark.createDataFrame([(t,) for t in texts], "sql_text string")
    return {r["sql_text"]: r for r in queryaudit.audit_queries(df, **how).collect()}


def test_safe_queries_pass(spark):
    got = audited(spark, SAFE)
    assert {t: list(got[t]["violations"]) for t in SAFE} == {t: [] for t in SAFE}
    assert got["  SELECT 1;  "]["sanitized_query"] == "SELECT 1"
    assert got["SELECTED things"]["query_type"] == "SELECT"


def test_blocked_queries_name_the_reason(spark):
    got = audited(spark, BLOCKED)
    for text, reasons in BLOCKED.items():
        said = " | ".join(got[text]["violations"])
        assert not got[text]["is_safe"] and got[text]["sanitized_query"] is None
        assert all(r in said for r in reasons), (text, said)


def test_every_keyword_is_found_as_a_whole_word(spark):
    texts = [f"SELECT 1 {k.lower()} x" for k in queryaudit.DANGEROUS]
    got = audited(spark, texts)
    for keyword, text in zip(queryaudit.DANGEROUS, texts):
        assert got[text]["violations"] == [f"Dangerous keyword '{keyword}' detected"]


def test_empty_is_invalid_but_not_counted_as_blocked(spark):
    df = spark.createDataFrame([("",), ("   ",), (None,), ("SELECT 1",), ("DROP x",)], "sql_text string")
    stats = queryaudit.query_stats(queryaudit.audit_queries(df)).first()
    assert (stats["total_checks"], stats["blocked_checks"], stats["success_rate"]) == (5, 1, 80.0)


def test_strict_rejects_any_second_statement(spark):
    got = audited(spark, ["SELECT 1; SELECT 2", "SELECT 1;", "SELECT ';a' x;"], strict=True)
    assert [got[t]["is_safe"] for t in got] == [False, True, True]


PLANS = [
    ("oracle", "| 0 | SELECT STATEMENT | | 1000 | 50 (5) | TABLE ACCESS FULL", 0.05, 1000, 50, "low", True),
    ("oracle", "Cost: 200000 Rows: 10", 200.0, 10, 200000, "high", False),
    ("oracle", "Cost=100 MERGE JOIN CARTESIAN", 1.0, 0, 1000, "low", False),
    ("oracle", "| 10000000 | 500000 (5) |", 5000.0, 10_000_000, 500_000, "excessive", False),
    ("mysql", "rows: 1000 key: k Extra: Using filesort Using temporary", 1.501, 1000, 1500, "low", False),
    ("mysql", "type: ALL key: NULL rows: 1000 rows: 100000", 100.0, 100_000_000, 0, "medium", True),
    ("postgresql", '"Total Cost": 2000000.0, "Plan Rows": 10, Seq Scan', 200.0, 10, 2_000_000, "high", True),
    ("postgresql", "Sort (cost=0.00..431.00 rows=21000 width=4) Nested Loop", 0.0431, 21000, 431, "low", False),
]


def test_plan_estimates(spark):
    data = [(i, *p[:2]) for i, p in enumerate(PLANS)]
    got = {r["id"]: r for r in planaudit.audit_plans(spark.createDataFrame(data, "id int, engine string, plan string")).collect()}
    for i, (_, _, seconds, rows, cost, level, scan) in enumerate(PLANS):
        r = got[i]
        assert abs(r["estimated_time_sec"] - seconds) < 1e-9, PLANS[i]
        assert (r["estimated_rows"], r["estimated_cost"]) == (rows, cost)
        assert (r["cost_level"], r["has_full_table_scan"]) == (level, scan)
        assert r["is_acceptable"] == (seconds <= 300)
    assert got[3]["recommendations"] == ["⚠️ High row count: 10,000,000 rows. Consider adding WHERE filters."]
    assert got[7]["recommendations"] == [planaudit.NESTED_LOOP, planaudit.SORT]
    assert planaudit.NO_INDEX in got[5]["recommendations"]


def test_thresholds_are_exclusive(spark):
    plans = [(i, "oracle", f"Cost: {ms}") for i, ms in enumerate((60000, 60001, 180001, 300000, 300001))]
    got = planaudit.audit_plans(spark.createDataFrame(plans, "id int, engine string, plan string")).orderBy("id").collect()
    assert [r["cost_level"] for r in got] == ["low", "medium", "high", "high", "excessive"]
    assert [r["is_acceptable"] for r in got] == [True, True, True, True, False]


GOOD = "a longer description of the problem."
CONTENT = [
    ("fine title", GOOD, None),
    ("abcd", GOOD, "title too short"),
    ("t" * 201, GOOD, "title too long"),
    ("fine title", "short", "description too short"),
    ("fine title", "d " * 2501, "description too long"),
    ("fine title", "this is " + "o" * 21, "repeated characters"),
    ("fine title", "this is " + "o" * 20 + " ok", None),
    ("fine title", "see https://example.org now", "external links"),
    ("fine title", "see https://github.com/a/b now", None),
    ("fine title", "please Subscribe to this", "promotional content"),
    ("fine title", "resell the buyers list", None),
    ("fine title", "XY" * 25, "excessive caps"),
    ("fine title", "xy" * 25, None),
]


def test_content_rules(spark):
    data = [(i, t, d) for i, (t, d, _) in enumerate(CONTENT)]
    rows = submissions.validate(spark.createDataFrame(data, "id int, title string, description string"))
    got = {r["id"]: r["invalid_reason"] for r in rows.collect()}
    assert got == {i: c[2] for i, c in enumerate(CONTENT)}


QUALITY = [
    ("bug", "Crash", "What happened: it failed. Expected result was shown. For example 1. open it. Actual: nothing.", 10, "low"),
    ("bug", "Bad", "it broke", 1, "high"),
    ("feature", "Wish", "something somehow maybe stuff whatever. Why: it is what is needed. Expected to be so.", 2, "high"),
    ("other", "Title", "this sentence has no capital letters at all and goes on and on.", 6, "medium"),
    ("other", "Title", "This Text Has No Stop And It Is Longer Than Fifty Characters In All", 6, "medium"),
]


def test_quality_scores(spark):
    data = [(i, *q[:3]) for i, q in enumerate(QUALITY)]
    rows = submissions.quality(spark.createDataFrame(data, "id int, issue_type string, title string, description string"))
    got = {r["id"]: (r["quality_score"], r["severity"]) for r in rows.collect()}
    assert got == {i: (float(q[3]), q[4]) for i, q in enumerate(QUALITY)}


def test_relevance_needs_two_whole_words(spark):
    texts = ["slow query", "slow thing", "nothing here", "slow query pizza", "processing queryable", "Query of SQL"]
    data = [(i, "t", d) for i, d in enumerate(texts)]
    rows = submissions.relevance(spark.createDataFrame(data, "id int, title string, description string"))
    got = [r["category"] for r in rows.orderBy("id").collect()]
    assert got == ["relevant", "unclear", "irrelevant", "offtopic", "irrelevant", "relevant"]


def test_quality_says_what_to_improve(spark):
    data = [(1, "other", "Title", "something somehow maybe stuff whatever."), (2, "other", "Crash", GOOD + " Expected: more than that.")]
    rows = submissions.quality(spark.createDataFrame(data, "id int, issue_type string, title string, description string"))
    got = {r["id"]: (r["needs_improvement"], r["vague_word_count"]) for r in rows.collect()}
    assert got == {1: (True, 5), 2: (False, 0)}


def test_relevance_names_the_words(spark):
    data = [(1, "t", "a song, a pizza query"), (2, "t", "slow sql")]
    rows = submissions.relevance(spark.createDataFrame(data, "id int, title string, description string"))
    got = [r["relevance_reason"] for r in rows.orderBy("id").collect()]
    assert got == [submissions.OFFTOPIC_REASON + "pizza, song", submissions.TOPIC_REASON + "2"]


def test_missing_texts_are_empty(spark):
    empty = spark.createDataFrame([(1, None, None)], "id int, title string, description string")
    assert submissions.validate(empty).first()["invalid_reason"] == "title too short"
    row = submissions.quality(empty.selectExpr("*", "'bug' as issue_type")).first()
    assert row["quality_score"] == 1.0 and row["severity"] == "high"

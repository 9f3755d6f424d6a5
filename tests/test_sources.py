"""Files, archives, databases and the history store."""

import random
import threading
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evenkeel import session
from evenkeel.operators import diff, report
from evenkeel.sources import archives, csvsplit, files, named, store
from evenkeel.sources.snapshots import Conflict, SnapshotTable
from evenkeel.spec import CompareSpec

AT = datetime(2024, 5, 1, 12)


def test_csv_is_text_and_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", value', "007"), (2, None, "x")], "id int, name string, code string")
    path = files.export_csv(df, str(tmp_path / "out"), order_by=["id"])
    back = files.read_csv(spark, path)
    assert set(back.dtypes) == {("id", "string"), ("name", "string"), ("code", "string")}
    assert {tuple(r) for r in back.collect()} == {("1", 'a "quoted", value', "007"), ("2", None, "x")}


def test_unreadable_csv_lines_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,5\n2,oops\n")
    rows = files.read_csv(spark, str(tmp_path), "id int, n int, bad string", corrupt_column="bad").cache()
    assert [r["bad"] for r in rows.orderBy("id").collect()] == [None, "2,oops"]


def test_documents_by_name(spark, tmp_path):
    for day in ("20240101", "20240102"):
        (tmp_path / f"statement.C1.{day}.final.csv").write_text("id,v\n1,2\n")
    (tmp_path / "gl.A.B.20240101.csv").write_text("id,v\n9,9\n")
    rows = files.read_documents(spark, str(tmp_path), "statement", payment_date="20240102").collect()
    assert [(r["id"], r["contract_number"], r["payment_date"]) for r in rows] == [("1", "C1", "20240102")]
    listed = files.list_documents(spark, str(tmp_path), "statement.*")
    assert listed.columns == ["path", "size_bytes", "modified_at"] and listed.count() == 2
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unknown document kind"):
        files.document_pattern("letter")
    sizes = files.file_sizes(files.read_csv(spark, str(tmp_path / "gl.A.B.20240101.csv"))).collect()
    assert [r["file_size"] for r in sizes] == [9]


def test_documents_keep_odd_texts(spark, tmp_path):
    rows = [("1", 'say "hi", now', ""), ("2", None, " b "), ("3", "two\nlines", "x,y"), ("4", "", None)]
    df = spark.createDataFrame(rows, "id string, v string, w string")
    contract = F.concat(F.lit("C"), F.col("id").cast("int") % 2)
    fields = {"prefix": F.lit("statement"), "payment_date": F.lit("20240101"), "transform_subtype": F.lit("final")}
    root = files.write_documents(df, str(tmp_path / "d"), "statement", contract_number=contract, extension=F.lit("csv"), **fields)
    names = ["statement.C0.20240101.final.csv", "statement.C1.20240101.final.csv"]
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith(".")) == names
    back = files.read_documents(spark, root, "statement", multiline=True)
    assert sorted(map(tuple, back.select("id", "v", "w").collect())) == rows
    assert {r["contract_number"] for r in back.collect()} == {"C0", "C1"}
    one = files.read_documents(spark, root, "statement", contract_number="C0")
    assert sorted(map(tuple, one.select("id", "v", "w", "payment_date").collect())) == [
        ("2", None, " b ", "20240101"), ("4", "", None, "20240101")
    ]


@pytest.mark.parametrize(
    "lines, inside, ends",
    [
        ("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b""",c', False, False), ('5" x,"', False, True),
        ('5" x', False, False), ('"a"b"c,"d', False, True), ('a",b', True, False), ('a"",b', True, True), ('a",",",b', True, False),
        ('""', False, False), ("", True, True), ('"a', True, False), ('",', True, False), ('","', True, True),
    ],
)
def test_state_at_the_end_of_a_line(lines, inside, ends):
    assert csvsplit.ends_inside(lines, inside) is ends


def _odd_csv(seed, rows):
    r = random.Random(seed)

    def field():
        if r.random() < 0.5:
            return r.choice(["a", "bc", "", " x ", '5" pipe', "é", "it's"])
        return '"' + "".join(r.choice(["a", ",", "\n", '""', " ", "long text ", "é"]) for _ in range(r.randint(0, 12))) + '"'

    lines = [",".join(field() for _ in range(3)) if r.random() > 0.05 else "" for _ in range(rows)]
    return "h1,h2,h3\n" + "\n".join(lines) + r.choice(["", "\n"])


def test_split_reading_equals_whole_reading(spark, tmp_path):
    for seed in range(3):
        (tmp_path / f"odd{seed}.csv").write_text(_odd_csv(seed, 40), newline="")
    (tmp_path / "odd_crlf.csv").write_text('\ufeffh1,h2,h3\r\na,"b, c",d\r\n\r\ne,,"f"\r\n', newline="")
    (tmp_path / "odd_long.csv").write_text('h1,"h\n2",h3\na,"' + "many\nlines " * 100 + '",z\nlast,,""', newline="")
    (tmp_path / "odd_open.csv").write_text('h1,h2,h3\na,b,c\nd,"never closed\ne,f', newline="")
    (tmp_path / "odd_head.csv").write_text("h1,h2,h3\n", newline="")
    (tmp_path / "odd_none.csv").write_text("", newline="")
    schema = "a string, b string, c string"
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": "\u0000", "emptyValue": ""}
    whole = sorted(map(str, spark.read.schema(schema).options(**options).csv(str(tmp_path)).collect()))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("134217728", "150"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = files.read_csv(spark, str(tmp_path), schema, multiline=True, name_column="file")
            assert sorted(map(str, found.drop("file").collect())) == whole
        records = csvsplit.records(spark, str(tmp_path / "odd0.csv"))
        assert records.rdd.getNumPartitions() > 4  # one file, several tasks
        names = {r["file"] for r in found.collect()}
        assert {"odd0.csv", "odd_long.csv"} <= names and "odd_head.csv" not in names
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    untyped = files.read_csv(spark, str(tmp_path / "odd0.csv"), multiline=True, header=False)
    assert untyped.columns == ["_c0", "_c1", "_c2"] and untyped.where("_c0 = 'h1'").count() == 1


def test_sql_sides_take_braces_and_leave_views_alone(spark):
    df = spark.range(3).withColumnRenamed("id", "n")
    spark.range(7).createOrReplaceTempView("mine")
    for text, rows in (
        ("select '{a}' as j, n from {mine}", [("{a}", 0), ("{a}", 1), ("{a}", 2)]),
        ("select '{}' as j, n from mine where n > 1; ", [("{}", 2)]),
        ("with w as (select n from mine) select '{' as j, n from w join {mine} using (n) where n < 1 -- {x}", [("{", 0)]),
    ):
        assert sorted(map(tuple, named.read_sql(spark, text, {"mine": df}).collect())) == rows
    assert spark.table("mine").count() == 7
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("evenkeel_")]
    assert named.read_sql(spark, "select '{a}' as j", {}).collect() == [("{a}",)]


def test_report_keys_are_told_apart(spark):
    keys = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("a\\", "b")]
    rows = spark.createDataFrame(keys, "a string, b string").select(report.row_key(["a", "b"]).alias("k")).collect()
    assert [r["k"] for r in rows] == ["a|\\N", "\\N|a", "a\\|b|c", "a|b\\|c", "\\\\N|x", "\\N|x", "a\\\\|b"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", 'id,name\n1,"x, y"\n2,"line\nbreak"\n')
        z.writestr("deep/two.csv", "name,id,name\nz,3,again\n\nshort\n")
        z.writestr("notes.txt", "no")
    rows = archives.read_zip_csv(spark, str(tmp_path))
    picked = rows.select("member", "row_number", archives.field("id"), archives.field("name"), archives.field("no"))
    assert sorted(map(tuple, picked.collect())) == [
        ("deep/two.csv", 1, "3", "z", None),
        ("deep/two.csv", 2, None, "short", None),
        ("one.csv", 1, "1", "x, y", None),
        ("one.csv", 2, "2", "line\nbreak", None),
    ]
    assert rows.where("member = 'deep/two.csv' and row_number = 1").first()["fields"] == ["z", "3", "again"]


def _archive(path, texts, **how):
    with zipfile.ZipFile(path, "w", **how) as z:
        for name, text in texts.items():
            z.writestr(name, text)


def test_members_of_one_archive_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    texts = {f"m{i:02}.csv": "id,v\n" + "".join(f"{i},{n}\n" for n in range(300)) for i in range(12)}
    # Tiny limits make the writer use the records of archives beyond 4 GB and 65,535 members.
    with monkeypatch.context() as small:
        small.setattr(zipfile, "ZIP64_LIMIT", 100)
        small.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
        _archive(tmp_path / "deep" / "big.zip", texts, compression=zipfile.ZIP_DEFLATED)
    assert b"PK\x06\x06" in (tmp_path / "deep" / "big.zip").read_bytes()
    rows = archives.read_zip_csv(spark, str(tmp_path), task_bytes=1500)
    tasks = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("member").alias("n")).collect()
    assert len(tasks) >= 6 and sum(r["n"] for r in tasks) == 12
    assert rows.count() == 3600 and rows.where("fields[0] != cast(substr(member, 2, 2) as int)").count() == 0
    one = archives.read_zip_csv(spark, str(tmp_path), "m0[12].csv")
    assert sorted(r["member"] for r in one.select("member").distinct().collect()) == ["m01.csv", "m02.csv"]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_members_by_method(spark, tmp_path, method):
    body = "\ufeffid,name\n" + "".join(f'{i},"näme, {i % 7}"\n' for i in range(40_000)) + "\n"
    _archive(tmp_path / "a.zip", {"one.csv": body, "empty.csv": "", "head.csv": "id\n", "dir/": ""}, compression=method)
    rows = archives.read_zip_csv(spark, f"file://{tmp_path}/a.zip")
    assert rows.count() == 40_000 and rows.agg(F.max("row_number")).first()[0] == 40_000
    assert rows.where("row_number = 9").select(archives.field("name")).first()[0] == "näme, 1"


def test_other_members_are_not_read_and_damage_is_found(spark, tmp_path):
    _archive(tmp_path / "a.zip", {"good.csv": "id\n1\n", "bad.csv": "id\n2\n"})
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"id\n2")] = 0x78  # the second member's check sum is wrong
    (tmp_path / "a.zip").write_bytes(raw)
    assert [r["fields"] for r in archives.read_zip_csv(spark, str(tmp_path), "g*.csv").collect()] == [["1"]]
    assert archives.read_zip_csv(spark, str(tmp_path), "none*").count() == 0
    with pytest.raises(Exception, match="damaged"):
        archives.read_zip_csv(spark, str(tmp_path)).collect()


def test_archives_round_trip(spark, tmp_path):
    rows = [("a.zip", "x.csv", 2, 'say "hi"'), ("a.zip", "x.csv", 1, None), ("a.zip", "y.csv", 3, "two\nlines"), ("b/c.zip", "x.csv", 4, "é")]
    df = spark.createDataFrame(rows, "archive string, member string, id int, v string")
    for _ in range(2):  # writing again replaces
        written = archives.write_zip_csv(df, str(tmp_path / "out"), "archive", "member", ["id"]).collect()
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in written) == ["/out/a.zip", "/out/b/c.zip"]
    found = archives.read_zip_csv(spark, str(tmp_path / "out"))
    got = found.select("member", "row_number", archives.field("id"), archives.field("v")).collect()
    assert sorted(map(tuple, got)) == [("x.csv", 1, "1", ""), ("x.csv", 1, "4", "é"), ("x.csv", 2, "2", 'say "hi"'), ("y.csv", 1, "3", "two\nlines")]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.*")) == ["a.zip", "c.zip"]


@pytest.fixture(scope="module")
def derby(spark):
    url = "jdbc:derby:memory:evenkeel;create=true"
    df = spark.range(1, 101).selectExpr("id as ID", "id % 4 as GRP", "cast(id as string) as NAME")
    df.write.format("jdbc").option("url", url).option("dbtable", "T").save()
    return {"url": url}


def test_jdbc_reads_tables_and_queries(spark, derby):
    everything = named.read_jdbc(spark, derby, table="T")
    assert everything.columns == ["id", "grp", "name"] and everything.count() == 100
    some = named.read_jdbc(spark, derby, table="T", query="SELECT ID FROM T WHERE GRP = 1;", order_by=["id"], limit=2)
    assert [r["id"] for r in some.collect()] == [1, 5]
    filtered = named.read_jdbc(spark, derby, table="T", where="grp = 2")
    assert filtered.count() == 25
    assert "PushedFilters: [*IsNotNull(GRP), *EqualTo(GRP,2)]" in filtered._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        named.read_jdbc(spark, derby)


def test_jdbc_partitions_find_their_bounds(spark, derby):
    split = named.read_jdbc(spark, derby, table="T", partition=named.Partitioning("ID", 4))
    assert split.rdd.getNumPartitions() == 4 and split.count() == 100


def test_jdbc_ranges_of_equally_many_rows(spark, derby):
    skewed = spark.range(4000).selectExpr(
        "case when id % 50 = 0 then null when id < 3000 then cast(pow(1.006, id) as bigint) else 10000000000 + id end as N",
        "timestamp_seconds(1700000000 + cast(pow(1.005, id % 2000) as bigint)) as T", "cast(date_add(date'2024-01-01', cast(sqrt(id) as int)) as date) as D",
        "cast(pow(1.004, id) as double) as X", "id as ID",
    )
    skewed.write.format("jdbc").mode("overwrite").option("url", derby["url"]).option("dbtable", "SKEWED").save()
    for column, values in (("N", 3920), ("X", 4000), ("T", 4000), ("D", 4000), ("ID", 4000)):
        how = named.Partitioning(column, 8, even=True)
        rows = named.read_jdbc(spark, derby, query="SELECT * FROM SKEWED;", partition=how)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert rows.count() == sum(sizes) == 4000 and rows.select("id").distinct().count() == 4000
        assert max(sizes) < 2 * values / 8 and 8 <= len(sizes) <= 18, (column, sizes)
    one = named.read_jdbc(spark, derby, table="SKEWED", where="id < 10", partition=named.Partitioning("ID", 3, even=True))
    assert sorted(r["id"] for r in one.collect()) == list(range(10))
    empty = named.read_jdbc(spark, derby, query="SELECT * FROM SKEWED WHERE ID < 0", partition=named.Partitioning("ID", 3, even=True))
    assert empty.count() == 0


def test_two_sources_compare(spark, derby):
    other = spark.range(1, 101).selectExpr("id", "id % 4 as grp", "if(id = 7, 'seven', cast(id as string)) as name")
    got = report.summary(named.read_jdbc(spark, derby, table="T"), other, CompareSpec(keys=("id",))).first()
    assert (got["matching_rows"], got["mismatched_rows"]) == (99, 1)


def test_named_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    known = {
        "books": {"type": "oracle", "host": "h", "port": 1521, "service_name": "s", "user": "u", "password": "p"},
        "shop": {"type": "postgresql", "host": "h", "port": 5432, "database": "d"},
        "lake": {"type": "parquet", "path": str(tmp_path / "p"), "description": "files"},
    }
    assert named.resolve("books", known)["url"] == "jdbc:oracle:thin:@//h:1521/s"
    assert named.resolve("shop", known)["url"] == "jdbc:postgresql://h:5432/d"
    assert named.read_named(spark, "lake", known).count() == 3
    with pytest.raises(KeyError, match="books, lake, shop"):
        named.resolve("nope", known)


def test_preview_is_limited(spark):
    assert files.preview(spark.range(500), ["id"], n=100).count() == 100
    with pytest.raises(ValueError, match="at most 100"):
        files.preview(spark.range(500), ["id"], n=200)


def test_csv_keeps_blanks_empty_texts_and_lines(spark, tmp_path):
    rows = [(1, "  pad "), (2, ""), (3, None), (4, "a\nb"), (5, 'say "hi", ok'), (6, "NULL"), (7, "\\N"), (8, "é")]
    df = spark.createDataFrame(rows, "k int, v string")
    for encoding in ("UTF-8", "UTF-16LE"):
        path = files.export_csv(df, str(tmp_path / encoding), encoding=encoding)
        back = files.read_csv(spark, path, "k int, v string", multiline=True, encoding=encoding)
        assert sorted(map(tuple, back.collect())) == rows


def test_the_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.workspace(Session())


def test_folders_can_be_released(spark):
    session.release(spark)
    df = session.pinned(spark.range(5))
    assert df.count() == 5 and session.release(spark) == 1
    assert session.release(spark) == 0


def test_history_store(spark, tmp_path):
    runs = store.HistoryStore(spark, str(tmp_path / "h"))
    name = store.run_id("select 1", "select 2", AT)
    assert name.startswith("20240501_120000_") and len(name) == 24
    runs.create_session(name, AT, test_type="database", client_id="c1", ignore_columns=["x"])
    runs.set_status(name, "running", AT.replace(minute=5))
    runs.set_status(name, "completed", AT.replace(minute=6))
    runs.create_session("open", AT, client_id="c2")
    runs.record_file(name, "source", AT, file_path="/a.csv", row_count=3, columns=["id"])
    runs.log_audit(AT, {"rows": 3}, session_id=name, client_id="c1", tool_name="compare", success=True)
    state = {r["session_id"]: r for r in runs.sessions().collect()}
    assert state[name]["status"] == "completed" and state[name]["execution_time_ms"] == 60000
    assert state["open"]["status"] == "pending" and list(state[name]["ignore_columns"]) == ["x"]
    assert runs.table("audit").first()["request_metadata"] == '{"rows": 3}'

    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id int, v string")
    spec = CompareSpec(keys=("id",))
    runs.save_summary(name, report.summary(a, b, spec), AT, 1.5)
    runs.save_mismatches(name, diff.value_diff(a, b, spec), AT)
    assert runs.table("results").first()["match_score"] == 50.0
    assert runs.table("mismatches").select("source_value", "target_value").collect() == [("y", "z")]

    before = {t: runs.table(t).count() for t in store.TABLES}
    assert len(runs.snapshots("events").snapshot().entries) == 4
    runs.compact()
    assert {t: runs.table(t).count() for t in store.TABLES} == before
    assert len(runs.snapshots("events").snapshot().entries) == 1

    assert set(runs.remove_expired(datetime(2024, 7, 1), 30)) == {"events", "files", "results", "mismatches", "sessions"}
    assert [r["session_id"] for r in runs.table("sessions").collect()] == ["open"]
    assert runs.table("files").count() == 0 and runs.table("events").count() == 1
    assert runs.table("audit").count() == 1
    with pytest.raises(ValueError):
        runs.set_status(name, "lost", AT)
    with pytest.raises(LookupError):
        store.HistoryStore(spark, str(tmp_path / "new")).table("results")


def _log(spark, rows):
    return spark.createDataFrame([(k, AT.replace(day=day), v) for k, day, v in rows], "k string, ts timestamp, v long")


def _kept(table, version=None):
    return sorted((r["k"], r["v"]) for r in table.read(version).collect())


def test_snapshots_upsert_and_compact(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), keys=["k"])
    assert table.read() is None and table.compact() == set() and table.remove(_log(spark, []), "k") == set()
    table.upsert(_log(spark, [("a", 1, 1), ("b", 1, 2), ("b", 1, 3), (None, 2, 4)]), "ts", ["v"])
    table.upsert(_log(spark, [("a", 3, 9), ("c", 3, 5), (None, 3, 6)]), "ts", ["v"])
    want = [("a", 9), ("b", 3), ("c", 5)]
    assert sorted((r["k"] or "", r["v"]) for r in table.read().collect()) == [("", 6), *want]
    assert sorted((r["k"] or "", r["v"]) for r in table.read(1).collect()) == [("", 4), ("a", 1), ("b", 3)]
    table.append(_log(spark, []), "ts")
    table.compact()
    assert not any(e.upsert for e in table.snapshot().entries) and table.read().count() == 4
    table.upsert(_log(spark, [("b", 1, 1)]), "ts", ["v"])
    assert ("b", 1) in {(r["k"], r["v"]) for r in table.read().collect()}
    assert table.vacuum(keep=1) > 0 and table.read().count() == 4 and len(table.versions()) == 1
    with pytest.raises(ValueError, match="nothing to replace"):
        SnapshotTable(spark, str(tmp_path / "u")).upsert(_log(spark, []), "ts", ["v"])
    with pytest.raises(ValueError, match="column 'v'"):
        table.append(_log(spark, [("z", 1, 1)]).withColumn("v", F.lit("text")), "ts")


def test_untouched_days_keep_their_files(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.append(_log(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 3, 4)]), "ts")
    table.append(_log(spark, [("a", 4, 5)]).withColumn("more", F.lit("x")), "ts")
    before = {e.period: e for e in table.snapshot().entries}
    assert table.remove(spark.createDataFrame([("a",), ("d",)], "k string"), "k") == {"2024-05-01", "2024-05-03", "2024-05-04"}
    after = {e.period: e for e in table.snapshot().entries}
    assert set(after) == {"2024-05-02", "2024-05-03"} and after["2024-05-02"] == before["2024-05-02"]
    assert _kept(table) == [("b", 2), ("c", 3)] and _kept(table, 2) == [("a", 1), ("a", 5), ("b", 2), ("c", 3), ("d", 4)]
    assert table.read().columns == ["k", "ts", "v", "more", "period"]
    assert table.compact() == set()  # one file a day already


@pytest.mark.parametrize("local", [True, False])
def test_two_writers_lose_no_commit(spark, tmp_path, local):
    path = str(tmp_path / "t")

    def writer():
        table = SnapshotTable(spark, path, keys=["k"])
        table.files.local = local
        return table

    one, two = writer(), writer()
    one.append(_log(spark, [("a", 1, 1), ("b", 1, 2)]), "ts")
    # Both take the same number; the second goes on from the first's version.
    seen = two.snapshot()
    create = two.files.create_once
    first = [True]

    def late(file, text):
        if first.pop() if first else False:
            one.upsert(_log(spark, [("a", 1, 7)]), "ts", ["v"])
        return create(file, text)

    two.files.create_once = late
    two.append(_log(spark, [("c", 2, 3)]), "ts")
    assert two.versions() == [1, 2, 3] and _kept(one) == [("a", 7), ("b", 2), ("c", 3)]
    # A compaction that began before an upsert does not bring old rows back.
    first.append(True)
    one.upsert(_log(spark, [("b", 1, 8)]), "ts", ["v"])
    two.compact()
    assert _kept(one) == [("a", 7), ("b", 8), ("c", 3)]
    # Two that replace the same folders cannot both do so.
    first.append(True)
    one.upsert = lambda *a: one.remove(spark.createDataFrame([("c",)], "k string"), "k")
    with pytest.raises(Conflict):
        two.remove(spark.createDataFrame([("c",), ("b",)], "k string"), "k")
    assert _kept(one) == [("a", 7), ("b", 8)] and seen.version == 1
    threads = [threading.Thread(target=lambda i=i: writer().append(_log(spark, [(f"t{i}", 9, i)]), "ts")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(_kept(one)) == 6


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    got = {r["column_name"]: r.asDict() for r in files.profile(df).collect()}
    assert (got["v"]["null_count"], got["v"]["min_value"], got["id"]["max_value"]) == (1, "a", "2")
    assert df.agg(F.count("*")).first()[0] == 2

"""Input relations of the registered queries, as SQL that Spark and DuckDB share.

Each derives a compare side, a log or a history table from whole driver tables.
Key remainders make rows that are absent or changed on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.session import spread

TABLES = ("customer", "documents", "events", "lineitem", "orders", "part")

RELATIONS = {
    # Unique key; rows missing on either side; changed values.
    "src": """
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice
        from orders where o_orderkey % 89 <> 0""",
    "tgt": """
        select o_orderkey, o_custkey,
               case when o_orderkey % 41 = 0 then 'X' else o_orderstatus end as o_orderstatus,
               case when o_orderkey % 31 = 0 then o_totalprice + 0.5 else o_totalprice end as o_totalprice
        from orders where o_orderkey % 97 <> 0""",
    # All orders, and a copy that differs in a few stretches of keys.
    "ball": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders",
    "bpart": """
        select o_orderkey, case when o_orderkey % 4096 = 9 then o_custkey + 1 else o_custkey end as o_custkey, o_orderstatus,
               case when o_orderkey % 4096 < 24 and o_orderkey % 3 = 0 then o_totalprice + 0.5 else o_totalprice end
                 as o_totalprice
        from orders where o_orderkey % 4096 <> 77""",
    # NULL keys, NULL values, padding and case noise.
    "nsrc": """
        select case when c_custkey % 101 = 0 then null else c_custkey end as k, c_name as name,
               case when c_custkey % 13 = 0 then null else c_acctbal end as bal, c_mktsegment as seg
        from customer""",
    "ntgt": """
        select case when c_custkey % 103 = 0 then null else c_custkey end as k,
               case when c_custkey % 7 = 0 then '  ' || c_name || ' ' else c_name end as name,
               case when c_custkey % 17 = 0 then null else c_acctbal end as bal,
               case when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end as seg
        from customer""",
    # Composite key that repeats.
    "lsrc": """
        select l_orderkey, l_linenumber, l_partkey, l_quantity
        from lineitem where l_partkey % 53 <> 0""",
    "ltgt": """
        select l_orderkey, l_linenumber, l_partkey,
               case when l_partkey % 29 = 0 then l_quantity + 1 else l_quantity end as l_quantity
        from lineitem where l_partkey % 59 <> 0""",
    # Values that are hard to write and to compare: not a number, infinite, large, empty, padded, of two lines.
    "osrc": """
        select o_orderkey as k,
               case o_orderkey % 8 when 0 then cast('NaN' as double) when 1 then cast('Infinity' as double)
                                   when 2 then 1e33 when 3 then null when 4 then 1e0 else o_totalprice end as num,
               case o_orderkey % 9 when 0 then '' when 1 then null when 2 then '  pad '
                                   when 3 then 'line' || chr(10) || 'break, "said"' else o_orderpriority end as txt
        from orders where o_orderkey % 89 <> 0""",
    "otgt": """
        select o_orderkey as k,
               case o_orderkey % 16 when 0 then cast('NaN' as double) when 8 then null
                                    when 1 then cast('Infinity' as double) when 9 then cast('-Infinity' as double)
                                    when 2 then 1e33 when 10 then 2e33 when 3 then null when 11 then 5e0
                                    when 4 then 1e0 when 12 then 1.0000001e0 else o_totalprice end as num,
               case o_orderkey % 18 when 0 then '' when 9 then null when 1 then null when 10 then ''
                                    when 2 then '  pad ' when 11 then 'pad'
                                    when 3 then 'line' || chr(10) || 'break, "said"' when 12 then 'line break, "said"'
                                    else o_orderpriority end as txt
        from orders where o_orderkey % 97 <> 0""",
    # NULLs that change columns, and equal numbers of two types.
    "gsrc": """
        select o_orderkey, cast(o_custkey % 5 as int) as a, case when o_orderkey % 3 = 0 then null else 'x' end as b,
               case when o_orderkey % 3 = 0 then 'x' end as c from orders where o_orderkey % 89 <> 0""",
    "gtgt": """
        select o_orderkey, cast(o_custkey % 5 as bigint) as a,
               case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then null else 'x' end as b,
               case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'x' end as c
        from orders where o_orderkey % 97 <> 0""",
    # Orders whose dates are written in two formats.
    "dsrc": """
        select o_orderkey, cast(cast(o_orderdate as date) as string) as order_day, o_totalprice
        from orders""",
    "dtgt": """
        select o_orderkey,
               split_part(cast(cast(o_orderdate as date) as string), '-', 3) || '/'
               || split_part(cast(cast(o_orderdate as date) as string), '-', 2) || '/'
               || split_part(cast(cast(o_orderdate as date) as string), '-', 1) as order_day,
               case when o_orderkey % 31 = 0 then o_totalprice + 0.004
                    when o_orderkey % 37 = 0 then o_totalprice + 0.5 else o_totalprice end as o_totalprice
        from orders""",
    # Submission log and block intervals.
    "subm": """
        select event_id as id, cast(user_id as string) as session_id, cast(user_id % 10 as string) as client_id,
               case event_type when 'error' then 'bug' when 'signup' then 'feature' else 'improvement' end
                 as submission_type,
               event_type || ' item ' || cast(event_id % 4 as string) as title,
               'description ' || props as description,
               md5(lower(event_type || ' item ' || cast(event_id % 4 as string) || ' description ' || props))
                 as content_hash,
               cast(event_id % 11 as double) as quality_score,
               case when event_id % 3 = 0 then event_id end as issue_number,
               case when event_id % 3 = 0 then 'created' when event_id % 3 = 1 then 'submitted' else 'failed' end
                 as status,
               ts as created_at
        from events""",
    "blocks": """
        select cast(user_id as string) as identifier, 'session' as identifier_type, ts as blocked_at,
               ts + interval 24 hours as unblock_at, 'rate limit' as reason
        from events where event_type = 'error' and event_id % 50 = 0""",
    # Run history.
    "sess": """
        select cast(o_orderkey as string) as session_id, cast(o_custkey % 25 as string) as client_id,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
               o_orderdate as created_at, o_orderdate + interval 1 hour as completed_at,
               cast(o_orderkey % 41 as double) + 60 as match_score
        from orders""",
    "files": """
        select cast(l_orderkey as string) as session_id,
               case when l_linenumber % 2 = 0 then 'target' else 'source' end as file_role,
               'part_' || cast(l_partkey as string)
                 || case when l_partkey % 9 = 0 then '_customer.csv' else '.csv' end as file_path,
               l_shipdate as downloaded_at, cast(l_quantity * 1000 as bigint) as row_count
        from lineitem""",
    "status_events": """
        select cast(o_orderkey as string) as session_id, 'pending' as status, o_orderdate as event_ts from orders
        union all
        select cast(o_orderkey as string), 'running', o_orderdate + interval 5 minutes
        from orders where o_orderkey % 10 <> 0
        union all
        select cast(o_orderkey as string), case o_orderstatus when 'F' then 'completed' else 'failed' end,
               o_orderdate + interval 65 minutes
        from orders where o_orderstatus <> 'O'""",
    "runs": """
        select cast(o_orderkey as string) as session_id, o_totalprice / 1000 as comparison_time_sec,
               o_custkey as total_rows, o_totalprice / 7 as size_mb, o_orderdate as created_at
        from orders""",
    "calls": """
        select event_id as id, cast(user_id as string) as session_id, cast(user_id % 10 as string) as client_id,
               event_type as tool_name, event_type <> 'error' as success, ts as created_at, user_id, event_type
        from events""",
    # Texts for the audits.
    "qlog": """
        select o_orderkey as id,
               case o_orderkey % 12
                 when 0 then 'SELECT * FROM t WHERE id = ' || cast(o_orderkey as string) || ';'
                 when 1 then 'with c as (select 1 as a) select * from c'
                 when 2 then 'delete from t where id = ' || cast(o_orderkey as string)
                 when 3 then 'SELECT inserted_date, updated_by FROM t'
                 when 4 then 'SELECT * FROM t /* drop table t */'
                 when 5 then 'SELECT a INTO b FROM t'
                 when 6 then 'SELECT 1; SELECT 2; SELECT 3'
                 when 7 then 'SELECT x FROM t WHERE b = ''one; two; three'''
                 when 8 then 'SELECT a FROM t UNION SELECT b FROM u; DROP TABLE t'
                 when 9 then '/* note */SELECT ' || cast(o_custkey as string)
                 when 10 then '/* note */ SELECT 1 -- updated ' || o_orderpriority
                 else '   ' end as sql_text
        from orders""",
    "plog": """
        select p_partkey as id,
               case p_partkey % 3 when 0 then 'oracle' when 1 then 'mysql' else 'postgresql' end as engine,
               case p_partkey % 3
                 when 0 then '| 0 | SELECT STATEMENT | | ' || cast(p_partkey * 5000 as string) || ' | '
                   || cast(p_size * 1000 as string) || ' (5) | '
                   || case when p_size % 2 = 0 then 'TABLE ACCESS FULL' else 'INDEX UNIQUE SCAN' end
                   || case when p_size % 7 = 0 then ' MERGE JOIN CARTESIAN' else '' end
                 when 1 then 'table: t type: ' || case when p_size % 2 = 0 then 'ALL key: NULL' else 'ref key: k' end
                   || ' rows: ' || cast(p_partkey * 1000 as string) || ' table: u type: ref rows: '
                   || cast(p_size as string)
                   || case when p_size % 3 = 0 then ' Extra: Using filesort' else '' end
                   || case when p_size % 5 = 0 then ' Using temporary' else '' end
                 else '"Node Type": "' || case when p_size % 2 = 0 then 'Seq Scan' else 'Index Scan' end
                   || case when p_size % 3 = 0 then ' Nested Loop Sort' else '' end
                   || '", "Total Cost": ' || cast(p_size * 100000 as string) || '.50, "Plan Rows": '
                   || cast(p_partkey * 2000 as string) end as plan
        from part""",
    # Whole documents as submissions; endings add the words the rules look for. Each 400 share three sessions and two
    # clients.
    "notes": """
        select doc_id as id, cast(cast(floor(doc_id / 400) * 3 + doc_id % 3 as bigint) as string) as session_id,
               cast(cast(floor(doc_id / 400) * 2 + doc_id % 2 as bigint) as string) as client_id,
               case doc_id % 3 when 0 then 'bug' when 1 then 'feature' else 'improvement' end as issue_type,
               case when doc_id % 11 = 8 then split_part(text, '.', 1) || ' note on ' || source
                    else split_part(text, '.', 1) end as title,
               case doc_id % 11
                 when 0 then text || ' The query on the orders table is slow. Steps to reproduce: 1. run the sql.'
                             || ' For example the join should be fast.'
                 when 1 then text || chr(10) || '- what happened: the database plan changed'
                 when 2 then text || ' buy now and subscribe'
                 when 3 then text || ' see http://example.org/page'
                 when 4 then text || ' see https://github.com/a/b and the database index plan'
                 when 5 then text || ' maybe something somehow, i think things are probably stuff, etc'
                 when 6 then text || repeat('z', 25)
                 when 7 then text || ' ' || repeat('AB', 30)
                 when 8 then text || ' the sql query of ' || lang || ' is slow, an index is expected'
                 when 9 then text || source || ' database query and sql plan with no full stop, why needed: the outcome'
                 else text || ' the pizza table query' end as description,
               lang, source,
               timestamp '2024-01-01 00:00:00' + (doc_id * 30 + (doc_id * doc_id) % 97) * interval '1' second
                 as created_at
        from documents""",
}

# Notes, some of which are sent once more ten minutes later.
RELATIONS["renotes"] = f"""
        select * from ({RELATIONS["notes"]}) first_time
        union all
        select id + 1000000000, session_id, client_id, issue_type, title, description, lang, source,
               created_at + interval '10' minute as created_at
        from ({RELATIONS["notes"]}) again where id % 4 < 2"""


def load(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver tables as views for the relations to read."""
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # Judging texts is dear per row, and a small table is one row group.
        (spread(rows) if name == "documents" else rows).createOrReplaceTempView(name)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load(spark, sf_dir)
    return spark.sql(RELATIONS[name])


def relations(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    load(spark, sf_dir)
    return [spark.sql(RELATIONS[n]) for n in names]


def latest(df: DataFrame, ts: str = "created_at"):
    """The newest time in the log, as the moment a report is made."""
    return df.select(F.max(ts)).scalar()


def with_(*names: str) -> str:
    """The WITH clause that defines relations for a DuckDB text."""
    return "with " + ",\n".join(f"{n} as ({RELATIONS[n]})" for n in names)

"""Registered compare queries and their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import diff, digests, keys, normalize, renames, report, resumable
from evenkeel.plans import oracles
from evenkeel.plans.fixtures import load, relation, relations, with_
from evenkeel.session import workspace
from evenkeel.sources import archives, files, named, store
from evenkeel.spec import CompareSpec, at_scale, within

ORDER = CompareSpec(keys=("o_orderkey",))
LINE = CompareSpec(keys=("l_orderkey", "l_linenumber"))
CUSTOMER = CompareSpec(keys=("k",))
VALUES = ("o_custkey", "o_orderstatus", "o_totalprice")
EQUAL = oracles.same(*VALUES)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _orders(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return relations(spark, sf_dir, "src", "tgt")


def _customers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return relations(spark, sf_dir, "nsrc", "ntgt")


@query("keyed_diff_summary", oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], EQUAL))
def keyed_diff_summary(spark, sf_dir):
    return report.summary(*_orders(spark, sf_dir), ORDER)


@query(
    "keyed_diff_rows",
    f"""{with_("src", "tgt")}, {oracles.statuses("src", "tgt", ["o_orderkey"], EQUAL)}
    select o_orderkey, n_source, n_target, row_status from j""",
)
def keyed_diff_rows(spark, sf_dir):
    return diff.row_statuses(*_orders(spark, sf_dir), ORDER)


@query("keyed_diff_digest", oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], EQUAL).replace(
    "3 as columns_compared", "0 as columns_compared"
).replace("duplicate_rows_target, columns_compared,\n           columns_with_differences,", "duplicate_rows_target,"))
def keyed_diff_digest(spark, sf_dir):
    return report.summary(*_orders(spark, sf_dir), CompareSpec(keys=("o_orderkey",), exact=False))


@query(
    "keyed_diff_digest_nulls",
    f"""{with_("gsrc", "gtgt")}, {oracles.statuses("gsrc", "gtgt", ["o_orderkey"], oracles.same("a", "b", "c"))}
    select o_orderkey, n_source, n_target, row_status from j""",
)
def keyed_diff_digest_nulls(spark, sf_dir):
    spec = CompareSpec(keys=("o_orderkey",), exact=False)
    return diff.row_statuses(*relations(spark, sf_dir, "gsrc", "gtgt"), spec)


@query(
    "keyed_diff_composite",
    oracles.summary(
        ["lsrc", "ltgt"], "lsrc", "ltgt", ["l_orderkey", "l_linenumber"], oracles.same("l_partkey", "l_quantity")
    ),
)
def keyed_diff_composite(spark, sf_dir):
    return report.summary(*relations(spark, sf_dir, "lsrc", "ltgt"), LINE)


@query(
    "keyed_diff_null_safe",
    f"""{with_("nsrc", "ntgt")},
    s as (select k, count(*) as n, any_value(name) as name, any_value(bal) as bal, any_value(seg) as seg
          from nsrc group by k),
    t as (select k, count(*) as n, any_value(name) as name, any_value(bal) as bal, any_value(seg) as seg
          from ntgt group by k)
    select cast(coalesce(s.k, t.k) as varchar) as k, coalesce(s.n, 0) as n_source, coalesce(t.n, 0) as n_target,
           case when t.n is null then 'missing_in_target' when s.n is null then 'missing_in_source'
                when s.n <> 1 or t.n <> 1 then 'duplicate_key'
                when s.name is not distinct from t.name and s.bal is not distinct from t.bal
                 and s.seg is not distinct from t.seg then 'match' else 'value_mismatch' end as row_status
    from s full outer join t on s.k is not distinct from t.k""",
)
def keyed_diff_null_safe(spark, sf_dir):
    spec = CompareSpec(keys=("k",), null_safe_keys=True)
    return diff.row_statuses(*_customers(spark, sf_dir), spec).withColumn("k", F.col("k").cast("string"))


@query(
    "keyed_diff_ordinal",
    f"""{with_("lsrc", "ltgt")},
    s as (select *, row_number() over (partition by l_orderkey, l_linenumber
                                       order by l_partkey, l_quantity) as ordinal from lsrc),
    t as (select *, row_number() over (partition by l_orderkey, l_linenumber
                                       order by l_partkey, l_quantity) as ordinal from ltgt)
    select coalesce(s.l_orderkey, t.l_orderkey) as l_orderkey,
           coalesce(s.l_linenumber, t.l_linenumber) as l_linenumber,
           coalesce(s.ordinal, t.ordinal) as ordinal,
           case when t.ordinal is null then 'missing_in_target' when s.ordinal is null then 'missing_in_source'
                when s.l_partkey is not distinct from t.l_partkey
                 and s.l_quantity is not distinct from t.l_quantity then 'match' else 'value_mismatch' end as row_status
    from s full outer join t
      on s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber and s.ordinal = t.ordinal""",
)
def keyed_diff_ordinal(spark, sf_dir):
    spec = CompareSpec(keys=LINE.keys, duplicates="ordinal")
    rows = diff.row_statuses(*relations(spark, sf_dir, "lsrc", "ltgt"), spec)
    return rows.select("l_orderkey", "l_linenumber", "ordinal", "row_status")


@query(
    "missing_in_target",
    f"""{with_("src", "tgt")} select * from src s
    where not exists (select 1 from tgt t where t.o_orderkey = s.o_orderkey)""",
)
def missing_in_target(spark, sf_dir):
    return diff.missing_in_target(*_orders(spark, sf_dir), ORDER)


@query(
    "missing_in_source",
    f"""{with_("src", "tgt")} select * from tgt t
    where not exists (select 1 from src s where t.o_orderkey = s.o_orderkey)""",
)
def missing_in_source(spark, sf_dir):
    return diff.missing_in_source(*_orders(spark, sf_dir), ORDER)


@query(
    "missing_both_sides",
    f"""{with_("nsrc", "ntgt")}
    select cast(s.k as varchar) as k, 'missing_in_target' as row_status from nsrc s
    where not exists (select 1 from ntgt t where t.k = s.k)
    union all
    select cast(t.k as varchar), 'missing_in_source' from ntgt t
    where not exists (select 1 from nsrc s where t.k = s.k)""",
)
def missing_both_sides(spark, sf_dir):
    rows = diff.missing_rows(*_customers(spark, sf_dir), CUSTOMER)
    return rows.withColumn("k", F.col("k").cast("string"))


def _cell(column: str, text: str) -> str:
    a, b = (text.format(side=s) for s in "st")
    return f"""
    select s.o_orderkey, '{column}' as column_name, {a} as source_value, {b} as target_value,
           'VALUE_MISMATCH' as difference_type
    from src s join tgt t on s.o_orderkey = t.o_orderkey where s.{column} is distinct from t.{column}"""


_MONEY = "cast({side}.o_totalprice as varchar)"
VALUE_DIFF = " union all ".join(
    [
        _cell("o_custkey", "cast({side}.o_custkey as varchar)"),
        _cell("o_orderstatus", "{side}.o_orderstatus"),
        _cell("o_totalprice", _MONEY),
    ]
)


@query("value_diff_long", f"{with_('src', 'tgt')} {VALUE_DIFF}")
def value_diff_long(spark, sf_dir):
    return diff.value_diff(*_orders(spark, sf_dir), ORDER)


@query(
    "value_diff_nulls",
    f"""{with_("nsrc", "ntgt")}
    select cast(s.k as varchar) as k,
           case when s.bal is not distinct from t.bal then 'MATCH' when s.bal is null then 'MISSING_SOURCE'
                when t.bal is null then 'MISSING_TARGET' else 'VALUE_MISMATCH' end as difference_type
    from nsrc s join ntgt t on s.k = t.k where s.bal is distinct from t.bal""",
)
def value_diff_nulls(spark, sf_dir):
    rows = diff.value_diff(*_customers(spark, sf_dir), CompareSpec(keys=("k",), columns=("bal",)))
    return rows.select(F.col("k").cast("string").alias("k"), "difference_type")


def _number_text(side: str) -> str:
    """A double as Spark prints it, for the values of the relations."""
    x = f"{side}.num"
    return f"""case when isnan({x}) then 'NaN' when isinf({x}) then case when {x} > 0 then 'Infinity' else '-Infinity' end
        when {x} = 1e33 then '1.0E33' when {x} = 2e33 then '2.0E33' else cast({x} as varchar) end"""


@query(
    "value_diff_odd",
    f"""{with_("osrc", "otgt")},
    p as (select s.k, 'num' as column_name, {_number_text("s")} as source_value, {_number_text("t")} as target_value
          from osrc s join otgt t on s.k = t.k where s.num is distinct from t.num
          union all
          select s.k, 'txt', s.txt, t.txt from osrc s join otgt t on s.k = t.k where s.txt is distinct from t.txt)
    select k, column_name, source_value, target_value,
           case when source_value is null then 'MISSING_SOURCE' when target_value is null then 'MISSING_TARGET'
                else 'VALUE_MISMATCH' end as difference_type from p""",
)
def value_diff_odd(spark, sf_dir):
    return diff.value_diff(*relations(spark, sf_dir, "osrc", "otgt"), CompareSpec(keys=("k",)))


def _wide(source: str, target: str, keys: tuple[str, ...], columns: tuple[str, ...], as_text: tuple[str, ...]) -> str:
    """The SQL of a wide diff: one row per key, values where a side has one row of it."""
    sides = [
        oracles.collapsed(f"{name}0", relation, keys, columns)
        + f""", {name} as (select {", ".join(keys)}, n,
            {", ".join(f"case when n = 1 then {c} end as {c}" for c in columns)} from {name}0)"""
        for name, relation in (("sk", source), ("tk", target))
    ]
    on = " and ".join(f"s.{k} = t.{k}" for k in keys)
    values = ", ".join(
        f"cast({s}.{c} as varchar) as {side}_{c}" if c in as_text else f"{s}.{c} as {side}_{c}"
        for c in columns
        for s, side in (("s", "source"), ("t", "target"))
    )
    kinds = ", ".join(
        f"""case when s.n is null then 'MISSING_SOURCE' when t.n is null then 'MISSING_TARGET'
            when s.n > 1 or t.n > 1 then null when s.{c} is not distinct from t.{c} then 'MATCH'
            when s.{c} is null then 'MISSING_SOURCE' when t.{c} is null then 'MISSING_TARGET'
            else 'VALUE_MISMATCH' end as {c}_diff_type"""
        for c in columns
    )
    same = " and ".join(f"s.{c} is not distinct from t.{c}" for c in columns)
    return f"""{with_(source, target)}, {", ".join(sides)},
    w as (select {", ".join(f"coalesce(s.{k}, t.{k}) as {k}" for k in keys)}, coalesce(s.n, 0) as n_source,
                 coalesce(t.n, 0) as n_target, {values}, {kinds},
                 case when t.n is null then 'missing_in_target' when s.n is null then 'missing_in_source'
                      when s.n > 1 or t.n > 1 then 'duplicate_key' when {same} then 'match'
                      else 'value_mismatch' end as row_status
          from sk s full outer join tk t on {on})
    select * from w where row_status <> 'match'"""


@query("value_diff_wide", _wide("src", "tgt", ("o_orderkey",), VALUES, ("o_custkey",)))
def value_diff_wide(spark, sf_dir):
    rows = diff.wide_diff(*_orders(spark, sf_dir), ORDER)
    as_text = {c: F.col(c).cast("string") for c in ("source_o_custkey", "target_o_custkey")}
    return rows.withColumns(as_text)


@query(
    "value_diff_wide_repeated",
    _wide("lsrc", "ltgt", LINE.keys, ("l_partkey", "l_quantity"), ("l_partkey", "l_quantity")),
)
def value_diff_wide_repeated(spark, sf_dir):
    rows = diff.wide_diff(*relations(spark, sf_dir, "lsrc", "ltgt"), LINE)
    names = [f"{s}_{c}" for s in ("source", "target") for c in ("l_partkey", "l_quantity")]
    return rows.withColumns({c: F.col(c).cast("string") for c in names})


_POSITIONS = """
    s as (select *, row_number() over (order by {order}) as row_number from src),
    t as (select *, row_number() over (order by {order}) as row_number from tgt)
    select coalesce(s.row_number, t.row_number) as row_number,
           case when t.row_number is null then 'missing_in_target'
                when s.row_number is null then 'missing_in_source'
                when s.o_orderkey is not distinct from t.o_orderkey
                 and s.o_custkey is not distinct from t.o_custkey
                 and s.o_orderstatus is not distinct from t.o_orderstatus
                 and s.o_totalprice is not distinct from t.o_totalprice then 'match'
                else 'value_mismatch' end as row_status
    from s full outer join t on s.row_number = t.row_number"""


@query(
    "positional_diff",
    f"""{with_("src", "tgt")},
    {_POSITIONS.format(order="o_custkey, o_orderkey, o_orderstatus, o_totalprice")}""",
)
def positional_diff(spark, sf_dir):
    rows = diff.positional_diff(*_orders(spark, sf_dir), CompareSpec(), sort_by=["o_custkey"])
    return rows.select("row_number", "row_status")


@query(
    "multiset_diff",
    f"""{with_("lsrc", "ltgt")},
    u as (select *, 1 as sign from lsrc union all select *, -1 from ltgt),
    g as (select l_orderkey, l_linenumber, l_partkey, l_quantity, cast(sum(sign) as bigint) as net
          from u group by all)
    select l_orderkey, l_linenumber, l_partkey, l_quantity,
           case when net > 0 then 'source_only' else 'target_only' end as side, abs(net) as copies
    from g where net <> 0""",
)
def multiset_diff(spark, sf_dir):
    return diff.multiset_diff(*relations(spark, sf_dir, "lsrc", "ltgt"))


@query(
    "diff_by_segment",
    f"""{with_("src", "tgt")}, {oracles.collapsed("sk", "src", ["o_orderkey"], VALUES)},
    {oracles.collapsed("tk", "tgt", ["o_orderkey"], VALUES)},
    j as (select coalesce(s.o_orderstatus, t.o_orderstatus) as segment,
                 coalesce(s.n, 0) as n_source, coalesce(t.n, 0) as n_target,
                 case when t.n is null then 'missing_in_target' when s.n is null then 'missing_in_source'
                      when s.o_custkey is not distinct from t.o_custkey
                       and s.o_orderstatus is not distinct from t.o_orderstatus
                       and s.o_totalprice is not distinct from t.o_totalprice
                      then 'match' else 'value_mismatch' end as row_status
          from sk s full outer join tk t on s.o_orderkey = t.o_orderkey),
    c as (select segment, {oracles.COUNTS} from j group by segment),
    m as (select *, {oracles.SCORE} as match_score from c)
    select segment, total_rows_source, total_rows_target, matching_rows, mismatched_rows, missing_in_target,
           missing_in_source, duplicate_rows_source, duplicate_rows_target, {oracles.SCORED} from m""",
)
def diff_by_segment(spark, sf_dir):
    return report.summary_by(*_orders(spark, sf_dir), ORDER, "o_orderstatus")


@query(
    "diff_by_segment_repeated",
    f"""{with_("lsrc", "ltgt")},
    sk as (select l_orderkey, l_linenumber, count(*) as n, any_value(l_partkey) as p, any_value(l_quantity) as q,
                  min(l_partkey % 7) as seg from lsrc group by all),
    tk as (select l_orderkey, l_linenumber, count(*) as n, any_value(l_partkey) as p, any_value(l_quantity) as q,
                  min(l_partkey % 7) as seg from ltgt group by all),
    j as (select coalesce(s.seg, t.seg) as segment, coalesce(s.n, 0) as n_source, coalesce(t.n, 0) as n_target,
                 case when t.n is null then 'missing_in_target' when s.n is null then 'missing_in_source'
                      when s.n > 1 or t.n > 1 then 'duplicate_key'
                      when s.p is not distinct from t.p and s.q is not distinct from t.q then 'match'
                      else 'value_mismatch' end as row_status
          from sk s full outer join tk t on s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber),
    c as (select segment, {oracles.COUNTS} from j group by segment),
    m as (select *, {oracles.SCORE} as match_score from c)
    select segment, total_rows_source, total_rows_target, matching_rows, mismatched_rows, missing_in_target,
           missing_in_source, duplicate_rows_source, duplicate_rows_target, {oracles.SCORED} from m""",
)
def diff_by_segment_repeated(spark, sf_dir):
    sides = [df.withColumn("part", F.col("l_partkey") % 7) for df in relations(spark, sf_dir, "lsrc", "ltgt")]
    spec = CompareSpec(keys=LINE.keys, columns=("l_partkey", "l_quantity"))
    return report.summary_by(*sides, spec, "part")


@query(
    "match_score",
    f"""{oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], EQUAL).replace(
        "select total_rows_source, total_rows_target, matching_rows, mismatched_rows",
        "select match_score, rating, outcome from (select total_rows_source, total_rows_target, matching_rows,"
        " mismatched_rows",
    )})""",
)
def match_score(spark, sf_dir):
    return report.summary(*_orders(spark, sf_dir), ORDER).select("match_score", "rating", "outcome")


@query(
    "mismatch_by_column",
    f"""{with_("src", "tgt")}, d as ({VALUE_DIFF})
    select column_name, count(*) as mismatch_count from d group by column_name""",
)
def mismatch_by_column(spark, sf_dir):
    return report.mismatches_by_column(*_orders(spark, sf_dir), ORDER)


@query(
    "mismatch_sample",
    f"""{with_("src", "tgt")}, d as ({VALUE_DIFF}) select * from d order by o_orderkey, column_name limit 100""",
)
def mismatch_sample(spark, sf_dir):
    return report.mismatch_sample(value_diff_long(spark, sf_dir), ["o_orderkey"], limit=100)


@query(
    "renamed_columns",
    """with t as (select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 10 <> 0),
    pairs(source_column, target_column, common, either) as (
      select 'c_custkey', 'id', (select count(*) from t), (select count(distinct c_custkey) from customer) union all
      select 'c_name', 'label', (select count(distinct trim(c_name)) from t), (select count(distinct c_name) from customer) union all
      select 'c_nationkey', 'country', (select count(distinct c_nationkey) from t), (select count(distinct c_nationkey) from customer) union all
      select 'c_acctbal', 'balance', (select count(distinct c_acctbal) from t), (select count(distinct c_acctbal) from customer) union all
      select 'c_mktsegment', 'segment', (select count(distinct c_mktsegment) from t), (select count(distinct c_mktsegment) from customer))
    select source_column, target_column, round(common / either, 6) as score from pairs""",
)
def renamed_columns(spark, sf_dir):
    """Columns of a target with other names, order and partly other types, found by the values they share."""
    load(spark, sf_dir)
    source = spark.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    target = source.where("c_custkey % 10 <> 0").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.col("c_name"), F.lit(" ")).alias("label"), F.col("c_nationkey").cast("double").alias("country"),
    )
    found = renames.proposed_mapping(source, target, bits=16)
    rows = [(source_column, target_column, round(score, 6)) for target_column, source_column, score in found]
    return spark.createDataFrame(rows, "source_column string, target_column string, score double")


@query(
    "resumed_compare",
    f"""{with_("src", "tgt")}, {oracles.statuses("src", "tgt", ["o_orderkey"], EQUAL)}
    select o_orderkey, n_source, n_target, row_status from j""",
)
def resumed_compare(spark, sf_dir):
    """A compare that stops after two of its units and is taken up by another run."""
    path = workspace(spark) + "/compare"
    for most in (2, None):
        run = resumable.ResumableCompare(*_orders(spark, sf_dir), ORDER, path, units=4)
        for _ in run.run(most):
            pass
    return run.rows().select("o_orderkey", "n_source", "n_target", "row_status")


@query("digest_summary", oracles.summary(["ball", "bpart"], "ball", "bpart", ["o_orderkey"], EQUAL))
def digest_summary(spark, sf_dir):
    """The summary of two mostly equal sides, of which only differing key ranges are compared by value."""
    return digests.summary(*relations(spark, sf_dir, "ball", "bpart"), ORDER, fan=64, few=1_000)


@query(
    "mismatch_report_rows",
    f"""{with_("src", "tgt")}, d as ({VALUE_DIFF})
    select row_number() over (order by o_orderkey, column_name) as row_number,
           cast(o_orderkey as varchar) as row_key, column_name, source_value, target_value, difference_type
    from d""",
)
def mismatch_report_rows(spark, sf_dir):
    return report.report_rows(value_diff_long(spark, sf_dir), ["o_orderkey"])


_ODD_KEYS = """
        select case when o_orderkey % 3 = 0 then null else o_orderstatus || '|' || cast(o_orderkey as {text}) end as a,
               case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then '{slash}' || o_orderpriority
                    else o_orderpriority || '|' end as b,
               o_orderkey as k, cast(o_orderkey as {text}) as source_value from orders where o_orderkey % 89 <> 0"""
_ODD_PART = "coalesce(replace(replace({0}, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(92) || 'N')"


@query(
    "mismatch_report_odd_keys",
    f"""with d as ({_ODD_KEYS.format(text="varchar", slash=chr(92))})
    select row_number() over (order by a nulls first, b nulls first, k) as row_number,
           {_ODD_PART.format("a")} || '|' || {_ODD_PART.format("b")} || '|' || cast(k as varchar) as row_key,
           'v' as column_name, source_value, cast(null as varchar) as target_value, 'missing' as difference_type from d""",
)
def mismatch_report_odd_keys(spark, sf_dir):
    """Report keys that hold NULLs, bars and backslashes."""
    load(spark, sf_dir)
    rows = spark.sql(_ODD_KEYS.format(text="string", slash=chr(92) * 2))
    found = rows.select(
        "a", "b", "k", F.lit("v").alias("column_name"), "source_value", F.lit(None).cast("string").alias("target_value"),
        F.lit("missing").alias("difference_type"),
    )
    return report.report_rows(found, ["a", "b", "k"])


@query(
    "key_profile",
    f"""{with_("lsrc")}, g as (select l_orderkey, l_linenumber, count(*) as n from lsrc group by all)
    select cast(sum(n) as bigint) as total_rows, 0 as null_key_rows, count(*) as distinct_keys,
           count(*) filter (where n > 1) as duplicate_groups,
           cast(sum(n) filter (where n > 1) as bigint) as duplicate_rows,
           cast(sum(n - 1) filter (where n > 1) as bigint) as surplus_rows
    from g""",
)
def key_profile(spark, sf_dir):
    return keys.key_profile(relation(spark, sf_dir, "lsrc"), LINE.keys)


@query(
    "key_profile_nulls",
    f"""{with_("nsrc")}
    select count(*) as total_rows, count(*) filter (where k is null) as null_key_rows,
           count(distinct k) as distinct_keys, 0 as duplicate_groups, 0 as duplicate_rows, 0 as surplus_rows
    from nsrc""",
)
def key_profile_nulls(spark, sf_dir):
    return keys.key_profile(relation(spark, sf_dir, "nsrc"), CUSTOMER.keys)


@query(
    "duplicate_keys",
    f"""{with_("lsrc")} select l_orderkey, l_linenumber, count(*) as n_rows from lsrc
    group by all having count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    return keys.duplicate_keys(relation(spark, sf_dir, "lsrc"), LINE.keys)


@query(
    "volume_check",
    f"""{with_("lsrc", "tgt")},
    v as (select 'source' as side, count(*) as row_count from lsrc union all select 'target', count(*) from tgt)
    select side, row_count, case when row_count > 40000 then 'high' when row_count >= 10000 then 'medium'
           else 'low' end as volume, row_count >= 10000 as needs_warning from v""",
)
def volume_check(spark, sf_dir):
    return keys.volume_check(*relations(spark, sf_dir, "lsrc", "tgt"), medium=10_000, high=40_000)


_ORDER_TYPES = (
    ("o_orderkey", "bigint", "bigint", "common"),
    ("o_custkey", "bigint", "bigint", "common"),
    ("o_orderstatus", "string", "string", "common"),
    ("o_totalprice", "double", "string", "type_changed"),
    ("o_orderdate", "timestamp_ntz", None, "source_only"),
    ("o_orderpriority", "string", None, "source_only"),
)


@query(
    "schema_diff",
    " union all ".join(
        f"""select '{name}' as column_name, '{a}' as source_type, {f"'{b}'" if b else "null"} as target_type,
            '{status}' as status, count(*) as row_count, count(*) - count({name}) as null_count from orders"""
        for name, a, b, status in _ORDER_TYPES
    ),
)
def schema_diff(spark, sf_dir):
    target = relation(spark, sf_dir, "tgt").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    source = spark.table("orders")
    found = normalize.schema_diff(source, target.withColumn("note", F.lit("")))
    filled = files.profile(source).select("column_name", "row_count", "null_count")
    return found.join(filled, "column_name")


# Normalisation options: each changes what counts as a difference.


@query(
    "diff_ignore_columns",
    oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], oracles.same("o_custkey", "o_orderstatus")),
)
def diff_ignore_columns(spark, sf_dir):
    spec = CompareSpec(keys=("o_orderkey",), ignore_target=("o_totalprice",))
    return report.summary(*_orders(spark, sf_dir), spec)


@query(
    "diff_trim_casefold",
    oracles.summary(
        ["nsrc", "ntgt"],
        "nsrc",
        "ntgt",
        ["k"],
        {
            "name": "lower(trim(s.name)) is not distinct from lower(trim(t.name))",
            "bal": "s.bal is not distinct from t.bal",
            "seg": "lower(trim(s.seg)) is not distinct from lower(trim(t.seg))",
        },
    ),
)
def diff_trim_casefold(spark, sf_dir):
    spec = CompareSpec(keys=("k",), trim=True, case_sensitive=False)
    return report.summary(*_customers(spark, sf_dir), spec)


@query(
    "diff_ignore_nulls",
    oracles.summary(
        ["nsrc", "ntgt"],
        "nsrc",
        "ntgt",
        ["k"],
        {"bal": "s.bal is not distinct from t.bal or s.bal is null or t.bal is null"},
    ),
)
def diff_ignore_nulls(spark, sf_dir):
    spec = CompareSpec(keys=("k",), columns=("bal",), ignore_nulls=True)
    return report.summary(*_customers(spark, sf_dir), spec)


@query(
    "diff_filtered",
    oracles.summary(
        ["src", "tgt"],
        "fsrc",
        "ftgt",
        ["o_orderkey"],
        EQUAL,
        extra="""fsrc as (select * from src where o_totalprice > 100000),
                 ftgt as (select * from tgt where o_totalprice > 100000)""",
    ),
)
def diff_filtered(spark, sf_dir):
    sides = [df.where("o_totalprice > 100000") for df in _orders(spark, sf_dir)]
    return report.summary(*sides, ORDER)


@query("diff_renamed", oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], EQUAL))
def diff_renamed(spark, sf_dir):
    source, target = _orders(spark, sf_dir)
    there = target.withColumnsRenamed({"o_custkey": "cust_id", "o_orderstatus": "state"})
    return report.summary(
        source, normalize.renamed(there, {"cust_id": "o_custkey", "state": "o_orderstatus"}), ORDER
    )


@query(
    "diff_date_format",
    oracles.summary(
        ["dsrc", "dtgt"],
        "dsrc",
        "d2",
        ["o_orderkey"],
        oracles.same("order_day"),
        extra="""d2 as (select o_orderkey, strftime(try_strptime(order_day, '%d/%m/%Y'), '%Y-%m-%d') as order_day
                        from dtgt)""",
    ),
)
def diff_date_format(spark, sf_dir):
    source, target = relations(spark, sf_dir, "dsrc", "dtgt")
    same_format = target.withColumn("order_day", normalize.canonical_date(F.col("order_day"), "dd/MM/yyyy"))
    return report.summary(source, same_format, CompareSpec(keys=("o_orderkey",), columns=("order_day",)))


@query(
    "diff_decimal_scale",
    oracles.summary(
        ["dsrc", "dtgt"],
        "dsrc",
        "dtgt",
        ["o_orderkey"],
        {
            "o_totalprice": "cast(s.o_totalprice as decimal(38,2)) is not distinct from"
            " cast(t.o_totalprice as decimal(38,2))"
        },
    ),
)
def diff_decimal_scale(spark, sf_dir):
    spec = CompareSpec(
        keys=("o_orderkey",), columns=("o_totalprice",), comparators={"o_totalprice": at_scale(2)}
    )
    return report.summary(*relations(spark, sf_dir, "dsrc", "dtgt"), spec)


@query(
    "diff_tolerance",
    oracles.summary(
        ["dsrc", "dtgt"], "dsrc", "dtgt", ["o_orderkey"], {"o_totalprice": "abs(s.o_totalprice - t.o_totalprice) <= 0.01"}
    ),
)
def diff_tolerance(spark, sf_dir):
    spec = CompareSpec(
        keys=("o_orderkey",), columns=("o_totalprice",), comparators={"o_totalprice": within(0.01)}
    )
    return report.summary(*relations(spark, sf_dir, "dsrc", "dtgt"), spec)


@query(
    "diff_nonnull_keys",
    oracles.summary(
        ["nsrc", "ntgt"],
        "a",
        "b",
        ["k"],
        oracles.same("name", "bal", "seg"),
        extra="a as (select * from nsrc where k is not null), b as (select * from ntgt where k is not null)",
    ),
)
def diff_nonnull_keys(spark, sf_dir):
    sides = [normalize.without_null_keys(df, ["k"]) for df in _customers(spark, sf_dir)]
    return report.summary(*sides, CUSTOMER)


@query(
    "diff_cross_dialect",
    oracles.summary(
        ["sess", "dtgt"],
        "a",
        "b",
        ["session_id"],
        oracles.same("day", "score"),
        extra="""hi as (select max(created_at) as as_of from sess),
        a as (select session_id, date_trunc('day', created_at) as day, coalesce(nullif(match_score, 60), 0) as score
              from sess, hi where created_at >= as_of - interval 365 days),
        b as (select o.session_id, date_trunc('day', o.completed_at) as day, o.match_score as score
              from sess o, hi where created_at >= as_of - interval 365 days)""",
    ),
)
def diff_cross_dialect(spark, sf_dir):
    sess = relation(spark, sf_dir, "sess")
    as_of = sess.select(F.max("created_at")).scalar()
    recent = sess.where(F.col("created_at") >= as_of - F.expr("interval 365 days"))
    source = recent.select(
        "session_id",
        F.date_trunc("day", "created_at").alias("day"),
        F.coalesce(F.nullif(F.col("match_score"), F.lit(60.0)), F.lit(0.0)).alias("score"),
    )
    target = recent.select(
        "session_id", F.date_trunc("day", "completed_at").alias("day"), F.col("match_score").alias("score")
    )
    return report.summary(source, target, CompareSpec(keys=("session_id",)))


# Sources and sinks.


@query("sql_sides_diff", oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], EQUAL))
def sql_sides_diff(spark, sf_dir):
    from evenkeel.plans.fixtures import RELATIONS

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sides = [named.read_sql(spark, RELATIONS[n], {"orders": orders}) for n in ("src", "tgt")]
    return report.summary(*sides, ORDER)


@query(
    "sql_sides_braces",
    """select o_orderkey, '{orders} {n}' as shape, o_orderstatus from orders where o_orderkey % 89 <> 0""",
)
def sql_sides_braces(spark, sf_dir):
    """Relations named in braces, plainly, and braces that stand for nothing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = """with kept as (select o_orderkey, concat('{', 'orders} {n}') as shape from {orders} where o_orderkey % 89 <> 0)
        select o_orderkey, shape, o_orderstatus from kept join orders using (o_orderkey) -- all of {n}"""
    return named.read_sql(spark, text, {"orders": orders})


@query(
    "named_source_diff",
    oracles.summary(
        ["tgt"], "books", "tgt", ["o_orderkey"], EQUAL,
        extra="books as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders)",
    ),
)
def named_source_diff(spark, sf_dir):
    known = {"books": {"type": "parquet", "path": f"{sf_dir}/orders.parquet", "description": "all orders"}}
    source = named.read_named(spark, "books", known)
    return report.summary(source, relation(spark, sf_dir, "tgt"), CompareSpec(keys=("o_orderkey",), columns=VALUES))


@query(
    "listed_files",
    "select o_orderstatus as status, 1::bigint as files, true as has_content from orders group by o_orderstatus",
)
def listed_files(spark, sf_dir):
    """Orders written as one CSV file per status, and the files that a listing finds."""
    load(spark, sf_dir)
    path = workspace(spark) + "/listed"
    spark.table("orders").repartition("o_orderstatus").write.partitionBy("o_orderstatus").csv(path)
    found = files.list_documents(spark, path, "*.csv")
    status = F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1)
    return found.groupBy(status.alias("status")).agg(
        F.count("*").alias("files"), F.bool_and(F.col("size_bytes") > 0).alias("has_content")
    )


_TEXTS = ("select * from src", "select * from tgt")


@query(
    "history_store",
    f"""{with_("src", "tgt")}, {oracles.statuses("src", "tgt", ["o_orderkey"], EQUAL)},
    c as (select {oracles.COUNTS} from j), d as ({VALUE_DIFF})
    select '20240501_120000_' || substr(md5('{"".join(_TEXTS)}'), 1, 8) as session_id, 'completed' as status,
           60000 as execution_time_ms, 2500 as comparison_time_ms, {oracles.SCORE} as match_score,
           'source' as file_role, column_name, count(*) as mismatches
    from c, d group by all""",
)
def history_store(spark, sf_dir):
    """A run from its name to its stored summary, files and mismatches, read back from the store."""
    at = datetime(2024, 5, 1, 12)
    runs = store.HistoryStore(spark, workspace(spark) + "/history")
    name = store.run_id(*_TEXTS, at)
    runs.create_session(name, at, test_type="table", client_id="c1", source_type="table", target_type="table")
    runs.set_status(name, "running", at.replace(minute=1))
    runs.record_file(name, "source", at, file_path="orders.parquet", file_format="parquet")
    runs.save_summary(name, report.summary(*_orders(spark, sf_dir), ORDER), at, 2.5)
    runs.save_mismatches(name, diff.value_diff(*_orders(spark, sf_dir), ORDER), at)
    runs.log_audit(at, {"keys": list(ORDER.keys)}, session_id=name, tool_name="compare", success=True)
    runs.set_status(name, "completed", at.replace(minute=2))
    counts = runs.table("mismatches").groupBy("session_id", "column_name").agg(F.count("*").alias("mismatches"))
    return (
        runs.sessions()
        .select("session_id", "status", "execution_time_ms")
        .join(runs.table("results").select("session_id", "match_score", "comparison_time_ms"), "session_id")
        .join(runs.table("files").select("session_id", "file_role"), "session_id")
        .join(counts, "session_id")
    )


@query("csv_roundtrip_diff", oracles.summary(["src", "tgt"], "src", "tgt", ["o_orderkey"], EQUAL))
def csv_roundtrip_diff(spark, sf_dir):
    source, target = _orders(spark, sf_dir)
    path = files.export_csv(target, workspace(spark) + "/target.csv")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return report.summary(source, files.read_csv(spark, path, schema), ORDER)


@query("csv_roundtrip_odd", oracles.summary(["osrc", "otgt"], "osrc", "otgt", ["k"], oracles.same("num", "txt")))
def csv_roundtrip_odd(spark, sf_dir):
    source, target = relations(spark, sf_dir, "osrc", "otgt")
    # One file, which is read by several tasks where it is large, line breaks or not.
    path = files.export_csv(target.repartition(1), workspace(spark) + "/odd.csv")
    back = files.read_csv(spark, path, "k long, num double, txt string", multiline=True)
    return report.summary(source, back, CompareSpec(keys=("k",)))


@query(
    "profile_table",
    """select count(*) as row_count, 6 as column_count,
       'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' as column_names
       from orders""",
)
def profile_table(spark, sf_dir):
    load(spark, sf_dir)
    return files.table_profile(spark.table("orders"))


def _profile_sql(position: int, name: str, kind: str) -> str:
    return f"""select {position} as position, '{name}' as column_name, '{kind}' as column_type,
        count(*) as row_count, count(*) - count({name}) as null_count,
        cast(min({name}) as varchar) as min_value, cast(max({name}) as varchar) as max_value from nsrc"""


@query(
    "profile_columns",
    f"""{with_("nsrc")}, c as (select * exclude (bal) from nsrc)
    {_profile_sql(0, "k", "bigint")} union all {_profile_sql(1, "name", "string")}
    union all {_profile_sql(2, "seg", "string")}""",
)
def profile_columns(spark, sf_dir):
    return files.profile(relation(spark, sf_dir, "nsrc").drop("bal"))


@query("preview_rows", "select * from orders order by o_orderkey limit 10")
def preview_rows(spark, sf_dir):
    load(spark, sf_dir)
    return files.preview(spark.table("orders"), ["o_orderkey"])


@query(
    "document_key_build",
    """select o_orderkey,
       concat_ws('.', 'statement', cast(o_custkey as varchar), strftime(o_orderdate, '%Y%m%d'), o_orderstatus, 'csv')
         as statement_key,
       concat_ws('.', 'invoice', cast(o_custkey as varchar), cast(o_orderkey as varchar), 'EUR',
                 strftime(o_orderdate, '%Y%m%d'), o_orderstatus, 'csv') as invoice_key,
       concat_ws('.', 'gl', cast(o_custkey % 7 as varchar), strftime(o_orderdate, '%Y%m%d'), 'csv') as gl_key,
       cast(o_custkey as varchar) as contract_number, strftime(o_orderdate, '%Y%m%d') as payment_date
       from orders""",
)
def document_key_build(spark, sf_dir):
    load(spark, sf_dir)
    contract = F.col("o_custkey").cast("string")
    day, kind, csv = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderstatus"), F.lit("csv")
    rows = spark.table("orders").select(
        "o_orderkey",
        files.document_key(
            "statement", prefix=F.lit("statement"), contract_number=contract, payment_date=day,
            transform_subtype=kind, extension=csv,
        ).alias("statement_key"),
        files.document_key(
            "invoice", prefix=F.lit("invoice"), contract_number=contract,
            partner_contract=F.col("o_orderkey").cast("string"), currency=F.lit("EUR"), payment_date=day,
            transform_subtype=kind, extension=csv,
        ).alias("invoice_key"),
        files.document_key(
            "gl", gl_document_type=F.lit("gl"), financial_institution=(F.col("o_custkey") % 7).cast("string"),
            gl_posting_date=day, extension=csv,
        ).alias("gl_key"),
    )
    read_back = files.document_fields("statement", F.col("statement_key"))
    return rows.select("*", read_back[1], read_back[2])


@query(
    "documents_read",
    f"""{with_("otgt")} select cast(k as varchar) as k, txt, 'C' || (k % 5) as contract_number,
       '2024010' || (k % 3) as payment_date, 'final' as transform_subtype from otgt where k % 3 <> 0""",
)
def documents_read(spark, sf_dir):
    """Odd texts written as documents that their names describe, and those of some days read back."""
    k = F.col("k").cast("long")
    root = files.write_documents(
        relation(spark, sf_dir, "otgt").select("k", "txt"), workspace(spark) + "/documents", "statement",
        prefix=F.lit("statement"), contract_number=F.concat(F.lit("C"), k % 5),
        payment_date=F.concat(F.lit("2024010"), k % 3), transform_subtype=F.lit("final"), extension=F.lit("csv"),
    )
    found = files.read_documents(spark, root, "statement", multiline=True, payment_date="2024010[12]")
    return found.select("k", "txt", "contract_number", "payment_date", "transform_subtype")


_PER_ARCHIVE = 500


@query(
    "zip_members",
    f"""select 'customers-' || cast(c_custkey // {_PER_ARCHIVE} as varchar) || '.zip' as archive,
       c_mktsegment || '.csv' as member,
       row_number() over (partition by c_custkey // {_PER_ARCHIVE}, c_mktsegment order by c_custkey) as row_number,
       cast(c_custkey as varchar) as c_custkey, c_name from customer""",
)
def zip_members(spark, sf_dir):
    """Customers as archives below the shared folder, a CSV member for each segment, read back member by member."""
    load(spark, sf_dir)
    number = F.floor(F.col("c_custkey") / _PER_ARCHIVE).cast("long")
    rows = spark.table("customer").select(
        "c_custkey", "c_name", F.concat(F.lit("customers-"), number, F.lit(".zip")).alias("archive"),
        F.concat("c_mktsegment", F.lit(".csv")).alias("member"),
    )
    root = workspace(spark) + "/archives"
    archives.write_zip_csv(rows, root, "archive", "member", ["c_custkey"]).write.format("noop").mode("overwrite").save()
    found = archives.read_zip_csv(spark, root, task_bytes=1 << 16)
    name = F.element_at(F.split("archive", "/"), -1).alias("archive")
    return found.select(name, "member", "row_number", archives.field("c_custkey"), archives.field("c_name"))

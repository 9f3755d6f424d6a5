"""Cost audit of a table of stored execution plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and cost weights.
MAX_SECONDS = 300.0
LEVELS = (("excessive", 300.0), ("high", 180.0), ("medium", 60.0))
LOWEST_LEVEL = "low"
MANY_ROWS = 1_000_000
NESTED_LOOP_ROWS = 10_000
FILESORT_COST = 1000.0
TEMPORARY_COST = 500.0
CARTESIAN_FACTOR = 10
ORACLE_PER_SECOND = 1000
MYSQL_ROWS_PER_SECOND = 1_000_000
MYSQL_COST_PER_SECOND = 1000
POSTGRESQL_PER_SECOND = 10_000
POSTGRESQL_ROW_FACTOR = 0.5
# Where the numbers stand in a plan's text, tried in this order.
ORACLE_COST = (r"\|\s*(\d+)\s*\(\d+%?\)", r"(?i)Cost\s*[:=]\s*(\d+)")
ORACLE_ROWS = (r"\|\s*(\d+)\s*\|\s*\d+\s*\(", r"(?i)Cardinality\s*[:=]\s*(\d+)", r"(?i)Rows\s*[:=]\s*(\d+)")
MYSQL_ROWS = r"(?i)rows[:\s]+(\d+)"
POSTGRESQL_COST = (r'(?i)Total Cost["\s:]+([0-9.]+)', r'(?i)cost["\s:=]+[0-9.]+\.\.([0-9.]+)')
POSTGRESQL_ROWS = (r'(?i)Plan Rows["\s:]+(\d+)', r'(?i)rows["\s:=]+(\d+)')
# Recommendation texts.
FULL_SCAN = "⚠️ Full table scan detected. Consider adding indexes."
SEQ_SCAN = "⚠️ Sequential scan detected. Consider adding indexes."
CARTESIAN = "❌ Cartesian product detected! Missing JOIN condition?"
FILESORT = "⚠️ Filesort detected. Consider adding index on ORDER BY columns."
TEMPORARY = "⚠️ Temporary table used. Consider query optimization."
NO_INDEX = "❌ No index used. Query may be very slow!"
NESTED_LOOP = "⚠️ Nested loop with large dataset. Consider hash join."
SORT = "💡 Sort operation detected. Ensure indexed ORDER BY if possible."
HIGH_ROWS = ("⚠️ High row count: ", " rows. Consider adding WHERE filters.")
HIGH_ROWS_LIMIT = ("⚠️ High row count: ", " rows. Consider limiting results.")


def _first_number(plan: Column, *patterns: str) -> Column:
    """The first pattern that occurs, as a number; 0 when none does."""
    found = [F.nullif(F.regexp_extract(plan, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(F.coalesce(*found).try_cast("double"), F.lit(0.0))


def _many_rows(rows: Column, words: tuple[str, str]) -> Column:
    text = F.concat(F.lit(words[0]), F.format_number(rows, 0), F.lit(words[1]))
    return F.when(rows > MANY_ROWS, text)


def _advice(*hints: Column) -> Column:
    return F.array_compact(F.array(*hints))


def _oracle(plan: Column) -> Column:
    raw, rows = _first_number(plan, *ORACLE_COST), _first_number(plan, *ORACLE_ROWS)
    cartesian = plan.contains("CARTESIAN")
    cost = F.when(cartesian, raw * CARTESIAN_FACTOR).otherwise(raw)
    seconds = cost / ORACLE_PER_SECOND
    full = plan.contains("TABLE ACCESS FULL")
    return F.struct(
        F.when(rows > MANY_ROWS, seconds * (rows / MANY_ROWS)).otherwise(seconds).alias("estimated_time_sec"),
        rows.alias("estimated_rows"),
        cost.alias("estimated_cost"),
        full.alias("has_full_table_scan"),
        _advice(F.when(full, FULL_SCAN), F.when(cartesian, CARTESIAN), _many_rows(rows, HIGH_ROWS)).alias(
            "recommendations"
        ),
    )


def _mysql(plan: Column) -> Column:
    counts = F.regexp_extract_all(plan, F.lit(MYSQL_ROWS), F.lit(1))
    product = F.aggregate(counts, F.lit(1.0), lambda acc, n: acc * n.cast("double"))
    rows = F.when(F.size(counts) > 0, product).otherwise(0.0)
    full = plan.contains("ALL")
    filesort, temporary = plan.contains("Using filesort"), plan.contains("Using temporary")
    cost = F.when(filesort, FILESORT_COST).otherwise(0.0) + F.when(temporary, TEMPORARY_COST).otherwise(0.0)
    no_index = full & plan.contains("NULL")
    return F.struct(
        (rows / MYSQL_ROWS_PER_SECOND + cost / MYSQL_COST_PER_SECOND).alias("estimated_time_sec"),
        rows.alias("estimated_rows"),
        cost.alias("estimated_cost"),
        full.alias("has_full_table_scan"),
        _advice(
            F.when(full, FULL_SCAN),
            F.when(filesort, FILESORT),
            F.when(temporary, TEMPORARY),
            F.when(no_index, NO_INDEX),
        ).alias("recommendations"),
    )


def _postgresql(plan: Column) -> Column:
    cost, rows = _first_number(plan, *POSTGRESQL_COST), _first_number(plan, *POSTGRESQL_ROWS)
    seconds = cost / POSTGRESQL_PER_SECOND
    full = plan.contains("Seq Scan")
    return F.struct(
        F.when(rows > MANY_ROWS, seconds * ((rows / MANY_ROWS) * POSTGRESQL_ROW_FACTOR)).otherwise(seconds).alias(
            "estimated_time_sec"
        ),
        rows.alias("estimated_rows"),
        cost.alias("estimated_cost"),
        full.alias("has_full_table_scan"),
        _advice(
            F.when(full, SEQ_SCAN),
            F.when(plan.contains("Nested Loop") & (rows > NESTED_LOOP_ROWS), NESTED_LOOP),
            F.when(plan.contains("Sort"), SORT),
            _many_rows(rows, HIGH_ROWS_LIMIT),
        ).alias("recommendations"),
    )


def audit_plans(df: DataFrame, engine: str = "engine", plan: str = "plan") -> DataFrame:
    """Add time, row and cost estimates, a level, a scan flag and advice per plan.

    Plans of unknown engines get NULL estimates and are not acceptable.
    """
    kind, body = F.lower(F.col(engine)), F.col(plan)
    found = (
        F.when(kind == "oracle", _oracle(body))
        .when(kind == "mysql", _mysql(body))
        .when(kind == "postgresql", _postgresql(body))
    )
    seconds = F.col("estimated_time_sec")
    level = F.when(seconds.isNull(), "excessive")
    for name, above in LEVELS:
        level = level.when(seconds > above, name)
    return (
        df.withColumn("_found", found)
        .select(*df.columns, "_found.*")
        .withColumn("cost_level", level.otherwise(LOWEST_LEVEL))
        .withColumn("is_acceptable", F.coalesce(seconds <= MAX_SECONDS, F.lit(False)))
    )

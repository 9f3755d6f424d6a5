"""Read-only audit of a table of SQL texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords a read-only query must not contain.
DANGEROUS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER",
    "CREATE", "GRANT", "REVOKE", "EXECUTE", "CALL", "EXEC",
    "MERGE", "REPLACE", "RENAME", "LOCK", "UNLOCK",
)
# How a query may begin, and the violation texts.
ALLOWED_STARTS = ("SELECT", "WITH")
EMPTY = "Query is empty"
BAD_START = "Query must start with SELECT or WITH (for CTEs). Found: "
SELECT_INTO = "SELECT INTO is not allowed (creates new tables)"
MULTI_STATEMENT = "Multi-statement queries not allowed (security risk). Found multiple semicolons."
HIDDEN_IN_COMMENT = "Suspicious comments detected that might hide dangerous code"
UNION_INJECTION = "UNION with dangerous keywords detected (possible injection)"

_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ANY = "|".join(DANGEROUS)
_WORD = rf"(?U)\b({_ANY})\b"


def _query_type(upper: Column) -> Column:
    """The allowed start, else the first word, after one leading comment."""
    bare = F.when(upper.startswith("/*"), F.regexp_replace(upper, r"(?s)^/\*.*?\*/", "")).otherwise(upper)
    bare = F.when(bare.startswith("--"), F.regexp_replace(bare, r"(?d)^--.*\n", "")).otherwise(bare)
    word = F.nullif(F.regexp_extract(bare, r"(?U)^(\w+)", 1), F.lit(""))
    kind = F.coalesce(word, F.lit("INVALID"))
    for start in reversed(ALLOWED_STARTS):
        kind = F.when(bare.startswith(start), start).otherwise(kind)
    return kind


def _keywords_found(upper: Column) -> Column:
    """Violations for whole-word keywords, in the order of the list."""
    found = F.regexp_extract_all(upper, F.lit(_WORD), F.lit(1))
    ordered = F.array_intersect(F.array(*[F.lit(k) for k in DANGEROUS]), found)
    return F.transform(ordered, lambda k: F.concat(F.lit("Dangerous keyword '"), k, F.lit("' detected")))


def _too_many_statements(sql: Column, strict: bool) -> Column:
    bare = F.regexp_replace(F.regexp_replace(sql, r"'[^']*'", ""), r'"[^"]*"', "")
    if strict:
        # Any semicolon with more text after it separates two statements.
        return bare.rlike(r"(?s);\s*[^;\s]")
    return F.length(bare) - F.length(F.replace(bare, F.lit(";"), F.lit(""))) > 1


def _hidden_in_comment(upper: Column) -> Column:
    blocks = F.regexp_extract_all(upper, F.lit(r"(?s)(/\*.*?\*/)"), F.lit(1))
    lines = F.regexp_extract_all(upper, F.lit(r"(?d)(--.*)"), F.lit(1))
    return F.exists(F.concat(blocks, lines), lambda c: c.rlike(_ANY))


def _keyword_after_union(upper: Column) -> Column:
    parts = F.split(upper, "UNION")
    return F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(_WORD))


def audit_queries(df: DataFrame, col: str = "sql_text", strict: bool = False) -> DataFrame:
    """Add ``query_type``, ``violations``, ``is_safe`` and ``sanitized_query``.

    ``strict`` also rejects two statements joined by a single semicolon.
    """
    text = F.btrim(F.coalesce(F.col(col), F.lit("")), F.lit(_BLANKS))
    rows = df.withColumn("_sql", text).withColumn("_upper", F.upper("_sql"))
    sql, upper = F.col("_sql"), F.col("_upper")
    empty = sql == ""
    rows = rows.withColumn("query_type", F.when(empty, "INVALID").otherwise(_query_type(upper)))

    def when(condition: Column, message: Column) -> Column:
        return F.when(condition, F.array(message)).otherwise(F.array().cast("array<string>"))

    # The cheap containment tests keep most texts away from the patterns.
    commented = sql.contains("--") | sql.contains("/*")
    problems = F.concat(
        when(~F.col("query_type").isin(*ALLOWED_STARTS), F.concat(F.lit(BAD_START), F.col("query_type"))),
        _keywords_found(upper),
        when(upper.contains("INTO") & upper.rlike(r"(?sU)\bSELECT\b.*\bINTO\b"), F.lit(SELECT_INTO)),
        when(sql.contains(";") & _too_many_statements(sql, strict), F.lit(MULTI_STATEMENT)),
        when(commented & _hidden_in_comment(upper), F.lit(HIDDEN_IN_COMMENT)),
        when(upper.contains("UNION") & _keyword_after_union(upper), F.lit(UNION_INJECTION)),
    )
    rows = rows.withColumn("violations", F.when(empty, F.array(F.lit(EMPTY))).otherwise(problems))
    safe = F.size("violations") == 0
    return rows.withColumn("is_safe", safe).select(
        *df.columns,
        "query_type",
        "violations",
        "is_safe",
        F.when(safe, F.regexp_replace(sql, ";+$", "")).alias("sanitized_query"),
    )


def check_counters(total: Column, blocked: Column) -> list[Column]:
    """Checks made, checks blocked and the share that passed, in percent."""
    rate = F.when(total > 0, (total - blocked) / total * 100).otherwise(0.0)
    return [total.alias("total_checks"), blocked.alias("blocked_checks"), rate.alias("success_rate")]


def query_stats(audited: DataFrame) -> DataFrame:
    """Counters over audited queries; empty texts are checked but not blocked."""
    blocked = ~F.col("is_safe") & (F.col("violations")[0] != EMPTY)
    return audited.agg(F.count("*").alias("t"), F.count_if(blocked).alias("b")).select(
        *check_counters(F.col("t"), F.col("b"))
    )


def plan_stats(audited: DataFrame) -> DataFrame:
    """Counters over audited plans."""
    return audited.agg(F.count("*").alias("t"), F.count_if(~F.col("is_acceptable")).alias("b")).select(
        *check_counters(F.col("t"), F.col("b"))
    )


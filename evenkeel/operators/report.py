"""Counts, scores and listings over a comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import scores
from evenkeel.operators import diff
from evenkeel.operators.rowindex import with_row_index
from evenkeel.spec import DUPLICATE_KEY, MATCH, MISSING_IN_SOURCE, MISSING_IN_TARGET, VALUE_MISMATCH, CompareSpec


def _rows(n: str, status: str | None = None) -> Column:
    counted = F.col(n) if status is None else F.when(F.col("row_status") == status, F.col(n))
    return F.coalesce(F.sum(counted), F.lit(0).cast("long"))


def status_counts() -> list[Column]:
    """Aggregates over keyed-diff rows; every input row is counted once per side."""
    return [
        _rows("n_source").alias("total_rows_source"),
        _rows("n_target").alias("total_rows_target"),
        _rows("n_source", MATCH).alias("matching_rows"),
        _rows("n_source", VALUE_MISMATCH).alias("mismatched_rows"),
        _rows("n_source", MISSING_IN_TARGET).alias("missing_in_target"),
        _rows("n_target", MISSING_IN_SOURCE).alias("missing_in_source"),
        _rows("n_source", DUPLICATE_KEY).alias("duplicate_rows_source"),
        _rows("n_target", DUPLICATE_KEY).alias("duplicate_rows_target"),
    ]


def scored(counts: DataFrame) -> DataFrame:
    score = scores.match_score(F.col("matching_rows"), F.col("total_rows_source"), F.col("total_rows_target"))
    clean = (
        (F.col("matching_rows") == F.col("total_rows_source"))
        & (F.col("matching_rows") == F.col("total_rows_target"))
    )
    return (
        counts.withColumn("match_status", F.when(clean, "identical").otherwise("mismatch"))
        .withColumn("match_score", score)
        .withColumn("rating", scores.rating(F.col("match_score")))
        .withColumn("outcome", scores.outcome(F.col("match_score")))
    )


def summary(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """One row: counts per status, differing columns, score and rating.

    All of it comes from one pass over the paired rows.
    """
    return scored(counts(source, target, spec))


def counts(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """One row: counts per status, compared and differing columns."""
    paired = diff.pair(source, target, spec)
    differs = [
        (paired.both() & ~paired.equal(c)).alias(f"_differs_{c}") for c in paired.columns
    ]
    rows = paired.rows.select("n_source", "n_target", paired.status().alias("row_status"), *differs)
    marks = [F.coalesce(F.bool_or(f"_differs_{c}"), F.lit(False)).alias(f"_differs_{c}") for c in paired.columns]
    found = rows.agg(*status_counts(), *marks)
    if not spec.exact and paired.columns:
        return found.drop("_differs_digest")
    n_differing = F.lit(0)
    for c in paired.columns:
        n_differing = n_differing + F.col(f"_differs_{c}").cast("int")
    found = found.withColumn("columns_compared", F.lit(len(paired.columns))).withColumn(
        "columns_with_differences", n_differing
    )
    return found.drop(*[f"_differs_{c}" for c in paired.columns])


def summary_by(source: DataFrame, target: DataFrame, spec: CompareSpec, segment: str) -> DataFrame:
    """One summary per value of ``segment``, which may differ between the sides.

    A key belongs to the segment of its source rows, else to that of its target rows;
    of a repeated key whose rows differ in it, to the smallest.
    """
    sides = [df.withColumn("_segment", F.col(segment)) for df in (source, target)]
    columns = diff.compare_columns(source, target, spec)
    paired = diff.pair(sides[0], sides[1], replace(spec, columns=tuple(columns)), carry=["_segment"])
    rows = paired.rows.select(
        F.coalesce("source__segment", "target__segment").alias("segment"),
        "n_source",
        "n_target",
        paired.status().alias("row_status"),
    )
    return scored(rows.groupBy("segment").agg(*status_counts()))


def mismatches_by_column(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """Differing values per column, most first; one conditional count per column."""
    paired = diff.pair(source, target, replace(spec, exact=True), how="inner")
    counted = paired.rows.agg(
        *[F.count_if(paired.both() & ~paired.equal(c)).alias(c) for c in paired.columns]
    )
    long = counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mismatch_count")) for c in paired.columns])
        ).alias("m")
    ).select("m.*")
    return long.where(F.col("mismatch_count") > 0).orderBy(F.desc("mismatch_count"), "column_name")


def mismatch_sample(differences: DataFrame, keys: Sequence[str], limit: int = 5000) -> DataFrame:
    """The first ``limit`` differences in key order, for display."""
    return differences.orderBy(*keys, "column_name").limit(limit)


def row_key(keys: Sequence[str]) -> Column:
    """Key columns as one text that can be told apart: parts are joined by a bar, a bar or backslash in a text gets a
    backslash before it, and NULL is ``\\N``."""
    parts = [F.regexp_replace(F.col(k).cast("string"), r"([\\|])", r"\\$1") for k in keys]
    return F.concat_ws("|", *[F.coalesce(part, F.lit("\\N")) for part in parts])


def report_rows(differences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mismatch report: numbered differences in key order with the key as text."""
    numbered = with_row_index(differences, [*keys, "column_name"])
    return numbered.select(
        "row_number",
        row_key(keys).alias("row_key"),
        "column_name",
        "source_value",
        "target_value",
        "difference_type",
    )

"""Key quality and volume checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row counts that separate low, medium and high volume.
MEDIUM_ROWS = 100_000
HIGH_ROWS = 1_000_000


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a NULL key, distinct keys, repeated keys and surplus rows.

    Key counts combine before the shuffle, so a key with very many rows costs no
    more than any other.
    """
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null_key = any_null(keys)
    repeated = ~null_key & (F.col("n") > 1)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return groups.agg(
        total(F.col("n")).alias("total_rows"),
        total(F.when(null_key, F.col("n"))).alias("null_key_rows"),
        F.count_if(~null_key).alias("distinct_keys"),
        F.count_if(repeated).alias("duplicate_groups"),
        total(F.when(repeated, F.col("n"))).alias("duplicate_rows"),
        total(F.when(repeated, F.col("n") - 1)).alias("surplus_rows"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without NULL that occur more than once, with their row counts."""
    return (
        df.where(~any_null(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    )


def volume_check(
    source: DataFrame, target: DataFrame, medium: int = MEDIUM_ROWS, high: int = HIGH_ROWS
) -> DataFrame:
    """Row count per side with its volume level and a warning flag."""
    sides = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(side).alias("side"), "row_count")
        for side, df in (("source", source), ("target", target))
    ]
    n = F.col("row_count")
    return sides[0].unionByName(sides[1]).select(
        "side",
        "row_count",
        F.when(n > high, "high").when(n >= medium, "medium").otherwise("low").alias("volume"),
        (n >= medium).alias("needs_warning"),
    )

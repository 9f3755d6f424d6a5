"""Global row numbers and n-th-of-key numbers without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import pinned

# monotonically_increasing_id() is (partition << 33) + row in partition.
_ROW_BITS = 33


def _sorted(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_part`` and ``_at``, first position of each part): the rows in order of
    ``order``, then of all other columns.

    Rows are range-partitioned and sorted, so each partition holds one stretch of
    the order; a stretch starts where the counts before it end. Only one count per
    partition meets in one place. Equal rows are spread by a tie column, so copies
    of one row may fill many partitions. The sorted rows are written once, because
    sampled range bounds may differ when a partition is computed again.
    """
    rest = [c for c in df.columns if c not in order]
    ranked = [*order, *rest]
    spread = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*ranked, "_tie")
        .sortWithinPartitions(*ranked)
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    fixed = pinned(spread).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition of the range shuffle: small by construction.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return fixed, sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))


def _position() -> Column:
    return F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Number all rows from 1 in the order of ``order``, then of all other columns."""
    fixed, starts = _sorted(df, order)
    return fixed.join(F.broadcast(starts), "_part").select(*df.columns, _position().alias(name))


def with_ordinal(df: DataFrame, keys: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Number the rows of each key from 1, ordered by all other columns.

    Rows are numbered within their stretch of the sorted order and key, to which the
    key's rows in earlier stretches are added. A key goes on over a border only if it
    is the first of the next stretch, so one small row for each stretch crosses; no
    task holds more than a stretch, however many rows a key has. Keys meet as a
    struct, which makes NULL keys meet as well.
    """
    fixed, _ = _sorted(df, list(keys))
    rows = fixed.withColumn("_key", F.struct(*keys))
    first = rows.groupBy("_part").agg(F.min_by("_key", "_at").alias("_key"))
    # Only keys that begin a stretch can have rows before it, so other rows are left out before any are counted.
    border = rows.select("_part", "_key").join(F.broadcast(first.select("_key").distinct()), "_key")
    carried = border.groupBy("_part", "_key").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opening = carried.select("_part", "_key", F.sum("_rows").over(before).alias("_before")).where("_before > 0")
    within = F.row_number().over(Window.partitionBy("_part", "_key").orderBy("_at"))
    # A stretch goes to the task of its number, where a hash could bring several together.
    stretches = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionById(stretches, F.col("_part").cast("int")).withColumn("_within", within.cast("long")).join(F.broadcast(opening), ["_part", "_key"], "left")
    return numbered.select(*df.columns, (F.col("_within") + F.coalesce("_before", F.lit(0))).alias(name))

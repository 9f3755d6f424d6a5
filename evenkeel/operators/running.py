"""Running aggregates per key that split a very long key by time.

A window over one key puts all its rows in one task. Here rows are first dealt out
by ranges of (key, time), so a key with many rows spreads over as many parts as it
fills, however its rows lie in time. Totals per (key, part) are few, their prefix
enters each part as one opening row, and the window runs per (key, part).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import pinned

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}
_FIRST = -(1 << 63)


@dataclass(frozen=True)
class Fold:
    """A running ``kind`` ('sum', 'max', 'min') over column ``over``."""

    kind: str
    over: str

    def __call__(self, column: str) -> Column:
        return _FOLDS[self.kind](column)


def running(
    df: DataFrame, keys: Sequence[str], at: str, folds: Mapping[str, Fold], after: Sequence[str] = ()
) -> DataFrame:
    """Add running folds over the rows of a key up to this one, in order of ``at``.

    ``at`` is a whole number (microseconds). By default all rows at the same
    ``at`` are included; with tie-break columns ``after`` the rows are strictly
    ordered and only those before this one count. The dealt rows are written once:
    sampled ranges may differ when a lost part is computed again. All columns of
    ``df`` are, so hand over those that are needed.
    """
    keys = list(keys)
    dealt = df.repartitionByRange(*keys, at, *after).withColumn("_part", F.spark_partition_id())
    rows = pinned(dealt)
    totals = rows.groupBy(*keys, "_part").agg(*[fold(fold.over).alias(f"_t_{n}") for n, fold in folds.items()])
    # a row per part that a key fills
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(
        *keys,
        "_part",
        F.lit(True).alias("_opening"),
        F.lit(_FIRST).cast("long").alias(at),
        *[fold(f"_t_{n}").over(before).alias(f"_v_{n}") for n, fold in folds.items()],
    )
    values = {f"_v_{n}": F.col(fold.over) for n, fold in folds.items()}
    every = rows.withColumns({"_opening": F.lit(False), **values}).unionByName(opening, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_part")
    if after:
        # NULL tie-breaks sort first, so the opening row is told apart as well
        inside = inside.orderBy(at, F.desc("_opening"), *after).rowsBetween(Window.unboundedPreceding, -1)
    else:
        inside = inside.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = {n: fold(f"_v_{n}").over(inside) for n, fold in folds.items()}
    return every.withColumns(out).where(~F.col("_opening")).select(*df.columns, *folds)

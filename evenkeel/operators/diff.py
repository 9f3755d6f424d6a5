"""Keyed, positional and multiset comparison of two relations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.keys import any_null
from evenkeel.operators.normalize import compare_columns, folded, normalized
from evenkeel.operators.rowindex import with_ordinal, with_row_index
from evenkeel.spec import (
    DUPLICATE_KEY,
    MATCH,
    MISSING_IN_SOURCE,
    MISSING_IN_TARGET,
    VALUE_MISMATCH,
    CompareSpec,
)

SIDES = ("source", "target")
_LONE = "_lone"


@dataclass(frozen=True)
class Paired:
    """Both sides brought together, one row per key.

    ``rows`` has the keys, ``n_source``/``n_target`` (rows of the key per side, 0
    when absent) and ``source_<c>``/``target_<c>`` per compared column.
    """

    rows: DataFrame
    spec: CompareSpec
    columns: list[str]
    keys: list[str]

    def both(self) -> Column:
        return (F.col("n_source") == 1) & (F.col("n_target") == 1)

    def equal(self, name: str) -> Column:
        return self.spec.equal(name, F.col(f"source_{name}"), F.col(f"target_{name}"))

    def status(self) -> Column:
        same = reduce(lambda a, b: a & b, [self.equal(c) for c in self.columns], F.lit(True))
        return (
            F.when(F.col("n_target") == 0, MISSING_IN_TARGET)
            .when(F.col("n_source") == 0, MISSING_IN_SOURCE)
            .when(~self.both(), DUPLICATE_KEY)
            .when(same, MATCH)
            .otherwise(VALUE_MISMATCH)
        )


def collapsed(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per key: how many rows it has, and their values when it is one.

    Columns to ``carry`` are kept for repeated keys too: the smallest value of the
    key's rows. Map-side combine folds a repeated key before the shuffle, so neither
    a key with very many rows nor a join fan-out can arise. The later join reuses
    this partitioning and adds no shuffle.
    """
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias(f"n_{side}"),
        *[F.first(c).alias(f"_{side}_{c}") for c in columns],
        *[F.min(c).alias(f"{side}_{c}") for c in carry],
    )
    single = F.col(f"n_{side}") == 1
    return grouped.select(
        *keys,
        f"n_{side}",
        *[F.when(single, F.col(f"_{side}_{c}")).alias(f"{side}_{c}") for c in columns],
        *[f"{side}_{c}" for c in carry],
    )


def _one_each(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str, carry: Sequence[str]
) -> DataFrame:
    """Rows that are alone under their key already."""
    return df.select(
        *keys,
        F.lit(1).cast("long").alias(f"n_{side}"),
        *[F.col(c).alias(f"{side}_{c}") for c in (*columns, *carry)],
    )


def _digests(sides: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str], carry: Sequence[str]):
    """Both sides with one hash per row over the compared values.

    Values are hashed in the type both sides can be widened to, each with a mark
    that tells NULL from a value: a hash alone skips NULLs, and hashes an int
    unlike the equal long.
    """
    common = sides[0].select(*columns).limit(0).unionByName(sides[1].select(*columns).limit(0)).schema
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast(common[c].dataType))]
    return [df.select(*keys, F.xxhash64(*cells).alias("digest"), *carry) for df in sides]


def pair(
    source: DataFrame,
    target: DataFrame,
    spec: CompareSpec,
    how: str = "full_outer",
    unique: bool = False,
    carry: Sequence[str] = (),
) -> Paired:
    """Bring both sides together by key; ``how`` is 'full_outer' or 'inner'.

    Under plain ``=`` rows with a NULL key match nothing. Each gets a number of its
    own, so they neither meet nor fill one partition, and come out as unmatched rows
    of their side from the same pass as all others. ``unique`` is for keys that
    cannot repeat, such as a row number. ``carry`` names columns that are not
    compared but come along as ``source_<c>``/``target_<c>``.
    """
    if not spec.keys:
        raise ValueError("a keyed compare needs keys; use multiset_diff or positional_diff without")
    columns = compare_columns(source, target, spec)
    keys, carry = list(spec.keys), list(carry)
    sides = [normalized(df, [*columns, *carry], spec) for df in (source, target)]
    if not spec.exact and columns:
        sides = _digests(sides, keys, columns, carry)
        columns = ["digest"]
    nullable = any(f.nullable for df in sides for f in df.schema.fields if f.name in keys)
    lone = []
    if nullable and not spec.null_safe_keys and not unique:
        own = F.when(any_null(keys), F.monotonically_increasing_id() + 1).otherwise(0)
        sides = [df.withColumn(_LONE, own) for df in sides]
        lone = [_LONE]

    if spec.duplicates == "ordinal":
        sides = [with_ordinal(df, [*keys, *lone]) for df in sides]
        keys = [*keys, "ordinal"]
        unique = True
    prepare = _one_each if unique else collapsed
    if spec.null_safe_keys:
        # A struct of keys is never NULL itself, so plain equality on it is
        # null-safe and the join can reuse the aggregation's partitioning.
        packed = [df.withColumn("_key", F.struct(*keys)).drop(*keys) for df in sides]
        a, b = (prepare(df, ["_key"], columns, s, carry) for s, df in zip(SIDES, packed))
        rows = a.join(b, "_key", how).select("_key.*", *[c for c in (*a.columns, *b.columns) if c != "_key"])
    else:
        a, b = (prepare(df, [*keys, *lone], columns, s, carry) for s, df in zip(SIDES, sides))
        rows = a.join(b, [*keys, *lone], how).drop(*lone)
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({f"n_{s}": F.coalesce(F.col(f"n_{s}"), zero) for s in SIDES})
    return Paired(rows, spec, columns, keys)


def keyed_diff(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """Every key with its row status, row counts and both sides' values.

    A side has values where the key has exactly one row there; its row count tells
    a repeated key (NULL values, count above 1) from an absent one (count 0).
    """
    paired = pair(source, target, spec)
    return paired.rows.withColumn("row_status", paired.status())


def row_statuses(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """Every key with its row status only."""
    paired = pair(source, target, spec)
    return paired.rows.select(*paired.keys, "n_source", "n_target", paired.status().alias("row_status"))


def wide_diff(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """Keys that differ or lack a side, with row counts, values and a difference type per column.

    The type says which side lacks the row, or compares both values where each side
    has exactly one row; a repeated key has no single value to compare: NULL.
    """
    paired = pair(source, target, replace(spec, exact=True))

    def kind(name: str) -> Column:
        return (
            F.when(F.col("n_source") == 0, "MISSING_SOURCE")
            .when(F.col("n_target") == 0, "MISSING_TARGET")
            .when(paired.both(), _column_status(paired, name))
        )

    kinds = [kind(c).alias(f"{c}_diff_type") for c in paired.columns]
    values = [f"{s}_{c}" for c in paired.columns for s in SIDES]
    counts = [f"n_{s}" for s in SIDES]
    rows = paired.rows.select(*paired.keys, *counts, *values, *kinds, paired.status().alias("row_status"))
    return rows.where(F.col("row_status") != MATCH)


def _column_status(paired: Paired, name: str) -> Column:
    a, b = F.col(f"source_{name}"), F.col(f"target_{name}")
    return (
        F.when(paired.equal(name), "MATCH")
        .when(a.isNull(), "MISSING_SOURCE")
        .when(b.isNull(), "MISSING_TARGET")
        .otherwise("VALUE_MISMATCH")
    )


def as_text(df: DataFrame, name: str) -> Column:
    """A compared value as text; a double as the shortest text that reads back to it."""
    return F.col(name).cast("string")


def value_diff(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """One row per differing value of keys present once on both sides.

    Only rows that differ somewhere are unpivoted.
    """
    paired = pair(source, target, replace(spec, exact=True), how="inner")
    rows = paired.rows.where(paired.status() == VALUE_MISMATCH)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                as_text(rows, f"source_{c}").alias("source_value"),
                as_text(rows, f"target_{c}").alias("target_value"),
                _column_status(paired, c).alias("difference_type"),
            )
            for c in paired.columns
        ]
    )
    differing = F.filter(cells, lambda cell: cell["difference_type"] != "MATCH")
    return rows.select(*paired.keys, F.explode(differing).alias("cell")).select(*paired.keys, "cell.*")


def missing_in_target(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """Source rows whose key the target lacks (NULL keys match nothing)."""
    return _missing(source, target, spec)


def missing_in_source(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    return _missing(target, source, spec)


def _missing(rows: DataFrame, other: DataFrame, spec: CompareSpec) -> DataFrame:
    """Rows without a partner.

    The other side's keys are made distinct first, so a key it repeats very often
    is one row. They are grouped as a struct, which makes the join shuffle them
    once more: only then can adaptive execution split a hot key among ``rows``.
    """
    keys = list(spec.keys)
    there = other.select(F.struct(*[folded(other, k, spec) for k in keys]).alias("_key")).distinct().select("_key.*")
    there = there.toDF(*[f"_there_{k}" for k in keys])
    same = Column.eqNullSafe if spec.null_safe_keys else Column.__eq__
    return rows.join(there, [same(folded(rows, k, spec), F.col(f"_there_{k}")) for k in keys], "left_anti")


def missing_rows(source: DataFrame, target: DataFrame, spec: CompareSpec) -> DataFrame:
    """Both halves of the unmatched keys with the side that lacks them."""
    halves = [
        missing_in_target(source, target, spec)
        .select(*spec.keys)
        .withColumn("row_status", F.lit(MISSING_IN_TARGET)),
        missing_in_source(source, target, spec)
        .select(*spec.keys)
        .withColumn("row_status", F.lit(MISSING_IN_SOURCE)),
    ]
    return halves[0].unionByName(halves[1])


def multiset_diff(source: DataFrame, target: DataFrame, spec: CompareSpec = CompareSpec()) -> DataFrame:
    """Rows without keys as multisets: which side has more copies, and how many.

    Copies count +1 in the source and -1 in the target, so one shuffle of
    pre-summed rows answers both directions.
    """
    columns = compare_columns(source, target, spec)
    sides = [
        normalized(source, columns, spec).withColumn("_sign", F.lit(1).cast("long")),
        normalized(target, columns, spec).withColumn("_sign", F.lit(-1).cast("long")),
    ]
    rows = [*spec.keys, *columns]
    net = sides[0].unionByName(sides[1]).groupBy(*rows).agg(F.sum("_sign").alias("_net"))
    return net.where(F.col("_net") != 0).select(
        *rows,
        F.when(F.col("_net") > 0, "source_only").otherwise("target_only").alias("side"),
        F.abs("_net").alias("copies"),
    )


def positional_diff(
    source: DataFrame, target: DataFrame, spec: CompareSpec, sort_by: Sequence[str] | None = None
) -> DataFrame:
    """Sort both sides alike and compare the n-th row with the n-th."""
    every = [*spec.keys, *compare_columns(source, target, spec)]
    by_value = replace(spec, keys=(), columns=every)
    order = list(sort_by or every)
    sides = [with_row_index(normalized(df, every, by_value), order) for df in (source, target)]
    by_position = replace(by_value, keys=("row_number",), duplicates="report", null_safe_keys=False)
    paired = pair(sides[0], sides[1], by_position, unique=True)
    return paired.rows.withColumn("row_status", paired.status())

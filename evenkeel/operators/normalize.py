"""Column choice and value normalisation before a compare."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.spec import CompareSpec


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def common_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns both sides have, in source order."""
    there = set(target.columns)
    return [c for c in source.columns if c in there]


def compare_columns(source: DataFrame, target: DataFrame, spec: CompareSpec) -> list[str]:
    """The columns whose values are compared.

    A column ignored on one side only cannot be compared, so it is left out too.
    """
    left_out = {*spec.keys, *spec.ignore, *spec.ignore_source, *spec.ignore_target}
    wanted = common_columns(source, target) if spec.columns is None else list(spec.columns)
    chosen = [c for c in wanted if c not in left_out]
    for side, df in (("source", source), ("target", target)):
        absent = [c for c in (*spec.keys, *chosen) if c not in df.columns]
        if absent:
            raise ValueError(f"{side} has no column {absent}; it has {df.columns}")
    return chosen


def normalized(df: DataFrame, columns: Iterable[str], spec: CompareSpec) -> DataFrame:
    """Keys and compared columns only, with strings (of keys too) trimmed and folded as asked."""
    return df.select(*[folded(df, c, spec) for c in (*spec.keys, *columns)])


def folded(df: DataFrame, name: str, spec: CompareSpec) -> Column:
    """A column as it is compared: trimmed and folded if it is text and the spec asks for it."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        c = F.trim(c) if spec.trim else c
        c = c if spec.case_sensitive else F.lower(c)
    return c.alias(name)


def canonical_date(c: Column, pattern: str, out: str = "yyyy-MM-dd") -> Column:
    """Text in ``pattern`` rewritten to one format; unreadable text becomes NULL."""
    return F.date_format(F.try_to_timestamp(c, F.lit(pattern)), out)


def rounded_to(c: Column, scale: int, precision: int = 38) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def without_null_keys(df: DataFrame, keys) -> DataFrame:
    return df.na.drop(subset=list(keys))


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters joined by AND; None leaves a column unfiltered."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per column: common, source_only, target_only or type_changed."""
    left = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    right = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    rows = []
    for name in [*left, *[c for c in right if c not in left]]:
        a, b = left.get(name), right.get(name)
        if b is None:
            status = "source_only"
        elif a is None:
            status = "target_only"
        else:
            status = "common" if a == b else "type_changed"
        rows.append((name, a, b, status))
    return source.sparkSession.createDataFrame(
        rows, "column_name string, source_type string, target_type string, status string"
    )

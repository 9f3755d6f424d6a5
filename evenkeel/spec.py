"""What to compare and how: the comparison spec and value comparators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Comparator = Callable[[Column, Column], Column]

MATCH = "match"
MISSING_IN_TARGET = "missing_in_target"
MISSING_IN_SOURCE = "missing_in_source"
VALUE_MISMATCH = "value_mismatch"
DUPLICATE_KEY = "duplicate_key"


def same(a: Column, b: Column) -> Column:
    """Null-safe equality: NULL equals NULL and nothing else."""
    return a.eqNullSafe(b)


def within(tolerance: float) -> Comparator:
    """Numbers at most ``tolerance`` apart are equal; NULL equals only NULL."""

    def compare(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(a - b) <= F.lit(tolerance), a.isNull() & b.isNull())

    return compare


def at_scale(scale: int, precision: int = 38) -> Comparator:
    """Compare numbers after rounding both to ``scale`` decimals."""
    kind = f"decimal({precision},{scale})"
    return lambda a, b: a.cast(kind).eqNullSafe(b.cast(kind))


def fold_case(a: Column, b: Column) -> Column:
    return F.lower(a).eqNullSafe(F.lower(b))


@dataclass(frozen=True)
class CompareSpec:
    """How two relations are matched and compared.

    keys            columns that identify a row (empty for multiset compare)
    columns         compared columns; None means all common columns but the keys
    ignore*         columns left out, on both sides or on one
    trim            strip surrounding blanks from strings, keys included
    case_sensitive  False folds strings, keys included, to lower case
    ignore_nulls    NULL against a value is not a difference
    null_safe_keys  NULL keys match each other (``<=>``); else they stay unmatched
    duplicates      'report': keys that repeat are set apart, never multiplied;
                    'ordinal': the n-th row of a key is paired with the n-th
    comparators     per-column equality, default ``same``
    exact           False compares one 64-bit digest per row in status-only jobs
    """

    keys: Sequence[str] = ()
    columns: Sequence[str] | None = None
    ignore: Sequence[str] = ()
    ignore_source: Sequence[str] = ()
    ignore_target: Sequence[str] = ()
    trim: bool = False
    case_sensitive: bool = True
    ignore_nulls: bool = False
    null_safe_keys: bool = False
    duplicates: str = "report"
    comparators: Mapping[str, Comparator] = field(default_factory=dict)
    exact: bool = True

    def __post_init__(self) -> None:
        if self.duplicates not in ("report", "ordinal"):
            raise ValueError(f"duplicates must be 'report' or 'ordinal', not {self.duplicates!r}")
        if not self.exact and (self.comparators or self.ignore_nulls):
            raise ValueError("a digest cannot honour comparators or ignore_nulls; use exact=True")

    def equal(self, name: str, a: Column, b: Column) -> Column:
        equal = self.comparators.get(name, same)(a, b)
        return (equal | a.isNull() | b.isNull()) if self.ignore_nulls else equal

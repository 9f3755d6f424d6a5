"""Match score, rating bands and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the rating bands, in percent.
RATING_BANDS = (("Excellent", 99.0), ("Good", 95.0), ("Warning", 80.0))
RATING_FLOOR = "Critical"
OUTCOME_BANDS = (("Pass", 95.0), ("Warning", 80.0))
OUTCOME_FLOOR = "Fail"


def percent(part: Column, whole: Column, scale: int = 2) -> Column:
    """``part`` of ``whole`` in percent, 0 when ``whole`` is 0.

    The quotient is rounded as a decimal, so halves round the same everywhere.
    """
    ratio = F.lit(100).cast("decimal(20,0)") * part.cast("decimal(20,0)") / whole.cast("decimal(20,0)")
    return F.when(whole > 0, F.round(ratio, scale).cast("double")).otherwise(F.lit(0.0))


def match_score(matched: Column, n_source: Column, n_target: Column) -> Column:
    return percent(matched, F.greatest(n_source, n_target))


def rounded_mean(value: Column, scale: int = 1) -> Column:
    """Mean rounded half up as a decimal, returned as a double."""
    return F.round(F.avg(value).cast("decimal(24,8)"), scale).cast("double")


def _banded(score: Column, bands, floor: str) -> Column:
    pick = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, low in bands:
        pick = pick.when(score >= low, name)
    return pick.otherwise(floor)


def rating(score: Column) -> Column:
    return _banded(score, RATING_BANDS, RATING_FLOOR)


def outcome(score: Column) -> Column:
    return _banded(score, OUTCOME_BANDS, OUTCOME_FLOOR)

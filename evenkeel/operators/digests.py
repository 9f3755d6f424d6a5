"""Compare two large, mostly equal tables by digests over key ranges, and only what differs value by value.

The range of a key is cut into ``FAN`` parts. Each side sums up its rows of a part, in any order, to a row count and two
digests of its rows' hashes; only these few numbers are shuffled. Parts whose digests are equal hold the same rows and
are done. The others are cut again, and only their rows are read, until few rows are left or cutting no longer helps;
what is left is compared exactly. Range conditions reach the scan, so files sorted by the key are skipped.

Digests are over values in their common type, NULLs marked. Two different parts pass as equal only if their counts, a
63-bit sum and a 64-bit exclusive or of two hashes agree by chance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import diff, report
from evenkeel.operators.keys import any_null
from evenkeel.operators.normalize import compare_columns, normalized
from evenkeel.spec import CompareSpec

FAN = 256
#: Parts that may differ at a level; with more the rows that they hold are compared exactly.
MOST = 1 << 14
#: Fewer rows than this in differing parts are not cut further.
FEW = 100_000
#: Range conditions in one filter.
RANGES = 100

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Differing:
    """Parts of a key's range that differ: their numbers at one level, where part n holds
    ``low + n * width <= key < low + (n + 1) * width``."""

    low: int
    width: int
    parts: list[int]
    levels: int
    #: rows (source, target) in parts that were told apart by digests alone
    equal_rows: int

    def ranges(self) -> list[tuple[int, int]]:
        """Adjacent parts as one range, first and last key; the nearest are joined while there are too many."""
        found: list[list[int]] = []
        for n in self.parts:
            first = self.low + n * self.width
            if found and found[-1][1] + 1 == first:
                found[-1][1] = first + self.width - 1
            else:
                found.append([first, first + self.width - 1])
        while len(found) > RANGES:
            gaps = sorted(b[0] - a[1] for a, b in zip(found, found[1:], strict=False))
            limit = gaps[min(len(gaps) - 1, len(found) - RANGES - 1)]
            joined = [found[0]]
            for one in found[1:]:
                if one[0] - joined[-1][1] <= limit:
                    joined[-1][1] = one[1]
                else:
                    joined.append(one)
            found = joined
        return [(a, b) for a, b in found]


def number_of(df: DataFrame, name: str) -> str:
    """A key column as a whole number, in SQL."""
    kind = df.schema[name].dataType
    if isinstance(kind, _WHOLE):
        return f"cast(`{name}` as bigint)"
    if isinstance(kind, T.DateType):
        return f"cast(unix_date(`{name}`) as bigint)"
    if isinstance(kind, T.TimestampType):
        return f"unix_micros(`{name}`)"
    raise ValueError(f"{name!r} is {kind.simpleString()}: ranges need whole numbers, dates or zoned times")


def value_of(df: DataFrame, name: str, number: int) -> Column:
    """The key value of a number, as a constant that a scan can be given."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(number))
    return F.timestamp_micros(F.lit(number)) if isinstance(kind, T.TimestampType) else F.lit(number)


def _part(df: DataFrame, by: str, low: int, width: int) -> Column:
    return F.expr(f"({number_of(df, by)} - {low}L) div {width}L")


def within(df: DataFrame, by: str, found: Differing) -> DataFrame:
    """The rows whose key lies in differing parts; ranges are pushed to the scan, parts are checked exactly."""
    ranges = found.ranges()
    if not ranges:
        return df.where(F.lit(False))
    near = [(F.col(by) >= value_of(df, by, low)) & (F.col(by) <= value_of(df, by, high)) for low, high in ranges]
    kept = df.where(reduce(lambda a, b: a | b, near))
    if sum(high - low + 1 for low, high in ranges) == len(found.parts) * found.width:
        return kept
    parts = df.sparkSession.createDataFrame([(n,) for n in found.parts], "_part long")  # at most MOST numbers
    return kept.withColumn("_part", _part(df, by, found.low, found.width)).join(F.broadcast(parts), "_part", "left_semi").drop("_part")


def without(df: DataFrame, by: str, found: Differing) -> DataFrame:
    """The rows whose key lies in no differing part."""
    parts = df.sparkSession.createDataFrame([(n,) for n in found.parts], "_part long")
    return df.withColumn("_part", _part(df, by, found.low, found.width)).join(F.broadcast(parts), "_part", "left_anti").drop("_part")


def _hashed(sides: Sequence[DataFrame], by: str, columns: Sequence[str]) -> list[DataFrame]:
    """Both sides with two hashes of each row, over values in the type that both can be widened to."""
    common = sides[0].select(*columns).limit(0).unionByName(sides[1].select(*columns).limit(0)).schema
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast(common[c].dataType))]
    one, two = F.xxhash64(*cells), F.xxhash64(F.lit("again"), *cells)
    return [df.select(by, one.alias("_one"), two.bitwiseAND((1 << 40) - 1).alias("_two")) for df in sides]


def differing(
    source: DataFrame, target: DataFrame, spec: CompareSpec, by: str | None = None, fan: int = FAN, few: int = FEW, most: int = MOST
) -> Differing | None:
    """Where two sides differ, by ranges of the key column ``by`` (the first one by default); rows with a NULL key are
    not looked at. None if there is no range to cut: no rows, or keys that span more than 2**62."""
    by = by or spec.keys[0]
    columns = compare_columns(source, target, spec)
    sides = [normalized(df, columns, spec).where(~any_null(list(spec.keys))) for df in (source, target)]
    ends = [df.select(F.expr(number_of(df, by)).alias("k")).agg(F.min("k"), F.max("k")).first() for df in sides]
    lows, highs = ([e[i] for e in ends if e[i] is not None] for i in (0, 1))
    if not lows or max(highs) - min(lows) >= 1 << 62:
        return None
    low = min(lows)
    hashed = _hashed(sides, by, [*spec.keys, *columns])
    found = Differing(low, max(highs) - low + 1, [0], 0, 0)
    while found.parts and found.width > 1:
        width = -(-found.width // fan)
        digests = []
        for name, df in zip(diff.SIDES, hashed, strict=True):
            rows = within(df, by, found).groupBy(_part(df, by, low, width).alias("_part"))
            digests.append(rows.agg(F.struct(F.count("*").alias("n"), F.bit_xor("_one").alias("x"), F.sum("_two").alias("s")).alias(name)))
        met = digests[0].join(digests[1], "_part", "full_outer")
        count = [F.coalesce(F.col(f"{s}.n"), F.lit(0)) for s in diff.SIDES]
        same = F.col("source").eqNullSafe(F.col("target"))
        # As many rows as there are parts of the differing ranges: FAN times those of the level before.
        told = met.select("_part", same.alias("same"), (count[0] + count[1]).alias("n")).collect()
        parts = sorted(r["_part"] for r in told if not r["same"])
        rows = sum(r["n"] for r in told if not r["same"])
        if len(parts) > most:
            break
        helped = len(parts) < 0.5 * len(told)
        found = Differing(low, width, parts, found.levels + 1, found.equal_rows + sum(r["n"] for r in told if r["same"]))
        if rows <= few or not helped:
            break
    return found


def summary(
    source: DataFrame, target: DataFrame, spec: CompareSpec, by: str | None = None, unique_keys: bool = False, **how
) -> DataFrame:
    """The row of ``report.summary``, in which only differing key ranges are compared value by value.

    Of equal ranges the keys alone are read once more, to find those that repeat; not if ``unique_keys`` says that none
    can. Comparators must call equal values equal.
    """
    found = differing(source, target, spec, by, **how)
    if found is None:
        return report.summary(source, target, spec)
    by, null_key = by or spec.keys[0], any_null(list(spec.keys))
    sides = [within(df.where(~null_key), by, found).unionByName(df.where(null_key)) for df in (source, target)]
    counts = report.counts(*sides, spec)
    equal = without(normalized(source, [], spec).where(~null_key), by, found)
    if unique_keys:
        repeats = equal.agg(F.count("*").alias("_rows"), F.lit(0).cast("long").alias("_repeated"))
    else:
        each = equal.groupBy(*spec.keys).agg(F.count("*").alias("n"))
        repeats = each.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("_repeated")
        )
    none = F.lit(0).cast("long")
    same = {"total_rows_source": "_rows", "total_rows_target": "_rows", "duplicate_rows_source": "_repeated", "duplicate_rows_target": "_repeated"}
    alike = repeats.select(
        *[F.col(same[c]).alias(c) if c in same else (F.col("_rows") - F.col("_repeated") if c == "matching_rows" else none).alias(c) for c in counts.columns]
    )
    both = counts.unionByName(alike)  # two rows
    return report.scored(both.agg(*[(F.max if c.startswith("columns_") else F.sum)(c).alias(c) for c in counts.columns]))

"""A compare in units that are finished one after another: partial results while it runs, and no work done twice.

The range of a key is cut into units that hold about equally many rows; the cuts are written first, so a later run has
the same. A unit reads its range of both sides (ranges reach the scan), writes its rows and then, as the last thing, its
counters; a unit without counters is done again and replaces what it has left. Rows with a NULL key are a unit of their
own. Readers may look at counters and rows of finished units at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import diff
from evenkeel.operators.digests import number_of, value_of
from evenkeel.operators.normalize import compare_columns
from evenkeel.spec import MATCH, CompareSpec


@dataclass(frozen=True)
class Unit:
    """Rows with ``low <= key < high``; NULL for an open end. The unit of NULL keys has neither."""

    number: int
    low: int | None
    high: int | None
    null_keys: bool = False


_CUTS = "unit int, low long, high long, null_keys boolean"


class ResumableCompare:
    """Compare ``source`` and ``target`` under ``path`` in ``units`` ranges of the key column ``by``.

    The sides must hold the same rows in every run, as a unit is not looked at again once it is finished.
    """

    def __init__(
        self, source: DataFrame, target: DataFrame, spec: CompareSpec, path: str, units: int = 16, by: str | None = None
    ) -> None:
        self.spark: SparkSession = source.sparkSession
        columns = compare_columns(source, target, spec)
        self.sides = [df.select(*spec.keys, *columns) for df in (source, target)]
        self.spec, self.path, self.by = spec, path.rstrip("/"), by or spec.keys[0]
        self.wanted = units

    def _there(self, folder: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def units(self) -> list[Unit]:
        """The units; the first call of the first run cuts them."""
        if not self._there("cuts"):
            keys = [df.select(F.expr(number_of(df, self.by)).alias("k")) for df in self.sides]
            shares = [i / self.wanted for i in range(1, self.wanted)]
            found = keys[0].unionByName(keys[1]).agg(F.percentile_approx("k", shares, 10_000).alias("q")).first()["q"]
            cuts = sorted(set(found or []))
            ends = [None, *cuts, None]
            rows = [(n, low, high, False) for n, (low, high) in enumerate(zip(ends, ends[1:], strict=False))]
            rows.append((len(rows), None, None, True))
            self.spark.createDataFrame(rows, _CUTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cuts")
        rows = self.spark.read.schema(_CUTS).parquet(f"{self.path}/cuts").collect()
        return sorted((Unit(*r) for r in rows), key=lambda u: u.number)

    def _within(self, df: DataFrame, unit: Unit) -> DataFrame:
        key: Column = F.col(self.by)
        if unit.null_keys:
            return df.where(key.isNull())
        df = df.where(key.isNotNull())
        df = df if unit.low is None else df.where(key >= value_of(df, self.by, unit.low))
        return df if unit.high is None else df.where(key < value_of(df, self.by, unit.high))

    def finished(self) -> set[int]:
        return {u.number for u in self.units() if self._there(f"counters/unit={u.number}")}

    def run(self, most: int | None = None) -> Iterator[dict]:
        """Do what is not finished, at most ``most`` units; gives each unit's counters when it is.

        Nothing is done before the first counters are asked for.
        """
        done = self.finished()
        left = [u for u in self.units() if u.number not in done]
        for unit in left if most is None else left[:most]:
            rows = diff.keyed_diff(*(self._within(df, unit) for df in self.sides), self.spec)
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/unit={unit.number}")
            written = self.spark.read.parquet(f"{self.path}/rows/unit={unit.number}")
            counters = written.agg(
                F.coalesce(F.sum("n_source"), F.lit(0)).alias("rows_source"),
                F.coalesce(F.sum("n_target"), F.lit(0)).alias("rows_target"),
                F.count("*").alias("keys"),
                F.count_if(F.col("row_status") != MATCH).alias("mismatches"),
            )
            counters.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counters/unit={unit.number}")
            yield {"unit": unit.number, **self.spark.read.parquet(f"{self.path}/counters/unit={unit.number}").first().asDict()}

    def _read(self, folder: str) -> DataFrame | None:
        done = sorted(self.finished())
        if not done:
            return None
        paths = [f"{self.path}/{folder}/unit={n}" for n in done]
        return self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(*paths)

    def progress(self) -> DataFrame:
        """One row: finished and all units, rows looked at and mismatches among them so far."""
        counters = self._read("counters")
        total = F.lit(len(self.units())).cast("long").alias("units")
        if counters is None:
            zero = F.lit(0).cast("long")
            names = ("finished", "rows_source", "rows_target", "keys", "mismatches")
            return self.spark.range(1).select(total, *[zero.alias(n) for n in names])
        sums = [F.sum(c).alias(c) for c in ("rows_source", "rows_target", "keys", "mismatches")]
        return counters.agg(total, F.count("*").alias("finished"), *sums)

    def rows(self) -> DataFrame | None:
        """The rows of ``diff.keyed_diff`` in finished units; None before there are any."""
        found = self._read("rows")
        return None if found is None else found.drop("unit")

"""Which column of a source is which of a target, when names differ: by the values that they hold.

One pass over each side makes a theta sketch (the smallest hashes of the distinct values) of every column, so two columns
are compared by a few kilobytes each, whatever the tables' sizes. Up to ``2**SKETCH_BITS`` distinct values a sketch holds
them all and the overlap is exact; beyond that its error is about 1.5 %.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_BITS = 12


def _text(df: DataFrame, name: str) -> F.Column:
    """A value as text that does not depend on its type: whole numbers without a point, texts without outer blanks."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.FractionalType):
        c = c.cast("double")
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
    return F.trim(c.cast("string"))


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """A row for each column: name, number of rows, share of NULLs, distinct values (estimated) and the sketch."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)] if columns is None else list(columns)
    cells = []
    for name in names:
        text = _text(df, name)
        cells.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count("*").alias("rows"),
                F.count_if(text.isNull()).alias("nulls"),
                F.theta_sketch_agg(text, F.lit(bits)).alias("sketch"),
            )
        )
    each = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    share = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(F.lit(0.0))
    return each.select("column_name", "rows", share.alias("null_share"), F.theta_sketch_estimate("sketch").alias("distinct_values"), "sketch")


def column_likeness(source: DataFrame, target: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Every pair of columns that share values: ``overlap`` (common distinct values to all of both) and ``score``, which
    takes off what their shares of NULLs differ by."""
    a = column_sketches(source, bits=bits).select([F.col(c).alias(f"source_{c}") for c in ("column_name", "null_share", "sketch")])
    b = column_sketches(target, bits=bits).select([F.col(c).alias(f"target_{c}") for c in ("column_name", "null_share", "sketch")])
    # As many rows a side as there are columns.
    met = a.join(b, F.lit(True))
    either = F.theta_sketch_estimate(F.theta_union("source_sketch", "target_sketch", F.lit(bits)))
    common = F.theta_sketch_estimate(F.theta_intersection("source_sketch", "target_sketch"))
    overlap = F.when(either > 0, common / either).otherwise(F.lit(0.0))
    scored = met.withColumn("overlap", overlap).where("overlap > 0")
    score = F.col("overlap") * (1 - F.abs(F.col("source_null_share") - F.col("target_null_share")))
    return scored.select(
        F.col("source_column_name").alias("source_column"),
        F.col("target_column_name").alias("target_column"),
        "overlap",
        score.alias("score"),
    )


def proposed_mapping(source: DataFrame, target: DataFrame, least: float = 0.5, bits: int = SKETCH_BITS) -> list[tuple[str, str, float]]:
    """(target column, source column, score) that make the target's names the source's, each column at most once.

    Pairs are taken from the best score down; of equal scores the one with the more alike names, then in order of names.
    Columns that have the same name on both sides keep it, unless their values do not meet at all.
    """
    found = [r for r in column_likeness(source, target, bits).collect() if r["score"] >= least]
    known = {r["source_column"] for r in found if r["source_column"] == r["target_column"]}

    def alike(a: str, b: str) -> int:
        return len(set(a.lower().split("_")) & set(b.lower().split("_")))

    best = sorted(
        found,
        key=lambda r: (-r["score"], -alike(r["source_column"], r["target_column"]), r["source_column"], r["target_column"]),
    )
    taken_source, taken_target, mapping = set(known), set(known), []
    for r in best:
        if r["source_column"] not in taken_source and r["target_column"] not in taken_target:
            taken_source.add(r["source_column"])
            taken_target.add(r["target_column"])
            mapping.append((r["target_column"], r["source_column"], r["score"]))
    return mapping


def as_mapping(proposed: Sequence[tuple[str, str, float]]) -> Mapping[str, str]:
    """For ``normalize.renamed`` on the target."""
    return {target: source for target, source, _ in proposed}

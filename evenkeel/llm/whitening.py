"""Whitening of embeddings by their principal components, fitted on distinct vectors.

Entries are first put on an integer grid, ``x = floor(64 * entry) + 1000000``, so that equality of vectors and all sums
are exact. Rows of equal x are one group (a shuffle with partial sums, which folds a hot vector early); the covariance
weighs a group with one or with its number of rows (``weights``). Tasks centre their part of the groups and multiply
(one GEMM a batch); the d x d partial products are summed by Spark, and the driver gets d * d numbers for each length d
of vectors, whatever the table's size. Each distinct vector is whitened once and joined back to the rows that have it;
AQE may split that join where one vector has very many rows, as both its sides come straight from a shuffle.

Cases: a row whose vector is NULL, or has a NULL, NaN or infinite entry, or one beyond 2**40 in size, is left out; NULL
ids and repeated rows are kept as they are; vectors of different lengths are fitted apart, each length on its own list;
a component without variance (eigenvalue below 1e-11 of the largest) has no whitened value and no row, so one distinct
vector, empty vectors and an empty table give no rows; a deviation beyond 64 bits is NULL; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.vectors import all_finite, lists, matrices
from evenkeel.session import pinned

GRID = 64
SHIFT = 1_000_000
#: Larger entries are left out: their grid numbers would no longer be exact in doubles.
LARGEST = float(1 << 40)
#: Eigenvalues below this share of the largest are zero up to rounding.
NO_VARIANCE = 1e-11


@dataclass(frozen=True)
class Centre:
    """Mean of vectors of one length as whole numbers plus a rest in [0, 1), with the total weight and exact sums."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors (columns) of the covariance, by falling eigenvalue; share of the trace of each."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def on_grid(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, x) of the usable rows."""
    found = rows.select(F.col(id_column).alias("id"), F.col(column).alias("v"))

    def in_range(e: Column) -> Column:
        return F.abs(e.cast("double")) <= LARGEST

    # Filters on x may run before those on v, so x must not fail on any entry.
    grid = F.transform("v", lambda e: F.when(in_range(e), F.floor(e.cast("double") * GRID).cast("long") + F.lit(SHIFT).cast("long")))
    return found.where(all_finite(F.col("v")) & F.forall("v", in_range)).select("id", grid.alias("x"))


def groups(gridded: DataFrame, weights: str = "one") -> DataFrame:
    """(x, w): each distinct vector once, with weight one or with the number of its rows; written once."""
    if weights not in ("one", "counts"):
        raise ValueError("weights are 'one' or 'counts'")
    weight = F.count("*") if weights == "counts" else F.first(F.lit(1).cast("long"))
    return pinned(gridded.groupBy("x").agg(weight.alias("w")))


def _summed(weights: np.ndarray, matrix: np.ndarray) -> list[int]:
    """Weighted sums of the columns, exact at any size."""
    if np.abs(matrix).max(initial=0) * float(weights.sum()) < 2.0**62:
        return (weights @ matrix).tolist()
    return (weights.astype(object) @ matrix.astype(object)).tolist()


def centres(distinct: DataFrame) -> dict[int, Centre]:
    """Exact total weight and sums for each length of vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            weights = batch.column("w").to_numpy()
            for rows, matrix in matrices(batch.column("x")):
                n, sums = totals.get(matrix.shape[1], (0, [0] * matrix.shape[1]))
                more = _summed(weights[rows], matrix)
                totals[matrix.shape[1]] = n + int(weights[rows].sum()), [a + b for a, b in zip(sums, more, strict=True)]
        for width, (n, sums) in totals.items():
            kinds = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pydict({"dim": [width], "n": [n], "sums": [[str(s) for s in sums]]}, kinds)

    parts = distinct.mapInArrow(each, "dim int, n long, sums array<string>")
    entry = parts.select("dim", "n", F.posexplode("sums").alias("pos", "s"))
    total = entry.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, Centre] = {}
    by_dim: dict[int, list] = {}
    for row in total.collect():  # one row for each entry of a vector
        by_dim.setdefault(row["dim"], []).append(row)
    for width, rows in by_dim.items():
        rows.sort(key=lambda r: r["pos"])
        n, sums = int(rows[0]["n"]), [int(r["s"]) for r in rows]
        whole = np.array([s // n for s in sums], np.int64)
        found[width] = Centre(n, sums, whole, np.array([(s % n) / n for s in sums]))
    return found


def _covariances(table: DataFrame, column: str, middle: dict[int, tuple]) -> dict[int, np.ndarray]:
    """Weighted covariance for each length of vectors, centred before multiplying; ``middle`` has the total weight and
    the mean as a sum of two arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column("w").to_numpy()
            for rows, matrix in matrices(batch.column(column)):
                width = matrix.shape[1]
                if width in middle:
                    _, whole, rest = middle[width]
                    centred = (matrix - whole) - rest
                    totals[width] = totals.get(width, 0.0) + centred.T @ (centred * weights[rows][:, None])
        for width, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, width, np.int32)), pa.array(np.arange(width, dtype=np.int32)), lists(total, pa.float64())],
                ["dim", "i", "row"],
            )

    parts = table.mapInArrow(each, "dim int, i int, row array<double>")
    entry = parts.select("dim", "i", F.posexplode("row").alias("j", "p"))
    summed = entry.groupBy("dim", "i", "j").agg(F.sum("p").alias("p")).toArrow()  # d * d numbers a length
    dim, i, j, p = (summed.column(name).to_numpy() for name in ("dim", "i", "j", "p"))
    found = {}
    for width in np.unique(dim).tolist():
        own = dim == width
        square = np.zeros((width, width))
        square[i[own], j[own]] = p[own]
        found[width] = (square + square.T) / (2 * middle[width][0])
    return found


def fit(distinct: DataFrame, most: int = 16) -> dict[int, Components]:
    """The first ``most`` components for each length of vectors; the sign makes the largest entry positive."""
    middle = centres(distinct)
    found = {}
    for width, square in _covariances(distinct, "x", {d: (c.n, c.whole, c.rest) for d, c in middle.items()}).items():
        values, vectors = np.linalg.eigh(square)
        values, vectors = values[::-1], vectors[:, ::-1]
        real = int(np.sum(values[:most] > NO_VARIANCE * max(values[0], 0.0)))
        vectors = vectors[:, :real] * np.sign(vectors[np.abs(vectors[:, :real]).argmax(0), np.arange(real)])
        found[width] = Components(middle[width], vectors, values[:real], values[:real] / np.trace(square))
    return found


def _deviations(matrix: np.ndarray, centre: Centre) -> list[int | None]:
    """Sum over the entries of (n * x - sum) ** 2; with x = whole + y and sum = n * whole + r this is
    n * n * sum(y * y) - 2 * n * sum(y * r) + sum(r * r)."""
    n = centre.n
    r = [s - n * w for s, w in zip(centre.sums, centre.whole.tolist(), strict=True)]
    y = matrix - centre.whole
    if float(np.abs(y).max(initial=0)) * max([abs(int(np.abs(y).max(initial=0))), n]) * max(1, y.shape[1]) >= 2.0**62:
        y = y.astype(object)
    squares, mixed = (y * y).sum(1).tolist(), (y @ np.array(r, dtype=y.dtype)).tolist()
    own = sum(v * v for v in r)
    exact = (n * n * a - 2 * n * b + own for a, b in zip(squares, mixed, strict=True))
    return [v if v < 1 << 63 else None for v in exact]


def whitened_groups(distinct: DataFrame, model: dict[int, Components]) -> DataFrame:
    """(x, w, whitened, deviation) of each distinct vector, written once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in matrices(batch.column("x")):
                part = model.get(matrix.shape[1])
                if part is None or not len(part.values):
                    continue
                centred = (matrix - part.centre.whole) - part.centre.rest
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        picked.column("x"),
                        picked.column("w"),
                        lists(centred @ part.vectors / np.sqrt(part.values), pa.float64()),
                        pa.array(_deviations(matrix, part.centre), pa.int64()),
                    ],
                    ["x", "w", "whitened", "deviation"],
                )

    return pinned(distinct.mapInArrow(each, "x array<long>, w long, whitened array<double>, deviation long"))


def identity_errors(table: DataFrame, model: dict[int, Components]) -> dict[int, float]:
    """For each length of vectors the largest entry of (covariance of the whitened vectors - identity).

    Lengths with as many components meet in one covariance unless they are told apart, so each is measured alone.
    """
    found = {}
    for width, part in model.items():
        if not len(part.values):
            continue
        own = table.where(F.size("x") == width)
        entry = own.select("w", F.posexplode("whitened").alias("pos", "v"))
        means = entry.groupBy("pos").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).collect()
        mean = np.array([r["m"] for r in sorted(means, key=lambda r: r["pos"])])
        square = _covariances(own, "whitened", {len(mean): (part.centre.n, 0.0, mean)})[len(mean)]
        found[width] = float(np.abs(square - np.eye(len(mean))).max())
    return found


def whitened(rows: DataFrame, id_column: str, column: str, most: int = 16, weights: str = "one") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component."""
    spark = rows.sparkSession
    gridded = on_grid(rows, id_column, column)
    distinct = groups(gridded, weights)
    model = fit(distinct, most)
    table = whitened_groups(distinct, model)
    errors = identity_errors(table, model)
    facts = [
        (width, k + 1, part.centre.n, float(share), errors[width])
        for width, part in model.items()
        for k, share in enumerate(part.explained)
    ]
    # At most ``most`` rows for each length of vectors.
    told = F.broadcast(spark.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double"))
    back = gridded.join(table.select("x", "whitened", "deviation"), "x")
    entry = back.select("id", F.size("x").alias("dim"), "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return (
        entry.withColumn("component", F.col("pos") + 1)
        .join(told, ["dim", "component"])
        .select(F.col("id").alias(id_column), "component", "n", "deviation", "whitened", "explained", "identity_error")
    )

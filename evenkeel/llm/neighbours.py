"""Approximate arithmetic, exact answers: nearest neighbours by inner product through a block matrix join.

Queries and candidates are dealt to blocks; each pair of blocks meets in one cell, in one task. There entries are
quantised to int8 with a scale for each vector, and tiles of the product matrix are taken on the codes (as a float
GEMM, in which sums of int8 products are whole and exact). With x = x' + r, where x' is what the code stands for and r
the rest,

    |x.y - x'.y'|  <=  |r_x| |y| + |x'| |r_y|,

so each pair has an upper and a lower bound. A pair survives if its upper bound reaches the least of the query's best
so far (at first: of the lower bounds in the tile). Survivors are computed again in doubles, entry after entry, and kept
in a heap for each query; the short lists of all cells are merged by heaps. Nothing is lost to quantisation.

Equal vectors are one candidate with its smallest ids (as many as can be named), found with partial limits before each
shuffle, and equal query vectors are asked once; so a group of copies costs as one vector, however large.

Blocks hold a bounded number of entries, and each block of queries meets each block of candidates: a stated query set
against all rows. Both sides are dealt by a hash of distinct vectors, which is even.

Cases: rows with a NULL id, or a vector that is NULL, empty or zero or has a NULL, NaN or infinite entry, take no part;
repeated rows (id and vector) count once; rows that share an id are never neighbours of each other; vectors meet those
of their own length only; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.vectors import all_finite, matrices
from evenkeel.session import pinned

#: Most entries (rows times length of vectors) in a block of either side, and most rows.
BLOCK_ENTRIES = 1 << 21
BLOCK_ROWS = 1 << 15
#: Blocks of candidates are not made smaller than this to keep all cores busy.
LEAST_ROWS = 1 << 11
#: A tile of the product matrix.
TILE = (256, 4096)
#: Lengths over which a float GEMM of int8 codes is exact: 1024 * 127 * 127 < 2 ** 24.
EXACT = 1024
#: Parts into which the ids of one vector are dealt before the smallest are chosen.
PARTS = 16


def usable(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    found = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    return found.where(F.col("id").isNotNull() & all_finite(F.col("v")) & F.exists("v", lambda e: e != 0))


def classes(found: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with the ``keep`` smallest of its ids, ascending."""
    dealt = found.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    for keys in (("v", "part"), ("v",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        dealt = dealt.withColumn("place", place).where(F.col("place") <= keep).drop("place")
    return dealt.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Coded:
    """Vectors as int8 codes, with the sizes that bound the error of a product."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        top = np.abs(vectors).max(1)
        scale = top / 127.0
        self.scale = np.where(scale > 0, scale, 1.0)
        self.codes = np.clip(np.rint(vectors / self.scale[:, None]), -127, 127).astype(np.int8)
        told = self.codes * self.scale[:, None]
        self.size, self.told, self.rest = (self._norm(m, top) for m in (vectors, told, vectors - told))

    @staticmethod
    def _norm(matrix: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Lengths of the rows; divided by their largest entry first, so that squares neither vanish nor overflow."""
        scaled = matrix / top[:, None]
        return top * np.sqrt(np.einsum("ij,ij->i", scaled, scaled))


def bounds(q: Coded, qs: slice, c: Coded, cs: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of two runs of vectors."""
    width = q.codes.shape[1]
    dots = np.zeros((qs.stop - qs.start, cs.stop - cs.start))
    for at in range(0, width, EXACT):
        left, right = q.codes[qs, at : at + EXACT], c.codes[cs, at : at + EXACT]
        dots += left.astype(np.float32) @ right.astype(np.float32).T
    dots *= q.scale[qs, None]
    dots *= c.scale[cs]
    # Quantisation, and rounding of the sums themselves.
    error = np.outer(q.rest[qs], c.size[cs]) + np.outer(q.told[qs], c.rest[cs])
    error += (width + 16) * 2.3e-16 * np.outer(q.size[qs], c.size[cs])
    error *= 1 + 1e-9
    lower, upper = dots - error, dots + error
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in doubles, summed entry after entry."""
    out = np.empty(len(left))
    step = max(1, (1 << 20) // max(1, left.shape[1]))
    for at in range(0, len(left), step):
        out[at : at + step] = np.cumsum(left[at : at + step] * right[at : at + step], axis=1)[:, -1]
    return out


def best_in_cell(queries: np.ndarray, candidates: np.ndarray, least: np.ndarray, keep: int) -> list[list[tuple]]:
    """For each query a heap of (score, -smallest id, candidate) of the ``keep`` best candidates."""
    q, c = Coded(queries), Coded(candidates)
    least = least.tolist()
    heaps: list[list[tuple]] = [[] for _ in range(len(queries))]
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for begin in range(0, len(queries), TILE[0]):
            qs = slice(begin, min(begin + TILE[0], len(queries)))
            floor = np.full(qs.stop - begin, -np.inf)
            for at in range(0, len(candidates), TILE[1]):
                cs = slice(at, min(at + TILE[1], len(candidates)))
                lower, upper = bounds(q, qs, c, cs)
                if at == 0 and cs.stop >= keep:
                    floor = np.partition(lower, cs.stop - keep, axis=1)[:, cs.stop - keep]
                for some in range(qs.stop - begin):
                    near = np.flatnonzero(upper[some] >= floor[some])
                    if not len(near):
                        continue
                    heap = heaps[begin + some]
                    own = np.broadcast_to(q.vectors[begin + some], (len(near), queries.shape[1]))
                    scores = products(own, c.vectors[at + near]).tolist()
                    for place, score in zip((at + near).tolist(), scores, strict=True):
                        entry = (score, -least[place], place)
                        if len(heap) < keep:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == keep:
                        floor[some] = max(floor[some], heap[0][0])
    return heaps


def _cells(queries: DataFrame, candidates: DataFrame, keep: int) -> DataFrame:
    """(qid, scores, ids): for each query and cell the best, best first."""
    spark = queries.sparkSession
    facts = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = queries.count()
    rows = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // max(1, facts["d"] or 1)))
    cores = spark.sparkContext.defaultParallelism
    n = int(facts["n"])
    down = max(1, -(-asked // rows))
    across = max(1, -(-n // max(min(rows, LEAST_ROWS), min(rows, -(-n // (4 * cores))))))
    block = F.xxhash64("v")
    left = queries.select(
        "qid", "v", F.size("v").alias("dim"), F.pmod(block, F.lit(down)).alias("q"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("c"),
    )
    right = candidates.select(
        "ids", "v", F.size("v").alias("dim"), F.pmod(block, F.lit(across)).alias("c"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("q"),
    )
    keys = ("dim", "q", "c")

    def cell(some: pa.Table, others: pa.Table) -> pa.Table:
        out: dict[str, list] = {"qid": [], "scores": [], "ids": []}
        if some.num_rows and others.num_rows:
            (_, asked), (_, found) = (next(matrices(t.column("v").combine_chunks())) for t in (some, others))
            ids = others.column("ids").to_pylist()
            least = np.array([own[0] for own in ids])
            heaps = best_in_cell(asked.astype(np.float64), found.astype(np.float64), least, keep)
            for qid, heap in zip(some.column("qid").to_pylist(), heaps, strict=True):
                near = heapq.nsmallest(keep, ((-score, i) for score, _, place in heap for i in ids[place]))
                out["qid"].append(qid)
                out["scores"].append([-score for score, _ in near])
                out["ids"].append([i for _, i in near])
        return pa.table(out, pa.schema([("qid", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))]))

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return met.applyInArrow(cell, "qid long, scores array<double>, ids array<long>")


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """One list for each query out of those of all cells."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, []

        def told(qid: int, best: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"qid": [qid], "near": [[{"score": -s, "id": i} for s, i in best]]},
                pa.schema([("qid", pa.int64()), ("near", pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))]),
            )

        for batch in batches:
            for qid, scores, ids in zip(*(batch.column(c).to_pylist() for c in ("qid", "scores", "ids")), strict=True):
                if qid != now:
                    if now is not None:
                        yield told(now, best)
                    now, best = qid, []
                more = [(-s, i) for s, i in zip(scores, ids, strict=True)]
                best = [entry for _, entry in zip(range(keep), heapq.merge(best, more), strict=False)]
        if now is not None:
            yield told(now, best)

    dealt = lists.repartition(F.col("qid")).sortWithinPartitions("qid")
    return dealt.mapInArrow(each, "qid long, near array<struct<score: double, id: long>>")


def nearest(rows: DataFrame, id_column: str, column: str, asks: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, <id>, score): the ``k`` rows of largest inner product to each row for which ``asks`` (of the id)
    holds, the row itself left out."""
    found = usable(rows, id_column, column)
    # One more than asked for: a query's own row is among the candidates.
    candidates = pinned(classes(found, k + 1))
    asking = pinned(found.where(asks).distinct())
    queries = pinned(asking.select("v").distinct().select("v", F.monotonically_increasing_id().alias("qid")))
    lists = _merged(_cells(queries, candidates, k + 1), k + 1).join(queries, "qid").select("v", "near")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k)
    return (
        asking.join(lists, "v")
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "e"))
        .select("query_id", (F.col("place") + 1).alias("rank"), F.col("e.id").alias(id_column), F.col("e.score").alias("score"))
    )

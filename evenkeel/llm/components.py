"""Connected components of a table of links, as a fixed point of large-star and small-star steps.

Each round replaces links by links to the smallest neighbour (Kiveris et al., "Connected Components in MapReduce and
Beyond"); the smallest neighbour of a node is an aggregate with partial sums, and the join that follows may be split by
AQE where a node has very many links. Each round is written to the cluster's shared folder; only two numbers per round
reach the driver (rows and a checksum), which tell when nothing has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import pinned

#: Links in a file of a round: small states should not be spread over very many files.
FILE_ROWS = 250_000


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return int(row["n"]), int(row["x"] or 0)


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to its smallest neighbour."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link; the root is the smallest node within reach.

    ``links`` has columns a and b; order, direction, repeats and links to itself do not matter; NULLs are left out.
    """
    now = pinned(links.select("a", "b").where("a != b").distinct())
    state = _state(now)
    while state[0]:
        # Rounds never add links, so the count says how many files the next one fills.
        files = -(-state[0] // FILE_ROWS)
        now = pinned(_small_star(_large_star(now)).coalesce(files))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )

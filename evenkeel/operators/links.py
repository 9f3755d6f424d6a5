"""Groups that a table of links connects, in few rounds and without a hot node in one task.

Each round replaces links by links to the smallest neighbour, first for larger and then for smaller neighbours (large-star
and small-star steps), so paths shrink by a factor and rounds grow with the logarithm of the longest path. A node with very
many links is one row of the aggregate that finds its smallest neighbour; that aggregate groups by a struct, so the join
back shuffles it once more and adaptive execution can split the node's links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.session import pinned


def _least(links: DataFrame, value: Column) -> DataFrame:
    """(key, least): the smallest ``value`` of each node ``a``."""
    grouped = links.groupBy(F.struct("a").alias("_node")).agg(value.alias("least"))
    return grouped.select(F.col("_node.a").alias("key"), "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, F.least(F.min("b"), F.first("a")))
    met = both.where("b > a").join(least, F.col("a") == F.col("key"))
    return met.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, F.min("b"))
    met = down.join(least, F.col("a") == F.col("key")).where("b != least")
    moved = met.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select(F.col("key").alias("a"), F.col("least").alias("b"))).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) for each node of ``links`` (a, b), the root being the smallest node within reach; and how many
    rounds it took. NULLs are left out. A count and a checksum a round reach the driver; rounds are written once."""
    nodes = links.select("a").unionByName(links.select(F.col("b").alias("a"))).where("a is not null").distinct()
    now = pinned(links.select("a", "b").where("a != b").distinct())
    rounds, state = 0, _digest(now)
    while state[0]:
        now = pinned(_small_star(_large_star(now)))
        rounds, before, state = rounds + 1, state, _digest(now)
        if state == before:
            break
    roots = now.select(F.col("a").alias("_moved"), F.col("b").alias("root"))
    found = nodes.join(roots, F.col("a") == F.col("_moved"), "left")
    return found.select(F.col("a").alias("node"), F.coalesce("root", "a").alias("root")), rounds

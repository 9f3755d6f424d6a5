"""The acceptance of submissions in order of time, under limits that hold together.

A submission is accepted only if its session and its client are both within their
limits, its content stands, it repeats no accepted submission of its session, and it
is good enough; only accepted submissions use quota. So what is decided for one
session bears on others of the same client: rows are decided in one order per group
of sessions and clients that share rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import clock
from evenkeel.operators.links import components
from evenkeel.session import pinned

ACCEPTED = "accepted"
RATE = "rate"
DUPLICATE = "duplicate"


@dataclass(frozen=True)
class Quota:
    """What a session and a client may submit per hour and day."""

    session: tuple[int, int]
    client: tuple[int, int]
    duplicate_minutes: int


def linked(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, group) of the distinct pairs; ``group`` is equal for all that are connected through shared values.

    Left and right values are nodes of one graph, so rounds grow with the logarithm of the longest chain of pairs.
    """
    rows = pinned(pairs.select(left, right).distinct())
    # Right values come after all left ones, so the smallest node of a group is a left value.
    node = F.concat(F.lit("l"), F.col(left).cast("string"))
    links = rows.select(node.alias("a"), F.concat(F.lit("r"), F.col(right).cast("string")).alias("b"))
    roots, _ = components(links)
    of_left = roots.select(F.col("node").alias("_node"), F.substring("root", 2, 1 << 30).alias("group"))
    return rows.join(of_left, node == F.col("_node")).select(left, right, "group")


def pieces(rows: DataFrame, keys: list[str], at: str, tie: str, gap: int) -> DataFrame:
    """Add ``piece``: counts up in each key wherever no row of it lies within ``gap`` before a row.

    Rows are dealt to ranges of (key, time) once, so a hot key is never in one task. Within a range a row is seen beside
    the one before it; from range to range one row for each key goes on, with its last time and the pieces begun so far.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(*keys, at, tie).withColumn("_part", F.spark_partition_id())
    # A range keeps its partition, so the windows below need no further shuffle.
    fixed = pinned(dealt).repartitionById(parts, F.col("_part"))
    inside = Window.partitionBy("_part", *keys).orderBy(at, tie)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    near = fixed.withColumn("_near", F.lag(at).over(inside))

    def begins(before: Column) -> Column:
        return F.when(before.isNull() | (F.col(at) - before >= gap), 1).otherwise(0)

    # A range's first row of a key begins a piece if the key's last row of an earlier range is that far back.
    sums = near.groupBy("_part", *keys).agg(
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
        F.sum(F.when(F.col("_near").isNotNull(), begins(F.col("_near"))).otherwise(0)).alias("_begun"),
    )
    known = sums.withColumn("_before", F.max("_last").over(earlier))
    opens = F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= gap), 1).otherwise(0)
    known = known.withColumn("_opens", opens)
    so_far = F.coalesce(F.sum(F.col("_begun") + F.col("_opens")).over(earlier), F.lit(0))
    # Only the first key of a range can go on from another: one small row for each range. Any other begins its first piece.
    entry = known.select("_part", *keys, (so_far + F.col("_opens")).alias("_entry"), "_before").where("_before is not null").drop("_before")
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(F.when(F.col("_near").isNotNull(), begins(F.col("_near"))).otherwise(0)).over(up_to)
    met = near.withColumn("_own", own).join(F.broadcast(entry), ["_part", *keys], "left")
    return met.withColumn("piece", F.coalesce("_entry", F.lit(1)) + F.col("_own")).select(*rows.columns, "piece")


@dataclass
class _Group:
    """Accepted submissions of one group that still bear on later ones."""

    quota: Quota
    times: dict[tuple[str, str], list[int]] = field(default_factory=dict)
    copies: dict[tuple[str, str], int] = field(default_factory=dict)
    cleaned: int = 0

    def _full(self, kind: str, value: str | None, at: int, most: tuple[int, int]) -> bool:
        held = self.times.get((kind, value)) if value is not None else None
        if not held:
            return False
        return any(
            len(held) - bisect_right(held, at - width) >= n for width, n in zip((clock.HOUR, clock.DAY), most, strict=True)
        )

    def decide(self, session: str | None, client: str | None, at: int, copy: str, stop: str | None, poor: bool) -> str:
        if self._full("s", session, at, self.quota.session) or self._full("c", client, at, self.quota.client):
            return RATE
        if stop is not None:
            return stop
        last = self.copies.get((session, copy)) if session is not None else None
        if last is not None and at - last < self.quota.duplicate_minutes * clock.MINUTE:
            return DUPLICATE
        if poor:
            return "quality"
        for kind, value, most in (("s", session, self.quota.session), ("c", client, self.quota.client)):
            if value is not None:
                held = self.times.setdefault((kind, value), [])
                held.append(at)
                del held[: -max(most)]
        if session is not None:
            self.copies[session, copy] = at
        if at - self.cleaned > clock.HOUR:
            self._clean(at)
        return ACCEPTED

    def _clean(self, at: int) -> None:
        self.cleaned = at
        self.times = {k: t for k, t in self.times.items() if t[-1] > at - clock.DAY}
        span = self.quota.duplicate_minutes * clock.MINUTE
        self.copies = {k: t for k, t in self.copies.items() if t > at - span}


def decided(
    rows: DataFrame, quota: Quota, ts: str, tie: str = "id", session: str = "session_id", client: str = "client_id"
) -> DataFrame:
    """``tie``, session, client, time and ``stage`` of every row.

    ``rows`` has ``content_hash``, ``stop`` (the stage at which its content fails,
    NULL if it stands) and ``poor`` (its quality is too low). Only these narrow
    columns are shuffled. A group is cut wherever it rests for as long as any limit
    looks back, as nothing before bears on what comes then. Such a piece is one
    stream through one task: Spark sorts it, Python sees a batch at a time and keeps
    what is younger than a day.
    """
    narrow = rows.select(
        F.col(tie).alias("_tie"),
        F.col(session).alias("_session"),
        F.col(client).alias("_client"),
        clock.micros(rows, ts).alias("_at"),
        F.col(ts).alias("_ts"),
        "content_hash",
        "stop",
        "poor",
    )
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    narrow = pinned(narrow)
    groups = linked(narrow.where("_session is not null and _client is not null"), "_session", "_client")
    of_session = groups.groupBy("_session").agg(F.min("group").alias("_gs"))
    of_client = groups.groupBy("_client").agg(F.min("group").alias("_gc"))
    # A row without session and client depends on no other row.
    alone = F.concat(F.lit("?"), F.xxhash64("_tie", "_at").cast("string"))
    group = F.coalesce(
        F.concat(F.lit("g"), F.coalesce("_gs", "_gc")),
        F.concat(F.lit("s"), F.col("_session")),
        F.concat(F.lit("c"), F.col("_client")),
        alone,
    )
    grouped = (
        narrow.join(of_session, "_session", "left").join(of_client, "_client", "left").select(*narrow.columns, group.alias("_group"))
    )
    widest = max(clock.DAY, quota.duplicate_minutes * clock.MINUTE)
    placed = (
        pieces(grouped, ["_group"], "_at", "_tie", widest)
        .repartition("_group", "piece")
        .sortWithinPartitions("_group", "piece", "_at", "_tie")
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, _Group(quota)
        for batch in batches:
            stages = []
            for name, s, c, at, copy, stop, poor in zip(
                zip(batch["_group"], batch["piece"], strict=True), batch["_session"], batch["_client"], batch["_at"], batch["content_hash"],
                batch["stop"], batch["poor"], strict=True,
            ):
                if name != current:
                    current, state = name, _Group(quota)
                stages.append(state.decide(s, c, int(at), copy, stop, bool(poor)))
            yield batch[["_tie", "_session", "_client", "_ts"]].assign(stage=stages)

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("_tie", "_session", "_client", "_ts"))
    return placed.mapInPandas(decide, f"{schema}, stage string").toDF(tie, session, client, ts, "stage")

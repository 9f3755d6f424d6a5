"""Admission limits and duplicate suppression as stateful streaming operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

import evenkeel
from evenkeel.functions import clock
from evenkeel.operators.keys import any_null
from evenkeel.operators.replay import ADMITTED, Admissions, Limits, reason

#: Keys are dealt to so many groups by hash. A stream that goes on from its checkpoint needs the number it began with.
GROUPS = 256
_DATA = T.StructType([T.StructField("data", T.BinaryType())])
State = tuple[list[int], int | None]


def _plain(values: pd.Series) -> list:
    """The values as Python objects; None for what is missing."""
    held = values.tolist()
    return [None if gone else v for v, gone in zip(held, values.isna().tolist(), strict=True)] if values.hasnans else held


class _Limiter(StatefulProcessor):
    """A group of keys: rows wait, by slots of event time, until the watermark has passed their slot, and are then decided.

    Each key is decided on its own; a group shares the calls to the state store, which cost far more than a decision.
    Kept are the latest admission times and the end of a block of each key (one value for all) and the rows that wait (a
    map by slot and number, with a map of how many numbers a slot has). A timer at the end of each slot decides its rows;
    timers come in order of time, so decisions do, whatever order rows arrived in. Keys that no limit looks back to any
    more are forgotten with each slot; one more timer after the last slot forgets the rest.
    """

    def __init__(self, keys: Sequence[str], limits: Limits, slot: int) -> None:
        self.keys, self.limits, self.slot = list(keys), limits, slot
        self.widest = max([w for _, w, _ in limits.spans] + [limits.block_span if limits.block_at else 0])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", _DATA)
        slot, number = T.StructField("slot", T.LongType()), T.StructField("number", T.LongType())
        self.numbers = handle.getMapState("numbers", T.StructType([slot]), T.StructType([number]))
        self.waiting = handle.getMapState("waiting", T.StructType([slot, number]), _DATA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for piece in rows:  # a group's rows of a micro-batch come in pieces and are never held together
            for slot, some in piece.groupby(piece["at_us"] // self.slot, sort=False):
                slot, number = int(slot), 0
                if self.numbers.containsKey((slot,)):
                    number = int(self.numbers.getValue((slot,))[0])
                else:
                    self.handle.registerTimer(self._end(slot))
                columns = [_plain(some[c]) for c in (*self.keys, "row_tie", "at_us")]
                self.waiting.updateValue((slot, number), (pickle.dumps(columns),))
                self.numbers.updateValue((slot,), (number + 1,))
        return iter(())

    def _end(self, slot: int) -> int:
        return -(-(slot + 1) * self.slot // 1000)

    def _forget_after(self, slot: int) -> None:
        """A timer, beside that of any slot, when nothing of a slot bears on later rows."""
        self.handle.registerTimer(self._end(slot - (-self.widest // self.slot)) + 1)

    def _known(self, since: int) -> dict[tuple, State]:
        """State of the keys that bear on rows from a time on."""
        if not self.states.exists():
            return {}
        held = pickle.loads(self.states.get()[0])
        return {k: (t, u) for k, (t, u) in held.items() if t and t[-1] + self.widest > since or u is not None and u > since}

    def _keep(self, known: dict[tuple, State]) -> None:
        if known:
            self.states.update((pickle.dumps(known),))
        else:
            self.states.clear()

    def handleExpiredTimer(
        self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot = now * 1000 // self.slot - 1
        if not self.numbers.containsKey((slot,)):  # the last timer of some slot
            self._keep(self._known(now * 1000))
            return
        rows: list[tuple] = []
        for number in range(int(self.numbers.getValue((slot,))[0])):
            *keys, ties, at = pickle.loads(self.waiting.getValue((slot, number))[0])
            rows += zip(zip(*keys, strict=True), at, ties, strict=True)
            self.waiting.removeKey((slot, number))
        self.numbers.removeKey((slot,))
        rows.sort(key=lambda r: (r[1], r[2] is not None, r[2]))
        known = self._known(slot * self.slot)
        states: dict[tuple, Admissions] = {}
        numbers = []
        for one, at, _ in rows:
            one = tuple(None if v != v else v for v in one)  # noqa: PLR0124 (NaN is a key like others; NULL is none)
            if one not in states:
                states[one] = Admissions(self.limits, *known.get(one, ((), None)))
            numbers.append(states[one].number(at))
        known.update((one, (state.times, state.blocked_until)) for one, state in states.items())
        self._keep(known)
        self._forget_after(slot)
        named = dict(zip(self.keys, zip(*(r[0] for r in rows), strict=True), strict=True))
        ties = pd.Series([r[2] for r in rows], dtype=object)  # numbers stay whole beside a NULL
        yield pd.DataFrame({**named, "row_tie": ties, "at_us": [r[1] for r in rows], "number": numbers})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        known = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        keys = zip(*(_plain(initialState[k]) for k in self.keys), strict=True)
        for one, times, until in zip(keys, initialState["times"], initialState["until"], strict=True):
            times = [int(t) for t in times]
            known[tuple(None if v != v else v for v in one)] = times, None if pd.isna(until) else int(until)  # noqa: PLR0124
            if times:
                self._forget_after(times[-1] // self.slot)
        self._keep(known)

    def close(self) -> None:
        pass


def stream_limits(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    limits: Limits,
    delay: str = "1 day",
    slot: int = clock.MINUTE,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Keys, tie, time in microseconds and ``decision`` for a stream of submissions.

    Rows are decided when the watermark, ``delay`` behind the latest row, has passed
    their ``slot`` of time (microseconds), in order of time and tie. So decisions are
    those of the batch replay whatever order rows come in and however batches are cut;
    rows that are later than ``delay`` are dropped. Keys are dealt to ``GROUPS`` by
    hash; memory holds the rows of a group in one slot and the latest admissions of
    its keys, and state the rows that wait. A key's state goes when no limit looks back
    to it any more. ``seed`` (from ``states_after``) lets a stream go on where a batch
    replay has ended. Rows without a key are admitted at once, rows without a time
    are left out. The stream is to be started within ``session.rocksdb_state`` (or
    in a session that has RocksDB as its state store).
    """
    keys = list(keys)
    narrow = df.select(
        *keys,
        F.col(tie).alias("row_tie"),
        clock.micros(df, ts).alias("at_us"),
        F.col(ts).cast("timestamp").alias("event_time"),
    ).where("event_time is not null")
    kinds = {f.name: f.dataType for f in narrow.schema.fields}
    free = narrow.where(any_null(keys)).select(*keys, F.col("row_tie").alias(tie), "at_us", F.lit(ADMITTED).alias("decision"))
    schema = T.StructType(
        [*(T.StructField(k, kinds[k]) for k in keys), T.StructField("row_tie", kinds["row_tie"]),
         T.StructField("at_us", T.LongType()), T.StructField("number", T.LongType())]
    )
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int").alias("_group")
    grouped = narrow.where(~any_null(keys)).withWatermark("event_time", delay).select("*", group).groupBy("_group")
    if seed is not None:  # a hash depends on the type
        typed = seed.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), "times", "until")
        seed = typed.select("*", group).groupBy("_group")
    # A Python process of the driver loads the processor too, and that one gets neither the paths of the driver's own
    # Python nor the files of addPyFile: so the code goes with it instead of being imported there.
    cloudpickle.register_pickle_by_value(evenkeel)
    try:
        decided = grouped.transformWithStateInPandas(
            _Limiter(keys, limits, slot), schema, "append", "EventTime", initialState=seed
        )
    finally:
        cloudpickle.unregister_pickle_by_value(evenkeel)
    labelled = decided.select(*keys, F.col("row_tie").alias(tie), "at_us", reason(limits, F.col("number")).alias("decision"))
    return labelled.unionByName(free)


def states_after(decided: DataFrame, keys: Sequence[str], ts: str, limits: Limits) -> DataFrame:
    """(keys, times, until) at the end of a batch replay's decisions: what ``stream_limits`` begins with.

    The latest admissions are enough: a row is only admitted outside a block, so no block but the last one's can hold.
    """
    at = decided.select(*keys, clock.micros(decided, ts).alias("at")).where(decided["decision"] == ADMITTED).where(~any_null(keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at")))
    latest = at.withColumn("place", place).where(F.col("place") <= limits.memory)
    times = latest.groupBy(*keys).agg(F.sort_array(F.collect_list("at")).alias("times"))
    last = F.element_at("times", -1)
    if limits.block_at is None:
        until = F.lit(None).cast("long")
    else:
        first = limits.spans[0][1]
        within = F.size(F.filter("times", lambda t: t > last - first))
        until = F.when(within >= limits.block_at, last + limits.block_span)
    return times.withColumn("until", until)


def stream_distinct(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, minutes: int = 30, delay: str = "1 day", slot: int = clock.MINUTE
) -> DataFrame:
    """Duplicate suppression: a copy is rejected within ``minutes`` of the last accepted one."""
    once = Limits(spans=(("duplicate", minutes * clock.MINUTE, 1),))
    return stream_limits(df, keys, ts, tie, once, delay, slot)

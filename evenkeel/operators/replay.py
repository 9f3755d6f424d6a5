"""Exact replay of admission limits: rejected rows use up no quota.

A row is admitted when, for every limit ``(span, most)``, fewer than ``most``
admitted rows of its key lie in the span before it. So after the n-th admission
the limit next admits at (time of admission n-most+1) + span: its release. Rows
before the latest release are rejected, the first row after it is admitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import clock
from evenkeel.operators.keys import any_null
from evenkeel.session import pinned

ADMITTED = "admitted"
BLOCKED = "blocked"


@dataclass(frozen=True)
class Limits:
    """``spans``: (name, microseconds, most) per limit, checked in this order.

    A key whose admissions within the first span reach ``block_at`` is blocked
    for ``block_span`` from that admission on; None never blocks.
    """

    spans: tuple[tuple[str, int, int], ...]
    block_at: int | None = None
    block_span: int = clock.DAY

    @property
    def names(self) -> tuple[str, ...]:
        """Reasons in the order they are checked; 'blocked' comes first."""
        return (BLOCKED, *[name for name, _, _ in self.spans])

    @property
    def shortest(self) -> int:
        return min(width for _, width, _ in self.spans)

    @property
    def memory(self) -> int:
        """How many past admissions decide the next one."""
        return max([most for _, _, most in self.spans] + [self.block_at or 0])


class Admissions:
    """The state of one key: its latest admission times and what they forbid."""

    def __init__(self, limits: Limits, times: Sequence[int] = (), blocked_until: int | None = None):
        self.limits = limits
        self.times = list(times)
        self.blocked_until = blocked_until
        self._held: list[tuple[int, int]] | None = None  # releases by reason number, until the next admission

    def releases(self) -> list[int | None]:
        """From when each reason no longer rejects; None when it does not now."""
        held = [
            self.times[-most] + width if len(self.times) >= most else None
            for _, width, most in self.limits.spans
        ]
        return [self.blocked_until, *held]

    def admit(self, at: int) -> None:
        self._held = None
        self.times = [*self.times, at][-self.limits.memory :]
        if self.limits.block_at is not None:
            first = self.limits.spans[0][1]
            if sum(1 for t in self.times if t > at - first) >= self.limits.block_at:
                self.blocked_until = at + self.limits.block_span

    def number(self, at: int) -> int:
        """Reason number, as ``decide`` gives it, of the next row."""
        if self._held is None:
            self._held = [(n, r) for n, r in enumerate(self.releases(), 1) if r is not None]
        for number, release in self._held:
            if at < release:
                return number
        self.admit(at)
        return 0

    def decide(self, at: np.ndarray) -> np.ndarray:
        """Reason number per row of sorted times: 0 admitted, i+1 for reason i.

        The state only changes at an admission, so the rows between two
        admissions are labelled together.
        """
        out = np.zeros(len(at), dtype=np.int64)
        here = 0
        while here < len(at):
            ends = [int(np.searchsorted(at, r)) if r is not None else 0 for r in self.releases()]
            stop = max(here, *ends)
            for number in range(len(ends), 0, -1):
                out[here : max(here, ends[number - 1])] = number
            if stop < len(at):
                self.admit(int(at[stop]))
            here = stop + 1
        return out


def reason(limits: Limits, number: Column) -> Column:
    """The label of a reason number."""
    labels = F.array(F.lit(ADMITTED), *[F.lit(n) for n in limits.names])
    return labels[number]


def replay(df: DataFrame, keys: Sequence[str], ts: str, tie: str, limits: Limits) -> DataFrame:
    """Keys, tie, time and ``decision`` ('admitted' or the first limit that rejects).

    Rows of a key are taken in order of time and tie. They are dealt out in stretches
    of (key, time), so a key with many rows fills many, and stretches are decided side
    by side. What a stretch must know of the past is the state of its first key, if
    that goes on from the stretch before: a few admission times. ``_entry_states``
    finds those. Spark sorts (and spills); Python sees one Arrow batch at a time.
    Rows without a key have no quota to use up.
    """
    keys = list(keys)
    every = df.select(*keys, F.col(tie).alias("_tie"), F.col(ts).alias("_ts"), clock.micros(df, ts).alias("_at"))
    free = every.where(any_null(keys)).withColumn("_number", F.lit(0).cast("long"))
    order = [*keys, "_at", "_tie"]
    dealt = every.where(~any_null(keys)).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stretches = pinned(dealt)  # sampled ranges may differ when a part is computed again
    known = _entry_states(stretches, keys, limits)
    kinds = "_part int, _times array<bigint>, _until bigint"
    states = df.sparkSession.createDataFrame([(part, *state) for part, state in known.items()], kinds)
    # One small row for each stretch that goes on from another.
    placed = stretches.join(F.broadcast(states), "_part", "left")
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionById(number, F.col("_part")).sortWithinPartitions("_part", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in every.schema.fields)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, runs in _runs(batches, keys, limits):
            number = np.zeros(len(rows), dtype=np.int64)
            for start, end, _, state in runs:
                number[start:end] = state.decide(rows["_at"].to_numpy()[start:end])
            yield rows.drop(columns=["_part", "_times", "_until"]).assign(_number=number)

    decided = placed.select(*every.columns, "_part", "_times", "_until").mapInPandas(decide, f"{schema}, _number bigint")
    return _labelled(decided.unionByName(free), keys, ts, tie, limits)


def _labelled(rows: DataFrame, keys, ts: str, tie: str, limits: Limits) -> DataFrame:
    return rows.select(
        *keys, F.col("_tie").alias(tie), F.col("_ts").alias(ts), reason(limits, F.col("_number")).alias("decision")
    )


def _runs(
    batches: Iterator[pd.DataFrame], keys: Sequence[str], limits: Limits, carry: bool = False
) -> Iterator[tuple[pd.DataFrame, Iterator[tuple[int, int, int, Admissions]]]]:
    """Each batch with its runs (begin, end, part, state): rows of one part and key that follow each other.

    A part begins with the state in ``_times`` and ``_until`` (none: nothing admitted yet); another key in it begins
    afresh. With ``carry`` a part without a state goes on with that of the part before.
    """
    part, key, state = None, None, Admissions(limits)
    for rows in batches:
        if not len(rows):
            continue
        values = [rows["_part"].to_numpy(), *[rows[k].to_numpy() for k in keys]]
        turns = np.zeros(len(rows) - 1, dtype=bool)
        for column in values:
            turns |= column[1:] != column[:-1]
        starts = [0, *(np.flatnonzero(turns) + 1).tolist(), len(rows)]

        def runs(rows=rows, values=values, starts=starts):
            nonlocal part, key, state
            for start, end in zip(starts, starts[1:], strict=False):
                here, *now = (column[start] for column in values)
                if here != part:
                    times = rows["_times"].iloc[start]
                    if times is not None:
                        until = rows["_until"].iloc[start]
                        state = Admissions(limits, [int(t) for t in times], None if pd.isna(until) else int(until))
                    elif not (carry and now == key):
                        state = Admissions(limits)
                elif now != key:
                    state = Admissions(limits)
                part, key = here, now
                yield start, end, int(here), state

        yield rows, runs()


#: After so many rounds of guessing, what is still open is followed from stretch to stretch.
ROUNDS = 3
State = tuple[list[int], int | None]


@dataclass
class _Stretch:
    """A part of the order of (key, time): its first and last key and its first time. One row for each partition."""

    part: int
    first: tuple
    begin: int
    last: tuple


def _entry_states(stretches: DataFrame, keys: Sequence[str], limits: Limits) -> dict[int, State]:
    """For each stretch that goes on with the last key of the one before: the state to begin with.

    At first every stretch is run, on rows of its last key alone, as if nothing had been admitted before it. That gives
    the right state at its end if the key began there or paused there for longer than any limit looks back, and a guess
    otherwise. Guesses become the states that the next stretches begin with; a stretch runs again only where that differs
    from what it began with before. Most keys forget how they began within a stretch or two, so all stretches are right
    after as many rounds. A key that is always at its limits may not; what is open after ``ROUNDS`` is run once more in
    order of time, a chain of stretches in one task.
    """
    found = stretches.groupBy("_part").agg(F.min(F.struct(*keys, "_at")).alias("first"), F.max(F.struct(*keys)).alias("last"))
    parts = [
        _Stretch(r["_part"], tuple(r["first"])[:-1], r["first"]["_at"], tuple(r["last"]))
        for r in sorted(found.collect(), key=lambda r: r["_part"])
    ]
    follows = {b.part: a for a, b in zip(parts, parts[1:], strict=False) if a.last == b.first}
    by_part = {p.part: p for p in parts}
    leads = {a.part for a in follows.values()}
    exits: dict[int, State] = {}
    begun: dict[int, State] = {}
    empty: State = ([], None)

    def entry(p: _Stretch) -> State:
        """What matters at a stretch's begin of the state that the one before ended with."""
        if p.part not in follows:
            return empty
        times, until = exits[follows[p.part].part]
        past = max(width for _, width, _ in limits.spans)
        return [t for t in times if t + past > p.begin], until if until is not None and until > p.begin else None

    def through(p: _Stretch) -> bool:
        return p.first == p.last  # only then the end depends on the begin

    open_parts = [p for p in parts if p.part in leads]
    exits.update(_exits(stretches, keys, limits, [(p, number, empty) for number, p in enumerate(open_parts)]))
    begun.update({p.part: empty for p in open_parts})
    for turn in range(ROUNDS + 1):
        again = [p for p in open_parts if through(p) and entry(p) != begun[p.part]]
        if not again:
            break
        if turn < ROUNDS:
            tasks = [(p, number, entry(p)) for number, p in enumerate(again)]
            begun.update({p.part: state for p, _, state in tasks})
        else:  # from the first open stretch of a chain on, all that follow it
            tasks, chain, dirty = [], -1, set()
            for p in open_parts:
                before = follows.get(p.part)
                if before is not None and before.part in dirty and through(p):
                    tasks.append((p, chain, None))
                    dirty.add(p.part)
                elif p in again:
                    chain += 1
                    tasks.append((p, chain, entry(p)))
                    dirty.add(p.part)
        exits.update(_exits(stretches, keys, limits, tasks))
    return {part: state for part in follows if (state := entry(by_part[part])) != empty}


def _exits(
    stretches: DataFrame, keys: Sequence[str], limits: Limits, tasks: list[tuple[_Stretch, int, State | None]]
) -> dict[int, State]:
    """The state of the last key at the end of each stretch; stretches of one chain number run one after another."""
    if not tasks:
        return {}
    spark = stretches.sparkSession
    kinds = ", ".join(f"`{k}` {stretches.schema[k].dataType.simpleString()}" for k in keys)
    given = spark.createDataFrame(
        [(p.part, *p.last, chain, *(state or (None, None))) for p, chain, state in tasks],
        f"_part int, {kinds}, _chain int, _times array<bigint>, _until bigint",
    )
    rows = stretches.select(*keys, "_at", "_tie", "_part").join(F.broadcast(given), ["_part", *keys])
    number = min(len({chain for _, chain, _ in tasks}), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(number, (F.col("_chain") % number).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: tuple[int, Admissions] | None = None

        def told() -> pd.DataFrame:
            part, state = done
            until = None if state.blocked_until is None else int(state.blocked_until)
            return pd.DataFrame({"part": [part], "times": [[int(t) for t in state.times]], "until": pd.array([until], "Int64")})

        for rows, runs in _runs(batches, keys, limits, carry=True):
            at = rows["_at"].to_numpy()
            for start, end, part, state in runs:
                if done is not None and done[0] != part:
                    yield told()
                state.decide(at[start:end])
                # The next part may go on with this very state, so it is copied.
                done = part, Admissions(limits, state.times, state.blocked_until)
        if done is not None:
            yield told()

    ran = dealt.sortWithinPartitions("_chain", "_part", "_at", "_tie").mapInPandas(
        run, "part int, times array<bigint>, until bigint"
    )
    return {r["part"]: (list(r["times"]), r["until"]) for r in ran.collect()}

"""CSV files with line breaks inside quotes, read by as many tasks as plain text.

A line break ends a record only outside quotes, and a task that begins in the middle of a file cannot know whether it is
inside. So each split of a file is scanned for both cases: from which of two states (a record begins, or a quoted field
goes on) to which it leads. These are two small maps for each split; chained over the splits of a file they give the
state in which each split really begins. A second scan cuts the lines of each split into records. A record that crosses
the end of a split leaves its pieces there, and only those pieces are brought together, by the split in which the record
begins. Texts are not shuffled otherwise.

Spark's text reader makes the splits and its CSV parser reads the records, so options mean what they mean there. Results
are those of reading whole files, but for one case: a quoted field that is never closed ends before the line break that
ends the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
#: Up to the quote that ends a field; a doubled quote is text.
_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_PLACE = ("file", "begin")


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Does a line that begins inside a quoted field (or at a record's begin) end inside one?

    A quote opens a field only as its first character. What follows the closing quote up to the separator is text.
    """
    at = 0
    while True:
        if inside or line.startswith(QUOTE, at):
            closed = _CLOSE.match(line, at if inside else at + 1)
            if closed is None:
                return True
            inside, at = False, line.find(sep, closed.end())
        else:
            at = line.find(sep + QUOTE, at)
        if at < 0:
            return False
        at += len(sep)


class _Lines:
    """Runs of lines of one split, as batches of (file, begin, value) give them."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
        for batch in self.batches:
            if not batch.num_rows:
                continue
            file, begin = (batch.column(name) for name in _PLACE)
            same = np.ones(batch.num_rows, bool)
            same[1:] = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(begin[1:], begin[:-1])).to_numpy(zero_copy_only=False)
            same[0] = False
            starts = [*np.flatnonzero(~same).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:], strict=False):
                yield (file[start].as_py(), begin[start].as_py()), batch.slice(start, end - start)


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)).tolist()


def _maps(text: DataFrame, sep: str) -> DataFrame:
    """(file, begin, out_0, open_0, out_1, open_1) for each split: for either state at its begin the state at its end,
    and whether the record that is open there began in this split."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ends, opens = None, [False, True], [False, False]

        def told() -> pa.RecordBatch:
            row = {"file": [place[0]], "begin": [place[1]], "out_0": [ends[0]], "open_0": [opens[0]], "out_1": [ends[1]], "open_1": [opens[1]]}
            return pa.RecordBatch.from_pydict(row)

        for here, batch in _Lines(batches):
            if here != place:
                if place is not None:
                    yield told()
                place, ends, opens = here, [False, True], [False, False]
            lines = batch.column("value")
            for at in _quoted(lines):
                line = lines[at].as_py()
                before = None
                for case in (0, 1):
                    out = ends_inside(line, ends[case], sep) if not case or ends[1] != before else ends[0]
                    before = ends[case]
                    opens[case] = out and (not before or opens[case])
                    ends[case] = out
        if place is not None:
            yield told()

    return text.mapInArrow(each, "file string, begin long, out_0 boolean, open_0 boolean, out_1 boolean, open_1 boolean")


def _entries(maps: DataFrame) -> DataFrame:
    """(file, begin, inside, owner): the state in which each split begins, and where the record that is open there began.

    A map that leads to one state from both resets what came before; of the others only one that swaps the states counts.
    One row for each split of a file moves.
    """
    up_to = Window.partitionBy("file").orderBy("begin")
    earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("out_0") & ~F.col("out_1"), 1).otherwise(0)).over(earlier), F.lit(0))
    counted = maps.withColumn("swaps", swaps)
    fixed = F.when(F.col("out_0") == F.col("out_1"), F.struct(F.col("out_0").cast("int").alias("state"), F.col("swaps").alias("at")))
    last = F.last(fixed, ignorenulls=True).over(earlier)
    state = F.coalesce(last["state"], F.lit(0)) + F.col("swaps") - F.coalesce(last["at"], F.lit(0))
    known = counted.withColumn("inside", state % 2 == 1)
    ends = F.when(F.col("inside"), F.col("out_1") & F.col("open_1")).otherwise(F.col("out_0") & F.col("open_0"))
    owner = F.last(F.when(ends, F.col("begin")), ignorenulls=True).over(earlier)
    return known.select("file", "begin", "inside", owner.alias("owner"))


_RECORDS = "file string, name string, owner long, begin long, first boolean, record string"


def _records(text: DataFrame, sep: str) -> DataFrame:
    """Whole records (``owner`` NULL) and pieces of records that cross the end of a split (``owner`` tells which belong
    together, ``begin`` their order); ``first`` marks the first record of a file."""
    schema = pa.schema(
        [("file", pa.string()), ("name", pa.string()), ("owner", pa.int64()), ("begin", pa.int64()), ("first", pa.bool_()), ("record", pa.string())]
    )

    class Split:
        """The split that is being read: whether a record is open, its lines so far, and whether the file's first is to come."""

        def __init__(self, place: tuple, batch: pa.RecordBatch) -> None:
            self.place, self.name = place, batch.column("name")[0].as_py()
            self.inside = batch.column("inside")[0].as_py()
            self.owner = batch.column("owner")[0].as_py() if self.inside else None
            self.head, self.first, self.lines = self.inside, place[1] == 0, []

        def rows(self, records: list[str] | pa.Array, owner: int | None = None, first: bool = False) -> pa.RecordBatch:
            n, begin = len(records), None if owner is None else self.place[1]
            return pa.RecordBatch.from_arrays(
                [pa.repeat(self.place[0], n), pa.repeat(self.name, n), pa.array([owner] * n, pa.int64()),
                 pa.array([begin] * n, pa.int64()), pa.repeat(first, n), pa.array(records, pa.string())],
                schema=schema,
            )

        def opening(self, lines: pa.Array) -> tuple[int, list[str]]:
            """How many lines the file's first record takes, blank lines before it included, and the record."""
            for at, line in enumerate(lines.to_pylist()):
                if not self.lines and not line.strip("\ufeff\r"):
                    continue
                self.inside = ends_inside(line if self.lines else line.removeprefix("\ufeff"), self.inside, sep)
                self.lines.append(line)
                if not self.inside:
                    record, self.lines, self.first = "\n".join(self.lines), [], False
                    return at + 1, [record]
            return len(lines), []

        def read(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
            if self.first:
                taken, record = self.opening(lines)
                lines = lines[taken:]
                if record:
                    yield self.rows(record, first=True)
            whole, joined, at = np.zeros(len(lines), bool), [], 0
            for quoted in [*_quoted(lines), len(lines)]:
                if self.inside:
                    self.lines.extend(lines[at:quoted].to_pylist())
                else:
                    whole[at:quoted] = True
                if quoted < len(lines):
                    line = lines[quoted].as_py()
                    out = ends_inside(line, self.inside, sep)
                    if not self.inside and not out:
                        whole[quoted] = True
                    else:
                        self.lines.append(line)
                        if not out:
                            record, self.lines = "\n".join(self.lines), []
                            if self.head:
                                self.head = False
                                yield self.rows([record], self.owner)
                            else:
                                joined.append(record)
                    self.inside = out
                at = quoted + 1
            yield self.rows(lines.filter(pa.array(whole)))
            yield self.rows(joined)

        def close(self) -> Iterator[pa.RecordBatch]:
            if self.lines:
                yield self.rows(["\n".join(self.lines)], self.owner if self.head else self.place[1], self.first)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for here, batch in _Lines(batches):
            if split is None or here != split.place:
                if split is not None:
                    yield from split.close()
                split = Split(here, batch)
            yield from split.read(batch.column("value"))
        if split is not None:
            yield from split.close()

    return text.mapInArrow(each, _RECORDS)


def records(spark: SparkSession, path: str | list[str], sep: str = ",", name_pattern: str | None = None) -> DataFrame:
    """(name, first, record) of the files: each record's text, the name of its file, and whether it is the first there."""

    def lines() -> DataFrame:
        reader = spark.read.option("lineSep", "\n")
        if name_pattern:
            reader = reader.option("pathGlobFilter", name_pattern)
        return reader.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("begin"),
            F.col("_metadata.file_name").alias("name"),
            "value",
        )

    entries = _entries(_maps(lines(), sep))
    # One row for each split, and lines must keep their order.
    cut = _records(lines().join(F.broadcast(entries), list(_PLACE)).select(*_PLACE, "name", "value", "inside", "owner"), sep)
    pieces = cut.where("owner is not null").groupBy("file", "name", "owner")
    sorted_pieces = F.sort_array(F.collect_list(F.struct("begin", "record")))
    joined = pieces.agg(F.max("first").alias("first"), F.array_join(sorted_pieces["record"], "\n").alias("record"))
    every = cut.where("owner is null").select("name", "first", "record").unionByName(joined.select("name", "first", "record"))
    text = F.regexp_replace("record", "\r$", "")
    text = F.when(F.col("first"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return every.select("name", "first", text.alias("record")).where("record != ''")


def read_split_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    options: dict[str, str],
    sep: str,
    header: bool,
    name_pattern: str | None = None,
) -> DataFrame:
    """The columns of ``schema`` and ``_name``, the name of a row's file."""
    found = records(spark, path, sep, name_pattern)
    if header:
        found = found.where("not first")
    return found.select(F.from_csv("record", _ddl(schema), options).alias("r"), F.col("name").alias("_name")).select("r.*", "_name")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)

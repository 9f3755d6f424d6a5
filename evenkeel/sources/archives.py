"""CSV members of ZIP archives."""

from __future__ import annotations

import csv
import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "archive string, member string, row_number long, header array<string>, fields array<string>"
_BATCH = 10_000


def unzip_csv(archives: DataFrame, pattern: str = "*.csv") -> DataFrame:
    """Rows of the CSV members of archives given as (path, content).

    ``header`` has the names of a member's columns and ``fields`` the texts of a row
    in the same order, so members may differ and names may repeat; ``field`` picks
    one by name. One archive is one task's work; a file read as ``binaryFile`` is
    below 2 GB. Rows leave in batches, so a member is never held unpacked as a whole.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    for name in sorted(archive.namelist()):
                        if fnmatch.fnmatch(name, pattern):
                            yield from _rows(path.as_py(), archive, name)

    return archives.select("path", "content").mapInArrow(members, MEMBER_SCHEMA)


def _rows(path: str, archive: zipfile.ZipFile, name: str) -> Iterator[pa.RecordBatch]:
    with archive.open(name) as raw:
        yield from csv_batches(path, name, raw)


def csv_batches(path: str, name: str, raw: BinaryIO) -> Iterator[pa.RecordBatch]:
    """The rows of an unpacked member in batches, so a member is never held as a whole."""
    reader = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
    header = next(reader, None)
    number, held = 0, []
    for row in reader:
        if row:  # a blank line is no row
            held.append(row)
        if len(held) == _BATCH:
            yield _batch(path, name, number, header, held)
            number, held = number + len(held), []
    if held:
        yield _batch(path, name, number, header, held)


def _batch(path: str, name: str, before: int, header: list[str], rows: list[list[str]]) -> pa.RecordBatch:
    n, texts = len(rows), pa.list_(pa.string())
    columns = [
        pa.repeat(path, n),
        pa.repeat(name, n),
        pa.array(range(before + 1, before + n + 1), pa.int64()),
        pa.repeat(pa.scalar(header, texts), n),
        pa.array(rows, texts),
    ]
    return pa.RecordBatch.from_arrays(columns, ["archive", "member", "row_number", "header", "fields"])


def field(name: str) -> Column:
    """The text of the first column called ``name``; NULL where a member or a row lacks it."""
    at = F.array_position("header", name)
    return F.when(at > 0, F.try_element_at("fields", at.cast("int"))).alias(name)


def read_zip_csv(spark: SparkSession, path: str, pattern: str = "*.csv", task_bytes: int | None = None) -> DataFrame:
    """Rows of all CSV members matching ``pattern`` in the archives at or below ``path``.

    Members are read by tasks of their own (``zipsource``), small ones together up to ``task_bytes``. Where only Spark
    can open the path, an archive is one task's work and below 2 GB (``unzip_csv``).
    """
    from evenkeel.sources.zipsource import ZipCsv, reachable

    if not reachable(path):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
        return unzip_csv(found, pattern)
    spark.dataSource.register(ZipCsv)
    reader = spark.read.format("zip_csv").option("path", path).option("pattern", pattern)
    if task_bytes is not None:
        reader = reader.option("taskBytes", task_bytes)
    return reader.load()


def write_zip_csv(df: DataFrame, root: str, archive: str, member: str, order_by: list[str]) -> DataFrame:
    """Write the other columns of ``df`` as CSV members of archives below ``root``: (path, size) of each archive.

    An archive is one file, so it is one task's work; it gets its name when it is whole, so a task that runs again
    replaces it. Columns are written as text, NULL as an empty field. Members and their rows are in order.
    """
    from evenkeel.sources.zipsource import file_system

    columns = [c for c in df.columns if c not in (archive, member)]
    texts = df.select(F.col(archive).alias("_archive"), F.col(member).alias("_member"), *[F.col(c).alias(f"_order_{c}") for c in order_by], *[F.col(c).cast("string").alias(c) for c in columns])

    def write(table: pa.Table) -> pa.Table:
        name = table.column("_archive")[0].as_py()
        system, place = file_system(f"{root.rstrip('/')}/{name}")
        system.create_dir(place.rpartition("/")[0], recursive=True)
        draft = f"{place}.{uuid.uuid4().hex}"
        table = table.sort_by([("_member", "ascending"), *((f"_order_{c}", "ascending") for c in order_by)])
        with system.open_output_stream(draft) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            kinds = table.column("_member").combine_chunks()
            turns = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
            for begin, end in zip(turns, turns[1:], strict=False):
                some = table.slice(begin, end - begin).select(columns)
                with out.open(kinds[begin].as_py(), "w", force_zip64=True) as raw_member:
                    with io.TextIOWrapper(raw_member, "utf-8", newline="") as text:
                        writer = csv.writer(text, lineterminator="\n")
                        writer.writerow(columns)
                        for batch in some.to_batches(_BATCH):
                            writer.writerows(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        system.move(draft, place)
        size = system.get_file_info(place).size
        return pa.table({"path": [f"{root.rstrip('/')}/{name}"], "size": pa.array([size], pa.int64())})

    return texts.groupBy("_archive").applyInArrow(write, "path string, size long")

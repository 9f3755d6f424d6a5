"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
BLANKS = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_rest(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 for a NULL id."""
    return F.coalesce((F.crc32(F.col(column).cast("string")) % divisor).cast("int"), F.lit(-1))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(1.0 / (1 << 53))


def chunks(texts: list[str], most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of about ``most_chars`` characters; a longer text makes a run of its own."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > most_chars:
            yield begin, i
            begin = i
            total = 0
        total += len(text)
    if texts:
        yield begin, len(texts)


def kept_rows(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose ``text`` a function of a batch of texts keeps."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(each, docs.schema)

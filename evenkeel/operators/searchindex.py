"""Keyword search that does not read every text: postings by term, cut in blocks by recency.

Building ranks the rows from the newest on and writes three tables: ``rows`` (by blocks of ``BLOCK`` ranks, without the
texts), ``postings`` (term, block, rank; a folder for each range of term hashes) and ``terms`` (each distinct term once).
Postings are shuffled once and not gathered in lists, which need a sort of their own on both sides of a shuffle; a folder's
files hold a stretch of ranks each, so that more rows make more files and not longer tasks.
A word of a query is looked for inside terms, as in the texts themselves: terms hold no blanks, and neither do words.
Only the folders of the terms found are read, the newest blocks first, and as soon as enough rows have been found no
older block is looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.normalize import where_equal
from evenkeel.operators.rowindex import with_row_index

#: Ranks in a block, and folders of postings.
BLOCK = 1 << 14
FOLDERS = 256
#: A file of postings holds a stretch of about so many rows for each folder there is.
FILE_ROWS = 1 << 11
#: Blocks that are looked at first; each further step takes twice as many.
FIRST_BLOCKS = 4
#: Terms that are named in a filter; more are joined.
NAMED_TERMS = 10_000
_POSTINGS = "term string, block long, rank long, folder int"


def _folder(term: F.Column, folders: int) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def build(df: DataFrame, path: str, texts: Sequence[str], newest: str, tie: str = "id", block: int = BLOCK, folders: int = FOLDERS) -> str:
    """Index the columns ``texts`` of ``df``, newest by ``newest`` and then the largest ``tie``; gives ``path``."""
    # Numbering counts up from the oldest; a rank counts from the newest.
    narrow = df.select(tie, newest)
    numbered = with_row_index(narrow, [newest, tie], "_number")
    total = narrow.count()
    rank = numbered.select(F.col(tie).alias("_tie"), F.col(newest).alias("_newest"), (F.lit(total) - F.col("_number")).alias("rank"))
    same = [F.col(tie).eqNullSafe(F.col("_tie")), F.col(newest).eqNullSafe(F.col("_newest"))]
    ranked = df.join(rank, same).drop("_tie", "_newest").withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    rows = ranked.drop(*texts[1:])  # the first text is the title, which a hit shows
    rows.repartitionByRange("block").sortWithinPartitions("block", "rank").write.parquet(f"{path}/rows")
    content = F.lower(F.concat_ws(" ", *texts))
    words = F.array_distinct(F.filter(F.split(content, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    posted = ranked.select("rank", F.explode(words).alias("term"))
    folder, stretch = _folder(F.col("term"), folders), F.floor(F.col("rank") / (FILE_ROWS * folders))
    dealt = posted.repartition(folder, stretch)  # what follows from term and rank is not shuffled
    full = dealt.select("term", F.floor(F.col("rank") / block).cast("long").alias("block"), "rank", folder.alias("folder"))
    laid = full.sortWithinPartitions("folder", "block", "term")
    laid.write.partitionBy("folder").parquet(f"{path}/postings")
    spark = df.sparkSession
    found = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    found.groupBy("folder", "term").agg(F.count("*").alias("rows")).write.parquet(f"{path}/terms")
    return path


class Index:
    """A built index, for searching."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.blocks = int(self.rows.agg(F.max("block")).first()[0] or 0) + 1

    def terms(self, word: str) -> list[tuple[int, str]]:
        """(folder, term) of the terms that contain a word; the distinct terms alone are read."""
        found = self.spark.read.parquet(f"{self.path}/terms").where(F.col("term").contains(word))
        return [(r["folder"], r["term"]) for r in found.select("folder", "term").limit(NAMED_TERMS + 1).collect()]

    def postings(self, word: str) -> DataFrame | None:
        """(block, rank) of the rows that contain a word; None if there are none. Only folders of its terms are read."""
        found = self.terms(word)
        if not found:
            return None
        base = self.spark.read.schema(_POSTINGS).option("basePath", f"{self.path}/postings")
        if len(found) > NAMED_TERMS:  # a word of a letter or two: its terms are in all folders
            hits = base.parquet(f"{self.path}/postings").where(F.col("term").contains(word))
        else:
            read = base.parquet(*sorted({f"{self.path}/postings/folder={folder}" for folder, _ in found}))
            hits = read.where(F.col("term").isin([term for _, term in found]))
        return hits.select("block", "rank").distinct()

    def search(self, query: str, limit: int = 10, **equal: str | None) -> DataFrame:
        """The newest ``limit`` rows that contain every word of ``query`` and have the given values; newest first."""
        words = sorted(set(query.lower().split()), key=len, reverse=True)
        hits = [self.postings(word) for word in words]
        wanted = where_equal(self.rows, **equal)
        if any(h is None for h in hits):
            return wanted.where(F.lit(False)).drop("block", "rank")
        begin, width = 0, FIRST_BLOCKS
        while True:
            end = min(begin + width, self.blocks)
            some = [h.where((F.col("block") >= 0) & (F.col("block") < end)) for h in hits]
            near = wanted.where(F.col("block") < end)
            found = near if not some else near.join(reduce(lambda a, b: a.join(b, ["block", "rank"]), some), ["block", "rank"])
            newest = found.orderBy("rank").limit(limit)
            if end == self.blocks or newest.count() >= limit:
                return newest.orderBy("rank").drop("block", "rank")
            width = 2 * end  # older blocks as well, with those before


def search(df: DataFrame, path: str, query: str, texts: Sequence[str], newest: str, limit: int = 10, **equal: str | None) -> DataFrame:
    """Build an index and search it."""
    return Index(df.sparkSession, build(df, path, texts, newest)).search(query, limit, **equal)

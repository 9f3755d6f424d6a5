"""Mixing sources to target weights.

The words of a source, its documents one after the other, are cut into blocks of ``BLOCK`` words (the last may be
shorter). The mix is a row of slots, dealt to output shards of ``SHARD`` slots. Per shard the slots of each source are a
multinomial draw by the sources' shares; the whole part of a source's expectation is fixed and the rest is drawn, which
keeps the draw's mean and makes its spread small. The n-th slot of a source takes pass n // blocks of that source, and
within the pass the block that a pseudorandom permutation of the block numbers gives (swap-or-not shuffle of Hoang,
Morris and Rogaway: a bijection on any range, keyed by source and pass). Slots and blocks then meet in an equality join
on (source, block).

Targets: sources in code point order, NULL last, weigh 1, 2, 3, 1, ... and share the size of all; a target stops at
``PASSES`` times the size of its source, and what it cannot take is shared anew by weight until none is above. No block
is taken more than ``PASSES`` times: slots that a draw gives a source beyond that stay empty.

Only DataFrame functions are used, draws and permutations are hashes, and nothing depends on the order of rows, so
reruns and recomputed tasks agree. A source's documents lie in ``BUCKETS`` hash buckets that are numbered on their own,
so no window spans a hot source. Tables of sources, of shards by source and of buckets by source are aggregates.

Cases: NULL text has no words; documents without words and sources without words take nothing; a NULL source is a source
of its own; rows that repeat a doc_id are documents of their own (equal ones share their result evenly by order); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import BLANKS, uniform
from evenkeel.session import pinned

WEIGHTS = (1, 2, 3)
PASSES = 3
BLOCK = 32
SHARD = 4_096
BUCKETS = 4_096
ROUNDS = 24
SEED = 7


def words(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def _key(source: Column) -> Column:
    """Sources as text that sorts by code point, NULL last, and never equals NULL."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the source), size, copies: equal rows are folded."""
    size = F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("source")).alias("key"), size.alias("size"))
    return rows.groupBy("doc_id", "key", "size").agg(F.count("*").alias("copies"))


def sources(sizes: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """One row per source: key, weight, source_size, target, blocks.

    Targets are min(cap, level * weight) with the level that makes them add up to the size of all: sources in order of
    cap by weight reach their cap until the level of the rest lies below theirs.
    """
    total = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    number = F.row_number().over(Window.orderBy("key"))
    weight = F.array(*map(F.lit, WEIGHTS))[((number - 1) % len(WEIGHTS)).cast("int")]
    known = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes)
    known = known.withColumn("reach", F.col("cap") / F.col("weight"))
    order = Window.orderBy("reach", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    levels = known.withColumn("level", free / weights)
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "key", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).select(
        "key", "weight", "source_size", "target", F.ceil(F.col("source_size") / block).cast("long").alias("blocks")
    )


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 .. size-1 (swap-or-not shuffle)."""
    keys = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(r, *key), size))

    def step(x: Column, k: Column) -> Column:
        other = F.pmod(k - x, size)
        high = F.greatest(x, other)
        return F.when(F.xxhash64(high, k, *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, index, step)


def draws(known: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """Slots of each source in each shard: key, shard, first (slot of the source), n, blocks."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # slots that a source needs: its blocks, as often as its target is of its size
    need = F.col("blocks") * F.col("target") / F.col("source_size")
    needs = known.where("source_size > 0").withColumn("need", need).withColumn("all", F.sum("need").over(every))
    # a row for each source of each shard
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard)))
    room = F.least(F.lit(shard).cast("long"), F.col("slots") - F.col("shard") * shard)
    mean = F.col("room") * F.col("need") / F.col("all")
    each = (
        needs.withColumn("slots", F.round("all").cast("long"))
        .where("slots > 0")
        .select("key", "blocks", "need", "all", "slots", numbers.alias("shard"))
        .withColumn("room", room)
        .withColumn("mean", mean)
        .withColumn("whole", F.floor("mean"))
        .withColumn("part", F.col("mean") - F.col("whole"))
        .select("shard", "room", "key", "blocks", "whole", "part")
    )
    own = Window.partitionBy("shard")
    run = own.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns(
        {"upto": F.sum("part").over(run), "parts": F.sum("part").over(own), "open": F.col("room") - F.sum("whole").over(own)}
    )
    # The open slots of a shard are points on the line of its parts; a point falls to the source whose stretch holds it.
    points = (
        each.groupBy("shard")
        .agg(F.max("open").cast("int").alias("open"), F.max("parts").alias("parts"))
        .where("open > 0")
        .select("shard", "parts", F.explode(F.sequence(F.lit(1), F.col("open"))).alias("i"))
        .select("shard", (uniform(F.lit(seed), F.col("shard"), F.col("i")) * F.col("parts")).alias("at"))
    )
    ends = each.select("shard", F.col("upto").alias("at"), "key", F.lit(0).alias("drawn"))
    line = ends.unionByName(points.select("shard", "at", F.lit(None).cast("string").alias("key"), F.lit(1).alias("drawn")))
    # the first stretch that ends beyond the point; the last source takes what rounding leaves
    beyond = Window.partitionBy("shard").orderBy(F.desc("at"), F.desc("drawn"), F.desc("key"))
    hit = F.last("key", ignorenulls=True).over(beyond.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = line.withColumn("key", F.coalesce(hit, F.max("key").over(Window.partitionBy("shard")))).groupBy("shard", "key")
    extra = drawn.agg(F.sum("drawn").alias("extra"))
    # Sizes of exploded rows cannot be estimated beforehand: without the hint a side could be broadcast, however large.
    counts = each.join(extra.hint("merge"), ["shard", "key"], "left").select(
        "shard", "key", "blocks", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("n")
    )
    # a row per shard and source
    upto = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("n > 0")


def slots(drawn: DataFrame, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """key, shard, slot (of the source), pass, block: one row per block that the mix takes."""
    numbers = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    # A row here becomes thousands below: dealt out by number, as adaptive execution would join such small partitions.
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = drawn.repartition(parts, "shard", "key").select("key", "shard", "blocks", numbers.alias("slot"))
    rows = rows.where(F.col("slot") < passes * F.col("blocks"))
    rows = rows.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("int"))
    index = F.col("slot") - F.col("pass") * F.col("blocks")
    block = permuted(index, F.col("blocks"), F.lit(seed), F.col("key"), F.col("pass"))
    return rows.select("key", "shard", "slot", "pass", block.alias("block"))


def fragments(sizes: DataFrame, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """Where the documents lie in their source's blocks: key, block, doc_id, size, copy, start, n (words)."""
    each = (
        sizes.where("size > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int"))
    )
    inner = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    # at most `buckets` rows per source
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    placed = (
        each.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(shifts, ["key", "bucket"])
        .withColumn("from", F.col("shift") + F.col("inner"))
        .withColumn("to", F.col("from") + F.col("size"))
    )
    numbers = F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))
    cut = placed.withColumn("block", F.explode(numbers))
    begin = F.greatest(F.col("from"), F.col("block") * block)
    end = F.least(F.col("to"), (F.col("block") + 1) * block)
    return cut.select(
        "key", "block", "doc_id", "size", "copy", (begin - F.col("from")).alias("start"), (end - begin).alias("n")
    )


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, mix): the mix has a row per shard, slot and fragment of a document's text."""
    sizes = pinned(sized(docs))
    known = pinned(sources(sizes, block).coalesce(1))
    taken = slots(draws(known, shard, seed), seed=seed)
    return sizes, known, taken.join(fragments(sizes, block).hint("merge"), ["key", "block"])


def taken_words(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    sizes, known, mix = mixed(docs, **settings)
    sums = mix.groupBy("doc_id", "key", "size", "copy").agg(F.sum("n").alias("taken"))
    every = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    same = [every["key"] == sums["key"], every["size"] == sums["size"], every["copy"] == sums["copy"]]
    joined = every.join(sums.hint("merge"), [every["doc_id"].eqNullSafe(sums["doc_id"]), *same], "left").select(
        every["doc_id"], every["key"], every["size"], F.coalesce(sums["taken"], F.lit(0)).alias("taken")
    )
    return joined.join(known, "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **settings: int) -> DataFrame:
    """The mix as documents: a row per document and pass with the words that the pass takes of it, in order.

    Columns are those of ``docs``; ``text`` and ``n_chars`` are those of the taken words, each with the white space
    before it. A document that a pass takes whole keeps its text as it is.
    """
    sizes, _, mix = mixed(docs, **settings)
    runs = mix.groupBy("doc_id", "key", "size", "copy", "pass").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs")
    )
    parts = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    count = F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct("*").alias("row"),
        _key(F.col("source")).alias("key"),
        count.alias("size"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(1).cast("long").alias("copy"),
    )
    if not sizes.where("copies > 1").isEmpty():  # number rows that share id, source and size
        alike = Window.partitionBy("doc_id", "key", "size").orderBy("row.text")
        rows = rows.withColumn("copy", F.row_number().over(alike).cast("long"))
    same = [rows["doc_id"].eqNullSafe(runs["doc_id"]), *(rows[c] == runs[c] for c in ("key", "size", "copy"))]

    def taken(cut_text: Column) -> Column:
        some = F.transform(runs["runs"], lambda r: F.slice(cut_text, (r["start"] + 1).cast("int"), r["n"].cast("int")))
        return F.array_join(F.flatten(some), "")

    # A text is cut into words once, not once for each of its runs: as the one element of an outer array.
    cut = F.transform(F.array(parts), taken)[0]
    text = F.when(runs["n"] == runs["size"], F.col("row.text")).otherwise(cut)
    row = F.col("row").withField("text", text)
    found = rows.join(runs.hint("merge"), same).select(row.alias("row"))
    if "n_chars" in docs.columns:
        found = found.select(F.col("row").withField("n_chars", F.length("row.text").cast("long")).alias("row"))
    return found.select("row.*")

"""Resolution of not-modified revisit records.

A revisit record says that a page was as before and has no body. Its base is the latest earlier full response (status
200) of the same canonical URL; earlier is by (time, record id). Its validators must agree with the base's: equal strong
entity tags where both have one, else equal modification dates where both have one, else nothing vouches for it. The
resolved record has the base's body and the base's headers, updated by those headers of the revisit that a not-modified
response may carry; headers that describe the stored body stay the base's.

The as-of join keeps only narrow columns and no window spans a whole URL: rows are put in order of (URL, time, record)
by a range exchange, so a hot URL spreads over many partitions, and the order is written to the shared folder once, since
sampled ranges may differ when computed again. Each partition carries its last response of a URL to later partitions of
the same URL (one row per partition and URL), and a window runs per (partition, URL).

Cases: a NULL URL has no canonical form, and its revisits stay unresolved; a NULL time is earlier than any other; records
with equal time are ordered by record id, a NULL id first, and responses that share both by a digest of the whole record,
which also refers to the base, so ids need not be unique or known; repeated rows each get their result; revisits without an earlier response,
with validators that differ, or without any are reported with that status and no body; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import pinned

#: A base with no more revisits than this is never copied.
HOT_ROWS = 1_000
#: Headers that a 304 response may update (fixed values, lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a page (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, without default port, user part, fragment, tracking parameters and closing slash;
    parameters in order; http and https are one."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?@]*@)?([^/?:]*)", 1))
    port = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?@]*@)?[^/?:]*:(\d+)", 1)
    port = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.sort_array(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    )
    joined = F.array_join(kept, "&")
    return F.concat(
        F.lit("//"),
        host,
        port,
        F.regexp_replace(path, r"/+$", ""),
        F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)),
    )


def _digest() -> Column:
    """Digest of all fields of a record: equal for equal records only."""
    fields = F.struct(
        "record_id",
        "url",
        F.col("ts").cast("string").alias("ts"),
        "kind",
        "status",
        F.array_sort(F.map_entries("headers")).alias("headers"),
        F.sha2(F.col("body").cast("binary"), 256).alias("body"),
    )
    return F.unhex(F.sha2(F.to_json(fields), 256))


def ordered(records: DataFrame) -> DataFrame:
    """Narrow rows with the partition that holds their stretch of the order (URL, time, record)."""
    narrow = records.select(
        "record_id",
        "url",
        canonical(F.col("url")).alias("page"),
        "ts",
        "kind",
        "status",
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("modified"),
        _digest().alias("digest"),
    )
    placed = narrow.repartitionByRange("page", "ts", "record_id", "kind")
    return pinned(placed.withColumn("stretch", F.spark_partition_id()))


def bases(records: DataFrame) -> DataFrame:
    """record_id, url, ts, page (canonical URL), digest of each revisit, base_id and base_digest (NULL: none), outcome."""
    rows = ordered(records)
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("page").isNotNull()
    base = F.when(full, F.struct("ts", "record_id", "digest", "etag", "modified"))
    rows = rows.withColumn("own", base)
    # one row per stretch and URL, then the last one of all earlier stretches of the URL
    lasts = rows.where("own is not null").groupBy("page", "stretch").agg(F.max("own").alias("last"))
    ends = rows.where("page is not null").select("page", "stretch").distinct().join(lasts, ["page", "stretch"], "left")
    before = Window.partitionBy("page").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("page", "stretch", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # strictly earlier by (time, record): peers in the order do not count
    inside = Window.partitionBy("page", "stretch").orderBy("ts", "record_id", "kind", "digest")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("near", F.last("own", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    joined = seen.join(carried, ["page", "stretch"], "left").withColumn("base", F.coalesce("near", "carried"))
    strong = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    weak = F.col("etag").startswith("W/") | F.col("base.etag").startswith("W/")
    dated = F.col("modified").isNotNull() & F.col("base.modified").isNotNull()
    outcome = (
        F.when(F.col("base").isNull(), "no_earlier_response")
        .when(strong & ~weak, F.when(F.col("etag") == F.col("base.etag"), "resolved").otherwise("validator_differs"))
        .when(dated, F.when(F.col("modified") == F.col("base.modified"), "resolved").otherwise("validator_differs"))
        .otherwise("no_validator")
    )
    return joined.select(
        "record_id",
        "url",
        "ts",
        "page",
        "digest",
        F.col("base.record_id").alias("base_id"),
        F.col("base.digest").alias("base_digest"),
        outcome.alias("outcome"),
    )


def merged(base: Column, update: Column) -> Column:
    """Headers of the base with the permitted ones of the revisit on top; names are lower case."""
    allowed = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolved(records: DataFrame) -> DataFrame:
    """Every revisit with its outcome and, where resolved, the base's body and the merged headers.

    ``records``: record_id, url, ts, kind ('response' or 'revisit'), status, headers (map, lower-case names), body.
    """
    spark = records.sparkSession
    known = pinned(bases(records).select("digest", "page", "base_id", "base_digest", "outcome").distinct())
    own = records.where("kind = 'revisit'").select("record_id", "url", "ts", F.col("headers").alias("own"), _digest().alias("digest"))
    every = own.join(known, "digest")
    # Revisits without a base would all meet in the partition of NULL.
    lone = every.where("base_digest is null")
    ids = every.where("base_digest is not null")
    stored = records.where("kind = 'response'").select(
        _digest().alias("base_digest"), F.col("headers").alias("base_headers"), F.col("body").alias("base_body")
    )
    # Responses of one digest are equal: one of them is joined. A base with more revisits than a partition has on average
    # is copied, and its revisits are dealt to the copies. There are fewer such bases than partitions, and together they
    # have at most twice as many copies.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(HOT_ROWS, -(-known.count() // parts))
    counts = known.where("base_digest is not null").groupBy("base_digest").count().where(F.col("count") > share)
    hot = {bytes(r["base_digest"]): -(-r["count"] // share) for r in counts.collect()}
    if hot:
        often = F.col("base_digest").isin(list(hot))
        copies = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("base_digest")]
        bodies = stored.where(often).dropDuplicates(["base_digest"])
        bodies = bodies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), (copies - 1).cast("long"))))
        dealt = ids.where(often).withColumn("copy", F.pmod(F.xxhash64("record_id", "url", "ts"), copies.cast("long")))
        rest = ids.where(~often).join(stored.where(~often).dropDuplicates(["base_digest"]), "base_digest", "left")
        met = dealt.join(bodies, ["base_digest", "copy"], "left").drop("copy").unionByName(rest)
    else:
        met = ids.join(stored.dropDuplicates(["base_digest"]), "base_digest", "left")
    got = F.col("outcome") == "resolved"
    return met.unionByName(lone, allowMissingColumns=True).select(
        "record_id",
        "url",
        "ts",
        "page",
        "base_id",
        "outcome",
        F.when(got, merged(F.col("base_headers"), F.col("own"))).alias("headers"),
        F.when(got, F.col("base_body")).alias("body"),
    )

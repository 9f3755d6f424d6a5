"""Comparisons and counts over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from evenkeel.functions import clock
from evenkeel.operators import diff
from evenkeel.operators.keys import any_null
from evenkeel.operators.normalize import folded, normalized
from evenkeel.session import pinned
from evenkeel.spec import MATCH, MISSING_IN_SOURCE, MISSING_IN_TARGET, VALUE_MISMATCH, CompareSpec


def drain(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all available input of a streaming frame into Parquet and read it back.

    In append mode what no watermark has passed yet (open windows, unmatched rows of
    the last stretch of time) stays in state and is not in the result; a closing row
    with a later time, such as ``plans/streams.py`` adds, brings it out.
    """
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def drain_batches(df: DataFrame, path: str, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``each`` on every micro-batch and collect its rows in Parquet.

    A batch writes its own folder, so a batch that is repeated after a failure
    replaces its rows instead of adding them twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out").drop("batch_id")


def stream_diff(
    source: DataFrame, target: DataFrame, spec: CompareSpec, ts: str, tolerance: int, delay: str = "10 minutes"
) -> DataFrame:
    """Live differences between two streams of rows with key and event time.

    Rows pair when keys are equal and times at most ``tolerance`` microseconds
    apart; unmatched rows follow once the watermark has passed them. A row without
    a time pairs with nothing and is unmatched at once. A key that repeats within
    the tolerance pairs with each of its rows: rows of a stream cannot be counted
    before they pair. Both time columns must be zoned timestamps, as watermarks need.
    """
    if spec.duplicates == "ordinal" or not spec.exact:
        raise ValueError("a stream cannot number the rows of a key or compare digests")
    keys = list(spec.keys)
    columns = [c for c in diff.compare_columns(source, target, spec) if c != ts]
    reach = clock.span(tolerance)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *[folded(df, c, spec).alias(f"{name}_{c}") for c in (*keys, *columns)],
            F.col(ts).alias(f"{name}_{ts}"),
            F.lit(True).alias(f"{name}_here"),
        )

    sides = {"source": side(source, "source"), "target": side(target, "target")}
    timed = [df.where(F.col(f"{n}_{ts}").isNotNull()).withWatermark(f"{n}_{ts}", delay) for n, df in sides.items()]
    on = (F.col(f"target_{ts}") >= F.col(f"source_{ts}") - reach) & (
        F.col(f"target_{ts}") <= F.col(f"source_{ts}") + reach
    )
    for k in keys:
        a, b = F.col(f"source_{k}"), F.col(f"target_{k}")
        on = on & (a.eqNullSafe(b) if spec.null_safe_keys else a == b)
    joined = timed[0].join(timed[1], on, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & spec.equal(c, F.col(f"source_{c}"), F.col(f"target_{c}"))
    status = (
        F.when(F.col("target_here").isNull(), MISSING_IN_TARGET)
        .when(F.col("source_here").isNull(), MISSING_IN_SOURCE)
        .when(same, MATCH)
        .otherwise(VALUE_MISMATCH)
    )
    rows = joined.select(
        *[F.coalesce(f"source_{k}", f"target_{k}").alias(k) for k in keys],
        F.coalesce(f"source_{ts}", f"target_{ts}").alias(ts),
        status.alias("row_status"),
    )
    for (name, df), lacks in zip(sides.items(), (MISSING_IN_TARGET, MISSING_IN_SOURCE)):
        lone = df.where(F.col(f"{name}_{ts}").isNull())
        rows = rows.unionByName(
            lone.select(
                *[F.col(f"{name}_{k}").alias(k) for k in keys],
                F.col(f"{name}_{ts}").alias(ts),
                F.lit(lacks).alias("row_status"),
            )
        )
    return rows


def against_source(source: DataFrame, spec: CompareSpec) -> Callable[[DataFrame], DataFrame]:
    """For ``drain_batches``: compare each row of the micro-batches with a fixed source.

    The source is grouped by key and written once; a batch then joins it as it is.
    Every target row is judged on its own, so results do not depend on where
    batches are cut: a key that the targets repeat gives a row for each of them,
    and one that the source repeats is ``duplicate_key``. What is missing in the
    target is only known at the end, so it is not reported.
    """
    if spec.duplicates == "ordinal" or not spec.exact:
        raise ValueError("a micro-batch cannot number the rows of a key or compare digests")
    keys = list(spec.keys)
    known: dict[tuple, tuple[list[str], DataFrame]] = {}

    def prepared(batch: DataFrame) -> tuple[list[str], DataFrame]:
        columns = tuple(diff.compare_columns(source, batch, spec))
        if columns not in known:
            rows = diff.collapsed(normalized(source, columns, spec), keys, columns, "source")
            known[columns] = (list(columns), pinned(rows.toDF(*[f"_s_{k}" for k in keys], *rows.columns[len(keys) :])))
        return known[columns]

    def each(batch: DataFrame) -> DataFrame:
        columns, held = prepared(batch)
        rows = normalized(batch, columns, spec)
        rows = rows.select(*keys, *[F.col(c).alias(f"target_{c}") for c in columns])
        same_key = [
            F.col(k).eqNullSafe(F.col(f"_s_{k}")) if spec.null_safe_keys else F.col(k) == F.col(f"_s_{k}") for k in keys
        ]
        joined = rows.join(held, same_key, "left").drop(*[f"_s_{k}" for k in keys])
        joined = joined.withColumn("n_source", F.coalesce("n_source", F.lit(0).cast("long")))
        paired = diff.Paired(joined.withColumn("n_target", F.lit(1).cast("long")), spec, columns, keys)
        return paired.rows.withColumn("row_status", paired.status())

    return each


def stream_compare(
    source: DataFrame, target: DataFrame, spec: CompareSpec, ts: str, gap: str = "10 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Keys, row counts of both sides and ``row_status`` of two streams, as a batch compare gives them.

    Rows of a key, of either side, that follow each other within ``gap`` are one spell and are compared together when the
    watermark has passed it. Spells are counted and folded as rows come, so a key that repeats is ``duplicate_key`` with
    its counts and its rows are never paired with each other; state holds one row for each open spell. Rows with a NULL
    key (unless keys are null-safe) or without a time are unmatched on their side at once. Times must be zoned.
    """
    if spec.duplicates == "ordinal" or not spec.exact:
        raise ValueError("a stream cannot number the rows of a key or compare digests")
    keys = list(spec.keys)
    columns = [c for c in diff.compare_columns(source, target, spec) if c != ts]

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*[folded(df, c, spec).alias(c) for c in (*keys, *columns)], F.col(ts).alias("_ts"))
        return rows.select(*keys, "_ts", F.lit(name).alias("_side"), F.struct(F.lit(True), *columns).alias(f"_{name}"))

    both = side(source, "source").unionByName(side(target, "target"), allowMissingColumns=True)
    alone = F.col("_ts").isNull() | (F.lit(False) if spec.null_safe_keys else any_null(keys))
    timed = both.where(~alone).withWatermark("_ts", delay)
    spells = timed.groupBy(*keys, F.session_window("_ts", gap).alias("_spell")).agg(
        *[F.count_if(F.col("_side") == s).alias(f"n_{s}") for s in diff.SIDES],
        *[F.first(f"_{s}", ignorenulls=True).alias(f"_{s}") for s in diff.SIDES],
    )
    values = [F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in diff.SIDES for c in columns]
    paired = diff.Paired(spells.select(*keys, "n_source", "n_target", *values), spec, columns, keys)
    rows = paired.rows.select(*keys, "n_source", "n_target", paired.status().alias("row_status"))
    here = F.col("_side") == "source"
    lone = both.where(alone).select(
        *keys,
        here.cast("long").alias("n_source"),
        (~here).cast("long").alias("n_target"),
        F.when(here, MISSING_IN_TARGET).otherwise(MISSING_IN_SOURCE).alias("row_status"),
    )
    return rows.unionByName(lone)


def drain_arriving(target: DataFrame, source: DataFrame, spec: CompareSpec, path: str) -> tuple[DataFrame, DataFrame]:
    """Compare an arriving target with a fixed source: rows as they came, and the whole compare at the end.

    Each micro-batch is judged against the source at once (``against_source``) and leaves its compared columns below
    ``path``; a batch that is repeated after a failure replaces both. When all have come, a closing sweep compares what
    was seen with the source, so keys that the target lacks, or repeats across batches, are told as in a batch compare,
    however batches were cut.
    """
    each = against_source(source, spec)

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = diff.compare_columns(source, batch, spec)
        batch.select(*spec.keys, *columns).write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")
        each(batch).write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    query = (
        target.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    reader = target.sparkSession.read
    columns = diff.compare_columns(source, target, spec)
    schema = target.select(*spec.keys, *columns).schema
    seen = reader.schema(schema).parquet(f"{path}/seen")
    return reader.parquet(f"{path}/out").drop("batch_id"), diff.row_statuses(source, seen, spec)


def windowed_counts(
    df: DataFrame, key: str, ts: str, width: str = "1 hour", slide: str = "10 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Rows per key in tumbling (slide = width) or sliding windows."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(key, F.window(ts, width, slide).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def activity_sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Spells of activity per key that end after ``gap`` without a row."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df`` with counters of rows and differences that an action fills on its way."""
    progress = Observation(name)
    differs = F.count_if(F.col("row_status") != "match")
    return df.observe(progress, F.count("*").alias("rows"), differs.alias("mismatches")), progress


class ProgressListener(StreamingQueryListener):
    """Adds up rows read and rows dropped as too late, per streaming query."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.late: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.runId)] = 0
        self.late[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.late[run] = self.late.get(run, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def file_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, bytes_per_batch: str | None = None
) -> DataFrame:
    """A Parquet folder, or a pattern of files, as a stream.

    Files come in the order they were written; the two limits bound a micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)

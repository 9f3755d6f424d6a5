"""Session settings for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders handed out by ``workspace`` and not released yet.
_made: list[str] = []

_STATE_SETTING = "spark.sql.streaming.stateStore.providerClass"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evenkeel")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("EVENKEEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(_STATE_SETTING, _STATE_STORE)
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting within a block. Queries and streams take it when they start there."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def rocksdb_state(spark: SparkSession) -> AbstractContextManager[None]:
    """Streams that start inside keep their state in RocksDB, whatever the session has set.

    A stateful processor with lists, maps and timers needs it: Spark's default store holds one table for each operator.
    A stream takes the settings at its start, so they need not last longer.
    """
    return setting(spark, _STATE_SETTING, _STATE_STORE)


def arrow_bytes(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Queries that run inside give Python a new Arrow batch when one has so many bytes, so a row of more comes alone."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def workspace(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master
    may leave it unset (tests, a laptop): a temporary folder is then made, and
    removed when Python ends. On a cluster executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="evenkeel-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/evenkeel-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the folders that this process has made below the shared folder.

    For when the results that read them have been used. Gives how many were there.
    """
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where a recomputed partition could differ from the first run (sampled
    range bounds), so a lost executor cannot change the result.
    """
    path = workspace(df.sparkSession) + "/pinned"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few large partitions to all cores, for work that is dear per row.

    A table with as many partitions as there are cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

"""Session helpers that every operator shares: table access, lineage cuts and guarded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side whose size has been measured is broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazy scan, so that filters and column lists reach the files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    The setting is read and never overwritten. Where it is unset (tests on a local master) a temporary
    folder is used; on any other master that is an error, because executors could not see the folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="listwright-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


#: Spark's setting by which an execution removes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and return a scan of it.

    Unlike :func:`checkpoint` the copy is columnar and compressed, and later reads prune columns and filter. What isn't
    dropped before goes when the driver ends; the shuffle files of the writing go with it, since nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`stored` once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the estimated size is within ``limit``; else leave the choice to Catalyst."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


#: Bytes up to which a scan is dealt out over all cores before Python reads it; larger ones have partitions enough.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where the files it scans make one or two partitions; else as it is. Rows don't change."""
    if df.isStreaming:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if read <= SPREAD_BYTES else df


def persist(df: DataFrame) -> DataFrame:
    """Keep a frame that several actions read; partitions that are lost are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

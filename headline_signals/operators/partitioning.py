"""Partitioning helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def target_parallelism(df: DataFrame) -> int:
    """The session's task slots (``defaultParallelism``), at least the shuffle width."""
    spark = df.sparkSession
    try:
        slots = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext (remote session)
        slots = 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(slots, min(shuffle, slots * 4) if slots else shuffle)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``partitions`` tasks when its scan yields fewer.

    Used right before CPU-heavy per-row work (text matching, parsing, model calls). A
    scan of many files already has enough partitions and is returned unchanged, so on
    a cluster this adds no shuffle; it only matters for a few large, unsplittable files.
    """
    if df.isStreaming:
        return df
    want = partitions or target_parallelism(df)
    try:
        # only plans without a shuffle: asking an adaptive plan with exchanges for its
        # partitions would run those stages ahead of the real job
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote sessions have no RDD or JVM view
        return df
    return df.repartition(want) if have < want else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now and continue from the written copy.

    Used for small intermediate tables (daily grain) that later steps read more than
    once: the upstream scan, join and aggregate run once, and the lineage is cut, so a
    lost executor costs a re-read instead of a recomputation.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries started in this block leave no shuffle files: each deletes its own as it ends.

    For steps whose result is written, so that nothing reads the shuffle again; else the files
    stay on the executors' disks until the driver collects its garbage."""
    try:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # noqa: BLE001 - a remote session or a Spark without the setting
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)

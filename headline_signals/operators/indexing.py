"""Distributed global row index (for feed paging and series positions).

``row_number()`` over an unpartitioned window moves every row into one task. Here the
keys are cut into ranges at quantiles of the data, so ranges hold about equally many rows
however sparse or uneven the keys are: per-range counts form a small table whose running
sum gives each range's offset, and rows are numbered inside their range with a window
partitioned by it. The number of ranges follows the session's shuffle partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges per shuffle partition: enough for hash partitioning to even them out.
RANGES_PER_PARTITION = 4


def key_range(df: DataFrame, key: str, ranges: int | None = None) -> Column:
    """Number of the range of ``key`` (ascending, of any orderable numeric type): how many of the
    quantiles of ``df`` are not above it, found in two steps of about the square root of
    their number. Null keys get range 0. The quantiles, one number per range, are found by a
    job of their own."""
    n = ranges or RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = math.isqrt(n) + 1
    edges = df.agg(F.percentile_approx(key, [i / n for i in range(n)], 10 * n)).first()[0]
    if not edges:
        return F.lit(0)
    kind, value = df.schema[key].dataType.simpleString(), F.col(key)

    def literal(values):
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    edges = sorted(set(edges))
    coarse = literal(edges[::step])
    fine = F.array(*[literal(edges[i:i + step]) for i in range(0, len(edges), step)])
    group = F.greatest(F.size(F.filter(coarse, lambda e: e <= value)) - 1, F.lit(0))
    within = F.greatest(F.size(F.filter(F.get(fine, group), lambda e: e <= value)) - 1, F.lit(0))
    return F.when(value.isNull(), 0).otherwise(group * step + within)


def global_index(df: DataFrame, key: str, out_col: str = "global_index",
                 partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based position of each row in ascending ``key`` order (within
    each ``partition_by`` group when given). Equal keys are numbered in any order."""
    pb = list(partition_by or [])
    keyed = df.withColumn("_bucket", key_range(df, key, ranges))
    # one row per non-empty range: a small table next to the data
    counts = keyed.groupBy(*pb, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    over_buckets = (Window.partitionBy(*pb) if pb else Window).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pb, "_bucket", F.sum("_n").over(over_buckets).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*pb, "_bucket").orderBy(key))
    # join strategy left to the planner: AQE broadcasts the offsets when they are small
    return (keyed.withColumn("_local", local)
            .join(offsets, [*pb, "_bucket"])
            .withColumn(out_col, (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_local")).cast("bigint"))
            .drop("_bucket", "_local", "_offset"))

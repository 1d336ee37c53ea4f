"""Exact quantiles of any number of rows by distributed rank selection.

``percentile`` holds every distinct value of a group in one task. Here a quantile is the
value at a rank, and ranks are found by counting: a histogram over the value range of each
group says which bucket holds a wanted rank, only that bucket is opened into finer ones,
and so on until a bucket holds one value, or few enough rows to order in one task. Wide
ranges are cut by logarithms, so that a few huge values do not put all others into one
bucket. What is shuffled is one count per bucket and task; values are never sorted
beyond ``FINISH`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .partitioning import materialize

#: Buckets of one histogram.
BUCKETS = 1024
#: Rows of a bucket that are ordered in one task.
FINISH = 10_000
#: Up to so many ranges go to the tasks as a broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_RANGES = 10_000

_RANGE = ["_g", "_metric", "_lo", "_hi"]


def _log(v: Column) -> Column:
    """Orders like ``v``; equal steps are equal ratios, down to the least double (exp(-745))."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 745))


def _in_ranges(values: DataFrame, state: DataFrame) -> DataFrame:
    """``values`` that fall into a range of ``state``, with the range."""
    ranges = materialize(state.select(*_RANGE).distinct())
    few = ranges.count() <= BROADCAST_RANGES
    return values.join(F.broadcast(ranges) if few else ranges, ["_g", "_metric"]).where(
        (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _opened(values: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    """``state`` with every range replaced by the bucket of it that holds the rank."""
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    share = F.when(_log(hi) - _log(lo) > 1, (_log(v) - _log(lo)) / (_log(hi) - _log(lo))).otherwise((v - lo) / (hi - lo))
    place = F.least(F.floor(share * buckets), F.lit(buckets - 1))
    counts = (_in_ranges(values, state).withColumn("_bucket", place).groupBy(*_RANGE, "_bucket")
              .agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to")))
    # at most ``buckets`` rows a range
    upto = Window.partitionBy(*_RANGE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(upto))
    rank = F.col("_rank") - F.col("_below")
    return (state.drop("_count").join(counts, _RANGE)
            .where((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")))
            .select("_g", "_metric", "_n", "_rank", (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"),
                    F.col("_c").alias("_count"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi")))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], partition_by: Sequence[str] | None = None,
                    buckets: int = BUCKETS, finish: int = FINISH) -> DataFrame:
    """One row (one per ``partition_by`` group): for each name of ``wanted`` the quantile ``p`` of a numeric
    column, with linear interpolation between the two nearest ranks, as ``percentile`` defines it.

    Nulls and NaN count as missing; a group without values has a null quantile, and an empty
    table gives one row of nulls (none with ``partition_by``). Runs a few jobs while it is
    called: one count per level, eight levels at most.
    """
    pb = list(partition_by or [])
    metrics = sorted({c for c, _ in wanted.values()})
    group = F.struct(*[F.col(c) for c in pb]) if pb else F.struct(F.lit(0).alias("all"))
    pairs = F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(metrics)])
    values = materialize(df.select(group.alias("_g"), F.explode(pairs).alias("_p"))
                         .select("_g", F.col("_p.m").alias("_metric"), F.col("_p.v").alias("_v"))
                         .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    asked = [[p for c, p in wanted.values() if c == metric] for metric in metrics]
    shares = F.element_at(F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for ps in asked]), F.col("_metric") + 1)
    place = F.explode(shares).alias("_share")
    state = (values.groupBy("_g", "_metric")
             .agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
             .select("*", place).withColumn("_h", F.col("_share") * (F.col("_n") - 1))
             .select("_g", "_metric", "_n", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_rank"),
                     F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_count"), "_lo", "_hi").distinct())
    state, done = materialize(state), None
    wide = (F.col("_count") > finish) & (F.col("_lo") < F.col("_hi"))
    while True:
        narrow = state.where(~wide)
        done = narrow if done is None else done.unionByName(narrow)
        state = state.where(wide)
        if state.isEmpty():
            break
        state = materialize(_opened(values, state, buckets))
    single = done.where(F.col("_lo") == F.col("_hi")).withColumn("_v", F.col("_lo"))
    several = done.where(F.col("_lo") < F.col("_hi"))
    ordered = _in_ranges(values, several).withColumn(
        "_at", F.row_number().over(Window.partitionBy(*_RANGE).orderBy("_v")) - 1)
    found = several.join(ordered, _RANGE).where(F.col("_at") == F.col("_rank") - F.col("_below"))
    keep = ["_g", "_metric", "_n", "_rank", "_v"]
    found = single.select(*keep).unionByName(found.select(*keep))

    def quantile(metric: int, p: float) -> Column:
        mine = F.col("_metric") == metric
        h = F.lit(float(p)) * (F.max(F.when(mine, F.col("_n"))) - 1)
        own = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.max(F.when(mine & (F.col("_rank") == F.floor(own)), F.col("_v")))
        high = F.max(F.when(mine & (F.col("_rank") == F.ceil(own)), F.col("_v")))
        return F.when(F.floor(h) == F.ceil(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    result = [quantile(metrics.index(c), p).alias(name) for name, (c, p) in wanted.items()]
    if not pb:
        return found.agg(*result)
    per_group = found.groupBy("_g").agg(*result)
    groups = df.select(*pb).distinct().withColumn("_g", group)
    return groups.join(per_group, "_g", "left").select(*pb, *wanted)

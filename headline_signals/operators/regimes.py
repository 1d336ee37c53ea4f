"""Quantile thresholds and regime flags.

Thresholds are exact quantiles with linear interpolation over the whole series (per entity
with ``partition_by``). A series of days is bounded by the calendar, and ``percentile`` holds
its distinct values in one task. A series of timestamps is not: its ranks are selected by
counting (``operators.quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import null_as_zero_flag
from .quantiles import exact_quantiles

# Names of the flags, in output order.
FLAG_COLUMNS = ["extreme_positive_day", "extreme_negative_day", "high_sentiment_volatility",
                "high_news_flow_day", "mixed_sentiment_day", "high_confidence_day"]


#: Names of the thresholds, their columns and quantiles.
THRESHOLDS = {
    "sentiment_q25": ("avg_sentiment", 0.25), "sentiment_q75": ("avg_sentiment", 0.75),
    "volatility_q75": ("sentiment_volatility", 0.75), "count_q75": ("headline_count", 0.75),
}


def thresholds(daily: DataFrame, partition_by: Sequence[str] | None = None, order_col: str = "Date") -> DataFrame:
    """q25/q75 of avg_sentiment, q75 of sentiment_volatility and headline_count."""
    if order_col not in daily.columns or daily.schema[order_col].dataType.simpleString() != "date":
        return exact_quantiles(daily, THRESHOLDS, partition_by)
    aggs = [F.percentile(c, p).alias(name) for name, (c, p) in THRESHOLDS.items()]
    return daily.groupBy(*partition_by).agg(*aggs) if partition_by else daily.agg(*aggs)


def regime_flags(daily: DataFrame, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Six 0/1 flags against whole-series quantiles and fixed levels.

    The quantiles are a scalar subquery over one series, or a grouped aggregate per
    entity joined back for panels; no window holds a whole series.
    """
    if partition_by:
        # one threshold row per entity (a partial aggregate), joined back on the entity
        t = thresholds(daily, partition_by).select(
            *partition_by, F.col("sentiment_q25").alias("_q25"), F.col("sentiment_q75").alias("_q75"),
            F.col("volatility_q75").alias("_v75"), F.col("count_q75").alias("_c75"))
        daily_t = daily.join(t, list(partition_by), "left")
        flags = _flags()
        return daily_t.withColumns(flags).select(*daily.columns, *FLAG_COLUMNS)
    else:
        # one series: the four quantiles are one scalar subquery (a partial aggregate)
        t = thresholds(daily).select(F.struct("*")).scalar()
        q = {"_q25": t.getField("sentiment_q25"), "_q75": t.getField("sentiment_q75"),
             "_v75": t.getField("volatility_q75"), "_c75": t.getField("count_q75")}
    return daily.withColumns(q).withColumns(_flags()).select(*daily.columns, *FLAG_COLUMNS)


def _flags() -> dict:
    return {
        "extreme_positive_day": null_as_zero_flag(F.col("avg_sentiment") > F.col("_q75")),
        "extreme_negative_day": null_as_zero_flag(F.col("avg_sentiment") < F.col("_q25")),
        "high_sentiment_volatility": null_as_zero_flag(F.col("sentiment_volatility") > F.col("_v75")),
        "high_news_flow_day": null_as_zero_flag(F.col("headline_count") > F.col("_c75")),
        "mixed_sentiment_day": null_as_zero_flag(F.col("Neutral_Probability_mean") > 0.5),
        "high_confidence_day": null_as_zero_flag(F.col("avg_confidence") > 0.8),
    }

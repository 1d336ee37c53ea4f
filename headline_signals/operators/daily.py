"""Daily aggregates: sentiment index (A1), daily statistics (A2) and keyword
features (K1-K4), computed in one ``groupBy`` per output.

All aggregates here are algebraic (count, sum, avg, stddev, min, max), so Spark runs a
partial aggregate before the shuffle: a day holding a third of all rows is reduced
map-side and costs no more than any other day after the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import KEYWORDS, class_to_sign, mean_of, round4
from ..functions.keywords import hit_columns, keyword_hits
from ..functions.timeparse import day_of, parse_time

# Names of the 15 daily aggregates, in output order.
DAILY_STAT_COLUMNS = [
    "avg_sentiment", "sentiment_volatility", "min_sentiment", "max_sentiment",
    "headline_count", "avg_weighted_sentiment", "weighted_sentiment_volatility",
    "avg_confidence", "confidence_volatility",
    "Positive_Probability_mean", "Positive_Probability_max",
    "Negative_Probability_mean", "Negative_Probability_max",
    "Neutral_Probability_mean", "Neutral_Probability_max",
]


def sentiment_columns(scored: DataFrame) -> DataFrame:
    """Add ``sentiment_score = Pos - Neg`` and ``weighted_sentiment = score * Confidence``."""
    score = F.col("Positive_Probability") - F.col("Negative_Probability")
    return scored.withColumns({
        "sentiment_score": score,
        "weighted_sentiment": score * F.col("Confidence"),
    })


def _grain(scored: DataFrame, time_col: str, grain: str) -> Column:
    if grain == "day":
        return day_of(scored, time_col)
    if grain == "exact":
        dtype = scored.schema[time_col].dataType.simpleString()
        return parse_time(time_col) if dtype == "string" else F.col(time_col)
    raise ValueError("grain must be 'day' or 'exact'")


def daily_index(scored: DataFrame, time_col: str = "Time", class_col: str = "Predicted_Class",
                confidence_col: str = "Confidence", scale: int | None = None) -> DataFrame:
    """Daily sentiment index (A1).

    Per calendar day: ``Daily_Sentiment_Index = 100 * mean(sign(class) * confidence)``
    over rows with a known score, and ``Headlines_Processed`` = all rows of the day.
    Rows whose time does not parse are excluded. ``scale``: the decimals that confidences
    carry, if the caller knows them (``score`` rounds to 4); the sum is then exact.
    """
    sign = class_to_sign(class_col)
    agg = (scored
           .select(day_of(scored, time_col).alias("Time"),
                   (sign * F.col(confidence_col)).alias("_score"))
           .groupBy("Time")
           .agg((mean_of("_score", scale) * 100).alias("Daily_Sentiment_Index"),
                F.count(F.lit(1)).alias("Headlines_Processed")))
    return drop_null_group(agg, "Time", scored, time_col)


def drop_null_group(agg: DataFrame, key: str, rows: DataFrame | None = None, time_col: str = "Time") -> DataFrame:
    """Drop the group of rows whose key (a day) is null. On a date or timestamp column the filter
    reaches the scan. Where the day is parsed from text (``time_col`` of ``rows``), a pushed filter would
    parse each text twice, in code too long to compile, so it stays above the aggregate."""
    if rows is None or rows.schema[time_col].dataType.simpleString() != "string":
        return agg.where(F.col(key).isNotNull())
    held = next(f.name for f in agg.schema.fields if f.dataType.simpleString() == "bigint")
    return agg.where(F.when(F.coalesce(held, F.lit(0)) >= 0, F.col(key)).isNotNull())


def _stat_aggs(scale: int | None) -> list[Column]:
    double = None if scale is None else 2 * scale  # decimals of a product
    s, w, c = F.col("sentiment_score"), F.col("weighted_sentiment"), F.col("Confidence")
    raw = [
        mean_of(s, scale), F.stddev_samp(s), F.min(s), F.max(s), F.count(s),
        mean_of(w, double), F.stddev_samp(w), mean_of(c, scale), F.stddev_samp(c),
        mean_of("Positive_Probability", scale), F.max("Positive_Probability"),
        mean_of("Negative_Probability", scale), F.max("Negative_Probability"),
        mean_of("Neutral_Probability", scale), F.max("Neutral_Probability"),
    ]
    out = []
    for name, agg in zip(DAILY_STAT_COLUMNS, raw):
        # rounded to 4 decimals; a missing value (std of one row) becomes 0
        val = agg if name == "headline_count" else F.coalesce(round4(agg), F.lit(0.0))
        out.append(val.alias(name))
    return out


def _with_hits(rows: DataFrame, keywords: dict[str, list[str]], match: str,
               text_col: str = "Headline") -> DataFrame:
    """Per-row keyword match columns, unless an upstream step already joined them."""
    if all(c in rows.columns for c in hit_columns(keywords)):
        return rows
    return keyword_hits(rows, text_col, keywords, match)


def _keyword_aggs(keywords: dict[str, list[str]], scale: int | None) -> list[Column]:
    double = None if scale is None else 2 * scale
    out = []
    for cat in keywords:
        hit = F.col(f"_kw_{cat}_hit")
        out += [
            F.sum(f"_kw_{cat}_n").cast("bigint").alias(f"{cat}_mentions"),
            F.coalesce(mean_of(F.when(hit, F.col("weighted_sentiment")), double), F.lit(0.0))
             .alias(f"{cat}_sentiment"),
            F.sum(hit.cast("int")).cast("bigint").alias(f"{cat}_headlines"),
        ]
    return out


def keyword_columns(keywords: dict[str, list[str]] | None = None) -> list[str]:
    keywords = KEYWORDS if keywords is None else keywords
    return [f"{cat}_{kind}" for cat in keywords for kind in ("mentions", "sentiment", "headlines")]


def daily_stats(scored: DataFrame, time_col: str = "Time", grain: str = "day",
                scale: int | None = None) -> DataFrame:
    """Daily statistics (A2): ``Date`` plus the 15 aggregates, rounded to 4 decimals.

    ``headline_count`` counts rows with a known score. Rows without a parseable time
    are left out (P3). ``grain="exact"`` groups on the full timestamp instead of the calendar
    day (the reference's behaviour when times carry minutes). ``scale``: the decimals that
    probabilities carry, if known; sums are then exact.
    """
    rows = sentiment_columns(scored).withColumn("Date", _grain(scored, time_col, grain))
    agg = rows.groupBy("Date").agg(*_stat_aggs(scale))
    return drop_null_group(agg, "Date", scored, time_col)


def keyword_features(scored: DataFrame, time_col: str = "Time", grain: str = "day",
                     keywords: dict[str, list[str]] | None = None,
                     match: str = "substring", scale: int | None = None) -> DataFrame:
    """Keyword features per day (K1-K3): for each category, mentions (distinct words
    found per headline, summed), headlines with any match, and the mean weighted
    sentiment of those headlines (0 when none).

    Text matching runs per row unless the input already carries the match columns of
    ``functions.keywords.keyword_hits`` (computed once per distinct text upstream).
    """
    keywords = KEYWORDS if keywords is None else keywords
    rows = sentiment_columns(scored).withColumn("Date", _grain(scored, time_col, grain))
    rows = _with_hits(rows, keywords, match)
    agg = rows.groupBy("Date").agg(*_keyword_aggs(keywords, scale))
    return drop_null_group(agg, "Date", scored, time_col)


def daily_features(scored: DataFrame, time_col: str = "Time", grain: str = "day",
                   keywords: dict[str, list[str]] | None = None,
                   match: str = "substring", scale: int | None = None) -> DataFrame:
    """A2 and K1-K3 in a single ``groupBy``: one scan, one shuffle, no join (fuses J1/J2)."""
    keywords = KEYWORDS if keywords is None else keywords
    rows = sentiment_columns(scored).withColumn("Date", _grain(scored, time_col, grain))
    rows = _with_hits(rows, keywords, match)
    agg = rows.groupBy("Date").agg(*_stat_aggs(scale), *_keyword_aggs(keywords, scale))
    return drop_null_group(agg, "Date", scored, time_col)


def merge_keywords(daily: DataFrame, keyword_daily: DataFrame) -> DataFrame:
    """Left-join keyword rows on ``Date`` and fill every null in the frame with 0.

    The fill covers the whole frame on purpose: rolling columns computed before this
    step lose their leading nulls here (parity with the reference's order of steps).
    """
    return daily.join(keyword_daily, "Date", "left").fillna(0)

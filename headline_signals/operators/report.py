"""Chart-ready datasets and summaries.

Each function returns a small DataFrame computed from the whole input by aggregation;
nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import mean_of
from .indexing import global_index

# Chart order of the label counts.
LABEL_CHART_ORDER = ["Positive", "Negative", "Neutral"]


def label_counts(scored: DataFrame, label_col: str = "Sentiment") -> DataFrame:
    """A3: rows per label, zero-filled, in chart order; unknown labels are not charted.

    One pass with three conditional counts (partial aggregation), then ``stack``.
    """
    aggs = [F.count(F.when(F.col(label_col) == lab, 1)).alias(f"_{i}")
            for i, lab in enumerate(LABEL_CHART_ORDER)]
    pairs = ", ".join(f"{i}, '{lab}', _{i}" for i, lab in enumerate(LABEL_CHART_ORDER))
    return (scored.agg(*aggs)
            .select(F.expr(f"stack({len(LABEL_CHART_ORDER)}, {pairs}) AS (chart_order, label, count)"))
            .select(F.col("chart_order").cast("int"), "label", F.col("count").cast("bigint")))


def histogram(df: DataFrame, col: str, n_bins: int | None = 10) -> DataFrame:
    """A4/A5: equal-width histogram with every bin present.

    ``bin = floor((v - min) / size)`` with the maximum folded into the last bin; when
    all values are equal (size 0) every row goes to bin 0. Labels are
    ``"%.2f - %.2f"`` of the bin edges. ``n_bins=None`` uses ``min(10, rows)`` bins, so
    no bins for no rows.
    Min, max and bin count are one scalar subquery; counting per bin is a partial
    aggregate; the empty bins come from an equi-join with the bin numbers.
    """
    vals = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    nb = (F.least(F.lit(10), F.count(F.lit(1)).cast("int")) if n_bins is None
          else F.lit(int(n_bins)))
    stats = vals.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), nb.alias("_nb"))
    s = stats.select(F.struct("_lo", "_hi", "_nb")).scalar()
    lo, hi, n = s.getField("_lo"), s.getField("_hi"), s.getField("_nb")
    size = (hi - lo) / n
    binned = vals.select(F.when(size > 0, F.least(F.floor((F.col("_v") - lo) / size), n - 1))
                         .otherwise(F.lit(0)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("_count"))
    bins = stats.select(F.explode(F.when(F.col("_nb") > 0, F.sequence(F.lit(0), F.col("_nb") - 1))
                                 .otherwise(F.array().cast("array<int>"))).alias("bin"))
    start, end = lo + F.col("bin") * size, lo + (F.col("bin") + 1) * size
    return (bins.join(counts, "bin", "left")
            .select(F.col("bin").cast("int"),
                    F.format_string("%.2f - %.2f", start, end).alias("label"),
                    start.alias("bin_start"), end.alias("bin_end"),
                    F.coalesce(F.col("_count"), F.lit(0)).cast("bigint").alias("count")))


def correlation(df: DataFrame, a: str, b: str, name: str = "correlation") -> DataFrame:
    """A7 with P10: Pearson correlation over rows where both values are known."""
    valid = df.dropna(subset=[a, b])
    return valid.agg(F.corr(a, b).alias(name), F.count(F.lit(1)).alias("n_pairs"))


def date_range(daily: DataFrame, order_col: str = "Date") -> DataFrame:
    """First and last date."""
    return daily.agg(F.min(order_col).alias("start_date"), F.max(order_col).alias("end_date"))


def extreme_days(daily: DataFrame, value: str = "avg_sentiment", order_col: str = "Date") -> DataFrame:
    """The day with the highest and the lowest value; the earliest day wins ties and days
    without a value win nothing."""
    v, d = F.col(value), F.col(order_col)
    return daily.agg(
        F.min_by(d, F.when(v.isNotNull(), F.struct(-v, d))).alias("most_positive_day"),
        F.max(v).alias("most_positive_value"),
        F.min_by(d, F.when(v.isNotNull(), F.struct(v, d))).alias("most_negative_day"),
        F.min(v).alias("most_negative_value"),
    )


def summary(daily: DataFrame, order_col: str = "Date", scale: int | None = None) -> DataFrame:
    """One-row run summary with quality grades (A10).

    ``scale``: the decimals that daily sentiments carry, if the caller knows them (A2 rounds
    to 4); their mean is then taken from an exact sum. Days without a value win nothing.
    """
    v = F.col("avg_sentiment")
    d = F.col(order_col)
    out = daily.agg(
        F.count(F.lit(1)).alias("total_days"),
        F.min(d).alias("start_date"), F.max(d).alias("end_date"),
        F.avg("headline_count").alias("avg_headlines_per_day"),
        mean_of(v, scale).alias("avg_sentiment"),
        F.stddev_samp(v).alias("sentiment_volatility"),
        F.min(v).alias("min_sentiment"), F.max(v).alias("max_sentiment"),
        F.min_by(d, F.when(v.isNotNull(), F.struct(-v, d))).alias("most_positive_day"),
        F.min_by(d, F.when(v.isNotNull(), F.struct(v, d))).alias("most_negative_day"),
    )
    return out.withColumns({
        "data_quality": F.when(F.col("avg_headlines_per_day") > 10, "Good").otherwise("Low"),
        "sentiment_consistency":
            F.when(F.col("sentiment_volatility") < 0.2, "High").otherwise("Variable"),
    })


def page_count(df: DataFrame, per_page: int = 5) -> DataFrame:
    """Number of pages, ``ceil(rows / per_page)``."""
    return df.agg(F.ceil(F.count(F.lit(1)) / per_page).cast("bigint").alias("pages"))


def feed_page(df: DataFrame, page: int, per_page: int = 5, order_col: str = "seq") -> DataFrame:
    """One page of the feed in ``order_col`` order, with its 1-based global index.

    Sort + offset + limit: Spark keeps only ``page * per_page`` rows per task (top-k).
    """
    start = (page - 1) * per_page
    rows = df.orderBy(order_col).offset(start).limit(per_page)
    # the page is at most per_page rows; number them inside that tiny result
    return rows.withColumn(
        "global_index", (F.row_number().over(Window.orderBy(order_col)) + start).cast("bigint"))


def feed_pages(df: DataFrame, per_page: int = 5, order_col: str = "seq") -> DataFrame:
    """O6 over the whole feed: page number and global index of every row, computed
    without pulling the feed into one task (see ``indexing.global_index``)."""
    idx = global_index(df, order_col)
    return idx.withColumns({
        "page": ((F.col("global_index") - 1) / per_page).cast("bigint") + 1,
        "position_in_page": ((F.col("global_index") - 1) % per_page + 1).cast("int"),
    })


def preview(df: DataFrame, n: int = 5, order_col: str | None = None) -> DataFrame:
    """The first ``n`` rows (in ``order_col`` order when given)."""
    return (df.orderBy(order_col) if order_col else df).limit(n)


def index_series(index: DataFrame) -> DataFrame:
    """The daily index series in date order."""
    return index.select("Time", "Daily_Sentiment_Index").orderBy("Time")


def market_summary(daily: DataFrame, summary: DataFrame, sentiment_col: str = "avg_sentiment",
                   return_col: str = "daily_return") -> DataFrame:
    """C4: ``summary`` with the correlation of sentiment and same-day market return and the mean
    return; both null without market data."""
    if return_col not in daily.columns:
        unknown = F.lit(None).cast("double")
        return summary.withColumns({"market_correlation": unknown, "mean_return": unknown})
    both = daily.agg(F.struct(F.corr(sentiment_col, return_col).alias("r"), F.avg(return_col).alias("m"))).scalar()
    return summary.withColumns({"market_correlation": both.getField("r"), "mean_return": both.getField("m")})


def dashboard(daily: DataFrame, ma_window: int = 7, n_bins: int | None = 30,
              return_col: str | None = "next_day_return", model_scores: DataFrame | None = None,
              importance: DataFrame | None = None, top_k: int = 10) -> dict[str, DataFrame]:
    """The data behind each dashboard panel, one DataFrame per panel.

    C2 is ``ma_window=7, n_bins=30, return_col="next_day_return"`` with ``model_scores`` (rows target,
    model, mean_score, as ``fold_summary`` returns them) and ``importance`` (rows feature,
    importance) for the panels of model scores and of the ``top_k`` features; C3 (simplified)
    is ``ma_window=3, n_bins=None`` (``min(10, days)`` bins), ``return_col="daily_return"``.
    Without the market column both fall back to confidence against sentiment.
    """
    ma = f"sentiment_ma_{ma_window}d"
    out = {
        "sentiment_series": daily.select("Date", "avg_sentiment",
                                         *([ma] if ma in daily.columns else [])),
        "headline_counts": daily.select("Date", "headline_count"),
        "sentiment_mean": daily.agg(F.avg("avg_sentiment").alias("mean_sentiment")),
        "sentiment_histogram": histogram(daily, "avg_sentiment", n_bins),
    }
    if return_col and return_col in daily.columns:
        out["scatter"] = daily.select("avg_sentiment", return_col).dropna()
        out["sentiment_vs_return"] = correlation(daily, "avg_sentiment", return_col)
    else:
        out["scatter"] = daily.select("avg_confidence", "avg_sentiment")
        out["confidence_vs_sentiment"] = correlation(daily, "avg_confidence", "avg_sentiment")
    if model_scores is not None:
        out["model_scores"] = model_scores.select("target", "model", "mean_score")
    if importance is not None:
        place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
        # one row a feature of the model
        out["top_features"] = importance.select("feature", "importance", place.alias("place")).where(F.col("place") <= top_k)
    return out

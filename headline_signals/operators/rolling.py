"""Rolling features over a daily series.

The window length counts *rows* (days present), as in the reference, even though the
columns are named ``_{w}d``; ``frame="range"`` counts calendar days instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from . import moments as mo
from . import series
from .partitioning import materialize

DEFAULT_WINDOWS = (3, 7, 14, 30)
#: Averaged columns and the names of their means.
MEANS = (("avg_sentiment", "sentiment_ma"), ("avg_weighted_sentiment", "weighted_sentiment_ma"),
         ("headline_count", "headline_count_ma"), ("avg_confidence", "confidence_ma"))


def rolling_feature_names(windows: Sequence[int] = DEFAULT_WINDOWS) -> list[str]:
    names = []
    for w in windows:
        names += [f"sentiment_ma_{w}d", f"sentiment_std_{w}d", f"weighted_sentiment_ma_{w}d",
                  f"headline_count_ma_{w}d", f"confidence_ma_{w}d",
                  f"sentiment_momentum_{w}d", f"sentiment_trend_{w}d"]
    return names


def rolling_features(daily: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS,
                     order_col: str = "Date", partition_by: Sequence[str] | None = None,
                     frame: str = "rows", scale: int | None = None,
                     chunk_rows: int = series.CHUNK_ROWS, method: str | None = None) -> DataFrame:
    """Add 7 columns per window length ``w``:

    * W1 ``sentiment_ma``, ``weighted_sentiment_ma``, ``headline_count_ma``,
      ``confidence_ma``: trailing means over the last ``w`` rows (at least 1 row);
    * W2 ``sentiment_std``: trailing sample std (null on a single row);
    * W3 ``sentiment_momentum``: ``ma - previous ma`` (null on the first row);
    * W4 ``sentiment_trend``: least-squares slope of ``avg_sentiment`` against row
      position, null until the frame holds ``w`` values.

    ``frame="range"`` counts calendar days: the frame is the row's day and the ``w - 1`` before it,
    with all rows of those days, and the slope is per day. ``scale``: the decimals that the
    averaged columns carry, if known (A2 rounds to 4); window sums are then exact.

    ``method``: "frames" runs window frames over position chunks with a halo of ``max(windows)``
    rows (``operators.series``; ``rows`` only); "prefix" takes differences of prefix sums
    (``operators.moments``), so that a row costs the same whatever the window. By default
    frames serve short windows of rows, prefix sums all others.
    """
    if frame not in ("rows", "range"):
        raise ValueError("frame must be 'rows' or 'range'")
    method = method or ("frames" if frame == "rows" and 8 * max(windows) <= series.CHUNK_ROWS else "prefix")
    if method not in ("frames", "prefix") or (method == "frames" and frame == "range"):
        raise ValueError("method must be 'prefix', or 'frames' for windows of rows")
    work = _by_frames if method == "frames" else _by_prefix
    out = work(daily, windows, order_col, list(partition_by or []), frame, scale, chunk_rows)
    return out.select(*daily.columns, *rolling_feature_names(windows))


def _by_frames(daily: DataFrame, windows: Sequence[int], order_col: str, pb: list[str], frame: str,
               scale: int | None, chunk_rows: int) -> DataFrame:
    data = series.chunked(daily, order_col, lookback=max(windows), chunk_rows=chunk_rows, partition_by=pb)
    base = Window.partitionBy(*pb, "_chunk").orderBy("_pos")

    def mean(c, fw):
        if scale is None:
            return F.avg(c).over(fw)
        return (F.sum(F.col(c).cast(f"decimal(24,{scale})")).over(fw).cast("double")
                / F.count(c).over(fw))

    out = data.withColumn("_x", F.col("_pos").cast("double"))
    first = {}
    for w in windows:
        fw = base.rowsBetween(-(w - 1), 0)
        first[f"sentiment_ma_{w}d"] = mean("avg_sentiment", fw)
        first[f"sentiment_std_{w}d"] = F.stddev_samp("avg_sentiment").over(fw)
        first[f"weighted_sentiment_ma_{w}d"] = mean("avg_weighted_sentiment", fw)
        first[f"headline_count_ma_{w}d"] = mean("headline_count", fw)
        first[f"confidence_ma_{w}d"] = mean("avg_confidence", fw)
        full = F.count("avg_sentiment").over(fw) == w
        first[f"sentiment_trend_{w}d"] = F.when(full, F.regr_slope("avg_sentiment", "_x").over(fw))
    out = out.withColumns(first).withColumns(_momentum(windows, base))
    return series.unchunk(out, keep_pos="_pos" in daily.columns)


def _momentum(windows: Sequence[int], base: WindowSpec) -> dict[str, Column]:
    return {f"sentiment_momentum_{w}d": F.col(f"sentiment_ma_{w}d") - F.lag(f"sentiment_ma_{w}d", 1).over(base)
            for w in windows}


def _by_prefix(daily: DataFrame, windows: Sequence[int], order_col: str, pb: list[str], frame: str,
               scale: int | None, chunk_rows: int) -> DataFrame:
    data = daily if "_pos" in daily.columns else materialize(series.with_positions(daily, order_col, partition_by=pb))
    key = F.col("_pos") if frame == "rows" else F.unix_date(F.col(order_col).cast("date"))
    data = data.withColumn("_key", key.cast("bigint"))
    digits = mo.digits_of(data, [c for c, _ in MEANS], scale)
    y = mo.scaled("avg_sentiment", digits["avg_sentiment"])
    x = F.when(y.isNotNull(), F.col("_key")).cast(mo.SUM)
    sums = {"xx": x * x, "x": x, "xy": x * y, "yy": y * y}
    for c, _ in MEANS:
        value = mo.scaled(c, digits[c])
        sums |= {f"n_{c}": F.when(value.isNotNull(), 1), f"s_{c}": value}
    found = mo.window_sums(data, "_key", windows, sums, pb, chunk_rows)
    out = data.join(found, [*pb, "_key"], "left")
    for w in windows:
        def s(name, w=w):
            return F.col(f"w{w}.{name}")

        n, total, d = s("n_avg_sentiment"), s("s_avg_sentiment"), digits["avg_sentiment"]
        out = out.withColumns({
            **{f"{name}_{w}d": mo.mean(s(f"n_{c}"), s(f"s_{c}"), digits[c]) for c, name in MEANS},
            f"sentiment_std_{w}d": mo.sample_std(n, total, s("yy"), d),
            f"sentiment_trend_{w}d": F.when(n == w, mo.slope(n, s("x"), s("xx"), total, s("xy"), F.col("_key"), d)),
        }).drop(f"w{w}")
    # the row before, across chunks: a halo of one row
    chunks = series.chunked(materialize(out), order_col, lookback=1, chunk_rows=chunk_rows, partition_by=pb)
    out = chunks.withColumns(_momentum(windows, series.chunk_window(pb))).drop("_key")
    return series.unchunk(out, keep_pos="_pos" in daily.columns)

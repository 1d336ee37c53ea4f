"""Market series: window indicators (W5-W9, F5), the date-range source filter (S8) and
left joins of the market columns onto the daily table (J3, J4).

The market table is long, ``(symbol, Date, Close)``, so all symbols share one window
pass partitioned by ``symbol``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import null_as_zero_flag
from . import series
from .partitioning import materialize


def select_range(market: DataFrame, start: Column, end: Column, pad_days: int = 30) -> DataFrame:
    """S8 re-aimed: market rows with ``start <= Date < end + pad_days``."""
    return market.where((F.col("Date") >= start) & (F.col("Date") < F.date_add(end, pad_days)))


def market_range_for(daily: DataFrame, market: DataFrame, pad_days: int = 30) -> DataFrame:
    """Market rows over the daily table's date range plus ``pad_days`` (a scalar subquery)."""
    span = daily.agg(F.struct(F.min("Date").alias("start"), F.max("Date").alias("end"))).scalar()
    return select_range(market, span.getField("start"), span.getField("end"), pad_days)


def indicators(market: DataFrame, order_col: str = "Date",
               partition_by: Sequence[str] = ("symbol",),
               chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """Per symbol: daily_return (W5), volatility_5d (W6), sma_20 (W7), rsi (W9),
    market_trend (W8) and high_fear (F5, ``Close > 20``).

    Frame guards reproduce minimum-row rules: volatility needs 5 returns, sma_20 needs
    20 closes, rsi needs 14 rows. Each symbol's series is numbered once, prices are
    padded forward with the two-pass chunk carry, and the windows run in position
    chunks with a 20-row halo (``operators.series``), so no task holds a whole series.
    """
    pb = list(partition_by or [])
    numbered = series.with_positions(market.withColumn("_padded", F.col("Close")), order_col,
                                     partition_by=pb)
    # written once: the chunking and every window pass read the padded series
    padded = materialize(series.forward_fill(numbered, ["_padded"], order_col, chunk_rows, pb))
    df = series.chunked(padded, order_col, lookback=20, chunk_rows=chunk_rows, partition_by=pb)
    base = series.chunk_window(pb)
    w5, w20, w14 = base.rowsBetween(-4, 0), base.rowsBetween(-19, 0), base.rowsBetween(-13, 0)
    df = df.withColumn("daily_return", F.try_divide(F.col("_padded"), F.lag("_padded", 1).over(base)) - 1)
    delta = F.col("Close") - F.lag("Close", 1).over(base)
    df = df.withColumns({
        "_gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "_loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
    })
    ag = F.when(F.count(F.lit(1)).over(w14) == 14, F.avg("_gain").over(w14))
    al = F.when(F.count(F.lit(1)).over(w14) == 14, F.avg("_loss").over(w14))
    df = df.withColumns({
        "volatility_5d": F.when(F.count("daily_return").over(w5) == 5,
                                F.stddev_samp("daily_return").over(w5) * math.sqrt(252)),
        "sma_20": F.when(F.count("Close").over(w20) == 20, F.avg("Close").over(w20)),
        "_ag": ag, "_al": al,
    })
    df = df.withColumns({
        "rsi": F.when(F.col("_al") > 0, 100 - 100 / (1 + F.col("_ag") / F.col("_al")))
                .when(F.col("_ag") > 0, F.lit(100.0)),
        "market_trend": null_as_zero_flag(F.col("Close") > F.col("sma_20")),
        "high_fear": null_as_zero_flag(F.col("Close") > 20),
    })
    return series.unchunk(df).drop("_gain", "_loss", "_ag", "_al", "_padded")


def wide(ind: DataFrame, main_symbol: str = "SPY", fear_symbol: str | None = "^VIX") -> DataFrame:
    """One row per date with the main series' columns (J3) and, when given, the fear
    series' columns (J4): a conditional aggregate over the long indicator table."""
    def pick(sym, c):
        return F.max(F.when(F.col("symbol") == sym, F.col(c)))
    aggs = [pick(main_symbol, "daily_return").alias("daily_return"),
            pick(main_symbol, "volatility_5d").alias("volatility_5d"),
            pick(main_symbol, "market_trend").alias("market_trend")]
    if fear_symbol is not None:
        aggs += [pick(fear_symbol, "Close").alias("VIX"),
                 pick(fear_symbol, "daily_return").alias("vix_change"),
                 pick(fear_symbol, "high_fear").alias("high_fear")]
    return ind.groupBy("Date").agg(*aggs)

"""Forward targets (W10, W11, F6, F7) and the market merge that feeds them.

Targets look forward along the daily series: ``lead`` for the next row and a
``rowsBetween(1, 3)`` frame for the next three rows. A single series is cut into
position chunks whose halo holds the next 3 rows (``operators.series``); panels are
partitioned by ``partition_by``. As in the reference, a target that is unknown (last
rows) gives a 0 flag; ``null_unknown=True`` keeps those flags null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions import null_as_zero_flag
from . import market as mk
from . import series

LOOKAHEAD = 3


def _flag(cond: Column, null_unknown: bool) -> Column:
    return cond.cast("int") if null_unknown else null_as_zero_flag(cond)


def _prepare(df: DataFrame, order_col: str, partition_by: Sequence[str] | None,
             chunk_rows: int) -> tuple[DataFrame, WindowSpec]:
    pb = list(partition_by or [])
    return (series.chunked(df, order_col, lookahead=LOOKAHEAD, chunk_rows=chunk_rows, partition_by=pb),
            series.chunk_window(pb))


def _finish(df: DataFrame, partition_by: Sequence[str] | None, keep_pos: bool = False) -> DataFrame:
    return series.unchunk(df, keep_pos)


def forward_mean_3(col: str, base: WindowSpec, scale: int | None = None) -> Column:
    """Mean of the next three rows along ``base``, null unless all three are known.

    With ``scale`` (values carrying at most that many decimals) the sum is exact.
    """
    fw = base.rowsBetween(1, LOOKAHEAD)
    if scale is None:
        mean = F.avg(col).over(fw)
    else:
        mean = F.sum(F.col(col).cast(f"decimal(24,{scale})")).over(fw).cast("double") / F.lit(LOOKAHEAD)
    return F.when(F.count(col).over(fw) == LOOKAHEAD, mean)


def fallback_targets(daily: DataFrame, order_col: str = "Date",
                     partition_by: Sequence[str] | None = None,
                     null_unknown: bool = False, chunk_rows: int = series.CHUNK_ROWS,
                     scale: int | None = None) -> DataFrame:
    """targets from future sentiment when there is no market data."""
    data, base = _prepare(daily, order_col, partition_by, chunk_rows)
    out = data.withColumns({
        "next_day_sentiment": F.lead("avg_sentiment", 1).over(base),
        "next_3day_sentiment": forward_mean_3("avg_sentiment", base, scale),
    })
    out = out.withColumns({
        "next_day_positive": _flag(F.col("next_day_sentiment") > 0, null_unknown),
        "next_3day_positive": _flag(F.col("next_3day_sentiment") > 0, null_unknown),
    })
    return _finish(out, partition_by, "_pos" in daily.columns).select(
        *daily.columns, "next_day_sentiment", "next_day_positive",
        "next_3day_sentiment", "next_3day_positive")


def market_targets(daily: DataFrame, ind: DataFrame, main_symbol: str = "SPY",
                   fear_symbol: str | None = "^VIX", order_col: str = "Date",
                   null_unknown: bool = False, chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """F6 with J3/J4: left-join the main series (and the fear series when present) on
    the calendar date, then build next-day and next-3-day return targets.

    The indicator table is pivoted to one row per date first (``market.wide``), so the
    market source is read once and joined once. Both sides are daily-grain; Spark picks
    the join strategy (AQE turns it into a broadcast at run time when it is small).
    """
    wide = mk.wide(ind, main_symbol, fear_symbol).withColumnRenamed("Date", "_market_day")
    # the market is daily: rows of a finer grain meet it on their calendar date
    merged = daily.join(wide, F.to_date(order_col) == F.col("_market_day"), "left").drop("_market_day")
    data, base = _prepare(merged, order_col, None, chunk_rows)
    data = data.withColumns({
        "next_day_return": F.lead("daily_return", 1).over(base),
        "next_3day_return": forward_mean_3("daily_return", base),
    })
    data = data.withColumns({
        "next_day_positive": _flag(F.col("next_day_return") > 0, null_unknown),
        "next_day_big_move": _flag(F.abs(F.col("next_day_return")) > 0.01, null_unknown),
        "next_3day_positive": _flag(F.col("next_3day_return") > 0, null_unknown),
    })
    cols = [*daily.columns, "daily_return", "volatility_5d", "market_trend",
            "next_day_return", "next_day_positive", "next_day_big_move",
            "next_3day_return", "next_3day_positive"]
    if fear_symbol is not None:
        cols += ["VIX", "vix_change", "high_fear"]
    return _finish(data, None, "_pos" in daily.columns).select(*cols)

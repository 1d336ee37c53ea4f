"""The feature flow as one lazy DataFrame plan.

scored rows -> daily statistics + keyword features (one groupBy) -> rolling windows ->
regime flags -> whole-frame fill -> targets (market or fallback) -> feature matrix.

Only the first step touches row-level data; everything after it is daily-grain (one row
per day, or per day and entity with ``partition_by``), so the windows and the one-row
threshold joins stay small however many headlines there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import KEYWORDS
from ..operators import daily as dl
from ..operators import market as mk
from ..operators import targets as tg
from ..operators.features import feature_matrix, feature_names
from ..operators import series
from ..operators.partitioning import materialize
from ..operators.regimes import FLAG_COLUMNS, regime_flags
from ..operators.rolling import DEFAULT_WINDOWS, rolling_feature_names, rolling_features


def daily_feature_table(scored: DataFrame, time_col: str = "Time", grain: str = "day",
                        keywords: dict[str, list[str]] | None = None, match: str = "substring",
                        windows: Sequence[int] = DEFAULT_WINDOWS,
                        keep_positions: bool = False, scale: int | None = None) -> DataFrame:
    """Steps 2-5: ``Date``, 15 aggregates, 28 rolling columns, 6 flags, 24 keyword columns.

    The keyword aggregates ride in the same ``groupBy`` as the statistics, which replaces
    the per-date lookup loop and the later merge (J1, J2); the whole-frame fill that the
    merge performed is applied at the same point in the flow. The daily aggregate (one
    row per day) is checkpointed and numbered once (``_pos``); the rolling windows, the
    targets and the forward fill reuse that numbering (``keep_positions`` keeps it).
    """
    keywords = KEYWORDS if keywords is None else keywords
    daily = dl.daily_features(scored, time_col, grain, keywords, match, scale)
    daily = materialize(series.with_positions(daily))
    daily = rolling_features(daily, windows, scale=scale)
    daily = regime_flags(daily)
    cols = (["Date"] + dl.DAILY_STAT_COLUMNS + rolling_feature_names(windows) + FLAG_COLUMNS
            + dl.keyword_columns(keywords) + (["_pos"] if keep_positions else []))
    return daily.select(*cols).fillna(0, subset=[c for c in cols if c not in ("Date", "_pos")])


def with_targets(daily: DataFrame, market: DataFrame | None = None,
                 main_symbol: str = "SPY", fear_symbol: str | None = "^VIX",
                 null_unknown: bool = False, scale: int | None = None) -> DataFrame:
    """Step 6: market targets when the main series is available, else fallback targets.

    ``market`` is a long ``(symbol, Date, Close)`` table; only the two symbols are read, cut
    to the daily date range plus 30 days before indicators are computed (S8). Without rows
    of the main symbol the fallback targets are used; without rows of the fear symbol its
    columns are left out.
    """
    if market is not None:
        # written once, a row per symbol and day: the symbols and the indicators are found in it
        market = materialize(mk.market_range_for(
            daily, market.where(F.col("symbol").isin(main_symbol, fear_symbol or main_symbol))))
        found = {r["symbol"] for r in market.select("symbol").distinct().collect()}  # two at most
    if market is None or main_symbol not in found:
        return tg.fallback_targets(daily, null_unknown=null_unknown, scale=scale)
    return tg.market_targets(daily, mk.indicators(market), main_symbol, fear_symbol if fear_symbol in found else None,
                             null_unknown=null_unknown)


def build_features(scored: DataFrame, market: DataFrame | None = None,
                   assemble: bool = False, **kwargs) -> DataFrame:
    """Steps 2-7: the filled feature table with keys and targets. Only the market columns can
    hold gaps: ``daily_feature_table`` has filled its own."""
    daily = daily_feature_table(scored, keep_positions=True, **kwargs)
    targets = with_targets(daily, market, scale=kwargs.get("scale"))
    gaps = [c for c in feature_names(targets) if c not in daily.columns]
    table = feature_matrix(targets, assemble=assemble, gaps=gaps)
    return table.drop("_pos")

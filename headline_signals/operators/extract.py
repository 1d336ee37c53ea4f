"""Headline rows from extracted table rows.

Input is the long table produced by ``sources.html.html_tables``: one row per table
row, ``(page_id, table_idx, row_idx, cells)``. Picking tables is a filter, reshaping
is a projection and combining tables is part of the same scan (no union of frames).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import complete_time, parse_time
from ..functions.labels import PLACEHOLDER
from .indexing import global_index


def pick_tables(tables: DataFrame, indexes: Sequence[int] = (3, 4),
                n_cells: int | None = 3) -> DataFrame:
    """Rows of the tables at ``indexes`` (in page order) with a ``shape_ok`` flag
    (``n_cells`` cells); a missing index simply yields no rows."""
    out = tables.where(F.col("table_idx").isin(list(indexes)))
    ok = F.lit(True) if n_cells is None else (F.size("cells") == n_cells)
    return out.withColumn("shape_ok", ok)


def drop_placeholders(df: DataFrame, col: str = "Headline") -> DataFrame:
    """Drop rows whose headline is the loading placeholder (null headlines stay)."""
    return df.where(~F.col(col).eqNullSafe(PLACEHOLDER))


def headline_rows(tables: DataFrame, as_of: _dt.date | str, indexes: Sequence[int] = (3, 4)) -> DataFrame:
    """P1 + P2 + D1 over picked tables: ``(page_id, table_idx, row_idx, Time, Headline)``.

    Three-cell rows become (unused, Time, Headline); rows of any other shape are kept
    out (flagged by ``pick_tables``), the placeholder is dropped and times completed.
    """
    rows = pick_tables(tables, indexes).where("shape_ok")
    rows = rows.select("page_id", "table_idx", "row_idx",
                       F.element_at("cells", 2).alias("Time"),
                       F.element_at("cells", 3).alias("Headline"))
    rows = drop_placeholders(rows)
    return rows.withColumn("Time", complete_time("Time", as_of))


def complete_feed(feed: DataFrame, as_of: _dt.date | str, time_col: str = "Time") -> DataFrame:
    """P2 + D1 on feed rows that are already ``(…, Time, Headline)``."""
    return drop_placeholders(feed).withColumn(time_col, complete_time(time_col, as_of))


def newest_rank(df: DataFrame, time_col: str = "Time", tie_col: str = "seq", out_col: str = "place") -> DataFrame:
    """O2 as a column: the 1-based place of each row in ``newest_first`` order, without one task
    for all rows (``indexing.global_index``). ``tie_col`` must be below 10**12."""
    at = F.timestamp_diff("MICROSECOND", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), parse_time(time_col))
    key = -F.coalesce(at, F.lit(-1)).cast("decimal(26,0)") * F.lit(10 ** 12).cast("decimal(13,0)") + F.col(tie_col)
    return global_index(df.withColumn("_newest", key.cast("decimal(38,0)")), "_newest", out_col).drop("_newest")


def newest_first(df: DataFrame, time_col: str = "Time", tie_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """O2: sort on the parsed time, newest first, unparseable times last; ``tie_cols`` (those of them
    that ``df`` has) order rows of one time, lowest first."""
    ties = [c for c in tie_cols if c in df.columns]
    return df.orderBy(parse_time(time_col).desc_nulls_last(), *ties)

"""Feature matrix (P8, W12, F8) and time-ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import series

# Columns never used as features (targets, keys, same-day market return).
EXCLUDED_COLUMNS = [
    "Date", "next_day_return", "next_day_positive", "next_day_big_move",
    "next_3day_return", "next_3day_positive", "next_day_sentiment", "next_3day_sentiment",
    "daily_return", "Date_y",
]
TARGET_COLUMNS = ["next_day_positive", "next_3day_positive"]


def feature_names(df: DataFrame, extra_excluded: Sequence[str] = ()) -> list[str]:
    """Every column except the excluded list and ``Unnamed*`` columns."""
    skip = set(EXCLUDED_COLUMNS) | set(extra_excluded)
    return [c for c in df.columns
            if c not in skip and not c.startswith("Unnamed") and not c.startswith("_")]


def fill_features(df: DataFrame, features: Sequence[str], order_col: str = "Date",
                  partition_by: Sequence[str] | None = None,
                  chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """Pad each feature forward along the series, then replace what is left by 0."""
    padded = series.forward_fill(df, list(features), order_col, chunk_rows,
                                 list(partition_by or []))  # keeps _pos if given
    return padded.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in features}).select(*df.columns)


def feature_matrix(df: DataFrame, order_col: str = "Date",
                   extra_excluded: Sequence[str] = (), assemble: bool = False,
                   gaps: Sequence[str] | None = None) -> DataFrame:
    """F8: the filled feature columns (plus keys and targets), optionally assembled
    into a ``features`` vector for Spark ML. ``gaps``: the features that can be null, if the
    caller knows them; the others are not read for filling."""
    names = feature_names(df, extra_excluded)
    to_fill = names if gaps is None else list(gaps)
    out = fill_features(df, to_fill, order_col) if to_fill else df
    if assemble:
        from pyspark.ml.feature import VectorAssembler
        out = VectorAssembler(inputCols=names, outputCol="features").transform(out)
    return out


def with_position(df: DataFrame, order_col: str = "Date") -> DataFrame:
    """Row position from 0 along the series (``series.with_positions``: bucketed global
    numbering, no single-task window)."""
    return series.with_positions(df, order_col, "row_idx").withColumn("row_idx", F.col("row_idx").cast("int"))


def fold_rule(n: Column) -> Column:
    """Number of folds the reference uses for ``n`` rows: none below 5, 3 below 10,
    else ``min(3, n // 5)``."""
    return F.when(n < 5, 0).when(n < 10, 3).otherwise(F.least(F.lit(3), (n / 5).cast("int")))


def time_folds(df: DataFrame, k: int | None = None, order_col: str = "Date") -> DataFrame:
    """Expanding time folds as rows ``(fold, role, row_idx, <order_col>)``.

    With ``n`` rows and ``s = n // (k + 1)``, fold ``i`` (from 0) tests rows
    ``[n - (k - i) s, n - (k - i - 1) s)`` and trains on every earlier row. ``k=None``
    applies the reference's rule (``fold_rule``) to ``n`` inside the plan (``n`` is a
    scalar subquery).
    """
    pos = with_position(df, order_col).withColumn("_n", series.count_all(df))
    if k is None:
        k_col = fold_rule(F.col("_n"))
    else:
        k_col = F.lit(int(k))
    x = pos.withColumn("_k", k_col).withColumn("_s", (F.col("_n") / (F.col("_k") + 1)).cast("int"))
    x = x.withColumn("fold", F.explode(F.when(F.col("_k") > 0, F.sequence(F.lit(0), F.col("_k") - 1))
                                       .otherwise(F.array().cast("array<int>"))))
    test_start = F.col("_n") - (F.col("_k") - F.col("fold")) * F.col("_s")
    role = (F.when(F.col("row_idx") < test_start, F.lit("train"))
            .when(F.col("row_idx") < test_start + F.col("_s"), F.lit("test")))
    return (x.withColumn("role", role).where(F.col("role").isNotNull())
            .select(F.col("fold").cast("int").alias("fold"), "role", "row_idx", order_col))


def ordered_split(df: DataFrame, order_col: str = "Date", fraction: float = 0.7,
                  minimum: int = 3) -> DataFrame:
    """First ``max(minimum, int(fraction * n))`` rows are ``train``, the rest ``test``."""
    pos = with_position(df, order_col).withColumn("_n", series.count_all(df))
    cut = F.greatest(F.lit(minimum), (F.col("_n") * fraction).cast("int"))
    return pos.withColumn("role", F.when(F.col("row_idx") < cut, "train").otherwise("test")).drop("_n")

"""Evaluation metrics as aggregates.

Classification metrics come from the confusion counts, a table of at most
``classes x classes`` rows built by one partial-aggregated ``groupBy``; everything
after it is tiny. Zero denominators give 0, as in the usual report conventions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows ``(label, prediction, n)``."""
    return (df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    cm = confusion(df, label, prediction)
    as_true = cm.select(F.col("label").alias("cls"), F.col("n").alias("t"), F.lit(0).alias("p"),
                        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"))
    as_pred = cm.select(F.col("prediction").alias("cls"), F.lit(0).alias("t"), F.col("n").alias("p"),
                        F.lit(0).alias("tp"))
    per = (as_true.unionByName(as_pred).groupBy("cls")
           .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp")))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    per = per.withColumns({"precision": prec, "recall": rec})
    per = per.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))
    return per


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class ``precision, recall, f1, support`` over the classes seen in either
    column."""
    return _per_class(df, label, prediction).select(
        "cls", "precision", "recall", "f1", F.col("support").cast("bigint"))


def classification_metrics(df: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """One row of accuracy and support-weighted precision, recall and F1, plus the
    macro averages (A14's summary lines)."""
    rep = _per_class(df, label, prediction)
    total = F.sum("support")
    return rep.agg(
        _safe_div(F.sum("tp"), total).alias("accuracy"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), total).alias("precision"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), total).alias("recall"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), total).alias("f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        total.cast("bigint").alias("support"),
    )


def fold_summary(scores: DataFrame, group_cols=("target", "model"), score_col: str = "score") -> DataFrame:
    """Mean and population std of fold scores per group."""
    return scores.groupBy(*group_cols).agg(F.avg(score_col).alias("mean_score"),
                                           F.stddev_pop(score_col).alias("std_score"),
                                           F.count(score_col).alias("n_folds"))


def r2_score(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``1 - sum((y - p)^2) / sum((y - mean y)^2)``; the mean is a scalar subquery."""
    mean = df.agg(F.avg(label)).scalar()
    return df.agg((F.lit(1.0) - F.sum((F.col(label) - F.col(prediction)) ** 2)
                   / F.sum((F.col(label) - mean) ** 2)).alias("r2"))

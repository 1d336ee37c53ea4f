"""Least squares over expanding folds from Gram matrices.

The rows of a series are cut where folds begin. One pass adds up a small matrix of products of
(1, features, target) for every piece; the training matrix of a fold is the sum of the pieces
before it, and what the fold is scored on is the matrix of the piece itself. So all folds, their
scores and the final fit on all rows come from that pass, and no row is read again per fold.

Columns are shifted by their means before multiplying, and the normal equations are solved on
the scale of the columns' spreads; columns that others determine get the least-norm solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, functions as F

from ..operators import features as ft

#: Directions of the scaled features with less than this share of the largest spread are not used.
RANK = 1e-10


@dataclass(frozen=True)
class LinearFit:
    """A fitted line: intercept and one coefficient a feature."""

    intercept: float
    coefficients: DenseVector

    def predict(self, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
        value = F.lit(self.intercept)
        for c, b in zip(features, self.coefficients.toArray().tolist()):
            value = value + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(b)
        return df.withColumn(out, value)


@dataclass(frozen=True)
class FoldGrams:
    """Matrices of products of (1, features - shift, target - shift) per piece, oldest first."""

    pieces: np.ndarray
    shift: np.ndarray
    starts: list[int]
    size: int

    def only(self, features: Sequence[int]) -> FoldGrams:
        """The matrices of a part of the features, by place: models on fewer features need no pass of their own."""
        rows = [0, *[1 + i for i in features], self.pieces.shape[1] - 1]
        return FoldGrams(self.pieces[:, rows][:, :, rows], self.shift[[*features, -1]], self.starts, self.size)

    def fit(self, upto: int | None = None) -> LinearFit:
        """The fit to the first ``upto`` pieces (None: to all)."""
        return _solve(self.pieces[:upto].sum(axis=0), self.shift)

    def r2(self, fit: LinearFit, piece: int) -> float:
        """R squared of ``fit`` on one piece; of a constant target 1 if met exactly, else 0."""
        g = self.pieces[piece]
        b = fit.coefficients.toArray()
        line = np.concatenate([[self.shift[-1] - fit.intercept - b @ self.shift[:-1]], -b, [1.0]])
        error, spread = line @ g @ line, g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
        if spread <= 1e-14 * max(g[-1, -1], 1e-300):
            return 1.0 if error <= 1e-14 * max(g[-1, -1], 1e-300) else 0.0
        return float(1 - error / spread)


def _solve(g: np.ndarray, shift: np.ndarray) -> LinearFit:
    n = g[0, 0]
    mean = g[0, 1:] / n
    about = g[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(about)[:-1], 0))
    used = spread > 1e-12 * np.sqrt(np.maximum(np.diag(g)[1:-1], 1e-300))
    b = np.zeros(len(spread))
    if used.any():
        scaled = about[:-1, :-1][np.ix_(used, used)] / np.outer(spread[used], spread[used])
        values, axes = np.linalg.eigh(scaled)
        keep = values > RANK * values[-1]
        right = about[:-1, -1][used] / spread[used]
        b[used] = axes[:, keep] @ ((axes[:, keep].T @ right) / values[keep]) / spread[used]
    means = mean + shift
    return LinearFit(float(means[-1] - b @ means[:-1]), Vectors.dense(b))


def fold_grams(table: DataFrame, target: str, features: Sequence[str], order_col: str = "Date",
               k: int | None = None, min_rows: int = 5) -> FoldGrams | None:
    """The matrices of ``k`` expanding folds (None: the reference's number) over the rows whose target is
    known, in ``order_col`` order; None where there are too few rows. Missing features count as 0."""
    columns = [*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features], F.col(target).cast("double")]
    data = ft.with_position(table.where(F.col(target).isNotNull()), order_col).select(
        "row_idx", F.array(*columns).alias("x"))
    size = len(columns)
    first = data.agg(F.count(F.lit(1)).alias("n"), ft.fold_rule(F.count(F.lit(1))).alias("k"),
                     F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(size)]).alias("means")).first()
    n, k = first["n"], first["k"] if k is None else k
    if n < min_rows or not k or n < k + 1:
        return None
    s = n // (k + 1)
    starts = [n - (k - i) * s for i in range(k)]
    shift = np.array(first["means"], float)

    def products(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, size + 1, size + 1))
        for batch in stream:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - shift
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            piece = np.searchsorted(starts, batch.column("row_idx").to_numpy(zero_copy_only=False), "right")
            for p in np.unique(piece):
                total[p] += x[piece == p].T @ x[piece == p]
        p, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(i), pa.array(j), pa.array(total[p, i, j])],
                                         names=["p", "i", "j", "v"])

    pieces = np.zeros((k + 1, size + 1, size + 1))
    # (k + 1) (features + 2)^2 sums, however many rows
    for r in data.mapInArrow(products, "p bigint, i bigint, j bigint, v double").groupBy("p", "i", "j").agg(
            F.sum("v").alias("v")).collect():
        pieces[r["p"], r["i"], r["j"]] = r["v"]
    return FoldGrams(pieces, shift, starts, s)


def fold_scores(grams: FoldGrams | None, target: str, name: str) -> list[tuple]:
    """Rows (target, model, fold, R squared, fold_ok, n_train, n_test) of all folds."""
    if grams is None:
        return []
    return [(target, name, i, grams.r2(grams.fit(i + 1), i + 1), 1, start, int(round(grams.pieces[i + 1][0, 0])))
            for i, start in enumerate(grams.starts)]

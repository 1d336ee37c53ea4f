"""Whitening of embedding vectors by Jacobi-Davidson.

The covariance matrix is never formed. A distributed product takes a narrow block of
columns ``X`` to ``V X``: every task centres its part of the fit list, multiplies it by
``X`` and back, and sends one small matrix; only those are added up. All that the driver
holds is a basis of a few times the wanted number of vectors.

Wanted eigenpairs are improved together. The Rayleigh-Ritz step takes the best pairs from
the basis; pairs whose residual has reached double precision are locked; for every other
pair the correction equation, projected off all current Ritz vectors, is solved by a few
MINRES steps, all pairs in lockstep, so that one pass over the data serves every pair. The
corrections extend the basis until all pairs are locked.

Vectors are integers (``floor(64 c)``), so sums and means are exact: an integer close to the
mean is subtracted before the fraction that is left, and centred entries are correct to
the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this (as 64 c) count as this: larger doubles have gaps between integers.
LARGEST = float(1 << 53)
#: A residual below this share of the largest eigenvalue is double precision.
TOLERANCE = 2.0 ** -46
#: A component below this share of the trace has no variance to scale by.
NO_VARIANCE = 1e-13
#: MINRES steps a correction; each is one pass over the fit list.
INNER_STEPS = 4
#: The basis is cut back to twice the wanted pairs beyond so many times their number.
BASIS = 6
#: Rows of the fit list in one packed block.
BLOCK_ROWS = 4096
#: Partial results up to so many are added by the driver; more are first added in groups.
DIRECT_PARTIALS = 256
_OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_vector(vector: Column) -> Column:
    """``floor(64 c)`` of every entry, without the offset, as array<bigint>."""
    def entry(c):
        return F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST)))

    return F.transform(vector, entry)


def _usable(vector: Column) -> Column:
    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & (F.size(vector) > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pack(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = _matrix(batch.column(0), width)
            for i in range(0, len(x), BLOCK_ROWS):
                part = x[i:i + BLOCK_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int64()), pa.array([part.astype("<i8").tobytes()], pa.binary())],
                    names=["rows", "packed"])

    return run


def _blocks(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in stream:
        for packed in batch.column("packed"):
            yield np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, width)


@dataclass
class FitList:
    """The distinct integer vectors as packed blocks, their number and exact sums."""

    blocks: DataFrame
    width: int
    n: int
    sums: list[int]

    @property
    def near(self) -> np.ndarray:
        """The integer next to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the mean has beyond ``near``."""
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.near)])

    def add_up(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all blocks of ``part`` of the centred block; one pass over the fit list."""
        near, rest, width = self.near, self.rest, self.width

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for x in _blocks(stream, width):
                total += part((x - near) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        partials = self.blocks.select("packed").mapInArrow(run, "total binary")
        tasks = partials.rdd.getNumPartitions()
        if tasks > DIRECT_PARTIALS:
            def combine(table: pa.Table) -> pa.Table:
                total = np.zeros(shape)
                for t in table.column("total").to_pylist():
                    total += np.frombuffer(t).reshape(shape)
                return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

            groups = math.isqrt(tasks)
            partials = (partials.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(groups)))
                        .groupBy("at").applyInArrow(combine, "total binary"))
        parts = sorted(r["total"] for r in partials.collect())
        return np.sum([np.frombuffer(p).reshape(shape) for p in parts], axis=0) if parts else np.zeros(shape)

    def product(self, x: np.ndarray) -> np.ndarray:
        """The covariance matrix times ``x``, without the matrix."""
        return self.add_up(lambda c: c.T @ (c @ x), x.shape) / self.n

    def trace(self) -> float:
        return float(self.add_up(lambda c: (c * c).sum(axis=0)[:, None], (self.width, 1)).sum() / self.n)


def fit_list(vectors: DataFrame, width: int) -> FitList:
    """The distinct rows of the array<bigint> column ``x`` of ``vectors``, each once."""
    blocks = written(vectors.select("x").distinct().mapInArrow(_pack(width), "rows bigint, packed binary"))

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for x in _blocks(stream, width):
            n += len(x)
            # 1,000 rows of 2**53 still fit into 63 bits
            for i in range(0, len(x), 1000):
                total = [a + int(b) for a, b in zip(total, x[i:i + 1000].sum(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["dim", "n", "s"])

    rows = (blocks.select("packed").mapInArrow(sums, "dim int, n bigint, s decimal(38,0)")
            .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect())
    return FitList(blocks, width, rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows])


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system per column of ``b``, all in lockstep."""
    k = b.shape[1]
    x, v_old, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    v, eta = b / np.where(beta, beta, 1), beta.copy()
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        after = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(after, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_new)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        rho = np.where(rho, rho, 1)
        c_old, c, s_old, s = c, delta / rho, s, beta_new / rho
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / rho
        x += c * eta * w
        eta = -s * eta
        v_old, v, beta = v, after / np.where(beta_new, beta_new, 1), beta_new
    return x


def _orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``x`` add to those of ``against``."""
    norms = np.linalg.norm(x, axis=0)
    x = x[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        x = x - against @ (against.T @ x)
        u, size, _ = np.linalg.svd(x, full_matrices=False)
        x = u[:, size > 1e-10]
    return x


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int,
                    inner: int = INNER_STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    ``apply`` multiplies a block of columns by a symmetric positive matrix. Ends when every
    residual is below ``tolerance`` times the largest eigenvalue, or when the basis has become
    the whole space, where the Rayleigh-Ritz step itself is exact to rounding.
    """
    wanted = min(wanted, width)
    start = np.random.default_rng(13).standard_normal((width, wanted))
    basis = _orthonormal(start, np.zeros((width, 0)))
    image = apply(basis)
    while True:
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        theta, ritz = values[:wanted], basis @ turn[:, :wanted]
        residual = image @ turn[:, :wanted] - ritz * theta
        open_ = np.linalg.norm(residual, axis=0) > tolerance * max(theta[0], 0.0)
        if not open_.any() or basis.shape[1] == width:
            return theta, ritz / np.linalg.norm(ritz, axis=0)

        def off(x):
            return x - ritz @ (ritz.T @ x)

        shift = theta[open_]
        correction = minres(lambda t: off(apply(off(t)) - off(t) * shift), -off(residual[:, open_]), inner)
        if basis.shape[1] + correction.shape[1] > max(BASIS * wanted, 3 * wanted):
            keep = turn[:, :2 * wanted]
            basis, image = basis @ keep, image @ keep
        more = _orthonormal(correction, basis)
        if not more.shape[1]:  # only rounding is left to correct
            return theta, ritz / np.linalg.norm(ritz, axis=0)
        basis = np.concatenate([basis, more], axis=1)
        image = np.concatenate([image, apply(more)], axis=1)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component (from 1): id, ``component``, ``n`` (size of the fit list),
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty or holds a null, a NaN or an infinity are dropped, as are
    vectors that do not have the most frequent length (of equally frequent ones, the longest).
    Entries beyond 2**53 in size count as that. Repeated vectors are one in the fit list and
    every row in the result; null ids pass through. Components whose eigenvalue is zero (fewer
    distinct vectors than components, constant dimensions) are not returned, so a table with one
    distinct vector gives an empty result, and so does an empty table. Components of equal
    eigenvalue are some orthonormal basis of their space, the same for all rows. ``deviation``
    is null where it exceeds a long. Other columns are ignored, whatever their names.
    """
    vector = F.col(f"`{vector_col}`")
    id_type = vectors.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v")).where(_usable(F.col("v")))
    rows = rows.select("id", integer_vector(F.col("v")).alias("x"))
    first = (rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.desc("width")).first())
    name = fresh(id_col, ["component", "n", "deviation", "whitened", "explained", "identity_error"])
    schema = f"`{name}` {id_type}, {_OUT}"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = first["width"]
    rows = rows.where(F.size("x") == width)
    fit = fit_list(rows, width)
    theta, axes = jacobi_davidson(fit.product, width, components)
    trace = fit.trace()
    real = theta > NO_VARIANCE * trace
    theta, axes = theta[real], axes[:, real]
    k = len(theta)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    scaled = axes / np.sqrt(theta)
    moments = fit.add_up(lambda c: np.concatenate([(c @ scaled).T @ (c @ scaled), (c @ scaled).sum(axis=0)[None]]),
                         (k + 1, k)) / fit.n
    identity_error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    near, rest, n, sums = fit.near, fit.rest, fit.n, fit.sums
    left = np.array([s - n * int(m) for s, m in zip(sums, near)], np.int64)
    explained = theta / trace

    def deviations(x: np.ndarray) -> list[int | None]:
        from_near = x - near
        largest = n * (int(np.abs(from_near).max()) + 1)
        if width * largest * largest < 1 << 63:
            return ((n * from_near - left) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, left)) for row in from_near]
        return [e if e < 1 << 63 else None for e in exact]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x = _matrix(batch.column("x"), width)
                m = len(x)
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     deviation, pa.array((((x - near) - rest) @ scaled).ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, identity_error))],
                    names=[name, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

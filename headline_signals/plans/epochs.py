"""Training a text classifier by epochs, the best of which is kept (L4).

A softmax classifier over hashed words is trained by mini-batches: in an epoch every task goes
through its rows in an order of its own, starting from the weights that the epoch before left,
and the tasks' weights are averaged by their rows. After each epoch the weighted F1 of the
validation rows is counted, and weights and score are published as a generation
(``sources.generations``). A run that is killed goes on after the last complete epoch, and the
model is the epoch with the best score (the earliest of equals).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keywords import tokens
from ..sources import generations as gn

FEATURES = 1 << 14
CLASSES = 3
BATCH_ROWS = 16
RATE, DECAY = 0.5, 1e-5
#: Weights of up to so many tasks are averaged by the driver; more are first added in groups.
DIRECT_TASKS = 64


def hashed(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(places array<int>, label int) of the rows whose label is known; null text has no words."""
    words = F.filter(tokens(F.lower(F.coalesce(F.col(text_col), F.lit("")))), lambda w: w != "")
    return df.where(F.col(label_col).isNotNull()).select(
        F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(FEATURES))).alias("places"),
        F.col(label_col).cast("int").alias("label"))


def _examples(batch: pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Distinct places and their weights (root of the counts, unit length) per row, and the labels."""
    rows = []
    for places in batch.column("places"):
        at, n = np.unique(np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64), return_counts=True)
        v = np.sqrt(n)
        rows.append((at, v / max(math.sqrt(float(n.sum())), 1.0)))
    return rows, batch.column("label").to_numpy(zero_copy_only=False)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _trained(weights: np.ndarray, epoch: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = weights.copy(), 0
        for batch in stream:
            rows, labels = _examples(batch)
            order = np.random.default_rng([epoch, seen]).permutation(len(rows))
            for i in range(0, len(order), BATCH_ROWS):
                gradient = np.zeros_like(w)
                part = order[i:i + BATCH_ROWS]
                for r in part:
                    at, v = rows[r]
                    error = _softmax(v @ w[at] + w[-1])
                    error[labels[r]] -= 1.0
                    gradient[at] += v[:, None] * error
                    gradient[-1] += error
                w -= RATE / math.sqrt(1 + epoch) * (gradient / len(part) * 4 + DECAY * w)
            seen += len(rows)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(w * seen).tobytes()], pa.binary())],
                                             names=["n", "w"])

    return run


def _epoch(train: DataFrame, weights: np.ndarray, epoch: int) -> np.ndarray:
    """The weights after one pass over ``train``."""
    parts = train.mapInArrow(_trained(weights, epoch), "n bigint, w binary")
    tasks = train.rdd.getNumPartitions()
    if tasks > DIRECT_TASKS:
        def combine(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(w) for w in table.column("w").to_pylist()], axis=0)
            return pa.table({"n": [sum(table.column("n").to_pylist())], "w": [total.tobytes()]})

        parts = (parts.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks))))
                 .groupBy("at").applyInArrow(combine, "n bigint, w binary"))
    rows = parts.collect()
    n = sum(r["n"] for r in rows)
    return np.sum([np.frombuffer(r["w"]) for r in rows], axis=0).reshape(weights.shape) / n if n else weights


@dataclass(frozen=True)
class EpochModel:
    """Weights of one epoch, its number (from 1) and its weighted F1 on the validation rows."""

    weights: np.ndarray
    epoch: int
    f1: float

    def predictions(self, data: DataFrame) -> DataFrame:
        """(label, prediction) of hashed rows."""
        weights = self.weights

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                rows, labels = _examples(batch)
                best = [int(np.argmax(v @ weights[at] + weights[-1])) for at, v in rows]
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(best, pa.int32())],
                                                 names=["label", "prediction"])

        return data.mapInArrow(run, "label int, prediction int")


def weighted_f1(pairs: DataFrame) -> float:
    """F1 per class weighted by its rows, from the counts of (label, prediction); 0 without rows."""
    counts = np.zeros((CLASSES, CLASSES))
    for r in pairs.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect():
        counts[r["label"], r["prediction"]] = r["n"]
    support, hit = counts.sum(axis=1), np.diag(counts)
    whole = support + counts.sum(axis=0)
    f1 = np.divide(2 * hit, whole, out=np.zeros(CLASSES), where=whole > 0)
    return float((f1 * support).sum() / support.sum()) if support.sum() else 0.0


def train_epochs(train: DataFrame, validation: DataFrame, root: str, text_col: str = "text", label_col: str = "label",
                 epochs: int = 3) -> tuple[EpochModel, DataFrame]:
    """The best epoch's model, and rows (epoch, f1, chosen) of all epochs. ``root`` is the shared folder of
    the run: epochs complete there are not trained again."""
    spark: SparkSession = train.sparkSession
    folder = f"{root.rstrip('/')}/rows"
    if not gn.generations(spark, f"{folder}-{FEATURES}"):
        # hashed once; every epoch reads the same partitions
        gn.publish_generation(spark, f"{folder}-{FEATURES}", [("train", hashed(train, text_col, label_col), "parquet"),
                                                              ("validation", hashed(validation, text_col, label_col), "parquet")])
    data = gn.current(spark, f"{folder}-{FEATURES}")
    rows, held = spark.read.parquet(data.path("train")), spark.read.parquet(data.path("validation"))
    done = gn.generations(spark, f"{root.rstrip('/')}/epochs")
    while len(done) < epochs:
        weights = _weights(spark, done[-1]) if done else np.zeros((FEATURES + 1, CLASSES))
        epoch = len(done) + 1
        model = EpochModel(_epoch(rows, weights, epoch), epoch, 0.0)
        f1 = weighted_f1(model.predictions(held))
        table = spark.createDataFrame([(bytearray(model.weights.tobytes()),)], "w binary")
        done.append(gn.publish_generation(spark, f"{root.rstrip('/')}/epochs", [("weights", table, "parquet")],
                                          notes={"epoch": str(epoch), "f1": repr(f1)}))
    scores = [(int(g.notes["epoch"]), float(g.notes["f1"])) for g in done]
    best = max(scores, key=lambda s: (s[1], -s[0]))
    report = spark.createDataFrame([(e, f1, e == best[0]) for e, f1 in scores], "epoch int, f1 double, chosen boolean")
    return EpochModel(_weights(spark, done[best[0] - 1]), *best), report


def _weights(spark: SparkSession, epoch: gn.Generation) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(epoch.path("weights")).first()["w"]).reshape(FEATURES + 1, CLASSES)

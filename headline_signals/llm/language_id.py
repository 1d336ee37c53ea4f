"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all training documents. The classifier itself is
fitted on a bounded sample of labelled rows (about ``SAMPLE_PER_LABEL`` of each label, by
hash of the id) with follow-the-regularised-leader and elastic-net penalties; a temperature
fitted on a part of the sample kept aside turns its outputs into probabilities. Weights are
a fixed ``FEATURES`` by labels table, small enough to travel with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_bucket, whole_row

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
#: Bound of the fitting sample: about so many rows of each label.
SAMPLE_PER_LABEL = 800
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
EPOCHS = 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"\s+")


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed character n-gram occurs in the whole lower-cased text."""
    points = np.frombuffer((" " + _GAPS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32)
    points = points.astype(np.uint64)
    counts = np.zeros(FEATURES, np.int64)
    code = np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if len(points) < order:
            break
        code = code[:len(points) - order + 1] * np.uint64(0x110000) + points[order - 1:]
        if order in ORDERS:
            place = ((code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
            counts += np.bincount(place.astype(np.int64), minlength=FEATURES)
    return counts


def tfidf(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[places]
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


def _document_frequencies(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(FEATURES, np.int64)
    for batch in stream:
        for text in batch.column(0).to_pylist():
            seen += ngram_counts(text or "") > 0
    places = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(seen[places])], names=["place", "n"])


def _sparse_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        found = [ngram_counts(t or "") for t in batch.column("text").to_pylist()]
        places = [np.flatnonzero(c) for c in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([p.tolist() for p in places], pa.list_(pa.int64())),
             pa.array([c[p].tolist() for c, p in zip(found, places)], pa.list_(pa.int64()))],
            names=["label", "places", "counts"])


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x labels
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tfidf(places, counts, self.idf) @ self.weights[places] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        if not self.labels:
            return UNKNOWN, 0.0
        counts = ngram_counts(text)
        places = np.flatnonzero(counts)
        p = softmax(self.logits(places, counts[places]) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], labels: int,
                      epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates: (weights, bias). ``z`` carries the sum of
    gradients, ``n`` of their squares; L1 sets small coordinates to zero."""
    z, n = np.zeros((FEATURES + 1, labels)), np.zeros((FEATURES + 1, labels))

    def solved(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            places, values, label = examples[i]
            rows, x = np.append(places, FEATURES), np.append(values, 1.0)
            w = solved(z[rows], n[rows], L1)
            error = softmax(x @ w)
            error[label] -= 1.0
            gradient = x[:, None] * error
            squares = n[rows] + gradient * gradient
            z[rows] += gradient - (np.sqrt(squares) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = squares
    weights = solved(z, n, L1)
    return weights[:-1], weights[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on kept-aside rows."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 93))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_language_model(train: DataFrame, text_col: str = "text", label_col: str = "lang",
                       id_col: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> LanguageModel:
    """Learns from the rows of ``train`` whose label is not null; idf counts all of them."""
    train = train.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    total = sum(sizes.values())
    frequencies = np.zeros(FEATURES)
    for r in (train.select("text").mapInArrow(_document_frequencies, "place bigint, n bigint")
              .groupBy("place").agg(F.sum("n").alias("n")).collect()):
        frequencies[r["place"]] = r["n"]
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    # a uniform number from id and text decides, so the sample is the same in every run, and rows
    # without an id are drawn one by one; of repeated rows one is enough
    draw = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = F.lit(0.0)
    for label in labels:
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_label / sizes[label]))).otherwise(share)
    sample = (train.where(draw < share).withColumn("key", F.xxhash64("id", "text"))
              .dropDuplicates(["label", "key"]).select("label", "text")
              .mapInArrow(_sparse_counts, "label string, places array<bigint>, counts array<bigint>").collect())
    number = {label: i for i, label in enumerate(labels)}
    rows = sorted(((number[r["label"]], r["places"], r["counts"]) for r in sample))
    examples = [(np.array(p), tfidf(np.array(p, np.int64), np.array(c), idf), y) for y, p, c in rows if p]
    aside = examples[::5]
    fit = [e for i, e in enumerate(examples) if i % 5]
    model = LanguageModel(labels, idf, np.zeros((FEATURES, len(labels))), np.zeros(len(labels)))
    if examples:
        model.weights, model.bias = follow_the_leader(fit, len(labels))
        logits = np.array([v @ model.weights[p] + model.bias for p, v, _ in aside])
        model.temperature = fit_temperature(logits, np.array([y for _, _, y in aside]))
    return model


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_score`` (calibrated probability, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no
    label was learned. An empty table stays empty. Only the text is looked at: repeated rows, null ids and further
    columns pass through, but for columns of those two names, which are replaced.
    """
    docs = docs.drop("_lang_pred", "_score")
    fields = docs.schema.fields

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                block = batch.slice(start, 512)
                found = [model.predict(t) for t in block.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())],
                    names=[*[f.name for f in fields], "_lang_pred", "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{schema}, _lang_pred string, _score double")


def training_rows(docs: DataFrame, id_col: str = "doc_id", hold_out: int = 1, folds: int = 3) -> DataFrame:
    return docs.where(id_bucket(F.col(id_col)) % folds != hold_out)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the training rows of ``docs`` and predicts all of them (``predict_language`` says how nulls,
    repeated rows and an empty table come out; null labels and all-null columns teach nothing)."""
    return predict_language(docs, fit_language_model(training_rows(docs)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is not ``und``: null texts and those without a letter
    go, null ids and repeated rows stay as they are. An empty table stays empty."""
    model = fit_language_model(training_rows(docs))
    found = predict_language(whole_row(docs, text="text"), model)
    return found.where(F.col("_lang_pred") != UNKNOWN).select("row.*")

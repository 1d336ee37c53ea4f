"""Text scoring (L1, M3): text -> three class probabilities, class, label, confidence.

A scorer turns a DataFrame with a text column into three probability columns. Three
kinds are offered:

* ``LexiconScorer`` - word lists, matched on batches of texts, and a softmax;
* ``SparkMLScorer`` - any fitted Spark ML ``PipelineModel`` with a ``probability`` column;
* ``BatchModelScorer`` - any external model called on batches of texts of like length
  (loaded once per Python worker, never row by row).

``score`` then applies the reference's output rules: probabilities rounded to 4
decimals, class = first arg-max of the unrounded probabilities, confidence = rounded
probability of that class, label from the class code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import KEYWORDS, argmax3, class_to_label, round4, softmax3
from ..functions.keywords import mention_counts

SCORE_COLUMNS = ["Sentiment", "Confidence", "Negative_Probability", "Neutral_Probability",
                 "Positive_Probability", "Predicted_Class"]


class LexiconScorer:
    """Logits ``(w * #negative words, neutral_logit, w * #positive words)`` -> softmax.

    Counts are distinct list words present in the lower-cased text (``match="word"``
    by default; ``"substring"`` for the reference's containment rule).
    """

    def __init__(self, positive: Sequence[str] | None = None, negative: Sequence[str] | None = None,
                 match: str = "word", neutral_logit: float = 0.5, weight: float = 1.0):
        self.positive = list(KEYWORDS["bullish"] if positive is None else positive)
        self.negative = list(KEYWORDS["bearish"] if negative is None else negative)
        self.match, self.neutral_logit, self.weight = match, neutral_logit, weight

    def probabilities(self, df: DataFrame, text_col: str) -> tuple[DataFrame, Column, Column, Column]:
        # counts first, as a column: later steps refer to them several times
        found = mention_counts(F.lower(F.col(text_col)), [self.positive, self.negative], self.match)
        out = df.withColumn("_found", found).withColumns({
            "_n_pos": F.col("_found")[0], "_n_neg": F.col("_found")[1]}).drop("_found")
        p = softmax3(F.col("_n_neg") * F.lit(self.weight), F.lit(self.neutral_logit),
                     F.col("_n_pos") * F.lit(self.weight))
        return out, *p


class SparkMLScorer:
    """A fitted Spark ML model whose ``probability`` vector has the three classes in
    code order (0 Negative, 1 Neutral, 2 Positive). ``text_col`` must be the model's
    input column. A model fitted on other than three classes is refused."""

    def __init__(self, model, probability_col: str = "probability"):
        last = model.stages[-1] if getattr(model, "stages", None) else model
        if getattr(last, "numClasses", 3) != 3:
            raise ValueError(f"the model has {last.numClasses} classes, not 3")
        self.model, self.probability_col = model, probability_col

    def probabilities(self, df: DataFrame, text_col: str):
        from pyspark.ml.functions import vector_to_array
        out = self.model.transform(df)
        arr = vector_to_array(F.col(self.probability_col))
        out = out.withColumn("_p", arr)
        return out, F.col("_p")[0], F.col("_p")[1], F.col("_p")[2]


class BatchModelScorer:
    """An external model called on batches of texts of about one length.

    ``make_predict_fn`` is called once per Python worker and returns a function from a
    NumPy array of texts to an ``(n, 3)`` array of probabilities (or logits with
    ``logits=True``, soft-maxed in Catalyst). Texts of an Arrow batch are ordered by length and cut
    into batches of at most ``batch_size`` texts whose padded size (texts times the longest) is at
    most ``batch_chars`` characters, so memory is bounded and little is padded; a longer text
    is a batch of its own. Scores come back in the order of the rows.
    """

    def __init__(self, make_predict_fn: Callable, batch_size: int = 64, logits: bool = False, batch_chars: int = 200_000):
        self.make_predict_fn, self.batch_size, self.logits = make_predict_fn, batch_size, logits
        self.batch_chars = batch_chars

    def probabilities(self, df: DataFrame, text_col: str):
        make, size, chars = self.make_predict_fn, self.batch_size, self.batch_chars
        names = [*df.columns, "_p"]

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = make()
            for batch in stream:
                texts = batch.column(text_col).to_pylist()
                p = np.empty((len(texts), 3))
                for part in length_batches([len(t or "") for t in texts], size, chars):
                    some = np.empty(len(part), object)
                    some[:] = [texts[i] for i in part]
                    p[part] = predict(some)
                ends = pa.array(np.arange(0, 3 * len(texts) + 1, 3, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=names)

        out = df.mapInArrow(run, StructType([*df.schema.fields, StructField("_p", ArrayType(DoubleType()))]))
        p = F.col("_p")
        if self.logits:
            return out, *softmax3(p[0], p[1], p[2])
        return out, p[0], p[1], p[2]


def length_batches(lengths: Sequence[int], most: int, chars: int) -> Iterator[list[int]]:
    """Places of texts by rising length, in batches of at most ``most`` texts and ``chars`` padded characters
    (one text at least)."""
    part: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        # the text that comes is the longest of its batch
        if part and (len(part) == most or (len(part) + 1) * lengths[i] > chars):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def from_probabilities(df: DataFrame, p_neg: Column, p_neu: Column, p_pos: Column) -> DataFrame:
    """The scored columns from three (unrounded) class probabilities."""
    df = df.withColumns({"_p0": p_neg, "_p1": p_neu, "_p2": p_pos})
    p_neg, p_neu, p_pos = F.col("_p0"), F.col("_p1"), F.col("_p2")
    df = df.withColumn("_cls", argmax3(p_neg, p_neu, p_pos))
    cls = F.col("_cls")
    conf = F.when(cls == 0, p_neg).when(cls == 1, p_neu).otherwise(p_pos)
    return df.withColumns({
        "Sentiment": class_to_label(cls),
        "Confidence": round4(conf),
        "Negative_Probability": round4(p_neg),
        "Neutral_Probability": round4(p_neu),
        "Positive_Probability": round4(p_pos),
        "Predicted_Class": cls,
    })


def score(df: DataFrame, text_col: str = "Headline", scorer=None) -> DataFrame:
    """L1: add the scored columns to every row of ``df`` (a map-only step)."""
    scorer = LexiconScorer() if scorer is None else scorer
    out, p0, p1, p2 = scorer.probabilities(df, text_col)
    scored = from_probabilities(out, p0, p1, p2)
    keep = [c for c in df.columns if c not in SCORE_COLUMNS]
    return scored.select(*keep, *SCORE_COLUMNS)

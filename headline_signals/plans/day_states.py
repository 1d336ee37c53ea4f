"""Daily index, statistics and keyword features kept current from partial states.

A partial state holds what some rows of a day add to it: counts, exact sums, sums of squares,
extremes and keyword sums. States of one day merge by adding up, so a refresh reads only new
rows, whichever days they belong to and however late they come, and writes one state row
per day they touch. The store is a log of such states, one folder a batch (a batch that is
run again replaces its own), and a snapshot that a compaction publishes as a generation:
reading costs one row per day and the batches since, not the history.

Sums are integers after scaling by ``10**digits`` (``operators.moments``), so merged states
give the same values as one pass over all rows, in whatever order they came.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import KEYWORDS, class_to_sign, round4
from ..functions.keywords import hit_columns, keyword_hits
from ..functions.timeparse import day_of
from ..operators import daily as dl
from ..operators import moments as mo
from ..sources import generations as gn

#: Decimals that a state keeps of probabilities and confidences; a product of two keeps twice as many.
DIGITS = 8
#: Measures: state name, column, whether squares, least and greatest value are kept.
_MEASURES = (
    ("s", "sentiment_score", True, True, True), ("w", "weighted_sentiment", True, False, False),
    ("c", "Confidence", True, False, False), ("pos", "Positive_Probability", False, False, True),
    ("neg", "Negative_Probability", False, False, True), ("neu", "Neutral_Probability", False, False, True),
)


def _digits(measure: str, digits: int) -> int:
    return 2 * digits if measure in ("w", "kw") else digits


def partial_states(scored: DataFrame, time_col: str = "Time", keywords: dict[str, list[str]] | None = None,
                   match: str = "substring", digits: int = DIGITS) -> DataFrame:
    """One state row per day of ``scored``. Rows whose time does not parse are left out. With
    ``keywords`` (a dictionary of word lists; ``{}`` for none, default: the eight categories)
    the keyword sums are kept too; texts are matched unless the match columns are there."""
    keywords = KEYWORDS if keywords is None else keywords
    rows = dl.sentiment_columns(scored).withColumns({
        "_day": day_of(scored, time_col),
        "_index": class_to_sign("Predicted_Class") * F.col("Confidence")})
    if keywords and not all(c in rows.columns for c in hit_columns(keywords)):
        rows = keyword_hits(rows, "Headline", keywords, match)
    aggs = [F.count(F.lit(1)).alias("rows"), F.count("_index").alias("n_i"), _total("_index", digits).alias("s_i")]
    for name, column, squares, least, greatest in _MEASURES:
        value = mo.scaled(column, _digits(name, digits))
        aggs += [F.count(F.col(column)).alias(f"n_{name}"), F.sum(value).cast(mo.SUM).alias(f"s_{name}")]
        aggs += [F.sum((value * value).cast(mo.SUM)).cast(mo.SUM).alias(f"q_{name}")] if squares else []
        aggs += [F.min(column).alias(f"min_{name}")] if least else []
        aggs += [F.max(column).alias(f"max_{name}")] if greatest else []
    for cat in keywords:
        hit = F.col(f"_kw_{cat}_hit")
        weighted = F.when(hit, F.col("weighted_sentiment"))
        aggs += [F.sum(f"_kw_{cat}_n").cast("bigint").alias(f"mentions_{cat}"),
                 F.sum(hit.cast("int")).cast("bigint").alias(f"headlines_{cat}"), F.count(weighted).alias(f"kn_{cat}"),
                 F.sum(F.when(hit, mo.scaled("weighted_sentiment", _digits("kw", digits)))).cast(mo.SUM).alias(f"ks_{cat}")]
    return dl.drop_null_group(rows.groupBy(F.col("_day").alias("Date")).agg(*aggs), "Date", scored, time_col)


def _total(column: str, digits: int) -> Column:
    return F.sum(mo.scaled(column, digits)).cast(mo.SUM)


def merge_states(states: DataFrame) -> DataFrame:
    """One state row per day from any number of them."""
    def merged(c):
        if c.startswith("min_"):
            return F.min(c)
        if c.startswith("max_"):
            return F.max(c)
        return F.sum(c).cast(states.schema[c].dataType)

    return states.groupBy("Date").agg(*[merged(c).alias(c) for c in states.columns if c != "Date"])


def index_of(states: DataFrame, digits: int = DIGITS) -> DataFrame:
    """A1 from merged states: the daily index and the rows behind it."""
    return states.select(F.col("Date").alias("Time"), (mo.mean(F.col("n_i"), F.col("s_i"), digits) * 100)
                         .alias("Daily_Sentiment_Index"), F.col("rows").alias("Headlines_Processed"))


def stats_of(states: DataFrame, digits: int = DIGITS) -> DataFrame:
    """A2 from merged states: ``Date`` and the 15 aggregates, rounded to 4 decimals."""
    def mean(m):
        return mo.mean(F.col(f"n_{m}"), F.col(f"s_{m}"), _digits(m, digits))

    def std(m):
        return mo.sample_std(F.col(f"n_{m}").cast(mo.SUM), F.col(f"s_{m}"), F.col(f"q_{m}"), _digits(m, digits))

    values = [mean("s"), std("s"), F.col("min_s"), F.col("max_s"), F.col("n_s"), mean("w"), std("w"), mean("c"), std("c")]
    for m in ("pos", "neg", "neu"):
        values += [mean(m), F.col(f"max_{m}")]
    return states.select("Date", *[
        (v if name == "headline_count" else F.coalesce(round4(v), F.lit(0.0))).alias(name)
        for name, v in zip(dl.DAILY_STAT_COLUMNS, values)])


def features_of(states: DataFrame, keywords: dict[str, list[str]] | None = None, digits: int = DIGITS) -> DataFrame:
    """A2 and K1-K3 from merged states, as ``daily_features`` returns them."""
    keywords = KEYWORDS if keywords is None else keywords
    words = []
    for cat in keywords:
        value = mo.mean(F.col(f"kn_{cat}"), F.col(f"ks_{cat}"), _digits("kw", digits))
        words += [F.col(f"mentions_{cat}").alias(f"{cat}_mentions"), F.coalesce(value, F.lit(0.0)).alias(f"{cat}_sentiment"),
                  F.col(f"headlines_{cat}").alias(f"{cat}_headlines")]
    return stats_of(states, digits).join(states.select("Date", *words), "Date")


@dataclass
class StateStore:
    """The states under a shared folder: a log of batches, and a snapshot up to one of them."""

    spark: SparkSession
    root: str

    @property
    def _log(self) -> str:
        return f"{self.root.rstrip('/')}/log"

    @property
    def _snapshots(self) -> str:
        return f"{self.root.rstrip('/')}/snapshots"

    def append(self, batch_id: int, states: DataFrame) -> None:
        """The states of one batch; the same batch again replaces what it wrote before. A batch that a
        snapshot holds already is not written again."""
        if batch_id > self._upto():
            states.write.mode("overwrite").parquet(f"{self._log}/batch={batch_id}")

    def _upto(self) -> int:
        snapshot = gn.current(self.spark, self._snapshots)
        return int(snapshot.notes["upto"]) if snapshot else -1

    def tail(self, after: int) -> DataFrame | None:
        """States of the batches after ``after`` with their ``batch``; None if there are none. Only their
        folders are read."""
        try:
            log = self.spark.read.parquet(self._log)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return log.where(F.col("batch") > after)

    def read(self) -> DataFrame:
        """One merged state row per day: the snapshot and the batches after it."""
        snapshot = gn.current(self.spark, self._snapshots)
        tail = self.tail(int(snapshot.notes["upto"]) if snapshot else -1)
        parts = [self.spark.read.parquet(snapshot.path("states"))] if snapshot else []
        parts += [tail.drop("batch")] if tail is not None else []
        if not parts:
            raise ValueError(f"no states under {self.root}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return merge_states(out)

    def compact(self, keep: int = 2) -> int:
        """Publish a snapshot of all batches so far (one row per day), drop older snapshots and the batches
        that all kept ones hold; the last batch in it. Nothing happens when no batch came since the one before. Batches must
        come in rising order, as a stream numbers them."""
        before = self._upto()
        tail = self.tail(before)
        batches = [r["batch"] for r in tail.select("batch").distinct().collect()] if tail is not None else []
        if not batches:
            return before
        last = max(batches)
        gn.publish_generation(self.spark, self._snapshots, [("states", self.read(), "parquet")], notes={"upto": str(last)})
        gn.drop_older(self.spark, self._snapshots, keep)
        # who reads the oldest kept snapshot still finds the batches after it
        held = int(gn.generations(self.spark, self._snapshots)[0].notes["upto"])
        for r in self.tail(-1).where(F.col("batch") <= held).select("batch").distinct().collect():
            gn.remove(self.spark, f"{self._log}/batch={r['batch']}")
        return last


def add_batch(store: StateStore, batch_id: int, scored: DataFrame, **how) -> None:
    """Refresh from new rows alone: their partial states become one batch of the store."""
    store.append(batch_id, partial_states(scored, **how))


def run_states(scored: DataFrame, store: StateStore, checkpoint: str, compact_every: int | None = None, **how) -> None:
    """X5 as a stream without state of its own: every micro-batch adds its partial states, late rows
    included. All available input is read, then the stream stops; it goes on from its
    checkpoint next time. ``compact_every``: batches after which a snapshot is published."""
    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(store, batch_id, batch, **how)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact()

    q = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def split_batches(rows: DataFrame, key: str, batches: int) -> Sequence[DataFrame]:
    """``rows`` in parts by a hash of ``key``, each with rows of all days: batches that come late."""
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    return [rows.where(part == i) for i in range(batches)]

"""Feeds whose rows refer to texts.

Many rows of a feed can show one text. Here the rows hold a key and the texts are a table of
their own, so that what depends on the text alone (its scores, its keywords) is found once a
text, however many rows refer to it, and joined to the rows. Texts are shuffled to the rows
only where an output holds them.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import complete_time
from ..functions.keywords import hit_columns, keyword_hits
from ..functions.labels import PLACEHOLDER
from . import extract as ex
from . import scoring as sc
from .partitioning import spread


@dataclass(frozen=True)
class Feed:
    """``rows`` with ``(seq, Time, key, loading)`` and ``texts`` with ``(key, Headline)``. A row that is
    ``loading`` shows the placeholder; one whose key is not among the texts has no headline."""

    rows: DataFrame
    texts: DataFrame
    key: str = "doc_id"

    def joined(self) -> DataFrame:
        """The feed as one table, ``(seq, Time, Headline)``, as a page shows it."""
        out = self.rows.join(self.texts, self.key, "left")
        return out.select("seq", "Time", F.when(F.col("loading"), F.lit(PLACEHOLDER))
                          .otherwise(F.col("Headline")).alias("Headline"))


def score_feed(feed: Feed | DataFrame, as_of: _dt.date | str, scorer=None, with_text: bool = False,
               keywords: dict[str, list[str]] | None = None, match: str = "substring") -> DataFrame:
    """The rows of ``feed`` that are not loading, ``(seq, Time, [Headline,] scores)``, with
    times completed. With ``keywords`` the match columns of ``keyword_hits`` come after the scores.

    The texts of a ``Feed`` are scored and matched once each. Rows without a text score like null text,
    so ``scorer`` must take it. Of a feed in one table every row's own text is scored."""
    if isinstance(feed, DataFrame):
        out = sc.score(ex.complete_feed(feed, as_of), "Headline", scorer)
        out = keyword_hits(out, "Headline", keywords, match) if keywords else out
        return out if with_text else out.drop("Headline")

    def of_text(texts: DataFrame) -> DataFrame:
        out = sc.score(texts, "Headline", scorer)
        return keyword_hits(out, "Headline", keywords, match) if keywords else out

    found = [*sc.SCORE_COLUMNS, *(hit_columns(keywords) if keywords else [])]
    texts = of_text(spread(feed.texts)).withColumns({
        "_placeholder": F.col("Headline").eqNullSafe(PLACEHOLDER), "_found": F.lit(True)})
    if with_text:
        # sorted by key: rows of one text are neighbours, which is what makes the written files small
        texts = texts.hint("merge")
    else:
        texts = texts.drop("Headline")
    without = of_text(feed.rows.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias("Headline"))).first()

    def value(c: str) -> Column:
        kind = texts.schema[c].dataType
        return F.when(F.col("_found"), F.col(c)).otherwise(F.lit(without[c]).cast(kind)).alias(c)

    rows = feed.rows.where(~F.col("loading")).withColumn("Time", complete_time("Time", as_of))
    out = rows.join(texts, feed.key, "left").where(~F.coalesce("_placeholder", F.lit(False)))
    return out.select("seq", "Time", *(["Headline"] if with_text else []), *[value(c) for c in found])

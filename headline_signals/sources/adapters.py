"""Adapter views: the library's data model built from the driver tables.

The library consumes a *scored headline* table (one row per headline with class
probabilities), a *market* series and *labelled text*. The driver tables carry none of
these directly, so these views derive them with plain DataFrame operations; their work
grows with the input tables. See SURVEY section 7.3 (V1-V6).

The stand-in model output is a deterministic function of row ids: three positive
integers per row, normalised into probabilities. It lets every downstream operator run
on realistic, varied class mixes without a trained model in the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import argmax3, class_to_label, label_to_class, mean_of, round4
from ..functions.keywords import keyword_hits
from ..operators.feeds import Feed
from ..operators.partitioning import spread
from .tables import load


def stand_in_scores(df: DataFrame, seq: Column, time: Column,
                    neg: Column, neu: Column, pos: Column) -> DataFrame:
    """Scored-table columns from three positive weights per row (V1 shape).

    Probabilities are the weights over their sum, rounded to 4 decimals; the class is
    the first arg-max of the weights (order Negative, Neutral, Positive) and the
    confidence is the rounded probability of that class.
    """
    t = neg + neu + pos
    p_neg, p_neu, p_pos = neg / t, neu / t, pos / t
    cls = argmax3(neg, neu, pos)
    return df.select(
        seq.cast("bigint").alias("seq"),
        time.alias("Time"),
        class_to_label(cls).alias("Sentiment"),
        round4(F.greatest(p_neg, p_neu, p_pos)).alias("Confidence"),
        round4(p_neg).alias("Negative_Probability"),
        round4(p_neu).alias("Neutral_Probability"),
        round4(p_pos).alias("Positive_Probability"),
        cls.alias("Predicted_Class"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one scored row per event; Time = ts, seq = event_id."""
    ev = load(spark, sf_dir, "events")
    return stand_in_scores(
        ev, F.col("event_id"), F.col("ts"),
        neg=F.lit(1) + F.floor("value") % 11,
        neu=F.lit(1) + F.col("user_id") % 5,
        pos=F.lit(1) + F.col("event_id") % 7,
    )


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 rows: one scored row per order; Time = o_orderdate (about 2,400 days)."""
    od = load(spark, sf_dir, "orders")
    return stand_in_scores(
        od, F.col("o_orderkey"), F.col("o_orderdate"),
        neg=F.lit(1) + F.col("o_custkey") % 11,
        neu=F.lit(1) + F.floor("o_totalprice") % 5,
        pos=F.lit(1) + F.col("o_orderkey") % 7,
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, Headline): the whole text of each document is one headline."""
    return load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Headline"))


def with_headlines(spark: SparkSession, sf_dir: str, scored: DataFrame,
                   keywords: dict[str, list[str]] | None = None,
                   match: str | None = None) -> DataFrame:
    """V2: attach a headline text to every scored row (document ``seq mod #documents``).

    The document count is a scalar subquery (one value, computed once); the headline join itself is a shuffle equi-join, since documents grow with
    the data and are never broadcast. With ``match`` set, keyword match columns are
    computed once per document before the join; a plan that then needs only those
    columns never ships the text through the shuffle.
    """
    heads = document_texts(spark, sf_dir)
    n_docs = heads.agg(F.count(F.lit(1))).scalar()  # scalar subquery, run once
    if match is not None:
        heads = keyword_hits(spread(heads), "Headline", keywords, match)
    keyed = spread(scored).withColumn("_doc_key", F.col("seq") % n_docs)
    joined = keyed.join(heads, keyed["_doc_key"] == heads["doc_id"], "left")
    extra = [c for c in heads.columns if c.startswith("_kw_")]
    cols = ["seq", "Time", "Headline"] + [c for c in scored.columns if c not in ("seq", "Time")]
    return joined.select(*cols, *extra)


def with_document_columns(spark: SparkSession, sf_dir: str, rows: DataFrame,
                          per_document: DataFrame) -> DataFrame:
    """Attach per-document columns (keyed by ``doc_id``, computed once per document)
    to the rows that refer to each document (``seq mod #documents``)."""
    n_docs = load(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    keyed = spread(rows).withColumn("_doc_key", F.col("seq") % n_docs)
    joined = keyed.join(per_document, keyed["_doc_key"] == per_document["doc_id"], "left")
    return joined.drop("_doc_key", "doc_id")


def scored_headlines(spark: SparkSession, sf_dir: str, base: str = "events",
                     keywords: dict[str, list[str]] | None = None,
                     match: str | None = None) -> DataFrame:
    """Scored rows with headline text; ``base`` is ``events`` (30 days) or ``orders``."""
    scored = scored_events(spark, sf_dir) if base == "events" else scored_orders(spark, sf_dir)
    return with_headlines(spark, sf_dir, scored, keywords, match)


def market_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: a long ``(symbol, Date, Close)`` table from ``lineitem`` ship days.

    Three series stand in for an index fund, a fear index and a yield: mean extended price, mean
    quantity and 100 x mean tax per ship day (2-decimal inputs, exact sums).
    """
    li = load(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    daily = (li.groupBy(day.alias("Date"))
             .agg(mean_of("l_extendedprice", 2).alias("SPY"),
                  mean_of("l_quantity", 2).alias("VIX"),
                  (mean_of("l_tax", 2) * 100).alias("TNX")))
    return daily.select(
        "Date",
        F.expr("stack(3, 'SPY', SPY, '^VIX', VIX, '^TNX', TNX) AS (symbol, Close)"),
    ).select("symbol", "Date", "Close")


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 panel form: one series per ``l_returnflag``."""
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("Date"))
            .agg(mean_of("l_extendedprice", 2).alias("Close")))


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: documents with their 0/1 quality label: ``(doc_id, text, label)``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


def labelled_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 in three classes: ``(doc_id, text, Sentiment, label)``; toxic documents stand in for
    negative ones, good ones for positive, the others are neutral. ``label`` is the class code."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kind = (F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive").otherwise("Neutral"))
    labels = load(spark, sf_dir, "labels").select("doc_id", kind.alias("Sentiment"))
    return docs.join(labels, "doc_id").withColumn("label", label_to_class(F.col("Sentiment")))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with ``<table>`` markup rendered from nations: ``(page_id, html)``, a page per region.

    Table 0 of a page lists its nations; the first cell of a nation's row spans two rows, the
    second of which holds a table of its own with the nation's name and key."""
    nation = load(spark, sf_dir, "nation").withColumn("inner", F.format_string(
        "<table><tr><td>%s</td><td>%d</td></tr></table>", "n_name", "n_nationkey"))
    rows = nation.select("n_regionkey", "n_nationkey", F.format_string(
        "<tr><td rowspan=2>%d</td><td>%s</td><td>R%d</td></tr><tr><td colspan=2>%s</td></tr>",
        "n_nationkey", "n_name", "n_regionkey", "inner").alias("row"))
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "row"))), lambda r: r["row"]), "")
    return rows.groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(
        F.concat(F.lit("<body><table>"), page, F.lit("</table></body>")).alias("html"))


def feed(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> Feed:
    """Extracted feed rows and the texts they refer to: ``(seq, Time, doc_id, loading)`` and
    ``(doc_id, Headline)``.

    ``Time`` is text in the feed's shapes, chosen by event type: full date and clock
    time (view), clock time only (click), month-day (signup) or date (others);
    ``Headline`` is a whole document text, and rows of error events are still loading.
    ``events`` replaces the events table, by a stream for example.
    """
    ev = (load(spark, sf_dir, "events") if events is None else events).select(
        F.col("event_id").alias("seq"), "ts", "event_type")
    ts, et = F.col("ts"), F.col("event_type")
    fmt = (F.when(et == "view", F.lit("yyyy-MM-dd hh:mma"))
           .when(et == "click", F.lit("hh:mma"))
           .when(et == "signup", F.lit("MMM-dd"))
           .otherwise(F.lit("yyyy-MM-dd")))
    time_text = F.call_function("date_format", ts, fmt)
    rows = ev.select("seq", time_text.alias("Time"), F.coalesce(et == "error", F.lit(False)).alias("loading"))
    heads = document_texts(spark, sf_dir)
    n_docs = heads.agg(F.count(F.lit(1))).scalar()
    return Feed(spread(rows).withColumn("doc_id", F.col("seq") % n_docs), heads)


def raw_feed(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The feed as a scraped page yields it, the text in every row: ``(seq, Time, Headline)``, with the
    loading placeholder for error events."""
    return feed(spark, sf_dir, events).joined()

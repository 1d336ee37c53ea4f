"""Registered queries: one per operator family, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the adapter views) and runs over the whole
of them. The operators return full doubles; here, where another engine adds up the same
doubles in another order, results are rounded to 6 decimals (``finalize``) to compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from . import day_states as ds
from . import epochs as ep
from . import feature_flow as ff
from . import linear_folds as lf
from . import modeling as ml
from . import refresh as rf
from ..functions import parse_time
from ..functions.keywords import keyword_hits
from ..operators import daily as dl
from ..operators import extract as ex
from ..operators import features as ft
from ..operators import feeds as fd
from ..operators import market as mk
from ..operators import metrics as mt
from ..operators import paging as pg
from ..operators import regimes as rg
from ..operators import report as rp
from ..operators import rolling as rl
from ..operators import scoring as sc
from ..operators import targets as tg
from ..operators.partitioning import materialize, spread
from ..operators.quantiles import exact_quantiles
from ..session import scratch_path
from ..sources import adapters as ad
from ..sources import files as fs
from ..sources import html as hx
from ..sources.tables import load
from ..streaming import incremental as st

#: Decimals of the stand-in and lexicon probabilities (the scorer rounds to 4).
SCALE = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn
    return wrap


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column to ``digits`` decimals (half even) for comparison."""
    scale = float(10 ** digits)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.rint(F.col(f.name) * scale) / scale + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --- A1: daily sentiment index (flagship) -------------------------------------------

@query("daily_index")
def q_daily_index(spark, sf):
    return finalize(dl.daily_index(ad.scored_events(spark, sf), scale=SCALE))


@query("daily_index_orders")
def q_daily_index_orders(spark, sf):
    return finalize(dl.daily_index(ad.scored_orders(spark, sf), scale=SCALE))


# --- A2: daily statistics -----------------------------------------------------------

@query("daily_stats")
def q_daily_stats(spark, sf):
    return finalize(dl.daily_stats(ad.scored_orders(spark, sf), scale=SCALE))


# --- A3 / A4: chart datasets over scored rows ---------------------------------------

@query("label_counts")
def q_label_counts(spark, sf):
    return rp.label_counts(ad.scored_events(spark, sf))


@query("confidence_histogram")
def q_confidence_histogram(spark, sf):
    return finalize(rp.histogram(ad.scored_events(spark, sf), "Confidence", 10))


# --- daily-grain feature flow over the long (orders) series -------------------------


def _orders_daily(spark, sf):
    # written once: the series operators read the daily table more than once
    return materialize(dl.daily_stats(ad.scored_orders(spark, sf), scale=SCALE))


def _orders_feature_table(spark, sf):
    return ff.daily_feature_table(ad.scored_headlines(spark, sf, base="orders", match="substring"), scale=SCALE)


@query("rolling_features")
def q_rolling(spark, sf):
    return finalize(rl.rolling_features(_orders_daily(spark, sf), scale=SCALE))


@query("regime_thresholds")
def q_thresholds(spark, sf):
    return finalize(rg.thresholds(_orders_daily(spark, sf)))


@query("regime_flags")
def q_flags(spark, sf):
    return finalize(rg.regime_flags(_orders_daily(spark, sf)))


@query("keyword_features")
def q_keywords(spark, sf):
    return finalize(dl.keyword_features(ad.scored_headlines(spark, sf, base="orders", match="substring"),
                                        scale=SCALE))


@query("keyword_features_word")
def q_keywords_word(spark, sf):
    heads = ad.scored_headlines(spark, sf, base="events", match="word")
    return finalize(dl.keyword_features(heads, match="word", scale=SCALE))


@query("daily_feature_table")
def q_feature_table(spark, sf):
    return finalize(_orders_feature_table(spark, sf))


@query("fallback_targets")
def q_fallback_targets(spark, sf):
    t = ff.with_targets(_orders_feature_table(spark, sf), scale=SCALE)
    return finalize(t.select("Date", "avg_sentiment", "next_day_sentiment", "next_day_positive",
                             "next_3day_sentiment", "next_3day_positive"))


@query("market_indicators")
def q_market_indicators(spark, sf):
    return finalize(mk.indicators(ad.market_series(spark, sf)))


@query("market_panel_indicators")
def q_market_panel(spark, sf):
    return finalize(mk.indicators(ad.market_panel(spark, sf)))


@query("market_targets")
def q_market_targets(spark, sf):
    t = ff.with_targets(_orders_feature_table(spark, sf), ad.market_series(spark, sf))
    return finalize(t.select("Date", "avg_sentiment", "daily_return", "volatility_5d", "market_trend",
                             "next_day_return", "next_day_positive", "next_day_big_move",
                             "next_3day_return", "next_3day_positive", "VIX", "vix_change",
                             "high_fear"))


@query("feature_matrix")
def q_feature_matrix(spark, sf):
    return finalize(ff.build_features(ad.scored_headlines(spark, sf, base="orders", match="substring"),
                                      ad.market_series(spark, sf), scale=SCALE))


@query("time_folds")
def q_time_folds(spark, sf):
    return ft.time_folds(_orders_daily(spark, sf))


@query("ordered_split")
def q_ordered_split(spark, sf):
    return ft.ordered_split(_orders_daily(spark, sf)).select("Date", "row_idx", "role")


@query("run_summary")
def q_summary(spark, sf):
    return finalize(rp.summary(_orders_daily(spark, sf), scale=SCALE))


@query("extreme_days")
def q_extreme_days(spark, sf):
    return finalize(rp.extreme_days(_orders_daily(spark, sf)))


@query("sentiment_histogram")
def q_sentiment_histogram(spark, sf):
    return finalize(rp.histogram(_orders_daily(spark, sf), "avg_sentiment", 30))


@query("sentiment_histogram_small")
def q_sentiment_histogram_small(spark, sf):
    return finalize(rp.histogram(dl.daily_stats(ad.scored_events(spark, sf), scale=SCALE), "avg_sentiment", None))


@query("sentiment_return_correlation")
def q_correlation(spark, sf):
    t = ff.with_targets(_orders_feature_table(spark, sf), ad.market_series(spark, sf))
    return finalize(rp.correlation(t, "avg_sentiment", "next_day_return"))


@query("feed_page")
def q_feed_page(spark, sf):
    return rp.feed_page(ad.scored_events(spark, sf), page=3)


@query("feed_pages")
def q_feed_pages(spark, sf):
    return rp.feed_pages(ad.scored_events(spark, sf))


@query("feed_last_page")
def q_feed_last_page(spark, sf):
    """The last page of the feed, read from stored pages."""
    root = scratch_path(spark, f"pages-{uuid.uuid4().hex}")
    pg.write_pages(ad.scored_events(spark, sf), root, block_rows=1_000)
    return pg.read_page(spark, root, pg.stored_page_count(spark, root))


@query("keyword_dictionary_hits")
def q_keyword_dictionary_hits(spark, sf):
    """K1 with the words of the benchmark passages as a dictionary: substrings found by hash, in one pass
    whatever their number."""
    found = load(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct()
    words = [r["w"] for r in found.where("length(w) between 5 and 8").collect()]
    keywords = {"even": [w for w in words if len(w) % 2 == 0], "odd": [w for w in words if len(w) % 2]}
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return keyword_hits(docs, "text", keywords, many=0).select(
        "doc_id", F.col("_kw_even_n").alias("even_n"), F.col("_kw_odd_n").alias("odd_n"))


@query("page_count")
def q_page_count(spark, sf):
    return rp.page_count(ad.scored_events(spark, sf))


# --- raw feed: extraction, time completion and parsing, scoring ---------------------


AS_OF = "2024-01-31"


@query("feed_times")
def q_feed_times(spark, sf):
    raw = ad.raw_feed(spark, sf)
    done = ex.complete_feed(raw.withColumn("raw_time", F.col("Time")), AS_OF)
    parsed = done.select("seq", "raw_time", "Time", parse_time("Time").alias("parsed_at"))
    return parsed.withColumn("day", F.to_date("parsed_at"))


@query("feed_lexicon_index")
def q_feed_lexicon_index(spark, sf):
    """The batch flow end to end: extracted rows -> completed times -> scores -> index."""
    return finalize(dl.daily_index(fd.score_feed(ad.feed(spark, sf), AS_OF), scale=SCALE))


@query("score_documents")
def q_score_documents(spark, sf):
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return sc.score(docs, "text").drop("text")


@query("score_documents_substring")
def q_score_documents_substring(spark, sf):
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return sc.score(docs, "text", sc.LexiconScorer(match="substring")).drop("text")


def _agreement(spark, sf):
    """Stand-in labels against the lexicon class of each row's text. Texts repeat across
    rows, so each document is scored once and the class joined to its rows."""
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    doc_class = sc.score(docs, "text").select("doc_id", F.col("Predicted_Class").alias("prediction"))
    rows = ad.scored_events(spark, sf).select("seq", F.col("Predicted_Class").alias("label"))
    return ad.with_document_columns(spark, sf, rows, doc_class).select("label", "prediction")


@query("scorer_agreement")
def q_scorer_agreement(spark, sf):
    return finalize(mt.classification_metrics(_agreement(spark, sf)))


@query("scorer_class_report")
def q_scorer_class_report(spark, sf):
    return finalize(mt.class_report(_agreement(spark, sf)))


# --- HTML pages ------------------------------------------------------------------


@query("page_list_rows")
def q_page_list_rows(spark, sf):
    rows = hx.html_rows(load(spark, sf, "pages"), kind="list")
    return rows.select("page_id", "table_idx", "row_idx", F.element_at("cells", 1).alias("text"),
                       F.size("cells").alias("n_cells"))


@query("page_headings")
def q_page_headings(spark, sf):
    return hx.page_headings(load(spark, sf, "pages"))


@query("page_tables")
def q_page_tables(spark, sf):
    """Every row of several tables a page, nested ones and spanning cells included."""
    rows = hx.html_tables(ad.table_pages(spark, sf))
    return rows.select("page_id", "table_idx", "row_idx", F.concat_ws("|", "cells").alias("cells"))


@query("page_headline_rows")
def q_page_headline_rows(spark, sf):
    """Three-cell rows of picked tables as headline rows."""
    return ex.headline_rows(hx.html_tables(ad.table_pages(spark, sf)), AS_OF, indexes=(0, 1))


# --- files, refresh, status ----------------------------------------------------------


def _refreshed(spark, sf):
    out = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    rf.refresh(spark, ad.feed(spark, sf), out, AS_OF, published_at="2024-01-30 23:30:00")
    return out


@query("published_index")
def q_published_index(spark, sf):
    """X3 + S4/S6/S7: refresh, then read the published daily index back from JSON Lines."""
    paths = rf.published(spark, _refreshed(spark, sf))
    return finalize(fs.read_json(spark, paths["index_json"], fs.INDEX_SCHEMA))


@query("published_scored_csv")
def q_published_scored(spark, sf):
    """The scored rows read back from the published CSV with a declared schema."""
    paths = rf.published(spark, _refreshed(spark, sf))
    return fs.read_csv(spark, paths["scored"], fs.SCORED_SCHEMA)


@query("published_headlines")
def q_published_headlines(spark, sf):
    """The headlines read back from the published CSV."""
    paths = rf.published(spark, _refreshed(spark, sf))
    return fs.read_csv(spark, paths["headlines"], fs.HEADLINES_SCHEMA)


@query("published_scored_json")
def q_published_scored_json(spark, sf):
    """The scored rows read back from the published JSON Lines."""
    paths = rf.published(spark, _refreshed(spark, sf))
    return fs.read_json(spark, paths["scored_json"], fs.SCORED_SCHEMA)


def _batches(spark, sf):
    """Scored event headlines in three batches, each with rows of all days: late ones among them."""
    rows = ad.scored_headlines(spark, sf, base="events", match="substring")
    return ds.split_batches(rows, "seq", 3)


def _stored(spark, sf):
    store = ds.StateStore(spark, scratch_path(spark, f"states-{uuid.uuid4().hex}"))
    for i, rows in enumerate(_batches(spark, sf)):
        ds.add_batch(store, i, rows)
        if i == 1:
            store.compact()
    return store


@query("incremental_daily_index")
def q_incremental_daily_index(spark, sf):
    """A1 from partial states of three batches, two of them in a snapshot."""
    return finalize(ds.index_of(_stored(spark, sf).read()))


@query("incremental_daily_features")
def q_incremental_daily_features(spark, sf):
    """A2 and K1-K3 from the same states."""
    return finalize(ds.features_of(_stored(spark, sf).read()))


@query("refreshed_new_rows")
def q_refreshed_new_rows(spark, sf):
    """X3 on new rows alone: the raw feed in two batches, each completed and scored once."""
    store = ds.StateStore(spark, scratch_path(spark, f"states-{uuid.uuid4().hex}"))
    feed = ad.feed(spark, sf)
    for i, rows in enumerate(ds.split_batches(feed.rows, "seq", 2)):
        rf.refresh_new(store, i, replace(feed, rows=rows), AS_OF)
    return finalize(ds.index_of(store.read()))


@query("snapshot_status")
def q_snapshot_status(spark, sf):
    return rf.snapshot_status(spark, _refreshed(spark, sf), "2024-01-31 00:00:00")


@query("feed_freshness")
def q_feed_freshness(spark, sf):
    feed = ex.complete_feed(ad.raw_feed(spark, sf), AS_OF)
    return rf.freshness(feed, "Time", "2024-01-31 00:00:00", name="feed")


# --- modelling (Spark ML; learner outputs have no SQL oracle) --------------------------


@query("split_assignment")
def q_split_assignment(spark, sf):
    return ml.split_column(ad.labelled_text(spark, sf), "doc_id").select("doc_id", "label", "split")


@query("text_classifier_report")
def q_text_classifier_report(spark, sf):
    data = ml.split_column(ad.labelled_sentiment(spark, sf), "doc_id")
    model = ml.train_text_classifier(data.where("split = 'train'"))
    _, report = ml.evaluate_classifier(model, data.where("split = 'test'"))
    return report


@query("text_epochs")
def q_text_epochs(spark, sf):
    """L4: weighted F1 of the validation rows after each of three epochs, and which epoch is kept."""
    data = ml.split_column(ad.labelled_sentiment(spark, sf), "doc_id")
    root = scratch_path(spark, f"epochs-{uuid.uuid4().hex}")
    return finalize(ep.train_epochs(data.where("split = 'train'"), data.where("split = 'test'"), root)[1])


@query("sentiment_labels")
def q_sentiment_labels(spark, sf):
    """P5: text labels and their class codes."""
    return ad.labelled_sentiment(spark, sf).select("doc_id", "Sentiment", F.col("label").cast("int").alias("label"))


@query("ml_scored_documents")
def q_ml_scored_documents(spark, sf):
    """L1(b): all documents scored by the three-class text classifier trained here."""
    model = ml.train_text_classifier(ad.labelled_sentiment(spark, sf), reg_params=(0.01,))
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return sc.score(docs, "text", sc.SparkMLScorer(model)).drop("text")


def _length_model():
    """A model that SQL can follow: logits (0, 1, length mod 3)."""
    def predict(texts):
        n = np.array([len(t) for t in texts], dtype=float)
        return np.stack([np.zeros_like(n), np.ones_like(n), n % 3], axis=1)
    return predict


@query("batch_scored_documents")
def q_batch_scored_documents(spark, sf):
    """L1(c): all documents scored by an external model on Arrow batches."""
    docs = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sc.score(docs, "text", sc.BatchModelScorer(_length_model, logits=True)).drop("text")


@query("rolling_features_exact")
def q_rolling_exact(spark, sf):
    """W1-W4 over a series of timestamps: several points a day, ordered within the day."""
    scored = fd.score_feed(ad.feed(spark, sf), AS_OF)
    series = dl.daily_stats(scored, grain="exact", scale=SCALE)
    return finalize(rl.rolling_features(series, windows=(3, 7), scale=SCALE).select(
        "Date", "avg_sentiment", "sentiment_ma_3d", "sentiment_ma_7d", "sentiment_std_7d", "headline_count_ma_7d"))


@query("rolling_features_range_exact")
def q_rolling_range_exact(spark, sf):
    """W1-W4 by calendar days over a series with several rows a day: prefix sums of moments."""
    scored = fd.score_feed(ad.feed(spark, sf), AS_OF)
    return finalize(rl.rolling_features(dl.daily_stats(scored, grain="exact", scale=SCALE), frame="range", scale=SCALE))


#: Lengths of very long windows, in rows.
LONG_WINDOWS = (1_000, 10_000)


@query("rolling_features_long")
def q_rolling_long(spark, sf):
    """W1-W4 with windows of up to 10,000 rows: a row costs the same as with short ones."""
    scored = fd.score_feed(ad.feed(spark, sf), AS_OF)
    series = dl.daily_stats(scored, grain="exact", scale=SCALE)
    return finalize(rl.rolling_features(series, LONG_WINDOWS, scale=SCALE).select(
        "Date", *rl.rolling_feature_names(LONG_WINDOWS)))


@query("regime_flags_exact_grain")
def q_flags_exact(spark, sf):
    """A6, F1-F4 over a series of timestamps: thresholds by rank selection."""
    scored = fd.score_feed(ad.feed(spark, sf), AS_OF)
    series = materialize(dl.daily_stats(scored, grain="exact", scale=SCALE))
    return finalize(rg.regime_flags(series).select("Date", "avg_sentiment", *rg.FLAG_COLUMNS))


@query("score_quantiles")
def q_score_quantiles(spark, sf):
    """A6 over all scored rows, per label: quantiles of confidence and of the class probabilities."""
    wanted = {f"{short}_q{round(100 * p):02d}": (c, p) for short, c in (
        ("confidence", "Confidence"), ("positive", "Positive_Probability"), ("negative", "Negative_Probability"))
        for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return finalize(exact_quantiles(ad.scored_orders(spark, sf), wanted, ["Sentiment"]))


#: Moves the stand-in market over the days of the feed.
MARKET_SHIFT_DAYS = 9862


@query("market_targets_exact")
def q_market_targets_exact(spark, sf):
    """J3 at the full timestamp: every row meets the market on its calendar date."""
    scored = fd.score_feed(ad.feed(spark, sf), AS_OF)
    series = dl.daily_stats(scored, grain="exact", scale=SCALE)
    market = ad.market_series(spark, sf).withColumn("Date", F.date_add("Date", MARKET_SHIFT_DAYS))
    out = tg.market_targets(series, mk.indicators(market), fear_symbol=None)
    return finalize(out.select("Date", "daily_return", "next_day_return", "next_day_positive"))


@query("feed_pages_sparse")
def q_feed_pages_sparse(spark, sf):
    """O6 over keys spread over the whole range of longs."""
    rows = ad.scored_events(spark, sf).select("seq", F.conv(F.substring(F.md5(F.col("seq").cast("string")), 1, 15),
                                                            16, 10).cast("long").alias("key"))
    return rp.feed_pages(rows, order_col="key")


def _market_feature_table(spark, sf):
    return ff.build_features(ad.scored_headlines(spark, sf, base="orders", match="substring"),
                             ad.market_series(spark, sf), scale=SCALE)


@query("model_cv_scores")
def q_model_cv_scores(spark, sf):
    scores, _ = ml.train_targets(spark, _market_feature_table(spark, sf), refit=False)
    return scores


@query("model_summary")
def q_model_summary(spark, sf):
    scores, _ = ml.train_targets(spark, _market_feature_table(spark, sf), refit=False)
    return ml.best_models(ml.summarize_folds(scores))


@query("feature_ranking")
def q_feature_ranking(spark, sf):
    table = _market_feature_table(spark, sf)
    forest = ml.classification_models()["random_forest_classifier"]
    model = ml.fit_all(table, "next_day_positive", forest)
    return ml.top_features(ml.feature_importance(spark, model, ft.feature_names(table)), 10)


#: Feature sets of the compared linear models, and their targets.
LINEAR_MODELS = {"confidence": ["avg_confidence"], "volume": ["headline_count"], "both": ["avg_confidence", "headline_count"]}
LINEAR_TARGETS = ("next_day_sentiment", "next_3day_sentiment")


def _linear_table(spark, sf):
    # unknown targets of the last days are null and left out
    return materialize(tg.fallback_targets(_orders_daily(spark, sf), null_unknown=True, scale=SCALE))


@query("linear_fold_scores")
def q_linear_fold_scores(spark, sf):
    """R squared of least squares on every expanding fold."""
    return finalize(ml.linear_scores(spark, _linear_table(spark, sf), LINEAR_MODELS, LINEAR_TARGETS))


@query("linear_model_summary")
def q_linear_model_summary(spark, sf):
    """Mean and deviation of the fold scores, the panel of model scores."""
    scores = ml.linear_scores(spark, _linear_table(spark, sf), LINEAR_MODELS, LINEAR_TARGETS)
    return finalize(ml.summarize_folds(scores))


@query("linear_best_models")
def q_linear_best_models(spark, sf):
    """The best model per target."""
    scores = ml.linear_scores(spark, _linear_table(spark, sf), LINEAR_MODELS, LINEAR_TARGETS)
    return finalize(ml.best_models(ml.summarize_folds(scores)).select("target", "model", "mean_score"))


@query("dashboard_top_features")
def q_dashboard_top_features(spark, sf):
    """Features of the linear model on all rows by the size of their coefficients."""
    table = _linear_table(spark, sf)
    columns = ["avg_confidence", "headline_count"]
    fit = lf.fold_grams(table, "next_day_sentiment", columns).fit()
    panels = rp.dashboard(table, importance=ml.feature_importance(spark, fit, columns))
    return finalize(panels["top_features"])


@query("dashboard_scatter")
def q_dashboard_scatter(spark, sf):
    """C2 panel: sentiment against the next day's return."""
    table = ff.with_targets(_orders_daily(spark, sf), ad.market_series(spark, sf))
    return finalize(rp.dashboard(table)["scatter"])


@query("simplified_dashboard_series")
def q_simplified_series(spark, sf):
    """C3 panel: daily sentiment with its 3-row moving average."""
    return finalize(rp.dashboard(_orders_feature_table(spark, sf), ma_window=3, n_bins=None)["sentiment_series"])


@query("simplified_dashboard_correlation")
def q_simplified_correlation(spark, sf):
    """C3 panel: sentiment against the same day's return."""
    table = ff.with_targets(_orders_daily(spark, sf), ad.market_series(spark, sf))
    return finalize(rp.dashboard(table, 3, None, "daily_return")["sentiment_vs_return"])


@query("market_run_summary")
def q_market_run_summary(spark, sf):
    """C4: the run summary with market correlation and mean return."""
    table = ff.with_targets(_orders_daily(spark, sf), ad.market_series(spark, sf))
    return finalize(rp.market_summary(table, rp.summary(table, scale=SCALE)))


@query("regressor_cv_scores")
def q_regressor_cv_scores(spark, sf):
    """Forest, boosting and least squares over expanding folds of the next day's return."""
    table = materialize(ff.with_targets(_orders_daily(spark, sf), ad.market_series(spark, sf)))
    models = ml.regression_models()
    models["gradient_boosting"].setMaxIter(10)  # trees one after the other; more add minutes, not code
    scores, _ = ml.cross_validate(spark, table, "next_day_return", dl.DAILY_STAT_COLUMNS, "regression", models, refit=False)
    return scores


@query("regression_r2")
def q_regression_r2(spark, sf):
    t = ff.with_targets(_orders_feature_table(spark, sf), scale=SCALE)
    return finalize(ml.ols_fit_r2(t, "next_day_sentiment", "avg_sentiment"))


# --- Structured Streaming ---------------------------------------------------------------


def _events_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    ev = st.file_stream(spark, sf, schema, glob="events.parquet")
    return ad.stand_in_scores(
        ev, F.col("event_id"), F.col("ts"),
        neg=F.lit(1) + F.floor("value") % 11,
        neu=F.lit(1) + F.col("user_id") % 5,
        pos=F.lit(1) + F.col("event_id") % 7,
    )


@query("streaming_daily_index")
def q_streaming_daily_index(spark, sf):
    """X5 over the events file read as a stream (everything on time, so equal to A1)."""
    run = scratch_path(spark, f"stream-index-{uuid.uuid4().hex}")
    st.run_updates(st.daily_index_stream(_events_stream(spark, sf), scale=SCALE), f"{run}/out", f"{run}/checkpoint")
    return finalize(st.latest_daily_index(spark, f"{run}/out"))


@query("streaming_states_index")
def q_streaming_states_index(spark, sf):
    """X5 from the events file as a stream of partial states."""
    store = ds.StateStore(spark, scratch_path(spark, f"stream-states-{uuid.uuid4().hex}"))
    ds.run_states(_events_stream(spark, sf), store, f"{store.root}/checkpoint", compact_every=1, keywords={})
    return finalize(ds.index_of(store.read()))


@query("compacted_daily_index")
def q_compacted_daily_index(spark, sf):
    """The update log of the watermarked stream folded into a snapshot, with the rows that came late."""
    run = scratch_path(spark, f"stream-compacted-{uuid.uuid4().hex}")
    st.run_updates(st.daily_index_stream(_events_stream(spark, sf), scale=SCALE), f"{run}/out", f"{run}/checkpoint")
    st.compact_updates(spark, f"{run}/out", ad.scored_events(spark, sf), scale=SCALE)
    return finalize(st.latest_daily_index(spark, f"{run}/out"))


@query("incremental_scored")
def q_incremental_scored(spark, sf):
    """The raw feed as a stream: times completed and parsed, texts scored, rows appended to a
    table partitioned by day, read back."""
    run = scratch_path(spark, f"stream-scored-{uuid.uuid4().hex}")
    events = st.file_stream(spark, sf, load(spark, sf, "events").schema, glob="events.parquet")
    feed = ex.complete_feed(ad.raw_feed(spark, sf, events), AS_OF)
    scored = sc.score(feed, "Headline").withColumn("day", F.to_date(parse_time("Time"))).drop("Headline")
    st.run_to_files(scored, f"{run}/out", f"{run}/checkpoint", partition_by=["day"])
    return spark.read.parquet(f"{run}/out")


# --- option paths and small reports ---------------------------------------------------

@query("index_series")
def q_index_series(spark, sf):
    """The daily index series in date order."""
    return finalize(rp.index_series(dl.daily_index(ad.scored_events(spark, sf), scale=SCALE)))


@query("daily_stats_exact_grain")
def q_daily_stats_exact(spark, sf):
    """A2 with ``grain="exact"``: groups on the full parsed time (minutes kept)."""
    scored = fd.score_feed(ad.feed(spark, sf), AS_OF)
    return finalize(dl.daily_stats(scored, grain="exact", scale=SCALE))


@query("rolling_features_range")
def q_rolling_range(spark, sf):
    """W1-W4 with ``frame="range"``: windows count calendar days, not rows."""
    return finalize(rl.rolling_features(_orders_daily(spark, sf), frame="range", scale=SCALE))


@query("fallback_targets_null_unknown")
def q_fallback_null_unknown(spark, sf):
    t = tg.fallback_targets(_orders_feature_table(spark, sf), null_unknown=True, scale=SCALE)
    return finalize(t.select("Date", "avg_sentiment", "next_day_sentiment", "next_day_positive",
                             "next_3day_sentiment", "next_3day_positive"))


@query("keyword_merge")
def q_keyword_merge(spark, sf):
    """J1 as the reference runs it: daily statistics left-joined to keyword rows, then 0-filled."""
    rows = ad.scored_headlines(spark, sf, base="orders", match="substring")
    return finalize(dl.merge_keywords(dl.daily_stats(rows, scale=SCALE), dl.keyword_features(rows, scale=SCALE)))


@query("feed_newest_first")
def q_feed_newest_first(spark, sf):
    """O2: the completed feed sorted on parsed time, newest first."""
    feed = ex.complete_feed(ad.raw_feed(spark, sf), AS_OF).select("seq", "Time")
    # a rank column, as the order of rows is not compared
    return ex.newest_rank(feed)


@query("feed_preview")
def q_feed_preview(spark, sf):
    """The first five scored rows in feed order."""
    return rp.preview(ad.scored_events(spark, sf), 5, "seq")


@query("date_range")
def q_date_range(spark, sf):
    return rp.date_range(_orders_daily(spark, sf))


@query("confidence_sentiment_correlation")
def q_conf_corr(spark, sf):
    """C3 fallback panel: confidence against sentiment when there is no market data."""
    return finalize(rp.correlation(_orders_daily(spark, sf), "avg_confidence", "avg_sentiment"))


@query("dashboard_sentiment_series")
def q_dashboard_series(spark, sf):
    """C2 panel: daily sentiment with its 7-row moving average."""
    panels = rp.dashboard(_orders_feature_table(spark, sf), ma_window=7)
    return finalize(panels["sentiment_series"])


@query("run_report")
def q_run_report(spark, sf):
    """C4: summary, best target and model, top features of the best model."""
    return finalize(ml.run_report(spark, _market_feature_table(spark, sf)))

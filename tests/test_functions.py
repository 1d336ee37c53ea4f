"""Inline cases (FIXTURES section 4) for the scalar and window operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from headline_signals.functions import complete_time, parse_time, round4
from headline_signals.functions.keywords import keyword_hits
from headline_signals.operators import features as ft
from headline_signals.operators import market as mk
from headline_signals.operators import regimes as rg
from headline_signals.operators import report as rp
from headline_signals.operators import rolling as rl
from headline_signals.operators import targets as tg


def col_values(df, c):
    return [r[c] for r in df.collect()]


def series(spark, values, name="avg_sentiment"):
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=i), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"Date date, {name} double")


def test_complete_time(spark):
    df = spark.createDataFrame([("01:58AM",), ("Aug-07",), ("2025-09-09 02:05PM",), ("5 min",),
                                (None,), ("Foo-99",)], "t string")
    out = col_values(df.select(complete_time("t", "2025-09-09").alias("c")), "c")
    assert out == ["2025-09-09 01:58AM", "2025-08-07", "2025-09-09 02:05PM", "5 min", None, "Foo-99"]


def test_complete_time_bad_month_day_is_null(spark):
    df = spark.createDataFrame([("Aug-99",)], "t string")
    assert col_values(df.select(complete_time("t", "2025-09-09").alias("c")), "c") == [None]


def test_parse_time(spark):
    df = spark.createDataFrame([("2025-09-09 02:05PM",), ("2025-09-09",), ("Loading…",), ("",),
                                ("bad",), ("2025-09-09 2:05pm",)], "t string")
    out = col_values(df.select(parse_time("t").alias("p")), "p")
    assert out == [dt.datetime(2025, 9, 9, 14, 5), dt.datetime(2025, 9, 9), None, None, None,
                   dt.datetime(2025, 9, 9, 14, 5)]


def test_round4(spark):
    df = spark.createDataFrame([(0.00005,), (0.00015,), (0.12345,)], "x double")
    assert col_values(df.select(round4("x").alias("r")), "r") == [0.0, 0.0001, 0.1234]


def test_keyword_substring(spark):
    df = spark.createDataFrame([("Said UP supply",)], "Headline string")
    out = keyword_hits(df, keywords={"k": ["up", "ai", "war"]}).first()
    assert out["_kw_k_n"] == 2 and out["_kw_k_hit"]


def test_keyword_word_match(spark):
    df = spark.createDataFrame([("Said UP supply, trade war",)], "Headline string")
    out = keyword_hits(df, keywords={"k": ["up", "ai", "trade war"]}, match="word").first()
    assert out["_kw_k_n"] == 2


def test_trend_std_forward(spark):
    d = series(spark, [1, 4, 9, 16, 25, 36])
    daily = d.withColumns({"avg_weighted_sentiment": F.col("avg_sentiment"),
                           "headline_count": F.lit(1).cast("bigint"),
                           "avg_confidence": F.lit(0.5)})
    out = rl.rolling_features(daily, windows=(3,)).orderBy("Date").collect()
    trend = [r["sentiment_trend_3d"] for r in out]
    assert trend[:2] == [None, None]
    assert trend[2:] == pytest.approx([4.0, 6.0, 8.0, 10.0], abs=1e-12)
    std = [r["sentiment_std_3d"] for r in out]
    assert std[0] is None
    assert std[1:] == pytest.approx([2.1213203, 4.0414519, 6.0277138, 8.0208063, 10.0166528], abs=1e-6)
    fwd = tg.fallback_targets(d).orderBy("Date")
    assert col_values(fwd, "next_3day_sentiment")[:3] == pytest.approx([9.666667, 16.666667, 25.666667], abs=1e-6)
    assert col_values(fwd, "next_3day_sentiment")[3:] == [None, None, None]


def test_quantiles(spark):
    d = series(spark, [1, 4, 9, 16, 25, 36]).withColumns(
        {"sentiment_volatility": F.lit(0.0), "headline_count": F.lit(1).cast("bigint")})
    q = rg.thresholds(d).first()
    assert q["sentiment_q25"] == pytest.approx(5.25) and q["sentiment_q75"] == pytest.approx(22.75)


def test_percent_change_pads_nulls(spark):
    m = spark.createDataFrame([("S", dt.date(2025, 1, i + 1), v) for i, v in enumerate([1.0, None, 2.0])],
                              "symbol string, Date date, Close double")
    out = mk.indicators(m).orderBy("Date")
    assert col_values(out, "daily_return") == [None, 0.0, 1.0]


def test_rsi(spark):
    rising = spark.createDataFrame([("S", dt.date(2025, 1, 1) + dt.timedelta(days=i), float(i))
                                    for i in range(20)], "symbol string, Date date, Close double")
    rsi = col_values(mk.indicators(rising).orderBy("Date"), "rsi")
    assert rsi[:13] == [None] * 13 and rsi[13:] == [100.0] * 7
    flat = rising.withColumn("Close", F.lit(5.0))
    assert col_values(mk.indicators(flat), "rsi") == [None] * 20


def test_forward_fill_then_zero(spark):
    d = series(spark, [None, 1.0, None], name="x")
    out = ft.fill_features(d, ["x"]).orderBy("Date")
    assert col_values(out, "x") == [0.0, 1.0, 1.0]


def test_flag_of_null_is_zero(spark):
    d = series(spark, [None], name="avg_sentiment")
    out = tg.fallback_targets(d).first()
    assert out["next_day_positive"] == 0 and out["next_3day_positive"] == 0


def test_histogram_edges(spark):
    same = spark.createDataFrame([(0.5,)] * 7, "v double")
    h = rp.histogram(same, "v", 10).orderBy("bin").collect()
    assert [r["count"] for r in h] == [7] + [0] * 9
    empty = spark.createDataFrame([], "v double")
    h = rp.histogram(empty, "v", 10).collect()
    assert all(r["count"] == 0 for r in h)


def test_histogram_counts_sum(spark):
    df = spark.range(1000).select((F.col("id") * 0.37 % 11).alias("v"))
    h = rp.histogram(df, "v", 10).collect()
    assert sum(r["count"] for r in h) == 1000 and len(h) == 10


def test_time_folds_n8(spark):
    d = series(spark, list(range(8)))
    folds = ft.time_folds(d, k=3).collect()
    tests = sorted((r["fold"], r["row_idx"]) for r in folds if r["role"] == "test")
    assert tests == [(0, 2), (0, 3), (1, 4), (1, 5), (2, 6), (2, 7)]
    for r in folds:
        if r["role"] == "train":
            assert r["row_idx"] < 2 + 2 * r["fold"]


def test_global_index_matches_row_number(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "seq")
    out = rp.feed_pages(df).orderBy("seq").collect()
    assert [r["global_index"] for r in out] == list(range(1, len(out) + 1))
    assert out[5]["page"] == 2 and out[5]["position_in_page"] == 1


def test_complete_time_rollback_future(spark):
    df = spark.createDataFrame([("Dec-31",), ("Jan-01",)], "t string")
    out = col_values(df.select(complete_time("t", "2026-01-01", rollback_future=True).alias("c")), "c")
    assert out == ["2025-12-31", "2026-01-01"]
    out = col_values(df.select(complete_time("t", "2026-01-01").alias("c")), "c")
    assert out == ["2026-12-31", "2026-01-01"]


def test_label_codes(spark):
    from headline_signals.functions import class_to_label, label_to_class, label_to_sign
    df = spark.createDataFrame([(" Negative",), ("neutral",), ("POSITIVE",), ("other",)], "s string")
    out = df.select(label_to_class("s").alias("c")).collect()
    assert [r["c"] for r in out] == [0, 1, 2, None]
    df2 = spark.createDataFrame([(0,), (1,), (2,), (7,)], "c int")
    got = df2.select(class_to_label("c").alias("l"), label_to_sign(class_to_label("c")).alias("s")).collect()
    assert [(r["l"], r["s"]) for r in got] == [("Negative", -1), ("Neutral", 0), ("Positive", 1), (None, None)]


def test_json_array_read(spark, tmp_path):
    from headline_signals.sources import files as fs
    p = tmp_path / "index.json"
    p.write_text('[\n {"Time": "2025-09-02", "Daily_Sentiment_Index": 28.3, "Headlines_Processed": 2},\n'
                 ' {"Time": "2025-09-03", "Daily_Sentiment_Index": 56.6, "Headlines_Processed": 6}\n]')
    df = fs.read_json(spark, str(p), fs.INDEX_SCHEMA, array=True)
    assert df.count() == 2 and df.schema == fs.INDEX_SCHEMA


def test_null_text_counts_zero(spark):
    df = spark.createDataFrame([(None,)], "Headline string")
    for match in ("substring", "word"):
        out = keyword_hits(df, keywords={"k": ["up", "trade war"]}, match=match).first()
        assert out["_kw_k_n"] == 0 and out["_kw_k_hit"] is False


def test_global_index_with_small_ranges(spark):
    from headline_signals.operators.indexing import global_index
    df = spark.range(0, 3000, 7).withColumnRenamed("id", "seq")
    out = global_index(df, "seq", ranges=60).orderBy("seq").collect()
    assert [r["global_index"] for r in out] == list(range(1, len(out) + 1))

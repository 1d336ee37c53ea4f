"""Inputs that the registered queries do not feed: long decimals, timestamps, gaps, odd text."""

import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from headline_signals.functions import parse_time
from headline_signals.operators import daily as dl
from headline_signals.operators import indexing as ix
from headline_signals.operators import market as mk
from headline_signals.operators import report as rp
from headline_signals.operators import rolling as rl
from headline_signals.operators import targets as tg
from headline_signals.plans import feature_flow as ff
from headline_signals.session import scratch_path
from headline_signals.sources import adapters as ad
from headline_signals.sources import files as fs
from headline_signals.sources import html as hx
from tests.conftest import SF_SMALL

SCORED = ("seq long, Time string, Headline string, Sentiment string, Confidence double, Negative_Probability double, "
          "Neutral_Probability double, Positive_Probability double, Predicted_Class int")


def test_means_keep_all_decimals(spark):
    df = spark.createDataFrame([(1, "2025-01-02", "x", "Positive", 0.123456, 0.1, 0.2, 0.7, 2)], SCORED)
    assert dl.daily_index(df).first()["Daily_Sentiment_Index"] == pytest.approx(12.3456)


def test_csv_keeps_texts(spark):
    texts = ["  spaced  ", "", None, 'a "quoted", b', "line\nbreak\r\nand more", "tab\tend ", "\\back"]
    rows = [(i, t, t, None, 0.5, 0.1, 0.2, 0.7, 2) for i, t in enumerate(texts)]
    path = scratch_path(spark, "t-csv")
    fs.write_csv(spark.createDataFrame(rows, SCORED), path)
    got = sorted(map(tuple, fs.read_csv(spark, path, fs.SCORED_SCHEMA).collect()))
    assert got == rows


def intraday(spark, n=400):
    start = dt.datetime(2025, 1, 1, 9, 30)
    rows = [(start + dt.timedelta(minutes=95 * i), ((i * 37) % 101) / 100 - 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "Date timestamp_ntz, avg_sentiment double")
    return df.withColumns({"avg_weighted_sentiment": F.col("avg_sentiment"), "headline_count": F.lit(3),
                           "avg_confidence": F.lit(0.5)})


def test_windows_follow_the_clock_within_a_day(spark):
    df = intraday(spark)
    got = {r["Date"]: r["sentiment_ma_7d"] for r in rl.rolling_features(df, (7,), chunk_rows=64).collect()}
    plain = F.avg("avg_sentiment").over(Window.orderBy("Date").rowsBetween(-6, 0))
    assert got == {r["Date"]: pytest.approx(r["m"]) for r in df.select("Date", plain.alias("m")).collect()}


def test_window_longer_than_a_chunk(spark):
    df = intraday(spark, 120)
    got = rl.rolling_features(df, (90,), chunk_rows=16).orderBy("Date").collect()
    plain = F.avg("avg_sentiment").over(Window.orderBy("Date").rowsBetween(-89, 0))
    want = df.select("Date", plain.alias("m")).orderBy("Date").collect()
    assert [r["sentiment_ma_90d"] for r in got] == pytest.approx([r["m"] for r in want])


def market(spark, symbols=("SPY", "^VIX")):
    rows = [(s, dt.date(2024, 12, 20) + dt.timedelta(days=i), 100.0 + (i * 7) % 13) for s in symbols for i in range(60)]
    return spark.createDataFrame(rows, "symbol string, Date date, Close double")


def test_market_meets_every_time_of_a_day(spark):
    out = tg.market_targets(intraday(spark, 60), mk.indicators(market(spark))).collect()
    assert all(r["daily_return"] is not None for r in out)


def test_absent_symbols(spark):
    daily = ff.daily_feature_table(ad.scored_headlines(spark, SF_SMALL, base="events", match="substring"))
    daily = daily.withColumn("Date", F.date_add("Date", 366))
    assert "next_day_sentiment" in ff.with_targets(daily, market(spark, ("OTHER",))).columns
    assert "VIX" not in ff.with_targets(daily, market(spark, ("SPY",))).columns
    assert "VIX" in ff.with_targets(daily, market(spark)).columns


def test_days_without_a_value_win_nothing(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), None), (dt.date(2025, 1, 2), 0.2), (dt.date(2025, 1, 3), -0.2)],
                               "Date date, avg_sentiment double")
    r = rp.extreme_days(df).first()
    assert r["most_positive_day"] == dt.date(2025, 1, 2) and r["most_negative_day"] == dt.date(2025, 1, 3)
    assert rp.histogram(df.limit(0), "avg_sentiment", None).collect() == []


def test_global_index_of_any_keys(spark):
    big = (1 << 63) - 1
    keys = [-big - 1, big, 0] + [(i * 0x9E3779B97F4A7C15 + 5) % (1 << 64) - (1 << 63) for i in range(1, 3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["global_index"] for r in ix.global_index(df, "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    ranges = df.select(ix.key_range(df, "k").alias("r")).groupBy("r").count().collect()
    assert 8 <= len(ranges) <= 64 and max(r["count"] for r in ranges) < 400


def test_nested_tables_and_spans(spark):
    page = ("<table><tr><td>o1</td><td><table><tr><td>i1</td></tr><tr><td>i2</td></tr></table>x</td></tr>"
            "<tr><td rowspan=2>r</td><td colspan=2>c</td></tr><tr><td>d</td></tr><tr><td>o2</td></tr></table>"
            "<ul><li>a<ol><li>b</li></ol>c</li><li>d</li></ul>")
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = {(r["table_idx"], r["row_idx"]): r["cells"] for r in hx.html_tables(df).collect()}
    assert got == {(0, 0): ["o1", "x"], (1, 0): ["i1"], (1, 1): ["i2"], (0, 1): ["r", "c", "c"], (0, 2): ["r", "d"],
                   (0, 3): ["o2"]}
    lists = {(r["table_idx"], r["row_idx"]): r["cells"] for r in hx.html_rows(df, kind="list").collect()}
    assert lists == {(0, 0): ["ac"], (1, 0): ["b"], (0, 1): ["d"]}


def test_times_are_parsed_by_their_shape(spark):
    rows = [("2025-09-09", "2025-09-09 00:00"), ("2025-09-09 2:05pm", "2025-09-09 14:05"), ("2025/09/09", "2025-09-09 00:00"),
            ("09/10/2025", "2025-09-10 00:00"), ("Sep 9 2025", "2025-09-09 00:00"), ("2025-09-09T14:05:00", "2025-09-09 14:05"),
            ("loading...", None), ("2025-13-45", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", F.date_format(parse_time("t"), "yyyy-MM-dd HH:mm").alias("got")).collect():
        assert r["got"] == r["want"]

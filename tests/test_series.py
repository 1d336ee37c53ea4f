"""Chunked series windows equal single-partition windows, with chunk edges exercised."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from headline_signals.operators import features as ft
from headline_signals.operators import rolling as rl
from headline_signals.operators import series
from headline_signals.operators import targets as tg


def daily(spark, n=97, seed=3):
    rnd = random.Random(seed)
    rows = []
    day = dt.date(2024, 1, 1)
    for i in range(n):
        day += dt.timedelta(days=rnd.choice([1, 1, 1, 2, 3]))  # gaps, so rows != days
        rows.append((day, round(rnd.uniform(-1, 1), 4), round(rnd.uniform(-1, 1), 4),
                     rnd.randint(1, 20), round(rnd.uniform(0.3, 1), 4),
                     None if rnd.random() < 0.3 else round(rnd.uniform(0, 1), 4)))
    return spark.createDataFrame(rows, "Date date, avg_sentiment double, avg_weighted_sentiment double, "
                                       "headline_count bigint, avg_confidence double, x double")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_rolling_chunked_equals_whole(spark):
    d = daily(spark)
    for frame in ("rows", "range"):
        small = rl.rolling_features(d, frame=frame, chunk_rows=31)
        whole = rl.rolling_features(d, frame=frame, chunk_rows=4096)
        assert rows_of(small) == rows_of(whole)


def test_rolling_chunked_equals_plain_window(spark):
    d = daily(spark, n=40)
    small = {r["Date"]: r for r in rl.rolling_features(d, windows=(3, 7), chunk_rows=8).collect()}
    w = Window.orderBy("Date")
    ref = d.withColumn("ma7", F.avg("avg_sentiment").over(w.rowsBetween(-6, 0))).collect()
    for r in ref:
        assert abs(small[r["Date"]]["sentiment_ma_7d"] - r["ma7"]) < 1e-12


def test_targets_chunked_equals_whole(spark):
    d = daily(spark)
    assert rows_of(tg.fallback_targets(d, chunk_rows=5)) == rows_of(tg.fallback_targets(d))


def test_forward_fill_across_chunks(spark):
    d = daily(spark)
    got = {r["Date"]: r["x"] for r in ft.fill_features(d, ["x"], chunk_rows=4).collect()}
    w = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    ref = d.withColumn("f", F.coalesce(F.last("x", True).over(w), F.lit(0.0))).collect()
    assert all(got[r["Date"]] == r["f"] for r in ref)


def test_positions_are_dense(spark):
    d = daily(spark)
    pos = sorted(r["_pos"] for r in series.with_positions(d).collect())
    assert pos == list(range(d.count()))


def test_panel_paths_equal_per_entity_runs(spark):
    from headline_signals.operators import regimes as rg
    a = daily(spark, n=50, seed=1).withColumn("symbol", F.lit("A"))
    b = daily(spark, n=35, seed=2).withColumn("symbol", F.lit("B"))
    panel = a.unionByName(b).withColumn("sentiment_volatility", F.col("avg_confidence"))
    for sym, one in (("A", a), ("B", b)):
        one = one.withColumn("sentiment_volatility", F.col("avg_confidence"))
        got = rl.rolling_features(panel, windows=(3, 7), partition_by=["symbol"]).where(F.col("symbol") == sym)
        want = rl.rolling_features(one, windows=(3, 7), chunk_rows=9)
        assert rows_of(got.drop("symbol")) == rows_of(want.drop("symbol"))
        got = tg.fallback_targets(panel, partition_by=["symbol"]).where(F.col("symbol") == sym)
        assert rows_of(got.drop("symbol")) == rows_of(tg.fallback_targets(one, chunk_rows=4).drop("symbol"))
        got = ft.fill_features(panel, ["x"], partition_by=["symbol"]).where(F.col("symbol") == sym)
        assert rows_of(got.drop("symbol")) == rows_of(ft.fill_features(one, ["x"], chunk_rows=6).drop("symbol"))
        ok = panel.withColumn("Neutral_Probability_mean", F.lit(0.4))
        got = rg.regime_flags(ok, partition_by=["symbol"]).where(F.col("symbol") == sym)
        one2 = one.withColumn("Neutral_Probability_mean", F.lit(0.4))
        assert rows_of(got.drop("symbol")) == rows_of(rg.regime_flags(one2).drop("symbol"))


def test_market_indicators_chunked_equals_whole(spark):
    from headline_signals.operators import market as mk
    rnd = random.Random(5)
    rows = []
    for sym in ("A", "B"):
        price = 100.0
        for i in range(90):
            price = max(1.0, price + rnd.uniform(-3, 3))
            rows.append((sym, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if rnd.random() < 0.1 else round(price, 2)))
    m = spark.createDataFrame(rows, "symbol string, Date date, Close double")
    assert rows_of(mk.indicators(m, chunk_rows=23)) == rows_of(mk.indicators(m))

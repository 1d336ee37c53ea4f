"""Prefix-sum windows against window frames and pandas, and rank selection against numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headline_signals.operators import regimes as rg
from headline_signals.operators import rolling as rl
from headline_signals.operators.quantiles import exact_quantiles
from tests.test_series import daily, rows_of

COLUMNS = "Date {}, avg_sentiment double, avg_weighted_sentiment double, headline_count bigint, avg_confidence double"


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def same(got, want):
    got, want = rows_of(got), rows_of(want)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and all(close(x, y) for x, y in zip(g[1:], w[1:])), (g, w)


@pytest.mark.parametrize("scale", [None, 4])
def test_prefix_sums_equal_frames(spark, scale):
    d = daily(spark, n=150)
    d = d.withColumn("avg_sentiment", F.when(F.dayofmonth("Date") != 5, F.col("avg_sentiment")))
    same(rl.rolling_features(d, (3, 30), method="prefix", scale=scale, chunk_rows=16),
         rl.rolling_features(d, (3, 30), method="frames", scale=scale))


def test_prefix_sums_of_a_panel(spark):
    a, b = daily(spark, n=50, seed=1), daily(spark, n=35, seed=2)
    panel = a.withColumn("symbol", F.lit("A")).unionByName(b.withColumn("symbol", F.lit("B")))
    for symbol, one in (("A", a), ("B", b)):
        got = rl.rolling_features(panel, (3, 7), partition_by=["symbol"], method="prefix", chunk_rows=8)
        same(got.where(F.col("symbol") == symbol).drop("symbol"), rl.rolling_features(one, (3, 7), method="frames"))


def test_windows_longer_than_chunks(spark):
    rnd = np.random.default_rng(4)
    n, w = 3000, 1000
    values = rnd.normal(1e6, 1e-3, n)  # a small spread about a large mean
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), float(v), 0.0, i, 1.0) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, COLUMNS.format("timestamp_ntz"))
    got = sorted(rl.rolling_features(d, (w,), chunk_rows=64).collect(), key=lambda r: r["Date"])
    s = pd.Series(values)
    for i in (0, 1, 999, 1000, 2500, 2999):
        part = s[max(0, i - w + 1):i + 1]
        assert abs(got[i][f"sentiment_ma_{w}d"] - part.mean()) < 1e-7
        if i:
            assert abs(got[i][f"sentiment_std_{w}d"] - part.std()) < 1e-7
        if i >= w - 1:
            assert abs(got[i][f"sentiment_trend_{w}d"] - np.polyfit(np.arange(w), part, 1)[0]) < 1e-9


def test_calendar_windows_with_several_rows_a_day(spark):
    rnd = random.Random(8)
    at, rows = dt.datetime(2024, 2, 27, 3), []
    for i in range(400):
        at += dt.timedelta(minutes=rnd.choice([20, 300, 900, 5000]))
        rows.append((at, rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.randint(1, 9), None if rnd.random() < 0.2 else 0.5))
    d = spark.createDataFrame(rows, COLUMNS.format("timestamp_ntz"))
    got = sorted(rl.rolling_features(d, (3, 14), frame="range", chunk_rows=4).collect(), key=lambda r: r["Date"])
    before = None
    for r, row in zip(got, rows):
        for w in (3, 14):
            frame = [x for x in rows if 0 <= (row[0].date() - x[0].date()).days < w]
            mean = np.mean([x[1] for x in frame])
            assert close(r[f"sentiment_ma_{w}d"], mean) and close(r[f"headline_count_ma_{w}d"], np.mean([x[3] for x in frame]))
            known = [x[4] for x in frame if x[4] is not None]
            assert close(r[f"confidence_ma_{w}d"], np.mean(known) if known else None)
            assert close(r[f"sentiment_std_{w}d"], np.std([x[1] for x in frame], ddof=1) if len(frame) > 1 else None)
            assert close(r[f"sentiment_momentum_{w}d"], None if before is None else mean - before[f"sentiment_ma_{w}d"])
            days = [(x[0].date() - dt.date(2024, 1, 1)).days for x in frame]
            full = len(frame) == w and len(set(days)) > 1
            assert close(r[f"sentiment_trend_{w}d"], np.polyfit(days, [x[1] for x in frame], 1)[0] if full else None)
        before = r


def test_rolling_of_an_empty_series(spark):
    empty = spark.createDataFrame([], COLUMNS.format("date"))
    for frame in ("rows", "range"):
        assert rl.rolling_features(empty, frame=frame, method="prefix").collect() == []


@pytest.mark.parametrize("buckets, finish", [(1024, 10_000), (64, 2)])
def test_quantiles_equal_numpy(spark, buckets, finish):
    rng = np.random.default_rng(6)
    columns = {
        "heavy": np.exp(rng.normal(0, 40, 500)) * rng.choice([-1, 1], 500),
        "ties": rng.choice([0.0, 0.0, 0.0, 1.5, 2.0], 500),
        "close": 1 + rng.integers(0, 9, 500) * 2.0 ** -52,
        "spike": np.append(np.full(499, 3.0), 1e300),
    }
    rows = [tuple(float(c[i]) for c in columns.values()) for i in range(500)]
    df = spark.createDataFrame(rows + [(None, float("nan"), None, None)], ", ".join(f"{c} double" for c in columns))
    wanted = {f"{c}_{p}": (c, p) for c in columns for p in (0.0, 0.25, 0.5, 0.9, 1.0)}
    got = exact_quantiles(df, wanted, buckets=buckets, finish=finish).first()
    for name, (c, p) in wanted.items():
        assert got[name] == pytest.approx(np.quantile(columns[c], p), rel=1e-15, abs=0), name


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(v), None if g == "none" else i) for g in ("a", None, "none") for i, v in enumerate(rng.normal(0, 1, 60))]
    df = spark.createDataFrame(rows + [("empty", None, None)], "g string, x double, y bigint")
    got = {r["g"]: r for r in exact_quantiles(df, {"x50": ("x", 0.5), "y75": ("y", 0.75)}, ["g"], 4, 5).collect()}
    assert set(got) == {"a", None, "none", "empty"} and got["empty"]["x50"] is None and got["none"]["y75"] is None
    for g in ("a", None):
        assert got[g]["x50"] == pytest.approx(np.quantile([r[1] for r in rows if r[0] == g], 0.5))
        assert got[g]["y75"] == pytest.approx(44.25)
    empty = exact_quantiles(df.limit(0), {"x50": ("x", 0.5)})
    assert empty.collect()[0]["x50"] is None and exact_quantiles(df.limit(0), {"x50": ("x", 0.5)}, ["g"]).collect() == []


def test_thresholds_at_both_grains_agree(spark):
    d = daily(spark, n=90).withColumn("sentiment_volatility", F.col("avg_confidence") * 3)
    fine = d.withColumn("Date", F.col("Date").cast("timestamp_ntz"))
    assert tuple(rg.thresholds(d).first()) == pytest.approx(tuple(rg.thresholds(fine).first()), rel=1e-15)

"""Differential and property tests against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from headline_signals.operators import rolling as rl
from headline_signals.operators import scoring as sc

vals = st.lists(st.integers(min_value=-9999, max_value=9999).map(lambda v: v / 1e4),
                min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(vals)
def test_rolling_matches_pandas(spark, xs):
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=i), x, x, 3, 0.5) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "Date date, avg_sentiment double, avg_weighted_sentiment double, "
                                     "headline_count bigint, avg_confidence double")
    out = rl.rolling_features(df, windows=(3, 7)).orderBy("Date").toPandas()
    s = pd.Series(xs)
    for w in (3, 7):
        ma = s.rolling(w, min_periods=1).mean()
        sd = s.rolling(w, min_periods=1).std()
        assert np.allclose(out[f"sentiment_ma_{w}d"], ma, atol=1e-12)
        assert np.allclose(out[f"sentiment_std_{w}d"].astype(float), sd, atol=1e-9, equal_nan=True)
        mom = ma - ma.shift(1)
        assert np.allclose(out[f"sentiment_momentum_{w}d"].astype(float), mom, atol=1e-12, equal_nan=True)
        # closed form of the least-squares slope over consecutive positions
        k = np.arange(w) - (w - 1) / 2
        trend = [np.nan if i + 1 < w else (k * np.array(xs[i + 1 - w:i + 1])).sum() / (k * k).sum()
                 for i in range(len(xs))]
        assert np.allclose(out[f"sentiment_trend_{w}d"].astype(float), trend, atol=1e-9, equal_nan=True)


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = sc.score(docs, "text").select(
        (F.col("Negative_Probability") + F.col("Neutral_Probability") + F.col("Positive_Probability")).alias("s"),
        "Confidence", "Negative_Probability", "Neutral_Probability", "Positive_Probability").collect()
    for r in out:
        assert r["s"] == pytest.approx(1.0, abs=2e-4)
        assert r["Confidence"] == max(r["Negative_Probability"], r["Neutral_Probability"], r["Positive_Probability"])

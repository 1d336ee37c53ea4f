"""Stored pages, keyword dictionaries and batches by length."""

import datetime as dt
import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from headline_signals.functions import parse_time
from headline_signals.functions.keywords import keyword_hits
from headline_signals.operators import paging as pg
from headline_signals.operators import report as rp
from headline_signals.operators import scoring as sc
from headline_signals.session import scratch_path


def test_stored_pages_equal_sorted_ones(spark):
    keys = random.Random(3).sample(range(-10 ** 12, 10 ** 12), 503)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "seq bigint, text string").repartition(4)
    root = scratch_path(spark, f"t-pages-{uuid.uuid4().hex}")
    pg.write_pages(df, root, block_rows=52)
    assert pg.stored_page_count(spark, root) == 101
    for page in (1, 10, 11, 57, 101):
        got = sorted(map(tuple, pg.read_page(spark, root, page).collect()))
        assert got == sorted(map(tuple, rp.feed_page(df, page).collect())) and got
    assert pg.read_page(spark, root, 102).collect() == []
    files = pg.read_page(spark, root, 101).select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "/block=10/" in files[0][0]
    pg.write_pages(df.limit(3), root)
    assert pg.stored_page_count(spark, root) == 1 and pg.read_page(spark, root, 1).count() == 3


def test_large_dictionaries_match_like_small_ones(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcd ", k=rnd.randint(1, 6))).strip() or "x" for _ in range(300)] + ["ai", "é✓"]
    texts = [None, "", "a", "AI said é✓", "the war on up", *["".join(rnd.choices("abcd é", k=rnd.randint(1, 200))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, Headline string")
    keywords = {"one": sorted(set(words[:150])), "two": sorted(set(words[150:])), "none": []}
    small = keyword_hits(df, keywords=keywords, many=10 ** 9).orderBy("i").collect()
    assert keyword_hits(df, keywords=keywords, many=1).orderBy("i").collect() == small


def test_length_batches():
    lengths = [5, 900, 0, 5, 5, 40, 5000, 1]
    parts = list(sc.length_batches(lengths, most=3, chars=1000))
    assert sorted(i for p in parts for i in p) == list(range(8))
    assert all(len(p) <= 3 and (len(p) == 1 or len(p) * max(lengths[i] for i in p) <= 1000) for p in parts)
    assert [6] in parts and list(sc.length_batches([], 3, 10)) == []


def test_batch_scores_keep_their_rows(spark):
    def make():
        seen = []

        def predict(texts):
            n = np.array([len(t or "") for t in texts], float)
            seen.append(n.max() * len(n))
            assert seen[-1] <= 300 or len(n) == 1
            return np.stack([np.zeros_like(n), np.ones_like(n), n % 3], axis=1)
        return predict

    texts = [None, "", "x" * 10_000, *["ab" * (i % 40) for i in range(100)]]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "i int, t string, other array<int>")
    got = sc.score(df, "t", sc.BatchModelScorer(make, logits=True, batch_chars=300)).orderBy("i").collect()
    assert [r["Predicted_Class"] for r in got] == [2 if len(t or "") % 3 == 2 else 1 for t in texts]
    assert [r["other"] for r in got] == [[i] for i in range(len(texts))]


def test_times_by_shape(spark):
    cases = {
        "2024-01-05": dt.datetime(2024, 1, 5), " 2024-01-05 2:05pm ": dt.datetime(2024, 1, 5, 14, 5),
        "2024-01-05 12:30AM": dt.datetime(2024, 1, 5, 0, 30), "2024-01-05 12:30PM": dt.datetime(2024, 1, 5, 12, 30),
        "2024-01-05 13:30PM": None, "2024-01-05 0:30AM": None, "2024/02/29": dt.datetime(2024, 2, 29), "2023/02/29": None,
        "12/31/2023": dt.datetime(2023, 12, 31), "31/12/2023": None, "Aug 7 2024": dt.datetime(2024, 8, 7),
        "AUG 07 2024": dt.datetime(2024, 8, 7), "Ugs 7 2024": None, "Feb 30 2024": None, "": None, "Loading...": None,
        "2024-01-05 14:05:06": dt.datetime(2024, 1, 5, 14, 5, 6), "nonsense": None, "2024-01-05 1:30XM": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(parse_time("t")).collect()] == list(cases.values())

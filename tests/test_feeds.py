"""Texts scored and matched once each, and what published rows take on disk."""

import os
import random
import time
import uuid
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headline_signals.functions.keywords import KEYWORDS, keyword_hits, mention_count
from headline_signals.functions.labels import PLACEHOLDER
from headline_signals.functions.word_match import STEP, WordMatcher, plain
from headline_signals.operators import extract as ex
from headline_signals.operators import feeds as fd
from headline_signals.operators import scoring as sc
from headline_signals.operators.partitioning import shuffles_dropped
from headline_signals.plans import refresh as rf
from headline_signals.session import scratch_path
from headline_signals.sources import files as fs

AS_OF = "2024-01-31"


def small_feed(spark, extra=()):
    rows = spark.createDataFrame(
        [(1, "Jan-05", 0, False), (2, "10:00AM", 1, False), (3, "2024-01-07", 0, True), (4, "x", 9, False),
         (5, None, None, False), (6, "2024-01-08", 2, False), (6, "2024-01-08", 2, False), (7, "2024-01-09", 3, False),
         (None, "2024-01-09", 4, False), *extra], "seq bigint, Time string, doc_id bigint, loading boolean")
    texts = spark.createDataFrame(
        [(0, "Rally and GAIN"), (1, "fall, drop"), (1, "soar"), (2, PLACEHOLDER), (3, None), (4, ""), (None, "up")],
        "doc_id bigint, Headline string")
    return fd.Feed(rows, texts)


def collected(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("with_text", [False, True])
def test_feed_of_references_scores_like_its_rows(spark, with_text):
    feed = small_feed(spark)
    want = keyword_hits(sc.score(ex.complete_feed(feed.joined(), AS_OF), "Headline"), "Headline")
    got = fd.score_feed(feed, AS_OF, with_text=with_text, keywords=KEYWORDS)
    want = want if with_text else want.drop("Headline")
    assert got.columns == want.columns and collected(got) == collected(want)
    assert collected(fd.score_feed(feed.joined(), AS_OF, with_text=with_text, keywords=KEYWORDS)) == collected(want)


def test_each_text_is_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def predict(texts):
            seen.add(len(texts))
            return [[0.2, 0.3, 0.5]] * len(texts)
        return predict

    rows = spark.range(400).select(F.col("id").alias("seq"), F.lit("2024-01-05").alias("Time"),
                                   (F.col("id") % 4).alias("doc_id"), F.lit(False).alias("loading"))
    texts = spark.range(4).select(F.col("id").alias("doc_id"), F.lit("a b").alias("Headline"))
    out = fd.score_feed(fd.Feed(rows, texts), AS_OF, sc.BatchModelScorer(make)).collect()
    assert len(out) == 400
    assert seen.value <= 2 * (4 + 1)  # and the null text; never once a row


def test_published_texts_take_little_more_room_than_once(spark):
    words = [uuid.uuid4().hex for _ in range(300)]
    texts = spark.createDataFrame([(i, " ".join(words[i:] + words[:i]) + ',"\n') for i in range(4)], "doc_id bigint, Headline string")
    rows = spark.range(2_000).select(F.col("id").alias("seq"), F.lit("2024-01-05").alias("Time"),
                                     (F.col("id") % 4).alias("doc_id"), F.lit(False).alias("loading"))
    root = scratch_path(spark, f"feeds-{uuid.uuid4().hex}")
    paths = rf.refresh(spark, fd.Feed(rows, texts), root, AS_OF)
    folder = os.path.dirname(paths["scored"]).removeprefix("file:")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    assert size < 2_000 * 300 * 33 / 10  # one copy of all rows is 20 MB, and four were written
    back = fs.read_csv(spark, paths["scored"], fs.SCORED_SCHEMA)
    want = rows.join(texts, "doc_id").select("seq", "Headline")
    assert back.count() == 2_000 and collected(back.select("seq", "Headline")) == collected(want)
    assert fs.read_json(spark, paths["scored_json"], fs.SCORED_SCHEMA).count() == 2_000


LISTS = [["up", "ai", "war", "trade war", "high", "a"], ["federal reserve", "federal bank", "war", "record"], []]
TEXTS = ["said up, ai", "UPWARD wars", None, "", "trade war", "trade  war", "the federal reserve", "xfederal reserve",
         "federal bank1", "aié éwar up€", "up", "a" * 7, "record\nhigh", "war" + " " * 40 + "high"]


@pytest.mark.parametrize("match", ["word", "substring"])
def test_matcher_counts_like_the_expressions(spark, match):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("l", F.lower("t"))
    want = [[r[f"c{j}"] for j in range(3)] for r in df.select("i", *[
        mention_count(F.col("l"), ws, match).alias(f"c{j}") for j, ws in enumerate(LISTS[:2])], F.lit(0).alias("c2")).orderBy("i").collect()]
    lowered = pa.array([r["l"] for r in df.orderBy("i").collect()])
    matcher = WordMatcher(LISTS, match == "word")
    assert matcher.counts(lowered).tolist() == want
    assert matcher.counts(lowered.slice(3, 8)).tolist() == want[3:11]
    one = keyword_hits(df, "t", {"a": LISTS[0], "b": LISTS[1]}, match).orderBy("i").collect()
    assert [[r["_kw_a_n"], r["_kw_b_n"], 0] for r in one] == want


def test_matcher_across_steps_and_with_a_large_dictionary():
    words = [f"{i:05d}{'x' * (i % 6)}" for i in range(2_000)]
    text = "." * (STEP - 3) + words[7] + "." * (STEP - 9) + words[1234] + words[11]
    texts = pa.array([text, words[7][:-1], "", None, words[5]])
    want = [[sum(w in (t or "") for w in words)] for t in texts.to_pylist()]
    assert WordMatcher([words]).counts(texts).tolist() == want
    assert WordMatcher([["", "q"]]).counts(pa.array(["", None, "q"])).tolist() == [[1], [0], [2]]
    assert plain(["a b", "x1"]) and not plain(["s&p"]) and not plain(["a  b"])


def test_classifier_reads_its_texts_once(spark):
    from headline_signals.plans import modeling as ml
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(i):
        seen.add(1)
        return ("good gain", "bad loss", "flat market")[i % 3] + f" w{i % 5}"

    rows = spark.range(0, 60, 1, 2).select(read("id").alias("text"), (F.col("id") % 3).alias("label"))
    model = ml.train_text_classifier(rows)
    assert seen.value <= 2 * 60  # written once (a checkpoint runs its plan twice)
    assert len(model.stages) == 4
    assert model.transform(spark.createDataFrame([("bad loss",)], "text string")).first()["prediction"] == 1


def _written(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("part-*") if f.is_file())


def test_published_rows_of_one_long_text_take_little_room(spark, tmp_path):
    """Texts far beyond the 32 KB that gzip looks back, ten rows each: every output about as large as the texts once."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(12_000)) for _ in range(4)]
    rows = spark.createDataFrame([(10 * i + j, "2024-01-03", i, False) for i in range(4) for j in range(10)],
                                 "seq long, Time string, doc_id long, loading boolean")
    heads = spark.createDataFrame(list(enumerate(texts)), "doc_id long, Headline string")
    paths = rf.refresh(spark, fd.Feed(rows, heads), str(tmp_path / "out"), "2024-01-30")
    once = len(zlib.compress("".join(texts).encode(), 9))
    for name in ("headlines", "scored", "scored_json"):
        assert once / 2 < _written(paths[name]) < 2 * once, name
    for got in (fs.read_csv(spark, paths["scored"], fs.SCORED_SCHEMA), fs.read_json(spark, paths["scored_json"], fs.SCORED_SCHEMA)):
        assert {r["seq"]: r["Headline"] for r in got.collect()} == {10 * i + j: texts[i] for i in range(4) for j in range(10)}


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    def shuffles():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {local.apply(i).getName() for i in range(local.size()) if "shuffle_" in local.apply(i).getName()}

    def write(name):
        before = shuffles()
        spark.range(2000).repartition(7).write.parquet(str(tmp_path / name))
        for _ in range(50):  # files are deleted in the background
            if not (left := shuffles() - before):
                break
            time.sleep(0.1)
        return left

    with shuffles_dropped(spark):
        assert not write("a")
    assert write("b")  # the setting is as it was

"""Generations, partial states and the compacted update log: equal to one pass over all rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from headline_signals.operators import daily as dl
from headline_signals.plans import day_states as ds
from headline_signals.plans import refresh as rf
from headline_signals.plans.queries import finalize
from headline_signals.session import scratch_path
from headline_signals.sources import generations as gn
from headline_signals.streaming import incremental as st

SCHEMA = ("seq bigint, Time timestamp_ntz, Headline string, Confidence double, Negative_Probability double, "
          "Neutral_Probability double, Positive_Probability double, Predicted_Class int")


def scored(spark, n=400, seed=1, days=9, decimals=6):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        p = [rnd.random() for _ in range(3)]
        p = [round(x / sum(p), decimals) for x in p]
        day = None if rnd.random() < 0.05 else f"2024-01-{1 + rnd.randrange(days):02d} {rnd.randrange(24):02d}:00:00"
        rows.append((i, day, rnd.choice(["stocks surge on ai", "war and tariffs", "quiet day", None]),
                     None if rnd.random() < 0.1 else max(p), *p, rnd.choice([0, 1, 2, None])))
    df = spark.createDataFrame(rows, SCHEMA.replace("Time timestamp_ntz", "Time string"))
    return df.withColumn("Time", F.col("Time").cast("timestamp_ntz"))


def fresh(spark, name):
    return scratch_path(spark, f"t-{name}-{uuid.uuid4().hex}")


def rows_of(df):
    return sorted((tuple(r) for r in finalize(df).collect()), key=repr)


def test_states_of_three_batches_equal_one_pass(spark):
    rows = scored(spark)
    store = ds.StateStore(spark, fresh(spark, "states"))
    for i, part in enumerate(ds.split_batches(rows, "seq", 3)):
        ds.add_batch(store, i, part)
        ds.add_batch(store, i, part)  # run again: replaces itself
        if i == 1:
            assert store.compact() == 1 and store.compact() == 1
            ds.add_batch(store, 1, part)  # in the snapshot already
    states = store.read()
    assert rows_of(ds.index_of(states)) == rows_of(dl.daily_index(rows))
    assert rows_of(ds.stats_of(states)) == rows_of(dl.daily_stats(rows))
    want = dl.daily_features(rows)
    assert rows_of(ds.features_of(states).select(want.columns)) == rows_of(want)


def test_reading_costs_the_days_and_the_tail(spark):
    store = ds.StateStore(spark, fresh(spark, "states"))
    for i in range(6):
        ds.add_batch(store, i, scored(spark, 30, seed=i), keywords={})
    assert store.compact() == 5
    ds.add_batch(store, 6, scored(spark, 30, seed=9), keywords={})
    files = [r[0] for r in store.tail(5).select(F.input_file_name()).distinct().collect()]
    assert files and all("batch=6" in f for f in files)
    assert store.compact() == 6  # both kept snapshots hold the batches up to 5, whose folders are gone
    assert {r["batch"] for r in store.tail(-1).select("batch").collect()} == {6}
    assert spark.read.parquet(gn.current(spark, f"{store.root}/snapshots").path("states")).count() <= 9


def test_store_without_batches(spark):
    store = ds.StateStore(spark, fresh(spark, "states"))
    assert store.compact() == -1
    with pytest.raises(ValueError):
        store.read()
    ds.add_batch(store, 0, scored(spark).limit(0))
    assert ds.index_of(store.read()).collect() == []


def test_a_killed_publication_leaves_the_one_before(spark):
    root = fresh(spark, "generations")
    assert gn.current(spark, root) is None
    good = spark.range(3).withColumnRenamed("id", "a")
    gn.publish_generation(spark, root, [("x", good, "parquet"), ("y", good, "csv")])
    broken = good.withColumn("a", F.when(F.col("a") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="killed"):
        gn.publish_generation(spark, root, [("x", spark.range(9), "parquet"), ("y", broken, "csv")])
    now = gn.current(spark, root)
    assert now.number == 0 and spark.read.parquet(now.path("x")).count() == 3
    with pytest.raises(KeyError):
        now.path("z")
    gn.publish_generation(spark, root, [("x", spark.range(5), "parquet")], notes={"upto": "7"})
    gn.publish_generation(spark, root, [("x", spark.range(6), "parquet")])
    assert gn.drop_older(spark, root, keep=1) == [0, 1]
    assert [g.number for g in gn.generations(spark, root)] == [2]
    assert spark.read.parquet(gn.current(spark, root).path("x")).count() == 6


def test_refresh_publishes_one_generation(spark):
    feed = spark.createDataFrame([(1, "Jan-05", "markets rally"), (2, "10:00AM", "stocks fall"), (3, "x", None)],
                                 "seq bigint, Time string, Headline string")
    root = fresh(spark, "refresh")
    assert [r["has_data"] for r in rf.snapshot_status(spark, root, "2024-01-31").collect()] == [False, False]
    first = rf.refresh(spark, feed, root, "2024-01-31")
    second = rf.refresh(spark, feed.limit(1), root, "2024-01-31", published_at="2024-01-31 00:10:00")
    assert set(first) == set(second) and first["index"] != second["index"]
    assert rf.published(spark, root) == second
    status = {r["table_name"]: r for r in rf.snapshot_status(spark, root, "2024-01-31 00:30:00").collect()}
    assert status["scored"]["rows"] == 1 and not status["scored"]["stale"]


def test_update_log_keeps_every_decimal_and_late_rows(spark):
    """Two runs of the stream; rows of the second that lie behind the watermark are folded in."""
    run = fresh(spark, "log")
    rows = scored(spark, 300, decimals=6)
    early, late = rows.where("seq < 200"), rows.where("seq >= 200")
    early.coalesce(1).write.parquet(f"{run}/in/a")
    end = spark.createDataFrame([(1000, "2024-02-20 00:00:00", "x", 0.123456, 0.1, 0.1, 0.8, 2)],
                                SCHEMA.replace("Time timestamp_ntz", "Time string")).withColumn(
        "Time", F.col("Time").cast("timestamp_ntz"))

    def stream():
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{run}/in")
        st.run_updates(st.daily_index_stream(source), f"{run}/out", f"{run}/checkpoint")

    stream()
    assert rows_of(st.latest_daily_index(spark, f"{run}/out")) == rows_of(dl.daily_index(early))
    end.coalesce(1).write.parquet(f"{run}/in/b")  # moves the watermark past all other days
    stream()
    late.coalesce(1).write.parquet(f"{run}/in/c")
    stream()
    everything = rows.unionByName(end)
    want = rows_of(dl.daily_index(everything))
    assert rows_of(st.latest_daily_index(spark, f"{run}/out")) != want  # the stream dropped them
    upto = st.compact_updates(spark, f"{run}/out", everything)
    assert rows_of(st.latest_daily_index(spark, f"{run}/out")) == want
    assert any(abs(r["Daily_Sentiment_Index"] - 12.3456) < 1e-9 for r in st.latest_daily_index(spark, f"{run}/out").collect()
               if r["Daily_Sentiment_Index"] is not None)
    assert st.compact_updates(spark, f"{run}/out") == upto
    assert rows_of(st.latest_daily_index(spark, f"{run}/out")) == want


def test_stream_of_states_has_no_late_rows(spark):
    run = fresh(spark, "states-stream")
    rows = scored(spark, 200)
    store = ds.StateStore(spark, f"{run}/store")
    for i, name in enumerate("abc"):
        rows.where(F.col("seq") % 3 == i).coalesce(1).write.parquet(f"{run}/in/{name}")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{run}/in")
        ds.run_states(source, store, f"{run}/checkpoint", compact_every=2, keywords={})
    assert rows_of(ds.index_of(store.read())) == rows_of(dl.daily_index(rows))
    assert gn.current(spark, f"{store.root}/snapshots").notes["upto"] == "1"

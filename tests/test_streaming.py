"""X5 over arbitrarily split files equals the batch index when nothing is late; X4 appends."""

import uuid

from pyspark.sql import functions as F

from headline_signals.operators import daily as dl
from headline_signals.plans.queries import finalize
from headline_signals.session import scratch_path
from headline_signals.sources import adapters as ad
from headline_signals.streaming import incremental as st
from tests.conftest import SF_SMALL


def test_stream_over_split_files_equals_batch(spark):
    run = scratch_path(spark, f"t-stream-{uuid.uuid4().hex}")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # three files in time order, read one per trigger
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for i in range(3):
        (ev.where((F.col("ts") >= bounds[i]) & (F.col("ts") < bounds[i + 1]))
         .coalesce(1).write.parquet(f"{run}/in/part{i}"))
        # flatten into the input folder
    src_files = [f"{run}/in/part{i}" for i in range(3)]
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(f"{run}/in")
    scored = ad.stand_in_scores(stream, F.col("event_id"), F.col("ts"),
                                neg=F.lit(1) + F.floor("value") % 11,
                                neu=F.lit(1) + F.col("user_id") % 5,
                                pos=F.lit(1) + F.col("event_id") % 7)
    st.run_updates(st.daily_index_stream(scored), f"{run}/out", f"{run}/ckpt")
    got = finalize(st.latest_daily_index(spark, f"{run}/out")).collect()
    want = finalize(dl.daily_index(ad.scored_events(spark, SF_SMALL))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(src_files) == 3


def test_incremental_append(spark):
    from headline_signals.plans.queries import QUERIES
    df = QUERIES["incremental_scored"](spark, SF_SMALL)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert df.count() == events.where("event_type <> 'error'").count()
    assert "day" in df.columns

"""Incremental refresh (X4) and a streaming daily index.

* X4: new feed files -> scored rows appended to a Parquet table partitioned by day.
  File source + stateless projections + file sink: exactly-once through the stream's
  checkpoint, with nothing kept in state.
* X5: the daily index kept current per day: event-time windows of one day with a
  watermark, emitted in update mode. Each micro-batch's updated days are written under
  ``batch=<n>`` (a rerun of a batch overwrites its own folder, so the sink is idempotent).
  ``compact_updates`` folds that log into a snapshot with one row per day, published as a
  generation; the current index is the snapshot and the batches after it. Rows later than
  the watermark are dropped by the stream; the compaction counts the rows of days that are
  closed and adds up again those that miss some. ``plans.day_states`` keeps the index from
  partial states instead, where nothing is ever late.

Checkpoints and outputs go to the shared checkpoint folder (``spark.checkpoint.dir``)
or any shared path given, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import class_to_sign, exact_sum
from ..functions.timeparse import day_of
from ..operators.partitioning import materialize
from ..sources import generations as gn


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file source over the files of ``folder`` (optionally those matching ``glob``)
    with a declared schema; new files are picked up by later triggers."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def event_instant(col: str) -> "F.Column":
    """A wall-clock ``timestamp_ntz`` as the instant with the same UTC wall clock.

    Watermarks need ``TIMESTAMP``; going through epoch microseconds keeps one-day
    windows on calendar days whatever the session time zone is.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.timestamp_micros(micros)


def run_to_files(df: DataFrame, out_path: str, checkpoint: str, partition_by: list[str] | None = None,
                 fmt: str = "parquet") -> None:
    """X4 sink: append every available input, then stop (``availableNow``)."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(out_path)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _score(class_col: str, confidence_col: str) -> Column:
    return class_to_sign(class_col) * F.col(confidence_col)


def _sums(score: Column, scale: int | None) -> list[Column]:
    total = F.sum(score) if scale is None else exact_sum(score, scale)
    return [total.alias("score_sum"), F.count(score).alias("scored_rows"), F.count(F.lit(1)).alias("Headlines_Processed")]


def daily_index_stream(scored: DataFrame, time_col: str = "Time", watermark: str = "1 day",
                       class_col: str = "Predicted_Class", confidence_col: str = "Confidence",
                       scale: int | None = None) -> DataFrame:
    """Per one-day event-time window, the score sum, the scored-row count and the row count; the
    index is ``100 * sum / count`` (see ``latest_daily_index``). ``scale``: the decimals that
    confidences carry, if known; the sum is then exact."""
    dtype = scored.schema[time_col].dataType.simpleString()
    rows = scored.withColumn("_event_at", event_instant(time_col) if dtype == "timestamp_ntz"
                             else F.col(time_col))
    return (rows.withWatermark("_event_at", watermark)
            .groupBy(F.window("_event_at", "1 day").alias("w"))
            .agg(*_sums(_score(class_col, confidence_col), scale)))


def run_updates(agg: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run an update-mode aggregate over all available input; each micro-batch's
    updated rows go to ``out_path/batch=<n>`` (overwritten on replay)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}"))

    q = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _day(window: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(F.col(f"{window}.start")) / 86_400_000_000).cast("int"))


def _current(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest row per day (``Time``, sums and ``batch``) of snapshot and log. Of the log only batches
    after the snapshot are read."""
    columns = ["Time", "score_sum", "scored_rows", "Headlines_Processed", "batch"]
    snapshot = gn.current(spark, f"{out_path.rstrip('/')}-snapshots")
    log = spark.read.parquet(out_path)
    rows = log.where(F.col("batch") > (int(snapshot.notes["upto"]) if snapshot else -1)).select(
        _day("w").alias("Time"), *columns[1:])
    if snapshot:
        rows = spark.read.parquet(snapshot.path("days")).select(columns).unionByName(rows)
    last = Window.partitionBy("Time").orderBy(F.col("batch").desc())
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def compact_updates(spark: SparkSession, out_path: str, scored: DataFrame | None = None, time_col: str = "Time",
                    class_col: str = "Predicted_Class", confidence_col: str = "Confidence",
                    scale: int | None = None, keep: int = 2) -> int:
    """Publish the current row of every day as the next snapshot; the last batch in it.

    ``scored``: the table of all rows that the stream has read (X4 writes it). Its rows are
    counted per day, and days that lack rows in the log, because those came after the watermark,
    are added up again from the table. Run it between runs of the stream.
    """
    days = _current(spark, out_path)
    upto = spark.read.parquet(out_path).agg(F.max("batch")).first()[0]
    before = gn.current(spark, f"{out_path.rstrip('/')}-snapshots")
    upto = max(-1 if upto is None else upto, int(before.notes["upto"]) if before else -1)
    if scored is not None:
        rows = scored.withColumn("_day", day_of(scored, time_col)).where(F.col("_day").isNotNull())
        counted = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
        short = materialize(counted.join(days.select("Time", "Headlines_Processed"), F.col("_day") == F.col("Time"), "left")
                            .where(F.coalesce("Headlines_Processed", F.lit(0)) < F.col("_n")).select("_day"))
        again = rows.join(short, "_day", "left_semi").groupBy(F.col("_day").alias("Time")).agg(
            *_sums(_score(class_col, confidence_col), scale)).withColumn("batch", F.lit(upto).cast("int"))
        days = days.join(short, F.col("Time") == F.col("_day"), "left_anti").unionByName(again)
    gn.publish_generation(spark, f"{out_path.rstrip('/')}-snapshots", [("days", days, "parquet")], notes={"upto": str(upto)})
    gn.drop_older(spark, f"{out_path.rstrip('/')}-snapshots", keep)
    return upto


def latest_daily_index(spark: SparkSession, out_path: str) -> DataFrame:
    """The current daily index: the latest row per day of the snapshot and of the batches after it."""
    return _current(spark, out_path).select(
        "Time", (F.col("score_sum").cast("double") / F.col("scored_rows") * 100).alias("Daily_Sentiment_Index"),
        "Headlines_Processed")

"""Batch refresh and snapshot status.

``refresh`` runs the batch flow of SURVEY 3.1 as Spark jobs and publishes its outputs:
headlines, scored rows (CSV and JSON) and the daily index (CSV and JSON). The scored
table is written once as Parquet and read back by the later steps, so scoring runs
once and the index job starts from a short lineage. Files are compressed; rows of one text
are neighbours in them (``operators.feeds``), so a text that many rows show takes little
more room than once. All outputs of a run form one generation
(``sources.generations``): they become current together, by the manifest row written last.
``refresh_new`` reads new rows only and brings the daily tables up to date from partial states.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import KEYWORDS, parse_time
from ..operators import daily as dl
from ..operators import feeds as fd
from ..operators.partitioning import shuffles_dropped
from ..sources import files as fs
from ..sources import generations as gn
from . import day_states as ds


#: Published outputs: name and format.
OUTPUTS = (("headlines", "csv"), ("scored", "csv"), ("scored_json", "json"), ("index", "csv"), ("index_json", "json"))


def refresh(spark: SparkSession, feed: fd.Feed | DataFrame, out_dir: str, as_of: _dt.date | str,
            scorer=None, published_at: str | None = None, keep: int = 2) -> dict[str, str]:
    """Extract -> complete times -> score -> index; the outputs replace those before as one.

    Scored rows and index are written once and published from there. ``published_at``
    (default: now) is when the outputs are complete. A run that fails leaves the generation
    before as the current one; of complete generations the newest ``keep`` stay.
    """
    folder = gn.new_folder(out_dir)
    with shuffles_dropped(spark):  # the texts' shuffle is as large as the table it makes
        fs.write_parquet(fd.score_feed(feed, as_of, scorer, with_text=True), f"{folder}/_scored", compression="zstd")
    scored = spark.read.parquet(f"{folder}/_scored")
    fs.write_parquet(dl.daily_index(scored, scale=4), f"{folder}/_index")  # the scorer rounds to 4 decimals
    index = spark.read.parquet(f"{folder}/_index")
    tables = {"headlines": scored.select("Time", "Headline"), "scored": scored, "scored_json": scored,
              "index": index, "index_json": index}
    fs.publish([(name, tables[name], fmt) for name, fmt in OUTPUTS], folder, compression="zstd")
    gn.complete(spark, out_dir, folder, dict(OUTPUTS) | {"_scored": "parquet", "_index": "parquet"}, published_at)
    gn.drop_older(spark, out_dir, keep)
    return published(spark, out_dir)


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """Paths of the current generation's outputs; empty if none is complete."""
    now = gn.current(spark, out_dir)
    return {name: now.path(name) for name in now.formats} if now else {}


def refresh_new(store: ds.StateStore, batch_id: int, feed: fd.Feed | DataFrame, as_of: _dt.date | str, scorer=None) -> None:
    """X3 for new rows alone: they are completed, scored and added to ``store`` as one batch, which then
    answers for the daily index, statistics and keyword features of all rows so far. A batch that
    is run again replaces itself."""
    ds.add_batch(store, batch_id, fd.score_feed(feed, as_of, scorer, keywords=KEYWORDS))


def freshness(df: DataFrame, time_col: str, as_of: str, max_age: str = "1 hour",
              name: str = "table", published_at: object = None) -> DataFrame:
    """One status row: rows, whether there is data, the time of the last update, and
    ``stale`` (no such time, or older than ``as_of - max_age``). The last update is
    ``published_at``, if given, else the newest ``time_col``."""
    dtype = df.schema[time_col].dataType.simpleString()
    if published_at is None:
        t = F.max(parse_time(time_col) if dtype == "string" else F.col(time_col).cast("timestamp_ntz"))
    else:
        t = F.lit(published_at).cast("timestamp_ntz")
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {max_age}")
    return (df.agg(F.count(F.lit(1)).alias("rows"), t.alias("last_update"))
            .select(F.lit(name).alias("table_name"), "rows", (F.col("rows") > 0).alias("has_data"),
                    "last_update",
                    (F.col("last_update").isNull() | (F.col("last_update") < limit)).alias("stale")))


def snapshot_status(spark: SparkSession, out_dir: str, as_of: str) -> DataFrame:
    """X2 over the current generation: status of the scored rows and of the daily index, by when it
    was published. Rows are counted in the Parquet tables that the outputs were written from;
    without a generation there is no data and the status is stale."""
    now = gn.current(spark, out_dir)
    empty = spark.createDataFrame([], "Time string")
    parts = [freshness(spark.read.parquet(now.path(table)) if now else empty, "Time", as_of, name=name,
                       published_at=now.published_at if now else None)
             for name, table in (("scored", "_scored"), ("index", "_index"))]
    return parts[0].unionByName(parts[1])

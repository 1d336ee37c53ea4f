"""Distributed windows over one long ordered series.

A window without ``partitionBy`` puts the whole series in one task. Here a series is cut
into chunks of ``chunk_rows`` consecutive rows instead:

1. every row gets its global position (``indexing.global_index`` on the day number or the
   microsecond: per-range counts and running offsets, no single-task numbering);
2. row ``p`` belongs to chunk ``p // chunk_rows``; rows near a chunk edge are also
   copied into the neighbouring chunk as *halo* rows (``lookback`` rows at the end of a
   chunk go to the next one, ``lookahead`` rows at its start to the previous one), in
   one ``explode``, without re-reading the input;
3. windows are partitioned by chunk and ordered by position; every frame that reaches
   at most ``lookback`` rows back and ``lookahead`` rows ahead sees exactly the rows it
   would see on the whole series;
4. halo copies are dropped.

Each task holds one chunk plus its halo, so the series length no longer bounds a task.
A table that already carries ``_pos`` (numbered once upstream) is not numbered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .indexing import global_index
from .partitioning import materialize

CHUNK_ROWS = 4096


def with_positions(df: DataFrame, order_col: str = "Date", out_col: str = "_pos",
                   partition_by: list[str] | None = None) -> DataFrame:
    """0-based position of each row in ``order_col`` order (dates, timestamps or integers; a
    series holds each value once, equal ones would be placed in any order).

    Numbering reads its input three times (key span, bucket counts, rows), so the input
    is checkpointed first: it is computed once, and stacked series steps keep short
    plans instead of nesting each other's lineage.
    """
    df = materialize(df)
    keyed = df.withColumn("_order_key", _order_key(df, order_col).cast("bigint"))
    return (global_index(keyed, "_order_key", out_col=out_col, partition_by=partition_by)
            .withColumn(out_col, F.col(out_col) - 1).drop("_order_key"))


def _order_key(df: DataFrame, col: str) -> Column:
    """An integer that orders like ``col``: a date's day number, a timestamp's microsecond."""
    kind = df.schema[col].dataType.simpleString()
    if kind == "date":
        return F.unix_date(col)
    if kind == "timestamp":
        return F.unix_micros(col)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.col(col)


def chunked(df: DataFrame, order_col: str = "Date", lookback: int = 0, lookahead: int = 0,
            chunk_rows: int = CHUNK_ROWS, partition_by: list[str] | None = None) -> DataFrame:
    """Rows with ``_pos``, ``_chunk`` and ``_halo``; edge rows copied to neighbour chunks. Chunks are
    longer than ``chunk_rows`` where a window reaches further."""
    chunk_rows = max(chunk_rows, lookback + 1, lookahead + 1)
    pos = df if "_pos" in df.columns else with_positions(df, order_col, partition_by=partition_by)
    p, c = F.col("_pos"), F.floor(F.col("_pos") / chunk_rows)
    off = p % chunk_rows
    copies = F.array(
        F.struct(c.alias("chunk"), F.lit(False).alias("halo")),
        F.when(off >= chunk_rows - lookback, F.struct((c + 1).alias("chunk"), F.lit(True).alias("halo"))),
        F.when((off < lookahead) & (c > 0), F.struct((c - 1).alias("chunk"), F.lit(True).alias("halo"))),
    )
    return (pos.withColumn("_copy", F.explode(F.filter(copies, lambda x: x.isNotNull())))
            .withColumn("_chunk", F.col("_copy.chunk")).withColumn("_halo", F.col("_copy.halo"))
            .drop("_copy"))


def chunk_window(partition_by: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(partition_by or []), "_chunk").orderBy("_pos")


def unchunk(df: DataFrame, keep_pos: bool = False) -> DataFrame:
    """Drop halo copies and the helper columns (``_pos`` too unless ``keep_pos``)."""
    out = df.where(~F.col("_halo")).drop("_chunk", "_halo")
    return out if keep_pos else out.drop("_pos")


def forward_fill(df: DataFrame, cols: list[str], order_col: str = "Date",
                 chunk_rows: int = CHUNK_ROWS, partition_by: list[str] | None = None) -> DataFrame:
    """Last known value of each column along the series (nulls padded forward).

    Two passes instead of an unbounded window: the last known value of every chunk (a
    table with one row per chunk), carried forward over chunks, then inside each chunk
    ``coalesce(last known so far in the chunk, carry from earlier chunks)``.
    """
    had_pos = "_pos" in df.columns
    pb = list(partition_by or [])
    pos = (df if had_pos else with_positions(df, order_col, partition_by=pb)) \
        .withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows))
    last_of_chunk = pos.groupBy(*pb, "_chunk").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v"))))
          .getField("v").alias(c) for c in cols])
    # one row per chunk: carry the last known value from all earlier chunks
    over_chunks = (Window.partitionBy(*pb) if pb else Window).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = last_of_chunk.select(
        *pb, "_chunk", *[F.last(c, ignorenulls=True).over(over_chunks).alias(f"_carry_{c}") for c in cols])
    inside = Window.partitionBy(*pb, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = pos.join(carry, [*pb, "_chunk"], "left")
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in cols}
    out = joined.withColumns(filled).drop("_chunk", *[f"_carry_{c}" for c in cols])
    return out if had_pos else out.drop("_pos")


def count_all(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery value."""
    return df.agg(F.count(F.lit(1))).scalar()

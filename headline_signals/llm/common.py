"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.partitioning import materialize
from ..session import scratch_path
from ..sources.tables import load

#: White space of the word definition: space and the control characters 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles at once (temporaries take about 50 times that).
BLOCK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` now and read from there afterwards."""
    return materialize(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``, for small tables that rounds of
    joins read: a checkpoint keeps the size estimate of the plan that made it, and those
    multiply from round to round. The application's folder goes when the application ends."""
    spark = df.sparkSession
    folder = scratch_path(spark, f"llm-{spark.sparkContext.applicationId}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    table = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(table)
    return spark.read.schema(df.schema).parquet(table)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until it is not among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tagged(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` and a bigint ``tag`` of each row that is the same whenever the rows are read: of
    a Parquet table a 64-bit hash of file and row number, else a number in a written copy."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and fresh(
            "_metadata", docs.columns) == "_metadata":
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(tag))
        except AnalysisException:  # a format without row numbers
            pass
    return checkpointed(docs.withColumn(tag, F.monotonically_increasing_id()))


def first_id(id_col: str, tag: str) -> Column:
    """What rows are ranked by: null ids last, then by id, then by tag."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(tag).alias("tag"))


def only_kept(rows: DataFrame, kept: DataFrame, id_col: str, tag: str) -> DataFrame:
    """The rows of tagged ``rows``, without tag, whose ``first_id`` is among ``kept`` (column ``id``)."""
    mark, mark_tag = fresh("_kept_id", rows.columns), fresh("_kept_tag", rows.columns)
    kept = kept.select(F.col("id.id").alias(mark), F.col("id.tag").alias(mark_tag))
    return rows.join(kept, F.col(id_col).eqNullSafe(F.col(mark)) & (F.col(tag) == F.col(mark_tag)), "left_semi").drop(tag)


def whole_row(docs: DataFrame, **needed: str) -> DataFrame:
    """``docs`` as one struct column ``row``, and what an operator needs by its own names, so that
    no column of the input can clash with one of the operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[F.col(f"`{c}`").alias(name) for name, c in needed.items()])


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_bucket(id_col: Column) -> Column:
    """crc32 of the id written as decimal text (null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def row_blocks(batch: pa.RecordBatch, column: str,
               budget: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` whose ``column`` (string, null as empty) holds at most ``budget``
    bytes (one row at least), with the UTF-8 bytes and the row offsets into them."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + budget, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield (batch.slice(start, stop - start), whole[offsets[start]:offsets[stop]],
               offsets[start:stop + 1] - offsets[start])
        start = stop


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    if n:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of a block, and the row offsets into
    them. A word's hash depends on its bytes only."""
    lower, space = _tables()
    gap = space[data]
    # a word starts where a non-space follows a space or a row's start
    start = ~gap
    start[1:] &= gap[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    start[edges] = ~gap[edges]
    starts = np.flatnonzero(start)
    end = ~gap
    end[:-1] &= gap[1:]
    ends_at = edges[edges > 0] - 1
    end[ends_at] = ~gap[ends_at]
    ends = np.flatnonzero(end) + 1
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)

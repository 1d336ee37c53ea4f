"""File sources and sinks (S3-S7, S9) with declared schemas.

Schemas are declared, never inferred. Writes replace the target (the reference
rewrites each snapshot on every run). JSON goes out as JSON Lines, the splittable form;
a top-level JSON array (the reference's snapshot shape) is read with ``multiLine``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)

#: Codecs of text files beyond the names that Spark knows for them. A zstd window holds megabytes, so rows of
#: one long text that are neighbours take little more room than one; gzip sees no further back than 32 KB.
TEXT_CODECS = {"zstd": "org.apache.parquet.hadoop.codec.ZstandardCodec"}
#: Level of zstd for all files: a quarter smaller than gzip on texts, and faster where texts repeat.
ZSTD_LEVEL = {"parquet.compression.codec.zstd.level": "9"}

HEADLINES_SCHEMA = StructType([
    StructField("Time", StringType()),
    StructField("Headline", StringType()),
])

SCORED_SCHEMA = StructType([
    StructField("seq", LongType()),
    StructField("Time", StringType()),
    StructField("Headline", StringType()),
    StructField("Sentiment", StringType()),
    StructField("Confidence", DoubleType()),
    StructField("Negative_Probability", DoubleType()),
    StructField("Neutral_Probability", DoubleType()),
    StructField("Positive_Probability", DoubleType()),
    StructField("Predicted_Class", IntegerType()),
])

INDEX_SCHEMA = StructType([
    StructField("Time", DateType()),
    StructField("Daily_Sentiment_Index", DoubleType()),
    StructField("Headlines_Processed", LongType()),
])

def read_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = True) -> DataFrame:
    """S3: CSV with a header row; quoted fields may hold commas, doubled quotes and, with
    ``multiline`` (needed for whole texts), line breaks. White space counts; ``\\N`` and
    an empty field are null, a quoted empty field is the empty text (``write_csv`` writes it so)."""
    return (_csv_options(spark.read.schema(schema)).option("multiLine", multiline)
            .option("mode", "PERMISSIVE").csv(path))


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header, replacing the target. Row ids travel as a named column."""
    w = _csv_options(df.write.mode("overwrite")).options(**ZSTD_LEVEL).option("escapeQuotes", True)
    w.csv(path, compression=TEXT_CODECS.get(compression, compression))


def _csv_options(io):
    """Options of reader and writer alike: texts survive unchanged, line breaks included."""
    return (io.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).option("nullValue", "\\N").option("lineSep", "\n"))


def dates_as_text(df: DataFrame) -> DataFrame:
    """Every date or timestamp column as ``yyyy-MM-dd`` text (time of day dropped)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON Lines records, dates as ``yyyy-MM-dd``; nulls are written as null."""
    w = dates_as_text(df).write.mode("overwrite").options(**ZSTD_LEVEL).option("ignoreNullFields", False)
    w.json(path, compression=TEXT_CODECS.get(compression, compression))


def read_json(spark: SparkSession, path: str, schema: StructType, array: bool = False) -> DataFrame:
    """JSON records; ``array=True`` reads files holding one top-level JSON array."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> None:
    w = df.write.mode("overwrite").options(**ZSTD_LEVEL)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path, compression=compression)


def publish(outputs: list[tuple[str, DataFrame, str]], base: str, compression: str = "none") -> list[str]:
    """Write each ``(name, df, fmt)`` under ``base/name`` in order; fmt is
    ``csv``, ``json`` or ``parquet``. Returns the written paths. The readers here know a file's
    ``compression`` (CSV and JSON; ``gzip`` or ``zstd`` for example) by its name."""
    paths = []
    for name, df, fmt in outputs:
        path = f"{base.rstrip('/')}/{name}"
        if fmt == "parquet":
            write_parquet(df, path)
        else:
            {"csv": write_csv, "json": write_json}[fmt](df, path, compression)
        paths.append(path)
    return paths

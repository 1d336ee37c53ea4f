"""Published generations of a set of tables.

A publication writes all its tables into a folder of its own and, when they are complete, one
manifest row. Readers look up the newest manifest row and read the folder it names, so they
see one generation whole: a run that is killed between two tables leaves no manifest row, and
the generation before stays what everyone reads. Two writers cannot publish one number: the
second finds the manifest row there and fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import write_csv, write_json, write_parquet

_MANIFEST = ("number bigint, folder string, formats map<string,string>, published_at timestamp_ntz, "
             "notes map<string,string>")
_WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet}


@dataclass(frozen=True)
class Generation:
    """One complete publication: its number, folder, tables (name to format), time and notes."""

    number: int
    folder: str
    formats: dict[str, str]
    published_at: object
    notes: dict[str, str]

    def path(self, name: str) -> str:
        if name not in self.formats:
            raise KeyError(f"generation {self.number} has no table {name!r}")
        return f"{self.folder}/{name}"


def generations(spark: SparkSession, root: str) -> list[Generation]:
    """All complete generations under ``root``, oldest first; none if nothing was published."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{root.rstrip('/')}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted((Generation(r["number"], r["folder"], r["formats"], r["published_at"], r["notes"] or {}) for r in rows),
                  key=lambda g: g.number)


def current(spark: SparkSession, root: str) -> Generation | None:
    """The newest complete generation."""
    return max(generations(spark, root), key=lambda g: g.number, default=None)


def new_folder(root: str) -> str:
    """A folder for a publication that nothing names yet."""
    return f"{root.rstrip('/')}/generation-{uuid.uuid4().hex}"


def complete(spark: SparkSession, root: str, folder: str, formats: dict[str, str],
             published_at: str | None = None, notes: dict[str, str] | None = None) -> Generation:
    """Name ``folder``, whose tables are all written, as the next generation: one manifest row."""
    before = current(spark, root)
    number = before.number + 1 if before else 0
    at = F.current_timestamp() if published_at is None else F.lit(published_at)

    def mapping(d):
        pairs = [F.lit(x) for kv in sorted(d.items()) for x in kv]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")

    row = spark.range(1).select(
        F.lit(number).cast("bigint").alias("number"), F.lit(folder).alias("folder"), mapping(formats).alias("formats"),
        at.cast("timestamp_ntz").alias("published_at"), mapping(notes or {}).alias("notes"))
    row.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/manifest/row={number}")
    return current(spark, root)


def publish_generation(spark: SparkSession, root: str, outputs: list[tuple[str, DataFrame, str]],
                       published_at: str | None = None, notes: dict[str, str] | None = None) -> Generation:
    """Write each ``(name, df, fmt)``, then the manifest row that makes them the current generation."""
    folder = new_folder(root)
    for name, df, fmt in outputs:
        _WRITERS[fmt](df, f"{folder}/{name}")
    return complete(spark, root, folder, {name: fmt for name, _, fmt in outputs}, published_at, notes)


def drop_older(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` generations, manifest row first; the numbers removed."""
    old = generations(spark, root)[:-keep] if keep else generations(spark, root)
    for g in old:
        remove(spark, f"{root.rstrip('/')}/manifest/row={g.number}")
        remove(spark, g.folder)
    return [g.number for g in old]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

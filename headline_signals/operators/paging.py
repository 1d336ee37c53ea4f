"""Deep pages of a feed from a stored page directory.

Sorting for page p costs p pages of rows in every task. A feed that is paged more than once is
written in order instead, once: every row with its global index, in blocks of whole pages,
a folder a block. The folders are the directory: which block holds a page is arithmetic, so
that reading the last page lists folders and reads one block, as reading the first does.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from ..sources import generations as gn
from .indexing import global_index

#: Rows of one block, about; a multiple of the page length is taken.
BLOCK_ROWS = 100_000


def write_pages(df: DataFrame, root: str, per_page: int = 5, order_col: str = "seq",
                block_rows: int = BLOCK_ROWS) -> gn.Generation:
    """Publish ``df`` in ``order_col`` order as pages under ``root``, replacing what was there as one.
    Equal keys are numbered in any order; null keys come first."""
    spark = df.sparkSession
    pages = max(1, block_rows // per_page)
    rows = global_index(df, order_col).withColumn(
        "block", F.floor((F.col("global_index") - 1) / (pages * per_page)))
    folder = gn.new_folder(root)
    (rows.repartition("block").sortWithinPartitions("block", "global_index")
     .write.partitionBy("block").parquet(f"{folder}/rows"))
    spark.createDataFrame([(df.count(),)], "n bigint").write.parquet(f"{folder}/count")
    made = gn.complete(spark, root, folder, {"rows": "parquet", "count": "parquet"},
                       notes={"per_page": str(per_page), "pages": str(pages), "schema": rows.drop("block").schema.json()})
    gn.drop_older(spark, root)
    return made


def stored_page_count(spark: SparkSession, root: str) -> int:
    """Number of pages, without reading any."""
    now = gn.current(spark, root)
    n = spark.read.parquet(now.path("count")).first()["n"]
    return -(-n // int(now.notes["per_page"]))


def read_page(spark: SparkSession, root: str, page: int) -> DataFrame:
    """One page with its rows' 1-based global index; empty beyond the last. Only the block that holds
    it is read, and of that the row groups with these indexes."""
    now = gn.current(spark, root)
    per_page, pages = int(now.notes["per_page"]), int(now.notes["pages"])
    first = (page - 1) * per_page + 1
    schema = StructType.fromJson(json.loads(now.notes["schema"])).add("block", LongType())
    return (spark.read.schema(schema).parquet(now.path("rows"))
            .where((F.col("block") == (page - 1) // pages) & F.col("global_index").between(first, first + per_page - 1))
            .drop("block"))

"""Exact duplicates by a tree-merge of digest runs (DataFrame functions only).

Every document becomes a leaf (run, digest, id): the run is a hash of the id, the digest
SHA-256 of the text after each white-space run has become one space. A run is reduced to
one record per digest (smallest id, count); then ``fan_in`` neighbouring runs are merged
at a time, round after round, until one run is left. The winners travel back down the
same tree. No step ever groups by the digest alone over all rows: a key (run, digest)
gets at most ``fan_in`` records at an inner level, and at the leaves the share of a group
that falls in one of many runs, so a group holding a third of all rows stays spread out.

A record is verified by more than its SHA-256: byte length and a second 64-bit hash of
the normalised text are part of the key at every level.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .common import SPACES, checkpointed, first_id, fresh, only_kept, partitions_for, tagged, text_or_empty

KEY = ["digest", "n_bytes", "check"]


def normalised(text_col: str):
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in: int = 16) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty, so all null and empty texts form one group. Rows with a null
    id are members of their group but give way to any id; a group of null ids only has a
    null ``keep_id`` and is kept. Repeated rows (same id, same text) are one document: each
    is returned, counted and marked alike. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    leaves, tree = _tree(docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t")), fan_in)
    won = tree[-1].select("run", *KEY, F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    for below in reversed(tree[:-1]):
        won = (below.select("run", *KEY).withColumn("above", F.floor(F.col("run") / fan_in))
               .join(won.withColumnRenamed("run", "above"), ["above", *KEY]).drop("above"))
    return leaves.join(won, ["run", *KEY]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _tree(text: DataFrame, fan_in: int) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves of rows ``(id, t)`` and the records of every level, the root's last."""
    levels = max(1, math.ceil(math.log(4 * partitions_for(text), fan_in)))
    leaves = checkpointed(text.select(
        "id", F.sha2("t", 256).alias("digest"), F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
        F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.rand(7))),
               F.lit(fan_in ** levels)).alias("run")))
    tree = [_merge(leaves.withColumn("n", F.lit(1).cast("long")))]
    for _ in range(levels):
        below = tree[-1]
        tree.append(_merge(below.withColumn("run", F.floor(F.col("run") / fan_in))))
    return leaves, tree


def _merge(records: DataFrame) -> DataFrame:
    """One record per run and digest, written out: each is read on the way up and down."""
    return checkpointed(records.groupBy("run", *KEY)
                        .agg(F.min("id").alias("id"), F.sum("n").alias("n"))
                        .sortWithinPartitions("run", *KEY))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one per text, that with the smallest id; of
    rows with the same id any one, and one with a null id only if no other has the text."""
    tag = fresh("_row_tag", docs.columns)
    rows = tagged(docs, tag)
    _, tree = _tree(rows.select(first_id(id_col, tag).alias("id"), normalised(text_col).alias("t")), fan_in)
    return only_kept(rows, tree[-1], id_col, tag)

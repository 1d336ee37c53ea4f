"""The corpus pipeline: stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from headline_signals.llm.byte_bpe import bpe_digests
from headline_signals.llm.common import documents
from headline_signals.llm.exact_dedup import keep_first
from headline_signals.llm.jaccard_join import keep_one
from headline_signals.llm.language_id import keep_identified
from headline_signals.llm.mixing import mixed_copies
from headline_signals.session import scratch_path


#: Memory of the pieces that a task of the last stage keeps: a quarter of what the operator takes by itself,
#: as the executors still hold what the stages before have touched.
CACHE_BYTES = 24 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (a text, with letters) stay; null texts go, null ids and repeated
    rows stay, an empty table stays empty."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays: one row, also of repeated rows, and one with a
    null id only if no other has the text."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links join, the one with the smallest id stays; texts without words and null
    ids are handled as ``keep_one`` says."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times; null texts never."""
    return mixed_copies(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row of the mix (a repeated document: every time); an empty mix has none."""
    return bpe_digests(docs, cache_bytes=CACHE_BYTES)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The first stage predicts with a trained model, which SQL cannot express; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; a stage reads what the one before wrote."""
    docs = documents(spark, sf_dir)
    folder = scratch_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

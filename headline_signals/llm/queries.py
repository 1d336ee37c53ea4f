"""The queries of this folder and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load
from .byte_bpe import bpe_digests
from .common import documents, id_bucket
from .exact_dedup import exact_dedup
from .fingerprints import edited_fingerprints
from .html_text import extract_text
from .jaccard_join import similar_documents
from .language_id import identify
from .mixing import mix
from .pitman_yor import language_model_scores
from .secret_scan import MORE_RULES, secret_digests
from .suffix_dedup import remove_repeats
from .token_alignment import align_tokens
from .toxicity import toxicity_scores
from .whitening import whiten


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", (id_bucket(F.col("doc_id")) % 3 == 1).alias("held_out"),
                                 F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_fingerprints": op2_fingerprints,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_html_text": op9_html_text,
    "op10_pitman_yor": op10_pitman_yor,
    "op11_toxicity": op11_toxicity,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}

#: kind, RE2 pattern, capturing group and its least length, as in the rules.
_SECRET_SQL = [
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
     "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    *((r.kind, r.pattern, r.group, r.least) for r in MORE_RULES),
]


def _spans_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """All spans of one kind: match i starts after the pieces up to it and the matches before it."""
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    's': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT,
    'l': length(m[i]), 'g': length(g[i])}}), lambda z: z.g >= {least})) AS z
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p,
               regexp_extract_all(t, '{pattern}', {group}) AS g FROM d)"""


ORACLE: dict[str, str] = {
    "op1_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(i, *rule) for i, rule in enumerate(_SECRET_SQL))}),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
             count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || z.s || ':' || (z.s + z.l), ',' ORDER BY z.s, k) FILTER (k <= 2) AS base,
             string_agg(kind || ':' || z.s || ':' || (z.s + z.l), ',' ORDER BY z.s, k) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
""",
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
             3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY source_size / w, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
             > cap * sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stops FROM w),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
        ((total - coalesce(sum(cap) FILTER (stops) OVER (), 0)) * w)::DOUBLE
        / sum(w) FILTER (NOT stops) OVER () END AS target FROM o),
r AS (SELECT d.doc_id, d.size, d.h, t.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS repeats
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, target - repeats * source_size AS budget FROM r)
SELECT doc_id, size, source_size, target,
       (size * (repeats + CASE WHEN upto <= budget
                               OR (upto - size <= budget AND size <= 2 * (budget - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
""",
}

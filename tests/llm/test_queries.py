"""The registered queries against DuckDB, the pipeline against its stages, and the guard."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from headline_signals.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm import brute
from tools.oracle_check import digest, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck(SF_SMALL).sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest([tuple(r) for r in df.collect()], df.columns)[0] == digest(rel.fetchall(), rel.columns)[0]


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


def test_pipeline(spark):
    """Language, exact copies and near copies by plain Python; the mix by its own property."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = [(i, r.text) for i, r in sorted(docs.items()) if any(c.isalpha() for c in r.text or "")]
    rows = [(i, t) for (i, t), g in zip(rows, brute.exact_groups(rows)) if g[3]]
    rows = [(i, t) for (i, t), c in zip(rows, brute.jaccard_components(rows)) if c[2] == i]
    result = corpus_pipeline.run(spark, SF_SMALL).collect()
    expected = {e[0]: e for e in brute.bpe(rows)}
    assert {r.doc_id for r in result} <= set(expected)
    for r in result:
        assert tuple(r) == expected[r.doc_id]
    size = {i: len(brute.WORD.findall(t)) for i, t in rows}
    total = sum(size.values())
    taken = sum(size[r.doc_id] for r in result)
    assert abs(taken - total) <= 20 * max(size.values())
    assert max(sum(r.doc_id == i for r in result) for i in expected) <= 3

"""Every registered query with SQL against DuckDB on the same Parquet tables (sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest, duck

SLOW = {"model_cv_scores", "model_summary", "feature_ranking", "text_classifier_report", "run_report", "ml_scored_documents",
        "regressor_cv_scores", "text_epochs"}
NAMES = sorted(set(E.oracle_sql()) - set(E.PIPELINE_QUERIES))


@pytest.fixture(scope="module")
def con():
    from tests.conftest import SF_SMALL
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    from tests.conftest import SF_SMALL
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(srows, df.columns)[0] == digest(drows, rel.columns)[0]


def test_every_query_has_oracle_or_is_a_learner():
    missing = set(E.queries()) - set(E.oracle_sql()) - set(E.PIPELINE_QUERIES)
    assert missing <= SLOW


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Time", "Daily_Sentiment_Index", "Headlines_Processed"]
    assert df.count() > 0

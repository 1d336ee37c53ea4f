"""Learners: rows-only checks (unseeded numbers are not compared), save/load, scorer hooks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from headline_signals.operators import scoring as sc
from headline_signals.plans import feature_flow as ff
from headline_signals.plans import modeling as ml
from headline_signals.session import scratch_path
from headline_signals.sources import adapters as ad
from tests.conftest import SF_SMALL


def test_cross_validation_rows(spark):
    table = ff.build_features(ad.scored_headlines(spark, SF_SMALL, base="orders", match="substring"))
    models = {"logistic_regression": ml.classification_models()["logistic_regression"]}
    scores, fitted = ml.cross_validate(spark, table, "next_day_positive", models=models)
    rows = scores.collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    imp = ml.feature_importance(spark, fitted["logistic_regression"], ml.ft.feature_names(table))
    assert imp.count() == len(ml.ft.feature_names(table)) == 73
    assert ml.best_models(ml.summarize_folds(scores)).count() == 1


def test_text_classifier_save_load(spark):
    data = ml.split_column(ad.labelled_sentiment(spark, SF_SMALL), "doc_id")
    model = ml.train_text_classifier(data.where("split = 'train'"), reg_params=(0.01,))
    path = scratch_path(spark, "t-model")
    ml.save_model(model, path)
    again = ml.load_model(path)
    summary, report = ml.evaluate_classifier(again, data.where("split = 'test'"))
    assert summary.count() == 1 and report.count() >= 1
    rows = sc.score(data.limit(5), "text", sc.SparkMLScorer(again)).collect()
    assert len(rows) == 5
    for r in rows:
        p = [r["Negative_Probability"], r["Neutral_Probability"], r["Positive_Probability"]]
        assert abs(sum(p) - 1) < 2e-4 and r["Confidence"] == max(p)


def test_scorer_refuses_other_than_three_classes(spark):
    two = ml.train_text_classifier(ad.labelled_text(spark, SF_SMALL), reg_params=(0.01,))
    with pytest.raises(ValueError, match="2 classes"):
        sc.SparkMLScorer(two)


def test_regression_models_fit(spark):
    table = ff.build_features(ad.scored_headlines(spark, SF_SMALL, base="orders", match="substring"), assemble=True)
    assert table.schema["features"].dataType.simpleString() == "vector"
    models = ml.regression_models()
    models["random_forest_regressor"].setNumTrees(5)
    models["gradient_boosting"].setMaxIter(3)
    scores, fitted = ml.cross_validate(spark, table.drop("features"), "next_day_sentiment", model_type="regression",
                                       models=models)
    assert set(fitted) == set(models) and scores.count() == 9
    assert all(r["score"] <= 1 for r in scores.collect())


def test_batch_model_scorer(spark):
    def make_predict():
        def predict(texts):
            n = np.array([len(t) for t in texts], dtype=float)
            return np.stack([np.zeros_like(n), np.ones_like(n), (n % 3)], axis=1)
        return predict
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    out = sc.score(docs, "text", sc.BatchModelScorer(make_predict, batch_size=16, logits=True))
    rows = out.select("Predicted_Class", "Confidence").collect()
    assert len(rows) == docs.count() and all(r["Predicted_Class"] in (1, 2) for r in rows)
    assert out.where(F.col("Confidence").isNull()).count() == 0


def test_gram_folds_equal_fits_per_fold(spark):
    """Every fold and the final fit against numpy on the rows themselves, a redundant column included."""
    import datetime as dt

    import numpy as np

    from headline_signals.plans import linear_folds as lf

    rng = np.random.default_rng(2)
    n = 47
    x = np.column_stack([rng.normal(1e4, 1, n), rng.normal(0, 1e-3, n), np.full(n, 3.0)])
    x = np.column_stack([x, x[:, 0] * 2 - 1])
    y = 0.5 * x[:, 0] - 200 * x[:, 1] + rng.normal(0, 0.1, n)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), None if i == 46 else float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "Date date, a double, b double, c double, d double, y double")
    grams = lf.fold_grams(df, "y", ["a", "b", "c", "d"])
    m, k = n - 1, 3
    s = m // (k + 1)
    assert grams.starts == [m - (k - i) * s for i in range(k)]
    for i, start in enumerate(grams.starts):
        coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(start), x[:start, :2]]), y[:start], rcond=None)
        test = slice(start, start + s)
        error = y[test] - np.column_stack([np.ones(s), x[test, :2]]) @ coef
        want = 1 - (error @ error) / ((y[test] - y[test].mean()) ** 2).sum()
        assert abs(grams.r2(grams.fit(i + 1), i + 1) - want) < 1e-6
    fit = grams.only([0, 1]).fit()
    coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(m), x[:m, :2]]), y[:m], rcond=None)
    assert np.allclose(fit.coefficients.toArray(), coef[1:], rtol=1e-6)
    predicted = grams.fit().predict(df, ["a", "b", "c", "d"]).where("y is not null").orderBy("Date").collect()
    assert np.allclose([r["prediction"] for r in predicted], np.column_stack([np.ones(m), x[:m, :2]]) @ coef, atol=1e-5)
    assert lf.fold_grams(df.limit(4), "y", ["a"]) is None and lf.fold_grams(df.limit(0), "y", ["a"]) is None


def test_least_squares_cross_validation_uses_the_grams(spark):
    import datetime as dt

    from pyspark.ml.regression import LinearRegression

    from headline_signals.plans import modeling as ml

    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7), float(i * i % 11), i % 7 * 2.0 + i * i % 11) for i in range(40)]
    df = spark.createDataFrame(rows, "Date date, a double, b double, y double")
    scores, fitted = ml.cross_validate(spark, df, "y", ["a", "b"], "regression", {"linear_regression": LinearRegression()})
    assert [round(r["score"], 9) for r in scores.collect()] == [1.0] * 3
    top = ml.feature_importance(spark, fitted["linear_regression"], ["a", "b"]).collect()
    assert [(r["feature"], round(r["importance"], 9)) for r in top] == [("a", 2.0), ("b", 1.0)]


def test_feature_table_is_computed_once_for_all_targets(spark):
    """Rows of the table pass a counting function: once each, however many targets, folds and models read them."""
    from pyspark.ml.classification import LogisticRegression

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 5)

    n = 24
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    table = spark.range(n).repartition(3).select(
        day.alias("Date"), counted.asNondeterministic()("id").alias("f"), (F.col("id") % 2).alias("next_day_positive"),
        (F.col("id") % 3 % 2).alias("next_3day_positive"))
    scores, _ = ml.train_targets(spark, table, models={"lr": LogisticRegression(maxIter=2)})
    assert scores.count() == 6 and seen.value == n


def test_fits_do_not_depend_on_the_shuffle_width(spark):
    table = spark.range(1300).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("Date"),
        (F.hash("id") % 7).alias("a"), (F.hash(F.lit(1), "id") % 5).alias("b"), (F.hash("id") % 2 == 0).cast("int").alias("next_day_positive"))
    forest = {"forest": ml.classification_models()["random_forest_classifier"].setNumTrees(3).setMaxDepth(3)}
    width, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("2", "19"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows, _ = ml.cross_validate(spark, table, "next_day_positive", ["a", "b"], models=forest, refit=False)
            scores.append([tuple(r) for r in rows.orderBy("fold").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert scores[0] == scores[1] and len(scores[0]) == 3
    assert ml._for_fits(spark.range(1300), 1300, "id").rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)

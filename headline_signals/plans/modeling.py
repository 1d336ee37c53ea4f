"""Modelling (L2-L10, O3-O5, A12, A15) on Spark ML.

* Text classifier: tokenise -> hashed term frequencies -> IDF -> multinomial logistic
  regression, chosen by weighted F1 on a validation split (L2, L4), evaluated with the
  confusion-count metrics (L5 = A13 + A14), saved and loaded as a ``PipelineModel`` (L6).
* Time-ordered cross-validation of daily feature tables (L7-L10): expanding folds
  from ``operators.features.time_folds``; each fit is a distributed Spark ML job and
  the driver only loops over at most 3 folds x a few models.
* Least squares has no fit per fold: all folds come from Gram matrices (``plans.linear_folds``).
* Feature ranking (O3-O5) from forest importances or absolute coefficients.

Every learner is seeded; repeated runs on the same partitioning give the same models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..operators import features as ft
from ..operators import metrics as mt
from ..operators.partitioning import materialize, target_parallelism
from . import linear_folds as lf

SEED = 42
#: Rows of a task in the fits of daily tables. A fit is some hundred short jobs, whose time is that of
#: their tasks; the shuffle width, which follows the headlines, would give each task a few days.
FIT_ROWS = 500


# --- text classifier ------------------------------------------------------------------

def split_column(df: DataFrame, id_col: str, train_fraction: float = 0.7) -> DataFrame:
    """L3: a repeatable train/test split from the id's md5 (bucket of 10), independent of
    partitioning: ``split`` is ``train`` for buckets below ``10 * train_fraction``."""
    bucket = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("bigint") % 10
    return df.withColumn("split", F.when(bucket < int(round(10 * train_fraction)), "train")
                         .otherwise("test"))


def text_pipeline(text_col: str = "text", label_col: str = "label", num_features: int = 1 << 18,
                  max_tokens: int | None = None, reg_param: float = 0.0) -> Pipeline:
    """L2 + L4: the whole text is used unless ``max_tokens`` cuts it (the reference's
    encoder truncates at 512 tokens; we do not by default)."""
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern="\\W+", toLowercase=True)]
    tok = "_tokens"
    if max_tokens:
        stages.append(SQLTransformer(
            statement=f"SELECT *, slice(_tokens, 1, {int(max_tokens)}) AS _tokens_cut FROM __THIS__"))
        tok = "_tokens_cut"
    stages += [
        HashingTF(inputCol=tok, outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial",
                           maxIter=50, regParam=reg_param),
    ]
    return Pipeline(stages=stages)


def train_text_classifier(labelled: DataFrame, text_col: str = "text", label_col: str = "label",
                          reg_params: Sequence[float] = (0.0, 0.01)) -> PipelineModel:
    """L4: pick the regularisation with the best weighted F1 on a validation split.

    Tokens and term frequencies do not depend on what is fitted: texts are read once, and every fit and
    evaluation starts from the written frequencies."""
    *fixed, idf, lr = text_pipeline(text_col, label_col).getStages()
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    tvs = TrainValidationSplit(estimator=Pipeline(stages=[idf, lr]), estimatorParamMaps=grid, trainRatio=0.8, seed=SEED,
                               evaluator=MulticlassClassificationEvaluator(
                                   labelCol=label_col, metricName="f1"))
    counted = PipelineModel(stages=fixed).transform(labelled.withColumn(label_col, F.col(label_col).cast("double")))
    best = tvs.fit(materialize(counted.select(label_col, idf.getInputCol()))).bestModel
    return PipelineModel(stages=[*fixed, *best.stages])


def evaluate_classifier(model, data: DataFrame, label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(A13 summary row, A14 per-class report) of ``model`` on ``data``."""
    pred = model.transform(data).select(F.col(label_col).cast("int").alias("label"),
                                        F.col("prediction").cast("int").alias("prediction"))
    return mt.classification_metrics(pred), mt.class_report(pred)


def save_model(model: PipelineModel, path: str) -> None:
    """Save, replacing the target."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load; a missing directory raises."""
    return PipelineModel.load(path)


# --- time-ordered cross-validation on daily features -----------------------------------

def classification_models() -> dict:
    """L7 (seeded; forest sized like the usual library default of 100 trees)."""
    return {
        "random_forest_classifier": RandomForestClassifier(numTrees=100, maxDepth=8,
                                                           maxMemoryInMB=1024, seed=SEED),
        # lbfgs with the usual library stopping rule (100 iterations, tol 1e-4) and a
        # light L2 penalty, since daily features are unscaled and nearly collinear
        "logistic_regression": LogisticRegression(maxIter=100, tol=1e-4, regParam=0.01),
    }


def regression_models() -> dict:
    """L8."""
    return {
        "random_forest_regressor": RandomForestRegressor(numTrees=100, maxDepth=8, seed=SEED),
        "gradient_boosting": GBTRegressor(maxIter=100, seed=SEED),
        "linear_regression": LinearRegression(),
    }


RESULT_SCHEMA = StructType([
    StructField("target", StringType()), StructField("model", StringType()),
    StructField("fold", IntegerType()), StructField("score", DoubleType()),
    StructField("fold_ok", IntegerType()), StructField("n_train", IntegerType()),
    StructField("n_test", IntegerType()),
])


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features",
                           handleInvalid="keep").transform(df)


def _for_fits(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """``df`` of ``n`` rows in partitions for repeated fits: as many as its rows fill, at most the task slots;
    rows in order, so that seeded learners do not depend on the shuffle width."""
    parts = max(1, min(-(-n // FIT_ROWS), target_parallelism(df)))
    return df.repartition(parts, order_col).sortWithinPartitions(order_col)


def _least_squares(est) -> bool:
    """Whether ``est`` is a linear regression without a penalty or weights."""
    return (isinstance(est, LinearRegression) and est.getRegParam() == 0 and est.getFitIntercept()
            and not est.isSet("weightCol") and est.getLoss() == "squaredError")


def linear_scores(spark: SparkSession, table: DataFrame, models: dict[str, Sequence[str]], targets: Sequence[str],
                  order_col: str = "Date") -> DataFrame:
    """Fold scores (R squared) of least squares on each feature set of ``models`` for each target; one
    pass per target serves all models."""
    columns = sorted({c for cols in models.values() for c in cols})
    rows = []
    for t in targets:
        grams = lf.fold_grams(table, t, columns, order_col)
        for name, cols in models.items():
            rows += lf.fold_scores(grams and grams.only([columns.index(c) for c in cols]), t, name)
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def cross_validate(spark: SparkSession, table: DataFrame, target: str,
                   features: Sequence[str] | None = None, model_type: str = "classification",
                   models: dict | None = None, order_col: str = "Date",
                   min_rows: int = 5, refit: bool = True) -> tuple[DataFrame, dict]:
    """Per model, fit on each expanding fold's train rows, score its test rows
    (accuracy or R^2), then (``refit``) fit on all rows. Fewer than ``min_rows`` rows: no models.

    The table is daily grain (one row per day), so it is positioned once, cached in few
    partitions, and every fold is a range filter on the position (W13), not a join.
    Returns ``(fold scores DataFrame, {model name: model fitted on all rows})``.
    """
    features = list(features or ft.feature_names(table))
    models = models or (classification_models() if model_type == "classification" else regression_models())
    data = _assemble(table.where(F.col(target).isNotNull()), features)
    data = materialize(ft.with_position(data, order_col).select(
        "row_idx", F.col(target).cast("double").alias("label"), "features"))
    n, k = data.agg(F.count(F.lit(1)), ft.fold_rule(F.count(F.lit(1)))).first()
    k = k if n >= min_rows else 0
    fitted: dict = {}
    if k == 0:
        return spark.createDataFrame([], RESULT_SCHEMA), fitted
    data = _for_fits(data, n, "row_idx").cache()
    s = n // (k + 1)
    starts = [n - (k - i) * s for i in range(k)]
    # classes present in each fold's training rows, in one pass
    classes = data.agg(*[F.countDistinct(F.when(F.col("row_idx") < st, F.col("label"))).alias(f"c{i}")
                         for i, st in enumerate(starts)]).first()
    evaluator = (MulticlassClassificationEvaluator(metricName="accuracy")
                 if model_type == "classification" else RegressionEvaluator(metricName="r2"))
    rows = []
    for name, est in models.items():
        if model_type != "classification" and _least_squares(est):
            grams = lf.fold_grams(table, target, features, order_col, min_rows=min_rows)
            rows += lf.fold_scores(grams, target, name)
            if refit and grams is not None:
                fitted[name] = grams.fit()
            continue
        for i, st in enumerate(starts):
            train = data.where(F.col("row_idx") < st)
            test = data.where((F.col("row_idx") >= st) & (F.col("row_idx") < st + s))
            score = evaluator.evaluate(est.fit(train).transform(test))
            ok = int(model_type != "classification" or classes[f"c{i}"] > 1)
            rows.append((target, name, i, float(score), ok, st, s))
        if refit:
            fitted[name] = est.fit(data)
    data.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA), fitted


def summarize_folds(scores: DataFrame, only_ok: bool = True) -> DataFrame:
    """A12 per (target, model); folds flagged not ok (single-class training) are left out
    of the mean when ``only_ok``."""
    s = scores.where(F.col("fold_ok") == 1) if only_ok else scores
    return mt.fold_summary(s, ("target", "model"), "score")


def best_models(summary: DataFrame) -> DataFrame:
    """The best model per target (highest mean score, then name)."""
    w = Window.partitionBy("target").orderBy(F.col("mean_score").desc_nulls_last(), "model")
    return summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def feature_importance(spark: SparkSession, model, feature_names: Sequence[str]) -> DataFrame:
    """O3: ``(feature, importance)`` sorted by importance, from forest importances or
    absolute linear coefficients. The vector is model metadata (one value per feature)."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        values = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        return spark.createDataFrame([], "feature string, importance double")
    df = spark.createDataFrame(list(zip(feature_names, [float(v) for v in values])),
                               "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most important features."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def train_targets(spark: SparkSession, table: DataFrame,
                  targets: Sequence[str] = ft.TARGET_COLUMNS, min_rows: int = 5,
                  models: dict | None = None, refit: bool = True) -> tuple[DataFrame, dict]:
    """Cross-validate every target present in the table, which is computed once for all of them.

    Returns (fold scores for all targets, {target: {model: fitted}})."""
    features = ft.feature_names(table)
    table = materialize(table)
    all_scores, fitted = None, {}
    for t in targets:
        if t not in table.columns:
            continue
        scores, models_t = cross_validate(spark, table, t, features, models=models,
                                          min_rows=min_rows, refit=refit)
        fitted[t] = models_t
        all_scores = scores if all_scores is None else all_scores.unionByName(scores)
    if all_scores is None:
        all_scores = spark.createDataFrame([], RESULT_SCHEMA)
    return all_scores, fitted


# --- in-sample regression score (A15 over an aggregate fit) ---------------------------

def fit_all(table: DataFrame, target: str, estimator, features: Sequence[str] | None = None, order_col: str = "Date"):
    """Fit ``estimator`` on every row with a known target (the final fit of L9)."""
    features = list(features or ft.feature_names(table))
    table = materialize(table.where(F.col(target).isNotNull()))
    data = _assemble(table, features)
    if order_col in data.columns:
        data = _for_fits(data, table.count(), order_col)
    data = data.select(F.col(target).cast("double").alias("label"), "features").cache()
    model = estimator.fit(data)
    data.unpersist()
    return model


def ols_fit_r2(df: DataFrame, y: str, x: str) -> DataFrame:
    """A15 on a one-variable least-squares fit computed by aggregates: slope and
    intercept (``regr_slope``, ``regr_intercept``), predictions, then ``r2_score``."""
    valid = df.dropna(subset=[x, y])
    coef = valid.agg(F.struct(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))).scalar()
    b, a = coef.getField("b"), coef.getField("a")
    pred = valid.select(F.col(y).alias("label"), (a + b * F.col(x)).alias("prediction"))
    return mt.r2_score(pred).select(b.alias("slope"), a.alias("intercept"), "r2")


# --- run report (C4) ---------------------------------------------------------------------

def run_report(spark: SparkSession, table: DataFrame, order_col: str = "Date",
               targets: Sequence[str] = ft.TARGET_COLUMNS, top_k: int = 5) -> DataFrame:
    """C4: one row with the run summary (A8-A11), the best target and model (O5) with
    their mean fold score, the ``top_k`` features of that model refitted on all rows
    (O3, O4), the feature count, and a recommendation when no model could be trained."""
    from ..operators import report as rp

    features = ft.feature_names(table)
    table = materialize(table)  # read by the fits of every target, the summary and the last fit
    scores, _ = train_targets(spark, table, targets, refit=False)
    ranked = summarize_folds(scores).orderBy(F.col("mean_score").desc_nulls_last(), "target", "model")
    best = ranked.first()  # one row: which learner to refit and rank
    summary = rp.market_summary(table, rp.summary(table, order_col)).withColumn("feature_count", F.lit(len(features)))
    if best is None:
        return summary.select("*", F.lit(None).cast("string").alias("best_target"),
                              F.lit(None).cast("string").alias("best_model"),
                              F.lit(None).cast("double").alias("best_score"),
                              F.lit(None).cast("array<string>").alias("top_features"),
                              F.lit("collect more days of headlines; too few rows to train models")
                              .alias("recommendation"))
    est = (classification_models() if best["model"] in classification_models() else regression_models())[best["model"]]
    model = fit_all(table, best["target"], est, features, order_col)
    top = top_features(feature_importance(spark, model, features), top_k)
    top_list = top.agg(F.collect_list("feature").alias("top_features"))  # at most top_k rows
    return (summary.select("*", F.lit(best["target"]).alias("best_target"),
                           F.lit(best["model"]).alias("best_model"),
                           F.lit(float(best["mean_score"])).alias("best_score"),
                           top_list.scalar().alias("top_features"),
                           F.lit(None).cast("string").alias("recommendation")))

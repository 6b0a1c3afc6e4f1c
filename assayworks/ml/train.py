"""Cross-validated training of the two model families."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from statistics import mean, pstdev
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.ml.evaluate import roc_evaluator, silhouette_evaluator
from assayworks.ml.indexer import TableIndexer, TableIndexerModel
from assayworks.ml.prep import assembler, fold_of, laid_out, packed, string_indexer
from assayworks.operators.frames import drop_incomplete, null_to_text
from assayworks.schemas import RUN_SUMMARY
from assayworks.session import discard, settle
from assayworks.sources.sinks import write_json

# Folds, seeds and parameter grid of the two jobs.
CLASSIFIER_FOLDS = 9
CLUSTERING_FOLDS = 7
FOLD_SEED = 123
CLUSTERING_SEED = 12345
REG_PARAMS = [0.1, 0.3, 0.7]

FOLD = "_fold"
#: Folds that are fitted at the same time.
PARALLEL_FITS = 4


class Trained(NamedTuple):
    model: CrossValidatorModel
    train_metric: float
    test_metric: float | None


def cross_validate(train: DataFrame, stages: list, grid: list[dict[Param, float]], evaluator: Evaluator,
                   key: str, folds: int, seed: int = FOLD_SEED,
                   parallelism: int = PARALLEL_FITS, drawn: bool = False) -> CrossValidatorModel:
    """Fit every parameter set on every fold and refit the best on all rows.

    With ``drawn`` the estimator draws its start from a seed and gets its rows laid out by key;
    others get theirs packed into few parts.

    The fold of a row comes from its key, so a re-read or re-partitioned table gives the same
    folds and metrics. The feature stages do not depend on the parameter set: they are fitted once
    per fold and their vectors written, where Spark's own validator fits them for every set, and
    the sets of a fold share that table. ``parallelism`` folds run at a time.
    """
    *feature_stages, estimator = stages
    pipeline = Pipeline(stages=stages)
    rows = train.withColumn(FOLD, fold_of(F.col(key), folds, seed))
    arranged = (lambda df: laid_out(df, key)) if drawn else (lambda df: df)
    gathered = (lambda df: df) if drawn else (lambda df: packed(df, estimator.getOrDefault("featuresCol")))
    needed = [FOLD, *([key] if drawn else []), *dict.fromkeys(
        estimator.getOrDefault(p) for p in estimator.params if p.name in ("featuresCol", "labelCol") and estimator.hasParam(p.name))]

    @inheritable_thread_target(train.sparkSession)
    def metrics_of(fold: int) -> list[float]:
        features = Pipeline(stages=feature_stages).fit(rows.where(F.col(FOLD) != fold))
        ready = settle(features.transform(rows).select(*needed), "fold")
        try:
            few = gathered(ready)
            kept, held = few.where(F.col(FOLD) != fold), few.where(F.col(FOLD) == fold)
            return [evaluator.evaluate(estimator.fit(arranged(kept), values).transform(held, values)) for values in grid]
        finally:
            discard(ready)
            for stage in features.stages:
                if isinstance(stage, TableIndexerModel):
                    stage.discard()

    with ThreadPool(max(1, min(parallelism, folds))) as pool:
        by_fold = pool.map(metrics_of, range(folds), chunksize=1)
    per_set = [list(values) for values in zip(*by_fold, strict=True)]
    averages = [mean(values) for values in per_set]
    choose = max if evaluator.isLargerBetter() else min
    best = averages.index(choose(averages))
    features = Pipeline(stages=feature_stages).fit(rows)
    fitted = estimator.fit(gathered(features.transform(arranged(rows))), grid[best])
    model = CrossValidatorModel(
        PipelineModel([*features.stages, fitted]), averages, stdMetrics=[pstdev(values) for values in per_set])
    for param, value in ((model.estimator, pipeline), (model.estimatorParamMaps, grid),
                         (model.evaluator, evaluator), (model.numFolds, folds), (model.seed, seed)):
        model.set(param, value)
    return model


def train_classifier(train: DataFrame, label: str, key: str, numeric: Sequence[str],
                     categorical: Sequence[str] = (), optional: Sequence[str] = (),
                     test: DataFrame | None = None, folds: int = CLASSIFIER_FOLDS,
                     parallelism: int = PARALLEL_FITS, reg_params: Sequence[float] = REG_PARAMS,
                     large: Sequence[str] = (), **svc) -> Trained:
    """Linear SVM over numeric and indexed text columns, chosen by area under ROC.

    The cleaned rows are written once; the many small jobs of the fits start from there.

    Nulls in ``optional`` columns become a category of their own; other rows with nulls drop
    out. ``test`` is scored when given. Categorical columns named in ``large`` keep their labels in a
    table (see :mod:`~assayworks.ml.indexer`), those of the others are on the driver.
    """
    def clean(df: DataFrame, needed: Sequence[str]) -> DataFrame:
        df = df.select(*dict.fromkeys([key, *numeric, *categorical, *needed]))
        for column in optional:
            df = null_to_text(df, column)
        return drop_incomplete(df)

    estimator = LinearSVC(labelCol=label, featuresCol="features", **svc)
    small = [c for c in categorical if c not in large]
    stages = [string_indexer(small)] if small else []
    if large:
        stages.append(TableIndexer(inputCols=list(large), outputCols=[c + "Id" for c in large]))
    stages += [assembler([*numeric, *[c + "Id" for c in categorical]]), estimator]
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(reg_params)).build()
    evaluator = roc_evaluator(label)
    rows = settle(clean(train, [label]), "training-rows")
    try:
        model = cross_validate(rows, stages, grid, evaluator, key, folds, parallelism=parallelism)
        train_metric = evaluator.evaluate(model.transform(rows))
        test_metric = None if test is None else evaluator.evaluate(model.transform(clean(test, [label])))
    finally:
        discard(rows)
    return Trained(model, train_metric, test_metric)


def train_kmeans(train: DataFrame, key: str, columns: Sequence[str] | None = None,
                 test: DataFrame | None = None, k: int = 2, folds: int = CLUSTERING_FOLDS,
                 parallelism: int = PARALLEL_FITS, **kmeans) -> Trained:
    """K-means over the given columns (or a ready ``features`` vector), measured by silhouette
    of its own predictions. Model and metrics do not depend on how the table is partitioned."""
    estimator = KMeans(featuresCol="features", predictionCol="pred", k=k, seed=CLUSTERING_SEED, **kmeans)
    stages = ([assembler(columns)] if columns else []) + [estimator]
    evaluator = silhouette_evaluator("pred")
    rows = settle(train, "training-rows")
    try:
        model = cross_validate(rows, stages, ParamGridBuilder().build(), evaluator, key, folds,
                               parallelism=parallelism, drawn=True)
        train_metric = evaluator.evaluate(model.transform(rows))
        test_metric = None if test is None else evaluator.evaluate(model.transform(test))
    finally:
        discard(rows)
    return Trained(model, train_metric, test_metric)


def run_summary(spark, model: CrossValidatorModel) -> DataFrame:
    """One row (app_id, scores, summary): a metric and a description per parameter set."""
    described = [
        ", ".join(sorted(f"{param.name}={value}" for param, value in params.items()))
        for params in model.getEstimatorParamMaps()
    ]
    row = (spark.sparkContext.applicationId, [float(m) for m in model.avgMetrics], described)
    return spark.createDataFrame([row], RUN_SUMMARY)


def save_run(spark, model: CrossValidatorModel, model_path: str, results_path: str) -> None:
    """Save the model and, beside it, its run summary as JSON; both overwrite."""
    model.write().overwrite().save(model_path)
    write_json(run_summary(spark, model), results_path)


def load_model(path: str) -> CrossValidatorModel:
    return CrossValidatorModel.load(path)

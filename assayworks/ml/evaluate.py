"""Metrics."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.operators.ranges import sum_before
from assayworks.session import settle


def roc_evaluator(label: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label)


class Silhouette(ClusteringEvaluator):
    """Spark's silhouette, and 0.0, the value of a point alone in its cluster, where all rows share one cluster."""

    def _evaluate(self, dataset: DataFrame) -> float:
        if dataset.select(self.getPredictionCol()).distinct().limit(2).count() < 2:
            return 0.0
        return super()._evaluate(dataset)


def silhouette_evaluator(prediction: str = "pred", features: str = "features") -> ClusteringEvaluator:
    return Silhouette(predictionCol=prediction, featuresCol=features)


def label_separation(df: DataFrame, label: str, features: str = "features") -> float:
    """Silhouette of the given labels: how far apart they lie, whatever a model says."""
    return silhouette_evaluator(label, features).evaluate(df)


def exact_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve over every distinct score, ties counted half.

    One row (positives, negatives, auc); null without both classes. Equal scores collapse
    before anything is ordered, and the order is cut into stretches. NaN ranks above all numbers.
    """
    positive = F.col(label).cast("int") == 1
    by_score = settle(
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score"))
        .agg(F.sum(F.when(positive, 1).otherwise(0)).alias("pos"),
             F.sum(F.when(positive, 0).otherwise(1)).alias("neg")), "scores")
    order = [("score", True)]
    ranked = sum_before(by_score, order, "neg", "below", settled=True)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
        F.when(pairs > 0, wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))

"""The two training jobs from input files to saved model and metrics.

    python -m assayworks.plans.training classification TRAIN.csv MODEL RESULTS [TEST.csv]
    python -m assayworks.plans.training kmeans TABLE.parquet MODEL RESULTS
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from assayworks.ml.prep import holdout_split
from assayworks.ml.train import Trained, save_run, train_classifier, train_kmeans
from assayworks.schemas import PASSENGERS_CSV
from assayworks.sources.files import read_csv

# Columns of the passenger table and of the digits table.
PASSENGER_NUMERIC = ["Pclass", "Age", "SibSp", "Parch", "Fare"]
PASSENGER_CATEGORICAL = ["Sex", "Cabin", "Embarked"]
PASSENGER_LABEL = "Survived"
PASSENGER_KEY = "PassengerId"
DIGIT_COLUMNS = [f"pixel_{row}_{column}" for row in range(8) for column in range(8)]


def passenger_schema() -> T.StructType:
    """The passenger table with its label, in the order of the training file."""
    fields = list(PASSENGERS_CSV.fields)
    return T.StructType([fields[0], T.StructField(PASSENGER_LABEL, T.IntegerType()), *fields[1:]])


def classification(spark: SparkSession, train_path: str, model_path: str, results_path: str,
                   test_path: str | None = None, **options) -> Trained:
    """Train on the passenger table and save model and metrics. A labelled test table is
    scored as well; options go to :func:`~assayworks.ml.train.train_classifier`."""
    test = read_csv(spark, test_path, passenger_schema()) if test_path else None
    trained = train_classifier(
        read_csv(spark, train_path, passenger_schema()), PASSENGER_LABEL, PASSENGER_KEY,
        PASSENGER_NUMERIC, PASSENGER_CATEGORICAL, ["Cabin"], test=test, **options)
    save_run(spark, trained.model, model_path, results_path)
    return trained


def kmeans(spark: SparkSession, table_path: str, model_path: str, results_path: str,
           key: str = "id", columns: list[str] | None = None, k: int = 2) -> Trained:
    """Split off a hold-out, cluster the rest, and save model and metrics."""
    fit, held = holdout_split(spark.read.parquet(table_path), key)
    trained = train_kmeans(fit, key, columns or DIGIT_COLUMNS, test=held, k=k)
    save_run(spark, trained.model, model_path, results_path)
    return trained


def main(arguments: list[str]) -> None:
    jobs = {"classification": classification, "kmeans": kmeans}
    if len(arguments) < 4 or arguments[0] not in jobs:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName(f"assayworks_{arguments[0]}").getOrCreate()
    trained = jobs[arguments[0]](spark, *arguments[1:])
    print("fold metrics:", trained.model.avgMetrics)
    print("training metric:", trained.train_metric, "hold-out metric:", trained.test_metric)


if __name__ == "__main__":
    main(sys.argv[1:])

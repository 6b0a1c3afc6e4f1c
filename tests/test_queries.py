"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import os

import pytest

from assayworks.catalog import load
from tests.oracle import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
CATALOG = load()
TRAINING = {"train_classifier", "train_kmeans", "silhouette", "cv_metrics"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_only_training_has_no_sql():
    assert set(CATALOG.queries) - set(CATALOG.sql) == TRAINING


@pytest.mark.parametrize("name", sorted(CATALOG.sql))
def test_same_rows_as_sql(spark, duck, name):
    df = CATALOG.queries[name](spark, FOLDER)
    assert differences(df, duck, CATALOG.sql[name]) == ""


@pytest.mark.parametrize("name", sorted(set(CATALOG.sql) - {"label_separation"}))
def test_plan_has_no_pairing_and_no_python(spark, name):
    plan = CATALOG.queries[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython",
                 "MapInPandas", "FlatMapGroups"):
        assert node not in plan, node


@pytest.mark.parametrize("name, folder", [("train_kmeans", SMALL), ("silhouette", FOLDER), ("ml_run_summary", SMALL)])
def test_clustering_does_not_depend_on_partitions(spark, folder, name):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append([tuple(r) for r in CATALOG.queries[name](spark, folder).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 1
    for a, b in zip(*[rows[0] for rows in found], strict=True):
        assert a == (pytest.approx(b, abs=1e-9) if isinstance(b, float) else b)


@pytest.mark.parametrize("name", ["train_classifier", "cv_metrics"])
def test_classifiers_are_chosen_by_their_metric(spark, name):
    found = CATALOG.queries[name](spark, SMALL).collect()
    assert len(found) == 3 and sum(r.is_best for r in found) >= 1
    assert all(0.0 <= r.fold_metric <= 1.0 for r in found)
    assert max(r.fold_metric for r in found) == next(r.fold_metric for r in found if r.is_best)

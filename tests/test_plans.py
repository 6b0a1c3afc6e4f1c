"""Plans: validation, a full run, reuse of earlier results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayworks.checks import Outcome
from assayworks.plans.assurance import assure, run_checks
from assayworks.plans.registry import RUN, Registry, Task, standard_registry
from assayworks.plans.standard import (
    CLASSIFICATION_JOBS, KMEANS_JOBS, assured_training_plan, expected_args, expected_jobs)
from assayworks.operators.report import task_warnings
from assayworks.schemas import CHECK_RESULTS, CHECK_WARNINGS
from assayworks.sources.sinks import publish, published_results, published_warnings, stage


def test_tasks_are_validated_before_anything_runs():
    registry = standard_registry()
    for task in assured_training_plan(True, "etl"):
        registry.validate(task)
    for wrong in (
        Task("t", "urls"),                                                      # required arguments missing
        Task("t", "nothing"),
        Task("t", "lint", {"files": "runs", "findings": "lint"}, {"colour": 1}),
        Task("t", "lint", {"files": "runs", "findings": "lint"}, {"files": 1}),
    ):
        with pytest.raises(ValueError, match="t: "):
            registry.validate(wrong)
    with pytest.raises(ValueError, match="no evidence table"):
        registry.run(Task("t", "lint", {"files": "runs", "findings": "lint"}), {"runs": None})
    with pytest.raises(ValueError, match="twice"):
        registry.register("urls", lambda: None)


def test_users_add_checks(spark):
    def always(subjects, score):
        return Outcome(subjects.withColumn("n_warnings", F.lit(0)).withColumn("score", F.lit(score)),
                       subjects.withColumn("warning", F.lit("x")).where("false"))

    registry = Registry()
    registry.register("always", always)
    runs = spark.createDataFrame([("p", "r")], "pipeline string, run_id string").withColumn("started_at", F.current_timestamp())
    outcome = run_checks([Task("t", "always", {"subjects": "runs"}, {"score": 0.3})], runs, {}, registry=registry)
    assert outcome.results.first().score == 0.3


def evidence(spark):
    runs = spark.createDataFrame([("good", "r1"), ("bad", "r1")], "pipeline string, run_id string").withColumn(
        "started_at", F.timestamp_seconds(F.lit(100)))
    table = lambda data, schema: spark.createDataFrame(data, f"pipeline string, run_id string, {schema}")
    application = "dags/train.py"
    good, bad = ("good", "r1"), ("bad", "r1")
    storage = [("dfs.encrypt.data.transfer", "true"), ("yarn.intermediate-data-encryption.enable", "true"),
               ("dfs.permissions.enabled", "true"), ("dfs.permissions.superusergroup", "ops"),
               ("hadoop.registry.secure", "true"), ("hadoop.security.authorization", "true")]
    tables = {
        "texts": table([(*good, "read('hdfs://localhost/in')"), (*bad, "read('titanic/train.csv'); get('http://x.org')")], "text string"),
        "job_sources": table([(*good, "no url"), (*bad, "get('http://x.org') get('http://x.org')")], "text string"),
        "task_args": table([(*good, "application", application), (*good, "args", None), (*bad, "application", "other.py")], "arg string, value string"),
        "expected_args": expected_args(runs, application),
        "lint": table([(*bad, "error")], "type string"),
        "dependencies": table([(*bad, "numpy", "1")], "lib string, advisory_id string"),
        "advisories": spark.createDataFrame([("numpy", "pyup.io-1", "CVE-1")], "lib string, advisory_id string, cve string"),
        "cve_scores": spark.createDataFrame([("CVE-1", 9.0)], "cve string, score double"),
        "inputs": table([(*good, "/in", "etl", "x", 400), (*bad, "/in", "root", "root", 640)], "path string, owner string, group string, perm int"),
        "outputs": table([(*good, "/out", "x", "hadoop", 770), (*bad, "/out", "root", "root", 755)], "path string, owner string, group string, perm int"),
        "storage_config": table([(*good, *kv) for kv in storage], "key string, value string"),
        "engine_config": table([(*good, "spark.network.crypto.enabled", "true"), (*good, "spark.io.encryption.enable", "true")], "key string, value string"),
        "scheduler_config": table([(*good, "core.fernet_key", "k"), (*good, "kubernetes.verify_ssl", "True")], "key string, value string"),
        "acl": table([(*bad, "Op", ["can_edit"])], "role string, perms array<string>"),
        "expected_acl": table([], "role string, perms array<string>"),
        "scans": table([(*good, 0, "s\n{}\n{\"data\": {}}"), (*bad, 0, 's\n{"data": {"h": {"vulnerabilities": {"v": {"cvss": 8.0}}}}}\n{}')], "returncode int, report string"),
        "app_jobs": table([(*good, "collect at KMeans.scala:1"), (*bad, "mine at Bitcoin.scala:1")], "job_name string").withColumn("started_at", F.timestamp_seconds(F.lit(100))),
        "expected_jobs": expected_jobs(spark, KMEANS_JOBS, "good").unionByName(expected_jobs(spark, CLASSIFICATION_JOBS, "bad")),
    }
    return runs, tables


BAD_SCORES = {
    "hdfs_paths_check": 0.0, "task_args_check": 0.0, "python_code_check_spark": 0.0,
    "requirements_check": 0.1, "read_permission_check": 0.0, "write_permission_check": 0.0,
    "hadoop_config_check_encryption": 0.1, "hadoop_config_check_security": 0.1, "spark_config_check": 0.1,
    "airflow_config_check": 0.1, "acl_config_check": 0.0, "openvas_check": 0.2, "spark_logs_check": 0.0,
    "network_traffic_check": 0.1,
}


def test_the_standard_plan(spark, tmp_path):
    runs, tables = evidence(spark)
    plan = assured_training_plan(True, "etl")
    assert len(plan) == 14 and len(assured_training_plan(False, "etl")) == 13
    found = {r.pipeline: r for r in assure(plan, runs, tables, str(tmp_path)).collect()}
    assert (found["good"].score, found["good"].prod_score, found["good"].n_incomplete) == (1.0, 1.0, 0)
    assert (found["bad"].score, found["bad"].prod_score) == (0.0, 0.0)
    assert {k: round(v, 6) for k, v in found["bad"].task_scores.items()} == BAD_SCORES
    warned = {r.task_id for r in published_warnings(spark, str(tmp_path)).where("pipeline = 'bad'").collect()}
    assert warned == set(BAD_SCORES)
    urls = published_warnings(spark, str(tmp_path)).where("task_id = 'network_traffic_check'").first()
    assert (urls.warning, urls.times) == ("Unexpected url http://x.org')", 2)


def test_kept_results_stand_for_new_ones(spark, tmp_path):
    runs, tables = evidence(spark)
    plan = [t for t in assured_training_plan(False, "etl") if t.task_id in ("python_code_check_spark", "acl_config_check")]
    assure(plan, runs, tables, str(tmp_path))
    history = published_results(spark, str(tmp_path)).withColumn("score", F.lit(0.42))
    # A result that is not earlier than the run must not stand for it.
    history = history.unionByName(history.withColumn("run_id", F.lit("r3")).withColumn("score", F.lit(0.9)).withColumn(
        "started_at", F.timestamp_seconds(F.lit(200))))
    later = runs.withColumn("run_id", F.lit("r2")).withColumn("started_at", F.timestamp_seconds(F.lit(200))).unionByName(
        runs.limit(0)).unionByName(spark.createDataFrame([("new", "r2")], "pipeline string, run_id string").withColumn(
            "started_at", F.timestamp_seconds(F.lit(200))))
    lint = tables["lint"].withColumn("run_id", F.lit("r2"))
    acl = tables["acl"].withColumn("run_id", F.lit("r2"))
    warned = published_warnings(spark, str(tmp_path))
    results, warnings, _ = run_checks(plan, later, {**tables, "lint": lint, "acl": acl}, history, ["python_code_check_spark"],
                                      history_warnings=warned)
    assert sorted((r.pipeline, r.run_id, r.task_id, r.warning) for r in warnings.collect()) == [
        ("bad", "r2", "acl_config_check", "Unexpected (Op,[can_edit])"), ("bad", "r2", "python_code_check_spark", "error")]
    scores = {(r.pipeline, r.task_id): r.score for r in results.collect()}
    lint_task, acl_task = "python_code_check_spark", "acl_config_check"
    assert scores == {
        ("good", lint_task): 0.42, ("bad", lint_task): 0.42, ("new", lint_task): 1.0,
        ("good", acl_task): 1.0, ("bad", acl_task): 0.0, ("new", acl_task): 1.0}
    assert RUN == ["pipeline", "run_id"]


def test_evidence_is_evaluated_once_and_only_needed_days_are_read(spark, tmp_path):
    runs, tables = evidence(spark)
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        counted.add(1)
        return value

    plan = [t for t in assured_training_plan(False, "etl") if t.task_id == "python_code_check_spark"]
    assure(plan, runs, {**tables, "lint": tables["lint"].withColumn("type", seen("type"))}, str(tmp_path)).collect()
    assert counted.value == tables["lint"].count()
    later = runs.withColumn("started_at", F.timestamp_seconds(F.lit(10 * 86_400)))
    report = assure(plan, later, tables, str(tmp_path))
    plan_text = report._jdf.queryExecution().executedPlan().toString()
    assert "1970-01-11" in plan_text and "PartitionFilters: [isnotnull(day" in plan_text


def test_warnings_of_keys_without_a_subject_are_left_out(spark, rows):
    from assayworks.operators.scoring import lowest_score

    subjects = spark.createDataFrame([("a",), ("b",)], "k string")
    violations = spark.createDataFrame([("a", 0.5), ("zz", 0.1)], "k string, score double")
    assert rows(lowest_score(subjects, violations, ["k"])) == [("a", 1, 0.5), ("b", 0, 1.0)]


def test_attempts_do_not_mix(spark, tmp_path):
    """A run assured twice, and an attempt that died between its two writes: the last whole attempt counts."""
    runs, tables = evidence(spark)
    plan = [t for t in assured_training_plan(False, "etl") if t.task_id == "python_code_check_spark"]
    place = str(tmp_path)
    clean = {**tables, "lint": tables["lint"].limit(0)}

    def state():
        rows = task_warnings(published_results(spark, place), published_warnings(spark, place)).where("pipeline = 'bad'").collect()
        return [(r.score, r.n_warnings, r.warning, r.times) for r in rows]

    assure(plan, runs, tables, place)
    assert state() == [(0.0, 1, "error", 1)]
    assure(plan, runs, tables, place)
    assert state() == [(0.0, 1, "error", 1)]
    report = assure(plan, runs, clean, place, attempt="fixed")
    assert state() == [(1.0, 0, None, None)] and {r.score for r in report.collect()} == {1.0}
    # One that dies after its results, one after its warnings: neither has a commit.
    half = run_checks(plan, runs, tables)
    stage(half.results, place, "results", CHECK_RESULTS, F.to_date("started_at"), "half")
    assert state() == [(1.0, 0, None, None)]
    started = half.warnings.join(runs, RUN)
    stage(started, place, "warnings", CHECK_WARNINGS, F.to_date("started_at"), "half")
    assert state() == [(1.0, 0, None, None)]
    # Published again under its name it replaces what it left, and counts once.
    for _ in range(2):
        publish(half.results, half.warnings, runs, place, "half")
        assert state() == [(0.0, 1, "error", 1)]
    assert published_results(spark, place).where("attempt = 'half'").count() == runs.count()
    # Kept results bring the warnings of the attempt that is kept.
    later = runs.withColumn("run_id", F.lit("r9")).withColumn("started_at", F.timestamp_seconds(F.lit(900)))
    kept = run_checks(plan, later, clean, published_results(spark, place), ["python_code_check_spark"], history_warnings=published_warnings(spark, place))
    assert [(r.pipeline, r.warning, r.times) for r in kept.warnings.collect()] == [("bad", "error", 1)]

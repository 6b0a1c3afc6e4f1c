"""The two assured training plans: which checks run, and what they expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayworks.operators.rules import ENGINE, SCHEDULER, STORAGE_ENCRYPTION, STORAGE_SECURITY
from assayworks.plans.registry import Task

# What the two plans allow and expect.
ALLOWED_PATHS = [r"hdfs://localhost.+"]
ALLOWED_SERVICES: list[str] = []

# Jobs of the two training applications, as the releases name them that the plans were
# written for. Other releases have entries of their own (see expected_jobs).
KMEANS_JOBS = [
    "collectAsMap at ClusteringMetrics",
    "collectAsMap at KMeans",
    "collect at ClusteringMetrics",
    "collect at ClusteringSummary",
    "collect at KMeans",
    "countByValue at KMeans",
    "json at NativeMethodAccessorImpl.java:0",
    "parquet at KMeans",
    "runJob at SparkHadoopWriter",
    "showString at NativeMethodAccessorImpl.java:0",
    "sum at KMeans",
    "takeSample at KMeans",
]
CLASSIFICATION_JOBS = [
    "collect at AreaUnderCurve",
    "collect at BinaryClassificationMetrics",
    "collect at StringIndexer",
    "count at BinaryClassificationMetrics",
    "parquet at LinearSVC",
    "parquet at StringIndexer",
    "runJob at SparkHadoopWriter",
    "showString at NativeMethodAccessorImpl.java:0",
    "treeAggregate at RDDLossFunction",
    "treeAggregate at Summarizer",
]


def expected_jobs(spark: SparkSession, names: Sequence[str], app_name: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(app_name, job, since, until): the jobs an application has from one Spark release up to, but without, another."""
    return spark.createDataFrame([(app_name, name, since, until) for name in names], "app_name string, job string, since string, until string")


def expected_args(runs: DataFrame, application: str) -> DataFrame:
    """Every run is expected to submit the application without further arguments."""
    wanted = [
        F.struct(F.lit(arg).alias("arg"), F.lit(value).cast("string").alias("value"))
        for arg, value in (("application", application), ("args", None))
    ]
    return runs.select("pipeline", "run_id", F.explode(F.array(*wanted)).alias("want")).select(
        "pipeline", "run_id", "want.*")


def assured_training_plan(reads_input: bool, user: str, group: str = "hadoop") -> list[Task]:
    """The checks around one training job that runs as ``user`` of ``group``.

    ``reads_input`` adds the read-permission check, which only the classification plan has.
    Evidence tables, all with pipeline and run_id: texts (text: task source, arguments and job
    source), job_sources (text), task_args and expected_args
    (arg, value), lint (type), dependencies (lib, advisory_id), advisories (lib, advisory_id,
    cve), cve_scores (cve, score), inputs and outputs (path, owner, group, perm),
    storage_config, engine_config and scheduler_config (key, value), acl and expected_acl
    (role, perms), scans (returncode, report), app_jobs (started_at, job_name), expected_jobs
    (app_name, job).
    """
    who = {"user": user, "group": group}
    config = lambda table: {"systems": "runs", "entries": table}
    before = [
        Task("hdfs_paths_check", "paths", {"subjects": "runs", "texts": "texts"}, {"allowed": ALLOWED_PATHS}),
        Task("task_args_check", "args", {"tasks": "runs", "args": "task_args", "expected": "expected_args"}),
        Task("network_traffic_check", "urls", {"subjects": "runs", "texts": "job_sources"},
             {"services": ALLOWED_SERVICES}),
        Task("python_code_check_spark", "lint", {"files": "runs", "findings": "lint"}),
        Task("requirements_check", "dependencies", {
            "projects": "runs", "findings": "dependencies", "advisories": "advisories",
            "cve_scores": "cve_scores"}),
        Task("write_permission_check", "can_write", {"files": "outputs"}, who),
        Task("hadoop_config_check_encryption", "config", config("storage_config"), {"rules": STORAGE_ENCRYPTION}),
        Task("hadoop_config_check_security", "config", config("storage_config"), {"rules": STORAGE_SECURITY}),
        Task("spark_config_check", "config", config("engine_config"), {"rules": ENGINE}),
        Task("airflow_config_check", "config", config("scheduler_config"), {"rules": SCHEDULER}),
        Task("acl_config_check", "acl", {"objects": "runs", "acl": "acl", "expected": "expected_acl"}),
        Task("openvas_check", "scan", {"scans": "scans"}),
    ]
    if reads_input:
        before.insert(5, Task("read_permission_check", "can_read", {"files": "inputs"}, who))
    after = [Task("spark_logs_check", "job_log", {"app_jobs": "app_jobs", "expected": "expected_jobs"})]
    return before + after

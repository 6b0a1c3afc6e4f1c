"""Earlier runs: the latest application, the previous run, the last good result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.operators.ranges import last_before
from assayworks.session import settle

# Fixed value: the state of a run whose result may be used again.
SUCCESS = "success"


def latest_app(apps: DataFrame, wanted: DataFrame) -> DataFrame:
    """The latest application (app_id, started_at) of each wanted name.

    A name without any application stays as a row with ``missing`` true.
    """
    latest = apps.groupBy("app_name").agg(
        F.max(F.struct("started_at", "app_id")).alias("latest"))
    return (
        wanted.select("app_name").distinct().join(latest, "app_name", "left")
        .select("app_name", F.col("latest.app_id").alias("app_id"),
                F.col("latest.started_at").alias("started_at"),
                F.col("latest").isNull().alias("missing"))
    )


def previous_runs(apps: DataFrame) -> DataFrame:
    """(app_id, app_name, started_at, previous_app_id) for every run of every application.

    The previous run is the last successful one before: a crash says nothing about what jobs a
    run has. ``apps`` may have ``succeeded``; without it every run counts, and a run counts if
    any of its rows says so. The runs are written when this is called: they are few beside the
    jobs, and are read more than once.
    """
    good = F.max("succeeded") if "succeeded" in apps.columns else F.lit(True)
    runs = settle(apps.groupBy("app_id", "app_name").agg(
        F.min("started_at").alias("started_at"), F.coalesce(good, F.lit(False)).alias("_good")), "runs")
    marked = runs.withColumn("_app", F.when(F.col("_good"), F.col("app_id")))
    return last_before(marked, ["app_name"], [("started_at", True), ("app_id", True)],
                       "_app", "previous_app_id", settled=True).drop("_good", "_app")


def last_results(results: DataFrame, keys: Sequence[str] = ("pipeline", "task_id"),
                 state: str = "state", at: str = "started_at", run: str = "run_id") -> DataFrame:
    """Add to every task run the run id of the latest strictly earlier success of the task
    (null when there is none), as ``last_run_id``. Runs at once and writes the results in order."""
    marked = results.withColumn("_good", F.when(F.col(state) == SUCCESS, F.col(run)))
    return last_before(marked, keys, [(at, True), (run, True)], "_good", "last_run_id").drop("_good")


def last_success_before(requested: DataFrame, results: DataFrame, carried: Sequence[str] = ("score", "n_warnings")) -> DataFrame:
    """Requested task runs (pipeline, task_id, run_id, started_at) with the last success that started
    strictly earlier: ``last_run_id`` and each carried column as ``last_<column>``; those without
    one are left out. Runs at once and writes the order."""
    keys = ["pipeline", "task_id"]
    kept = F.struct(F.col("run_id"), *carried)
    # At the same moment a request comes before a success, so an earlier one is strictly earlier.
    asked = requested.select(*keys, "run_id", "started_at", F.lit(0).alias("_success"))
    good = results.where(F.col("state") == SUCCESS).select(*keys, "run_id", "started_at", F.lit(1).alias("_success"), kept.alias("_kept"))
    both = asked.unionByName(good, allowMissingColumns=True)
    found = last_before(both, keys, [("started_at", True), ("_success", True), ("run_id", True)], "_kept", "_last")
    return found.where("_success = 0 AND _last IS NOT NULL").select(
        *keys, "run_id", F.col("_last.run_id").alias("last_run_id"), *[F.col(f"_last.{c}").alias(f"last_{c}") for c in carried])


def latest_success(results: DataFrame, keys: Sequence[str] = ("pipeline", "task_id"),
                   carried: Sequence[str] = ("score",)) -> DataFrame:
    """The latest successful result per task: (keys, last_run_id) and each carried column as
    ``last_<column>``."""
    return (
        results.where(F.col("state") == SUCCESS).groupBy(*keys)
        .agg(F.max(F.struct("started_at", "run_id", *carried)).alias("latest"))
        .select(*keys, F.col("latest.run_id").alias("last_run_id"),
                *[F.col(f"latest.{name}").alias(f"last_{name}") for name in carried])
    )


def reuse_results(requested: DataFrame, results: DataFrame,
                  keys: Sequence[str] = ("pipeline", "task_id")) -> DataFrame:
    """What to do with each requested task: keep its last good result or run it.

    ``requested`` has the keys and ``keep_last``. A task that should be kept but never
    succeeded has to run.
    """
    last = latest_success(results, keys).withColumn("_found", F.lit(True))
    kept = F.col("keep_last") & F.coalesce("_found", F.lit(False))
    return requested.join(last, list(keys), "left").select(
        *keys, F.when(kept, F.lit("keep")).otherwise(F.lit("run")).alias("action"),
        F.when(kept, F.col("last_run_id")).alias("last_run_id"),
        F.when(kept, F.col("last_score")).alias("last_score"))

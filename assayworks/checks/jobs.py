"""Jobs an application ran, against expectations and its previous run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.checks.outcome import Outcome, judged
from assayworks.functions.text import job_stem
from assayworks.operators.differences import new_jobs, unexpected_jobs
from assayworks.operators.history import previous_runs


def stems(app_jobs: DataFrame) -> DataFrame:
    """(app_id, app_name, started_at, job), one row per distinct job of a run, with its ``spark_version`` if given."""
    release = ["spark_version"] if "spark_version" in app_jobs.columns else []
    return (
        app_jobs.where(F.col("job_name").isNotNull())
        .select("app_id", "app_name", "started_at", job_stem(F.col("job_name")).alias("job"), *release).distinct()
    )


def job_log_check(app_jobs: DataFrame, expected: DataFrame) -> Outcome:
    """0.0 for a run with a job that is not expected, or that its previous run did not have.

    A job may give both warnings. ``expected`` is a table (app_name, job), and
    since and until where names depend on the Spark release, which ``app_jobs`` then have as
    spark_version.
    """
    jobs = stems(app_jobs)
    warnings = unexpected_jobs(jobs, expected).unionByName(new_jobs(jobs, previous_runs(app_jobs)))
    return judged(app_jobs.select("app_id", "app_name").distinct(), warnings, ["app_id", "app_name"])

"""Applications, their jobs and earlier runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.checks.jobs import job_log_check, stems
from assayworks.functions.text import job_stem
from assayworks.operators import differences, history

# A user is an application, a day one of its runs, an event one job of the run. Every fifth day all fail.
_JOB = "concat(event_type, ' at Step', CAST({k} AS INTEGER) % 3, '.scala:', {k})"
_SPARK_JOB = _JOB.format(k="get_json_object(props, '$.k')")
_SQL_JOB = _JOB.format(k="json_extract_string(props, '$.k')")

_RAW_SQL = f"""
    raw AS (SELECT user_id || '@' || CAST(ts AS DATE) AS app_id, CAST(user_id AS VARCHAR) AS app_name, ts,
                   split_part({_SQL_JOB}, '.scala', 1) AS job, extract(day FROM ts) % 5 <> 0 AS succeeded FROM events),
    jobs AS (SELECT DISTINCT app_id, app_name, job FROM raw),
    runs AS (SELECT app_id, app_name, min(ts) AS started_at, bool_or(succeeded) AS good FROM raw GROUP BY app_id, app_name),
    previous AS (
        SELECT *, last_value(CASE WHEN good THEN app_id END IGNORE NULLS) OVER (
            PARTITION BY app_name ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs)
"""


def _app_jobs(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "concat(user_id, '@', CAST(ts AS DATE)) AS app_id", "CAST(user_id AS STRING) AS app_name",
        "ts AS started_at", "event_id AS job_id", f"{_SPARK_JOB} AS job_name", "day(ts) % 5 <> 0 AS succeeded")


@CATALOG.add(f"SELECT event_id, split_part({_SQL_JOB}, '.scala', 1) AS job FROM events")
def job_name_stem(spark, folder):
    return _app_jobs(spark, folder).select(F.col("job_id").alias("event_id"), job_stem(F.col("job_name")).alias("job"))


@CATALOG.add(f"""
    WITH {_RAW_SQL},
    latest AS (SELECT app_name, max_by(app_id, started_at) AS app_id FROM runs GROUP BY app_name)
    SELECT CAST(c_custkey AS VARCHAR) AS app_name, l.app_id, l.app_id IS NULL AS missing
    FROM customer LEFT JOIN latest l ON l.app_name = CAST(c_custkey AS VARCHAR)
""")
def latest_app_by_name(spark, folder):
    wanted = table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS app_name")
    return history.latest_app(_app_jobs(spark, folder), wanted).select("app_name", "app_id", "missing")


@CATALOG.add(f"""
    WITH {_RAW_SQL}
    SELECT app_id, app_name, before AS previous_app_id FROM previous
""")
def previous_runs(spark, folder):
    return history.previous_runs(_app_jobs(spark, folder)).drop("started_at")


_EXPECTED_SQL = """
    expected AS (
        SELECT CAST(c_custkey AS VARCHAR) AS app_name, kind || ' at Step' || step AS job
        FROM customer, (VALUES ('view', 0), ('view', 1), ('view', 2), ('click', 0), ('error', 1)) AS e(kind, step)
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR), 'purchase at Step' || (c_custkey % 3) FROM customer)
"""
_UNEXPECTED_SQL = """
    unexpected AS (
        SELECT j.app_id, j.app_name, j.job, 'Unexpected job ' || j.job AS warning FROM jobs j
        WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.app_name = j.app_name AND e.job = j.job))
"""
_NEW_SQL = """
    fresh AS (
        SELECT j.app_id, j.app_name, j.job, 'New job ' || j.job || ' not present in previous logs' AS warning
        FROM jobs j JOIN previous p ON p.app_id = j.app_id AND p.before IS NOT NULL
        WHERE NOT EXISTS (SELECT 1 FROM jobs o WHERE o.app_id = p.before AND o.job = j.job))
"""


def _expected(spark, folder):
    always = ["view at Step0", "view at Step1", "view at Step2", "click at Step0", "error at Step1"]
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("app_name"),
        F.explode(F.array(*[F.lit(name) for name in always],
                          F.concat(F.lit("purchase at Step"), F.col("c_custkey") % 3))).alias("job"))


@CATALOG.add(f"WITH {_RAW_SQL}, {_EXPECTED_SQL}, {_UNEXPECTED_SQL} SELECT * FROM unexpected")
def unexpected_jobs(spark, folder):
    return differences.unexpected_jobs(stems(_app_jobs(spark, folder)), _expected(spark, folder))


@CATALOG.add(f"WITH {_RAW_SQL}, {_NEW_SQL} SELECT * FROM fresh")
def new_jobs_vs_previous(spark, folder):
    jobs = _app_jobs(spark, folder)
    return differences.new_jobs(stems(jobs), history.previous_runs(jobs))


@CATALOG.add(f"""
    WITH {_RAW_SQL}, {_EXPECTED_SQL}, {_UNEXPECTED_SQL}, {_NEW_SQL},
    found AS (SELECT app_id FROM unexpected UNION ALL SELECT app_id FROM fresh)
    SELECT r.app_id, r.app_name, CAST(count(f.app_id) AS BIGINT) AS n_warnings,
           CASE WHEN count(f.app_id) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM runs r LEFT JOIN found f USING (app_id) GROUP BY r.app_id, r.app_name
""")
def job_log_score(spark, folder):
    return job_log_check(_app_jobs(spark, folder), _expected(spark, folder)).results


# Task results: a user is a pipeline, an event type a task, an event one run of the task.
_STATE = "CASE WHEN value < 20 THEN 'success' ELSE 'failed' END"


def _results(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "user_id AS pipeline", "event_type AS task_id", "event_id AS run_id", "ts AS started_at",
        f"{_STATE} AS state", "value AS score")


@CATALOG.add(f"""
    SELECT user_id AS pipeline, event_type AS task_id, event_id AS run_id,
           last_value(CASE WHEN {_STATE} = 'success' THEN event_id END IGNORE NULLS) OVER (
               PARTITION BY user_id, event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_run_id
    FROM events
""")
def last_success(spark, folder):
    return history.last_results(_results(spark, folder)).select("pipeline", "task_id", "run_id", "last_run_id")


_TASKS = ["click", "error", "purchase", "signup", "view"]


@CATALOG.add(f"""
    WITH good AS (
        SELECT user_id, event_type, max_by(event_id, ts) AS run, max_by(value, ts) AS score
        FROM events WHERE {_STATE} = 'success' GROUP BY user_id, event_type),
    requested AS (
        SELECT c_custkey AS pipeline, task_id, (c_custkey + length(task_id)) % 3 <> 0 AS keep_last
        FROM customer, (VALUES {", ".join(f"('{t}')" for t in _TASKS)}) AS t(task_id))
    SELECT pipeline, task_id, CASE WHEN keep_last AND run IS NOT NULL THEN 'keep' ELSE 'run' END AS action,
           CASE WHEN keep_last THEN run END AS last_run_id, CASE WHEN keep_last THEN score END AS last_score
    FROM requested LEFT JOIN good ON user_id = pipeline AND event_type = task_id
""")
def reuse_last_results(spark, folder):
    requested = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pipeline"), F.explode(F.array(*[F.lit(t) for t in _TASKS])).alias("task_id")
    ).withColumn("keep_last", F.expr("(pipeline + length(task_id)) % 3 <> 0"))
    return history.reuse_results(requested, _results(spark, folder))

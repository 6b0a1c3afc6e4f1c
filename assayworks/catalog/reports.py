"""Reports over check results."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.operators import report as R

# A user is a pipeline, a week one of its runs, an event type a check; every event is one
# attempt of the check and the latest attempt counts. A very high value leaves no score.
_TASKS = ["click", "error", "purchase", "signup", "view"]
_SCORE = """CASE WHEN value > 110 THEN NULL WHEN value > 60 THEN 0.1 WHEN value > 45 THEN 0.5
    WHEN value > 30 THEN 0.75 WHEN value > 20 THEN 0.9 ELSE 1.0 END"""


def _results(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS pipeline", "CAST(CAST(date_trunc('week', ts) AS DATE) AS STRING) AS run_id",
        "event_type AS task_id", f"CAST({_SCORE} AS DOUBLE) AS score", "ts AS ended_at")


_LATEST_SQL = f"""
    attempts AS (
        SELECT CAST(user_id AS VARCHAR) AS pipeline, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS run_id,
               event_type AS task_id, CAST({_SCORE} AS DOUBLE) AS score, ts FROM events),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY pipeline, run_id, task_id ORDER BY ts DESC) AS nth FROM attempts),
    latest AS (SELECT pipeline, run_id, task_id, score FROM numbered WHERE nth = 1),
    runs AS (SELECT DISTINCT pipeline, run_id FROM attempts)
"""
_TASK_VALUES = "VALUES " + ", ".join(f"('{task}')" for task in _TASKS)
_PLAN_SQL = f"tasks(task_id) AS ({_TASK_VALUES})"
_WANTED_SQL = """
    wanted AS (
        SELECT r.pipeline, r.run_id, t.task_id, l.score
        FROM runs r CROSS JOIN tasks t LEFT JOIN latest l
          ON l.pipeline = r.pipeline AND l.run_id = r.run_id AND l.task_id = t.task_id)
"""
_TOTALS = """
    pipeline, run_id,
    CASE WHEN count(*) = count(score) THEN least(min(score), 1.0) END AS score,
    CASE WHEN count(*) = count(score) THEN round(product(score), 6) END AS prod_score,
    CAST(count(*) - count(score) AS INTEGER) AS n_incomplete
"""


@CATALOG.add(f"""
    WITH {_LATEST_SQL}, {_PLAN_SQL}, {_WANTED_SQL}
    SELECT {_TOTALS} FROM wanted GROUP BY pipeline, run_id
""")
def report_scores(spark, folder):
    return R.report(_results(spark, folder), _TASKS).select(
        "pipeline", "run_id", "score", F.round("prod_score", 6).alias("prod_score"), "n_incomplete")


@CATALOG.add(f"""
    WITH {_LATEST_SQL}, {_PLAN_SQL}, {_WANTED_SQL}
    SELECT pipeline, run_id, string_agg(task_id || '=' || coalesce(CAST(score AS VARCHAR), 'null'), ',' ORDER BY task_id) AS task_scores
    FROM wanted GROUP BY pipeline, run_id
""")
def report_task_maps(spark, folder):
    # The map as text, so that both engines show it alike; the tasks are in order already.
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null")))
    return R.report(_results(spark, folder), _TASKS).select(
        "pipeline", "run_id",
        F.array_join(F.transform(F.map_entries("task_scores"), entry), ",").alias("task_scores"))


# Every customer is a pipeline with a plan of its own: four or five checks.
_DECLARED_SQL = f"""
    declared AS (
        SELECT CAST(c_custkey AS VARCHAR) AS pipeline, task_id FROM customer, ({_TASK_VALUES}) AS t(task_id)
        WHERE NOT (task_id = 'error' AND c_custkey % 2 = 0)),
    planned AS (
        SELECT r.pipeline, r.run_id, d.task_id, l.score
        FROM runs r JOIN declared d USING (pipeline) LEFT JOIN latest l
          ON l.pipeline = r.pipeline AND l.run_id = r.run_id AND l.task_id = d.task_id)
"""


def _declared(spark, folder):
    return (
        table(spark, folder, "customer")
        .select("c_custkey", F.explode(F.array(*[F.lit(task) for task in _TASKS])).alias("task_id"))
        .where("NOT (task_id = 'error' AND c_custkey % 2 = 0)")
        .selectExpr("CAST(c_custkey AS STRING) AS pipeline", "task_id")
    )


@CATALOG.add(f"""
    WITH {_LATEST_SQL}, {_DECLARED_SQL}
    SELECT {_TOTALS} FROM planned GROUP BY pipeline, run_id
""")
def fleet_report(spark, folder):
    return R.fleet_report(_results(spark, folder), _declared(spark, folder)).withColumn(
        "prod_score", F.round("prod_score", 6))


@CATALOG.add(f"WITH {_LATEST_SQL}, {_DECLARED_SQL} SELECT pipeline, run_id, task_id, score FROM planned")
def report_task_rows(spark, folder):
    return R.task_rows(_results(spark, folder), _declared(spark, folder))


@CATALOG.add(f"WITH {_LATEST_SQL}, {_DECLARED_SQL} SELECT pipeline, run_id, task_id FROM planned WHERE score IS NULL")
def incomplete_tasks(spark, folder):
    return R.incomplete_tasks(_results(spark, folder), _declared(spark, folder))


# An event's props are what its attempt warned of; a high value makes it count more than once. The
# warnings of earlier attempts are no part of the report.
@CATALOG.add("""
    WITH attempts AS (
        SELECT CAST(user_id AS VARCHAR) AS pipeline, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS run_id,
               event_type AS task_id, CAST({score} AS DOUBLE) AS score, ts, props,
               CAST(CASE WHEN value > 60 THEN 2 ELSE 1 END AS BIGINT) AS times, event_id % 3 <> 0 AS warned, event_id FROM events),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY pipeline, run_id, task_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS nth FROM attempts)
    SELECT pipeline, run_id, task_id, score, times AS n_warnings,
           CASE WHEN warned THEN props END AS warning, CASE WHEN warned THEN times END AS times
    FROM numbered WHERE nth = 1
""".replace("{score}", _SCORE))
def report_task_warnings(spark, folder):
    events = table(spark, folder, "events").withColumn("times", F.expr("CAST(CASE WHEN value > 60 THEN 2 ELSE 1 END AS BIGINT)"))
    run = ["CAST(user_id AS STRING) AS pipeline", "CAST(CAST(date_trunc('week', ts) AS DATE) AS STRING) AS run_id", "event_type AS task_id"]
    results = events.selectExpr(*run, f"CAST({_SCORE} AS DOUBLE) AS score", "times AS n_warnings", "ts AS ended_at", "CAST(event_id AS STRING) AS attempt")
    return R.task_warnings(results, events.where("event_id % 3 <> 0").selectExpr(*run, "props AS warning", "times", "CAST(event_id AS STRING) AS attempt"))

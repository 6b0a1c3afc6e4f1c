"""The report of a run: lowest and product score over its checks.

A check without a score makes both scores of its run null: aggregates that skip nulls would
let an unfinished check pass unseen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["pipeline", "run_id"]


def _order(results: DataFrame) -> Column:
    """When an attempt ended; its name decides between equal times."""
    return F.struct("ended_at", "attempt") if "attempt" in results.columns else F.struct("ended_at")


def latest_attempts(results: DataFrame) -> DataFrame:
    """The results of the latest attempt at each task of each run."""
    keys = [*RUN, "task_id"]
    others = [c for c in results.columns if c not in keys]
    latest = results.groupBy(*keys).agg(F.max_by(F.struct(*others), _order(results)).alias("_latest"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_latest.{c}").alias(c) for c in results.columns])


def latest_scores(results: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """One row per run with a column ``score_<n>`` per declared task, the score of its latest
    attempt by ``ended_at``.

    The declared tasks are columns, so all attempts of all tasks reduce to one fixed-size row
    per run before the shuffle.
    """
    def latest(task: str) -> Column:
        mine = F.col("task_id") == task
        return F.max_by(F.when(mine, F.col("score")), F.when(mine, _order(results)))

    if not tasks:
        return results.select(*RUN).distinct()
    return results.groupBy(*RUN).agg(
        *[latest(task).alias(f"score_{n}") for n, task in enumerate(tasks)])


def report(results: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """(pipeline, run_id, score, prod_score, n_incomplete, task_scores) for every run.

    ``tasks`` declares the checks of the plan; with none both scores are 1.0. Attempts are
    told apart by ``ended_at``.
    """
    rows = latest_scores(results, tasks)
    scores = [F.col(f"score_{n}") for n in range(len(tasks))]
    missing = reduce(lambda a, b: a + b, [s.isNull().cast("int") for s in scores], F.lit(0))
    product = reduce(lambda a, b: a * b, scores, F.lit(1.0))
    task_map = F.create_map(*[part for task, s in zip(tasks, scores) for part in (F.lit(task), s)])
    if not tasks:
        task_map = task_map.cast("map<string,double>")
    return rows.select(
        *RUN,
        F.when(missing == 0, F.least(F.lit(1.0), F.lit(1.0), *scores)).alias("score"),
        F.when(missing == 0, product).alias("prod_score"),
        missing.alias("n_incomplete"),
        task_map.alias("task_scores"))


def fleet_report(results: DataFrame, declared: DataFrame) -> DataFrame:
    """The same scores when every pipeline declares its own tasks in a table
    (pipeline, task_id). Task scores stay rows; see :func:`task_rows`."""
    latest = results.groupBy(*RUN, "task_id").agg(F.max_by("score", _order(results)).alias("score"))
    named = declared.distinct().withColumn("_declared", F.lit(True))
    n_tasks = declared.distinct().groupBy("pipeline").agg(F.count(F.lit(1)).alias("n_tasks"))
    # Runs without any result of a declared task keep a row: only its scores are left out.
    score = F.when(F.col("_declared"), F.col("score"))
    totals = (
        latest.join(named, ["pipeline", "task_id"], "left").groupBy(*RUN)
        .agg(F.min(score).alias("low"), F.product(score).alias("product"), F.count(score).alias("n_scored"))
    )
    joined = totals.join(n_tasks, ["pipeline"], "left").fillna(0, ["n_tasks"])
    open_tasks = F.col("n_tasks") - F.col("n_scored")
    return joined.select(
        *RUN,
        F.when(open_tasks == 0, F.least(F.coalesce("low", F.lit(1.0)), F.lit(1.0))).alias("score"),
        F.when(open_tasks == 0, F.coalesce("product", F.lit(1.0))).alias("prod_score"),
        open_tasks.cast("int").alias("n_incomplete"))


def task_rows(results: DataFrame, declared: DataFrame) -> DataFrame:
    """(pipeline, run_id, task_id, score) for every declared task of every run, null where
    the run has no score: the task list joined with the results."""
    runs = results.select(*RUN).distinct()
    wanted = runs.join(declared.distinct(), ["pipeline"])
    latest = results.groupBy(*RUN, "task_id").agg(F.max_by("score", _order(results)).alias("score"))
    return wanted.join(latest, [*RUN, "task_id"], "left")


def incomplete_tasks(results: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared tasks without a score, one row each."""
    return task_rows(results, declared).where(F.col("score").isNull()).select(*RUN, "task_id")


def task_warnings(results: DataFrame, warnings: DataFrame) -> DataFrame:
    """(pipeline, run_id, task_id, score, n_warnings, warning, times): the report of a run's tasks with
    what each warned of, one row per distinct warning and one with null for a task without any.

    Both tables name the ``attempt`` a row is of: a task tried more than once is reported with the
    score and the warnings of its latest attempt only. Equal warnings of an attempt come once, with
    their times added up.
    """
    latest = latest_attempts(results.select(*RUN, "task_id", "score", "n_warnings", "ended_at", "attempt"))
    found = warnings.groupBy(*RUN, "task_id", "attempt", "warning").agg(F.sum("times").alias("times"))
    return latest.join(found, [*RUN, "task_id", "attempt"], "left").select(
        *RUN, "task_id", "score", "n_warnings", "warning", "times")

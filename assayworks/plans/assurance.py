"""Run a plan of checks over all runs of all pipelines, and report on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.checks import Outcome
from assayworks.operators.history import SUCCESS, last_success_before
from assayworks.operators.report import latest_attempts, report
from assayworks.operators.scoring import ROW, scored, subject_rows, warning_rows
from assayworks.plans.registry import RUN, Registry, Task, standard_registry
from assayworks.schemas import CHECK_RESULTS, CHECK_WARNINGS
from assayworks.session import discard, settle
from assayworks.sources.sinks import new_attempt, publish, published_results

TASK_RUN = [*RUN, "task_id"]


def check_rows(plan: Sequence[Task], runs: DataFrame, evidence: Mapping[str, DataFrame],
               history: DataFrame | None = None, keep_last: Sequence[str] = (),
               registry: Registry | None = None, history_warnings: DataFrame | None = None) -> DataFrame:
    """The rows of all tasks of the plan for every run (see ``scoring.ROW``), as one lazy union.

    ``runs`` has pipeline, run_id and started_at; the evidence tables carry pipeline and
    run_id and are offered to the checks under their names, ``runs`` among them. Tasks in
    ``keep_last`` take the last good result of the same pipeline that started before the run, with
    its warnings, from ``history`` and ``history_warnings``, and are only run where there is none.
    """
    registry = registry or standard_registry()
    for task in plan:
        registry.validate(task)
    offered = {"runs": runs.select(*RUN), **evidence}
    found = []
    for task in plan:
        tables = offered
        if history is not None and task.task_id in keep_last:
            kept = _kept(runs, history, task)
            tables = {name: _of_others(offered[name], kept) for name in task.tables.values()}
            found.append(_task(_kept_rows(kept, history_warnings, task), task))
        found.append(_task(_rows(registry.run(task, tables)), task))
    return reduce(lambda a, b: a.unionByName(b), found)


def _rows(outcome: Outcome) -> DataFrame:
    """A check's rows; those of a check that has none itself come from its results and warnings."""
    if outcome.rows is not None:
        return outcome.rows
    results = outcome.results.withColumn("score", F.col("score").cast("double"))
    own = subject_rows(results, RUN, F.col("score"), F.col("score").isNull(), F.col("n_warnings"))
    return own.unionByName(warning_rows(outcome.warnings, RUN, None))


def _task(rows: DataFrame, task: Task) -> DataFrame:
    return rows.select(*RUN, F.lit(task.task_id).alias("task_id"), *ROW)


def _kept(runs: DataFrame, history: DataFrame, task: Task) -> DataFrame:
    asked = runs.select(*RUN, "started_at").withColumn("task_id", F.lit(task.task_id))
    good = history.where((F.col("task_id") == task.task_id) & (F.col("state") == SUCCESS))
    if "attempt" not in history.columns:
        return last_success_before(asked, good)
    return last_success_before(asked, latest_attempts(good), ["score", "n_warnings", "attempt"])


def _kept_rows(kept: DataFrame, history_warnings: DataFrame | None, task: Task) -> DataFrame:
    own = subject_rows(kept, RUN, F.col("last_score"), given=F.col("last_n_warnings"))
    if history_warnings is None:
        return own
    # Warnings of other attempts at the run whose result is kept stay out.
    of_attempt = "last_attempt" in kept.columns and "attempt" in history_warnings.columns
    named = {"run_id": "last_run_id"} | ({"attempt": "last_attempt"} if of_attempt else {})
    earlier = history_warnings.where(F.col("task_id") == task.task_id).select(
        "pipeline", *[F.col(c).alias(last) for c, last in named.items()], "warning", "times")
    return own.unionByName(warning_rows(kept.join(earlier, ["pipeline", *named.values()]), RUN, None))


def _of_others(table: DataFrame, kept: DataFrame) -> DataFrame:
    """Evidence of the runs without a result to keep; shared tables stay whole."""
    keys = [key for key in RUN if key in table.columns]
    if keys != RUN:
        return table
    return table.join(kept.select(*RUN).distinct(), RUN, "left_anti")


def _outcome(rows: DataFrame, runs: DataFrame, attempt: str) -> Outcome:
    stamped = (
        scored(rows, TASK_RUN).join(runs.select(*RUN, "started_at").distinct(), RUN)
        .withColumn("ended_at", F.current_timestamp()).withColumn("attempt", F.lit(attempt))
        .withColumn("state", F.when(F.col("score").isNull(), "failed").otherwise("success"))
    )
    warned = rows.where(F.col("times") > 0).withColumn("attempt", F.lit(attempt))
    return Outcome(stamped.select(*CHECK_RESULTS.names), warned.select(*CHECK_WARNINGS.names), rows)


def run_checks(plan: Sequence[Task], runs: DataFrame, evidence: Mapping[str, DataFrame],
               history: DataFrame | None = None, keep_last: Sequence[str] = (),
               registry: Registry | None = None, history_warnings: DataFrame | None = None) -> Outcome:
    """Results and warnings of every task of the plan for every run; arguments as in
    :func:`check_rows`. Each of the two frames evaluates the evidence; :func:`assure` does so once."""
    return _outcome(check_rows(plan, runs, evidence, history, keep_last, registry, history_warnings), runs, new_attempt())


def assure(plan: Sequence[Task], runs: DataFrame, evidence: Mapping[str, DataFrame], folder: str,
           history: DataFrame | None = None, keep_last: Sequence[str] = (),
           registry: Registry | None = None, history_warnings: DataFrame | None = None, attempt: str | None = None) -> DataFrame:
    """Run the plan, publish its results and warnings under ``folder`` and return the report of the runs.

    What is published counts from the moment the ``attempt`` is whole (see
    :func:`~assayworks.sources.sinks.publish`); the report takes the last whole attempt at each task.
    The rows of all checks are written once; results and warnings are derived from that table, and
    the report reads the days on which the runs started.
    """
    rows = settle(check_rows(plan, runs, evidence, history, keep_last, registry, history_warnings), "rows")
    attempt = attempt or new_attempt()
    outcome = _outcome(rows, runs, attempt)
    publish(outcome.results, outcome.warnings, runs, folder, attempt)
    discard(rows)
    days = runs.agg(F.min(F.to_date("started_at")).alias("first"), F.max(F.to_date("started_at")).alias("last")).first()
    mine = published_results(runs.sparkSession, folder, days["first"], days["last"]).join(
        runs.select(*RUN).distinct(), RUN, "left_semi")
    return report(mine, [task.task_id for task in plan])

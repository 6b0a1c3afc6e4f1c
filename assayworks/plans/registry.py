"""Checks by name. A check is any function that returns an Outcome."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from assayworks import checks
from assayworks.checks import Outcome

#: What identifies the subject of a check inside a plan.
RUN = ["pipeline", "run_id"]


class Task(NamedTuple):
    """One check of a plan: which check, which evidence table feeds which of its arguments,
    and its fixed arguments."""

    task_id: str
    check: str
    tables: Mapping[str, str] = {}
    params: Mapping[str, Any] = {}


class Registry:
    def __init__(self) -> None:
        self._checks: dict[str, Callable[..., Outcome]] = {}

    def register(self, name: str, check: Callable[..., Outcome]) -> None:
        if name in self._checks:
            raise ValueError(f"check {name!r} is registered twice")
        self._checks[name] = check

    def names(self) -> list[str]:
        return sorted(self._checks)

    def validate(self, task: Task) -> None:
        """Fail before anything runs when arguments are missing, unknown or given twice."""
        if task.check not in self._checks:
            raise ValueError(f"{task.task_id}: no check named {task.check!r}")
        twice = set(task.tables) & set(task.params)
        if twice:
            raise ValueError(f"{task.task_id}: {sorted(twice)} given twice")
        given = {**task.tables, **task.params}
        try:
            inspect.signature(self._checks[task.check]).bind(**given)
        except TypeError as error:
            raise ValueError(f"{task.task_id}: {task.check}: {error}") from None

    def run(self, task: Task, evidence: Mapping[str, Any]) -> Outcome:
        self.validate(task)
        missing = sorted(set(task.tables.values()) - set(evidence))
        if missing:
            raise ValueError(f"{task.task_id}: no evidence table {missing}")
        tables = {argument: evidence[name] for argument, name in task.tables.items()}
        check = self._checks[task.check]
        keyed = {"keys": RUN} if "keys" in inspect.signature(check).parameters else {}
        return check(**tables, **{**keyed, **task.params})


def _job_log(app_jobs, expected) -> Outcome:
    """The job log check with the application as pipeline and its id as run."""
    outcome = checks.job_log_check(
        app_jobs.withColumnsRenamed({"pipeline": "app_name", "run_id": "app_id"}), expected)
    named = {"app_name": "pipeline", "app_id": "run_id"}
    return Outcome(*[frame.withColumnsRenamed(named) for frame in outcome])


def standard_registry() -> Registry:
    """All checks of the library."""
    registry = Registry()
    registry.register("config", checks.config_check)
    registry.register("acl", checks.acl_check)
    registry.register("args", checks.args_check)
    registry.register("paths", checks.paths_check)
    registry.register("urls", checks.urls_check)
    registry.register("lint", checks.lint_check)
    registry.register("permissions", checks.permission_check)
    registry.register("can_read", checks.can_read_check)
    registry.register("can_write", checks.can_write_check)
    registry.register("dependencies", checks.dependency_check)
    registry.register("scan", checks.scan_check)
    registry.register("job_log", _job_log)
    return registry

"""Task arguments against expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from assayworks.checks.outcome import Outcome, judged
from assayworks.operators.differences import args_differences


def args_check(tasks: DataFrame, args: DataFrame, expected: DataFrame,
               keys: Sequence[str] = ("task",)) -> Outcome:
    """0.0 for a task with an argument that is not expected or has another value."""
    warnings = args_differences(args, expected, keys)
    return judged(tasks, warnings, keys)

"""What every check returns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from assayworks.operators.scoring import scored, subject_rows, warning_rows


class Outcome(NamedTuple):
    """``results`` has one row (keys, n_warnings, score) per subject, ``warnings`` one row
    (keys, …, warning) per finding; warnings are never gathered into arrays. ``rows`` holds
    both in one table (see :mod:`~assayworks.operators.scoring`), so that a plan can write it
    once and derive the rest; a check of a user's own may leave it out.

    Frames are lazy, but for :func:`~assayworks.checks.jobs.job_log_check`, which writes the runs
    and their order when it is built. Using results and warnings both evaluates the evidence twice.
    """

    results: DataFrame
    warnings: DataFrame
    rows: DataFrame | None = None


def judged(subjects: DataFrame, warnings: DataFrame, keys: Sequence[str], score: Column | float = 0.0) -> Outcome:
    """The outcome of a check whose warnings each bring a sub-score."""
    rows = subject_rows(subjects, keys).unionByName(warning_rows(warnings, keys, score))
    return Outcome(scored(rows, keys), warnings, rows)

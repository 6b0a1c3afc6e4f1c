"""From violations to one score per subject.

Every score starts from the list of all subjects: a subject without violations shows up with
1.0, and evidence of a key that is no subject is left out. What a check leaves behind is one
table of rows, those of its subjects and those of its warnings; it is aggregated in a single
shuffle whose partial aggregates have a fixed size, whatever the warnings of one subject. A
violation with a column ``times`` counts that often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a check's rows beside its keys. A subject row has no warning and times 0.
#: ``otherwise`` is the score of a subject all of whose warnings are unrated (null score),
#: ``unknown`` makes the subject's score null, ``given`` replaces the number of warnings.
ROW = ["warning", "times", "score", "otherwise", "unknown", "given"]


KINDS = ["string", "long", "double", "double", "boolean", "long"]


def row_columns(warning: Column | None = None, times: int | Column = 0, score: float | Column | None = None,
                otherwise: float | Column | None = None, unknown: bool | Column = False, given: Column | None = None) -> list[Column]:
    """The columns ``ROW`` of one row."""
    values = [warning, times, score, otherwise, unknown, given]
    return [(v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name) for name, kind, v in zip(ROW, KINDS, values, strict=True)]


def subject_rows(subjects: DataFrame, keys: Sequence[str], score: float | Column = 1.0,
                 unknown: bool | Column = False, given: Column | None = None) -> DataFrame:
    return subjects.select(*keys, *row_columns(score=score, unknown=unknown, given=given))


def warning_rows(violations: DataFrame, keys: Sequence[str], score: float | Column | None,
                 otherwise: float | None = None) -> DataFrame:
    times = F.col("times") if "times" in violations.columns else 1
    return violations.select(*keys, *row_columns(F.col("warning"), times, score, otherwise))


def scored(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_warnings, score) of the subjects among a check's rows."""
    rated = F.count(F.when(F.col("times") > 0, F.col("score")))
    sums = rows.groupBy(*keys).agg(
        F.max(F.col("times") == 0).alias("listed"), F.sum("times").alias("times"), F.max("given").alias("given"),
        F.min("score").alias("low"), F.min("otherwise").alias("otherwise"), rated.alias("rated"), F.max("unknown").alias("unknown"))
    unrated = (F.col("times") > 0) & (F.col("rated") == 0) & F.col("otherwise").isNotNull()
    return sums.where("listed").select(
        *keys, F.coalesce("given", "times").alias("n_warnings"),
        F.when(~F.col("unknown"), F.when(unrated, F.col("otherwise")).otherwise(F.least("low", F.lit(1.0)))).alias("score"))


def lowest_score(subjects: DataFrame, violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest sub-score of the violated rules, 1.0 when there is none."""
    rows = subject_rows(subjects, keys).unionByName(
        warning_rows(violations.withColumn("warning", F.lit("")), keys, F.col("score")))
    return scored(rows, keys)


def all_or_nothing(subjects: DataFrame, violations: DataFrame, keys: Sequence[str],
                   floor: float = 0.0) -> DataFrame:
    """1.0 without violations, ``floor`` with any."""
    return lowest_score(subjects, violations.withColumn("score", F.lit(floor)), keys)

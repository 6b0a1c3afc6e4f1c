"""Table layouts: evidence that goes in, violations and results that come out."""

from __future__ import annotations

from pyspark.sql import types as T

#: One vulnerability report: host -> vulnerability id -> severity.
SCAN_REPORT = T.StructType([
    T.StructField("data", T.MapType(T.StringType(), T.StructType([
        T.StructField("vulnerabilities", T.MapType(T.StringType(), T.StructType([
            T.StructField("cvss", T.DoubleType()),
        ]))),
    ]))),
    T.StructField("_corrupt_record", T.StringType()),
])

#: Probe timings as shipped: column names and order of the CSV file.
PROBE_TIMINGS_CSV = T.StructType([
    T.StructField("row", T.IntegerType()),
    T.StructField("dag_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("Probe type", T.StringType()),
    T.StructField("Execution time (s)", T.DoubleType()),
    T.StructField("CC", T.BooleanType()),
    T.StructField("PC", T.BooleanType()),
    T.StructField("EC", T.BooleanType()),
    T.StructField("NC", T.BooleanType()),
    T.StructField("IC", T.BooleanType()),
    T.StructField("Task type", T.StringType()),
])

PASSENGERS_CSV = T.StructType([
    T.StructField("PassengerId", T.IntegerType()),
    T.StructField("Pclass", T.IntegerType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Sex", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("SibSp", T.IntegerType()),
    T.StructField("Parch", T.IntegerType()),
    T.StructField("Ticket", T.StringType()),
    T.StructField("Fare", T.DoubleType()),
    T.StructField("Cabin", T.StringType()),
    T.StructField("Embarked", T.StringType()),
])

#: One score per (pipeline, run, task) and attempt.
CHECK_RESULTS = T.StructType([
    T.StructField("pipeline", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("n_warnings", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("attempt", T.StringType()),
])

#: Warnings stay rows: their number has no bound.
CHECK_WARNINGS = T.StructType([
    T.StructField("pipeline", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("warning", T.StringType()),
    T.StructField("times", T.LongType()),
    T.StructField("attempt", T.StringType()),
])

#: The attempts whose results and warnings are whole.
COMMITS = T.StructType([
    T.StructField("attempt", T.StringType()),
    T.StructField("committed_at", T.TimestampType()),
])

RUN_SUMMARY = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("summary", T.ArrayType(T.StringType())),
])

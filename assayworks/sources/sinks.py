"""Writers. All of them overwrite or append whole tables, in parallel."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayworks.schemas import CHECK_RESULTS, CHECK_WARNINGS, COMMITS


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def new_attempt() -> str:
    """A name for one attempt at running and publishing a plan."""
    return uuid.uuid4().hex


def publish(results: DataFrame, warnings: DataFrame, runs: DataFrame, folder: str, attempt: str | None = None) -> str:
    """Publish the check results and warnings of one attempt, where later runs and reports find them.

    Both are partitioned by the day a run started (``runs`` has it for the warnings), so a busy
    pipeline does not make one huge directory and history is pruned by date, and by attempt. The rows
    of a day are rebalanced into few files, and a very busy day into more of them. Readers see an
    attempt only by its commit, which is written last: one that dies before leaves nothing that
    counts, and publishing it again under its name replaces what it left. Returns the attempt's name.
    """
    attempt = attempt or new_attempt()
    stage(results, folder, "results", CHECK_RESULTS, F.to_date("started_at"), attempt)
    started = runs.select("pipeline", "run_id", F.to_date("started_at").alias("_day")).distinct()
    stage(warnings.join(started, ["pipeline", "run_id"]), folder, "warnings", CHECK_WARNINGS, F.col("_day"), attempt)
    spark = results.sparkSession
    commit = spark.range(1).select(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"))
    commit.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return attempt


def stage(rows: DataFrame, folder: str, name: str, schema: T.StructType, day: Column, attempt: str) -> None:
    """Write an attempt's rows, in place of what the same attempt left on the same days."""
    named = rows.select(*[c for c in schema.names if c != "attempt"], day.alias("day"), F.lit(attempt).alias("attempt"))
    (named.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "attempt").parquet(f"{folder}/{name}"))


def _published(spark: SparkSession, folder: str, name: str, schema: T.StructType, first: date | None, last: date | None) -> DataFrame:
    fields = [f for f in schema.fields if f.name != "attempt"]
    parts = [T.StructField("day", T.DateType()), T.StructField("attempt", T.StringType())]
    table = spark.read.schema(T.StructType([*fields, *parts])).parquet(f"{folder}/{name}")
    commits = spark.read.schema(COMMITS).parquet(f"{folder}/commits").select("attempt").distinct()
    table = table.join(commits, "attempt", "left_semi").select(*schema.names, "day")
    if first is not None:
        table = table.where(F.col("day") >= F.lit(first))
    return table if last is None else table.where(F.col("day") <= F.lit(last))


def published_results(spark: SparkSession, folder: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Results of committed attempts at runs that started on the days from ``first`` to ``last``; only those are read."""
    return _published(spark, folder, "results", CHECK_RESULTS, first, last)


def published_warnings(spark: SparkSession, folder: str, first: date | None = None, last: date | None = None) -> DataFrame:
    return _published(spark, folder, "warnings", CHECK_WARNINGS, first, last)

"""Compare a registered query with its SQL, run by DuckDB over the same files."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else float(repr(value))
    if isinstance(value, (datetime, date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_sql(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    return [names[i] for i in order], rows


def differences(df, connection, sql: str) -> str:
    """Empty when both give the same columns and the same multiset of rows."""
    spark_names, spark_rows = rows_of_spark(df)
    sql_names, sql_rows = rows_of_sql(connection, sql)
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    if spark_rows == sql_rows:
        return "" if spark_rows else "both are empty"
    only_spark, only_sql = spark_rows - sql_rows, sql_rows - spark_rows
    return (f"{sum(only_spark.values())} of {sum(spark_rows.values())} rows only in Spark "
            f"{list(only_spark)[:3]}; {sum(only_sql.values())} of {sum(sql_rows.values())} only in SQL "
            f"{list(only_sql)[:3]}")

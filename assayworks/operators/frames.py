"""Row-wise clean-up of training and timing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a missing category is called.
NONE_TEXT = "None"


def null_to_text(df: DataFrame, column: str, text: str = NONE_TEXT) -> DataFrame:
    """Replace nulls of a column by a text; other values are rendered as text."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(text)))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in any of the columns."""
    return df.dropna("any", subset=list(columns) if columns else None)


def seconds_between(start: Column, end: Column) -> Column:
    """Duration in seconds, exact to the microsecond."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)

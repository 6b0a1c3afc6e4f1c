"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayworks.session import workspace

#: Fixed value: the words of a text are the runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: About so many bytes of text are handled at once inside a task, whatever the batch holds.
SLICE_BYTES = 4 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back; what follows starts from the files."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, if they lack it."""
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, known), home])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_names(text: Column) -> Column:
    """The words of a text as 64-bit names, in order; a null text has none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(w))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it often or in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; rows of equal texts share it."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def slices(batch: pa.RecordBatch, lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` units each; a longer row is a range of its own."""
    ends = np.cumsum(lengths)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column; null lists are empty."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit names."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))

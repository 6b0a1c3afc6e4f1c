"""Preparing training tables: folds, hold-out, indices, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.operators.ranges import sum_before
from assayworks.session import settle


def key_number(key: Column, salt: int) -> Column:
    """A number in [0, 2**32) that depends on the key and the salt only."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def fold_of(key: Column, folds: int, seed: int) -> Column:
    """Fold number of a row: the same for any partitioning of the table."""
    return (key_number(key, seed) % folds).cast("int")


def holdout_split(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 12345):
    """(train, test): a repeatable split by the key of the rows."""
    bound = int(round(train_share * 10_000))
    ticket = key_number(F.col(key), seed) % 10_000
    return df.where(ticket < bound), df.where(ticket >= bound)


#: Rows in a part of a table laid out for a seeded fit.
LAYOUT_ROWS = 100_000


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """The rows in parts and an order that depend on their number and keys only.

    What an estimator draws with a seed depends on the parts it finds; here they are the same for any
    number of shuffle partitions and files. ``key`` tells rows apart. Counts the rows when called.
    """
    parts = max(1, -(-df.count() // LAYOUT_ROWS))
    return df.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key)


#: Entries of vectors in a part of a table packed for a fit: 16 MB of doubles.
PACKED_VALUES = 2_000_000


def packed(df: DataFrame, column: str) -> DataFrame:
    """The rows in as few parts as hold PACKED_VALUES entries of the vectors in ``column`` each.

    A fit runs a job for every step. With small parts its time goes by the tasks and stages of these
    jobs, not by the rows. There are never more parts than before. Reads the vectors when called.
    """
    sizes = df.where(F.col(column).isNotNull()).select(F.size(vector_to_array(column)).alias("n"))
    values = sizes.agg(F.sum("n")).first()[0] or 0
    return df.coalesce(max(1, -(-values // PACKED_VALUES)))


def string_indexer(columns: Sequence[str], suffix: str = "Id") -> StringIndexer:
    """Indices by descending frequency; unseen values and nulls get an index of their own."""
    return StringIndexer(inputCols=list(columns), outputCols=[c + suffix for c in columns],
                         handleInvalid="keep")


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep")


def vector_from_array(df: DataFrame, column: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(column)))


def widen(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """An array column as one column per position."""
    return df.select("*", *[F.get(F.col(column), F.lit(i)).alias(n) for i, n in enumerate(names)]).drop(column)


def frequency_index(df: DataFrame, column: str, output: str = "index") -> DataFrame:
    """(value, n, index): values by descending frequency, ties by value.

    The same order as :func:`string_indexer`, whose labels live on the driver, for columns
    with too many distinct values for that.
    """
    counts = settle(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")), "counts")
    order = [("n", False), ("value", True)]
    ones = counts.withColumn("_one", F.lit(1).cast("long"))
    return sum_before(ones, order, "_one", output, settled=True).drop("_one")

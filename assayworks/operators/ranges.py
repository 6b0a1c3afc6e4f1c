"""Running values over one long order, without putting a whole key into one task.

A plain window gives every key to a single task. Here Spark's range partitioning cuts the order
into balanced stretches: a window runs inside each (key, stretch), and one row per stretch
carries what the earlier stretches hold. The stretch of a row is written down with it, so later
steps and retried tasks agree on it. There is one path for every size; nulls and NaN lie where
Spark's sort puts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayworks.session import settle, workspace

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def _sorted(order: Order) -> list[Column]:
    return [F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in order]


def stretched(df: DataFrame, order: Order, settled: bool = False) -> DataFrame:
    """``df`` with ``_stretch``: rows of a lower stretch come before those of a higher one.

    Runs at once and writes the table. Range partitioning reads its input twice (to sample it and
    to cut it), so the input is written first unless it is a table already (``settled``). There
    are as many stretches as shuffle partitions, or fewer of them where Spark joins small ones.
    """
    if not settled:
        df = settle(df, "order")
    path = workspace(df.sparkSession, "stretches")
    cut = df.repartitionByRange(*_sorted(order)).withColumn("_stretch", F.spark_partition_id())
    cut.write.parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def last_before(df: DataFrame, keys: Sequence[str], order: Order, value: str, output: str,
                settled: bool = False) -> DataFrame:
    """Add the latest non-null ``value`` among strictly earlier rows of the same key.

    ``order`` must be unique within a key.
    """
    staged = stretched(df, order, settled)
    within = Window.partitionBy(*keys, "_stretch").orderBy(*_sorted(order)).rowsBetween(
        Window.unboundedPreceding, -1)
    filled = staged.where(F.col(value).isNotNull())
    # The last filled row of each key and stretch, then of all earlier stretches of the key.
    last = F.last("_last", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    latest = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(
        *[F.col(n).desc() if ascending else F.col(n).asc() for n, ascending in order]))
    ends = filled.withColumn("_nth", latest).where("_nth = 1").select(*keys, "_stretch", F.col(value).alias("_last"))
    present = staged.select(*keys, "_stretch").distinct()
    same = [present[k].eqNullSafe(ends[k]) for k in [*keys, "_stretch"]]
    carried = (
        present.join(ends, same, "left").select(*[present[k] for k in [*keys, "_stretch"]], "_last")
        .withColumn("_carried", last).drop("_last")
    )
    carried = carried.withColumnsRenamed({k: f"_c_{k}" for k in [*keys, "_stretch"]})
    met = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in [*keys, "_stretch"]]
    return (
        staged.withColumn("_near", F.last(value, ignorenulls=True).over(within)).join(carried, met, "left")
        .withColumn(output, F.coalesce("_near", "_carried")).select(*df.columns, output)
    )


def sum_before(df: DataFrame, order: Order, value: str, output: str, settled: bool = False) -> DataFrame:
    """Add the sum of ``value`` over all rows strictly before, over the whole table.

    ``order`` must be unique. The only single-task window sees one row per stretch.
    """
    staged = stretched(df, order, settled)
    nothing = F.lit(0)
    within = Window.partitionBy("_stretch").orderBy(*_sorted(order)).rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (
        staged.groupBy("_stretch").agg(F.sum(value).alias("_sum"))
        .withColumn("_carried", F.sum("_sum").over(
            Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_stretch", F.coalesce("_carried", nothing).alias("_carried"))
    )
    return (
        staged.withColumn("_near", F.coalesce(F.sum(value).over(within), nothing)).join(carried, "_stretch")
        .withColumn(output, F.col("_near") + F.col("_carried")).select(*df.columns, output)
    )

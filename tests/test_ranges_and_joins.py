"""Stretched windows against plain loops, and joins with hot keys."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from assayworks.operators.ranges import last_before, stretched, sum_before


def history(spark, n=3_000):
    """One key holds a third of all rows; many rows share a moment, some have none or NaN."""
    rng = random.Random(1)
    data = [
        (rng.choice(["hot", *[f"k{i}" for i in range(40)], None]) if rng.random() > 0.34 else "hot",
         rng.choice([None, math.nan, *map(float, range(200))]), i, i if rng.random() < 0.3 else None)
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "key string, at double, id int, value int").repartition(7)


def spark_order(at, ascending=True):
    """Nulls first and NaN last, or the other way round."""
    rank = (0, 0.0) if at is None else (2, 0.0) if math.isnan(at) else (1, at)
    return rank if ascending else (-rank[0], -rank[1])


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("rows_left", [3_000, 5, 0])
def test_last_before(spark, ascending, rows_left):
    data, df = history(spark)
    data, df = data[:rows_left], df.where(F.col("id") < rows_left)
    expected = {}
    for key in {row[0] for row in data}:
        last = None
        for row in sorted((r for r in data if r[0] == key), key=lambda r: (spark_order(r[1], ascending), r[2])):
            expected[row[2]] = last
            last = row[3] if row[3] is not None else last
    found = last_before(df, ["key"], [("at", ascending), ("id", True)], "value", "last")
    assert found.columns == ["key", "at", "id", "value", "last"]
    assert {row.id: row["last"] for row in found.collect()} == expected


def test_stretches_balance_a_hot_key(spark):
    _, df = history(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [row["count"] for row in stretched(df, [("at", True), ("id", True)]).groupBy("_stretch").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 6 and max(sizes) < 3 * min(sizes)


@pytest.mark.parametrize("ascending", [True, False])
def test_sum_before(spark, ascending):
    df = spark.range(500).withColumn("v", F.col("id") % 7).withColumn("group", F.when(F.col("id") % 5 > 0, F.col("id") % 5))
    rows = sorted(((r.group, r.id, r.v) for r in df.collect()), key=lambda r: (spark_order(r[0], ascending), r[1]))
    expected, total = {}, 0
    for _, ident, value in rows:
        expected[ident] = total
        total += value
    assert {r.id: r.s for r in sum_before(df, [("group", ascending), ("id", True)], "v", "s").collect()} == expected

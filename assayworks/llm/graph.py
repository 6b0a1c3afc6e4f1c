"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.llm.common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.withColumnRenamed("least", "b"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Links of a node with itself and repeated links do no harm; the order of a and b is free.
    Each round is a written table; the driver sees one count and one sum of it.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = written(links, label)
    before = _mark(links)
    while True:
        links = written(_small(_large(links).distinct()).distinct(), label)
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct()
    return (
        links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
    )

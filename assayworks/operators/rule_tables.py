"""Rules kept as rows: audits against a table of any number of rules, without pairing systems and rules.

A rule that its default does not break is violated only by an entry, so entries meet rules by key.
The rules that are bad by default get ranks in the order of their sub-scores; a system breaks all
of them but those whose keys it sets. Their number is a subtraction, and the lowest sub-score is
that of the first rank the system leaves out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayworks.operators.ranges import sum_before
from assayworks.operators.scoring import row_columns
from assayworks.session import settle

RULE = ["key", "default_value", "bad_value", "warning", "score"]


def ranked_rules(rules: DataFrame) -> DataFrame:
    """Rules (key, default_value, bad_value, warning, score) with ``rule``, a number of their own, and
    ``rank``, from 1, for those bad by default, lowest sub-score first. Equal rules count once. Written."""
    distinct = rules.select(*RULE[:4], F.col("score").cast("double").alias("score")).distinct()
    usual = distinct.select("*", F.col("default_value").eqNullSafe(F.col("bad_value")).cast("long").alias("usual"))
    # Rules bad by default come first, so their numbers are their ranks.
    order = [("usual", False), *[(c, True) for c in ("score", "key", "bad_value", "warning", "default_value")]]
    numbered = sum_before(usual.withColumn("one", F.lit(1)), order, "one", "earlier")
    rule = F.col("earlier") + 1
    return settle(numbered.select(*RULE, rule.alias("rule"), F.when(F.col("usual") == 1, rule).alias("rank")), "rules")


def _met(entries: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (keys, rule, rank, score, bad) per system and rule whose key it sets.

    What is aggregated has a fixed size, so Spark hashes it; texts of the rules are left to who needs them.
    """
    ordered = "position" in entries.columns
    place = F.col("position").cast("long") if ordered else F.lit(None).cast("long")
    given = entries.select(*keys, "key", "value", place.alias("position"))
    bad = F.coalesce(F.col("value") == F.col("bad_value"), F.lit(False))
    judged = given.join(rules, "key").select(*keys, "rule", "rank", "score", "position", bad.alias("bad"))
    sides = judged.groupBy(*keys, "rule").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"), F.max("bad").alias("any_bad"), F.min("bad").alias("all_bad"),
        F.max(F.when(F.col("bad"), F.col("position"))).alias("bad_at"), F.max(F.when(~F.col("bad"), F.col("position"))).alias("good_at"))
    # Of equal positions, or without any, the bad value counts.
    last = F.col("any_bad") & (F.col("all_bad") | F.coalesce(F.col("bad_at") >= F.col("good_at"), F.col("good_at").isNull()))
    return sides.select(*keys, "rule", "rank", "score", last.alias("bad"))


def _gaps(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_set, first_left): how many rules bad by default a system sets, and the first rank it leaves out."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    return (
        met.where(F.col("rank").isNotNull()).select(*keys, "rank").withColumn("nth", nth).groupBy(*keys)
        .agg(F.count("*").alias("n_set"), F.min(F.when(F.col("rank") != F.col("nth"), F.col("nth"))).alias("gap"))
        .select(*keys, "n_set", F.coalesce("gap", F.col("n_set") + 1).alias("first_left"))
    )


def table_scores(systems: DataFrame, entries: DataFrame, rules: DataFrame, keys: Sequence[str] = ("system",)) -> DataFrame:
    """(keys, n_warnings, score) of every system against ranked rules.

    As with listed rules: the last value of a key counts where entries have a ``position``, else any
    bad one; a key present with null does not violate; entries of other systems are left out.
    """
    met = _met(entries, rules, keys)
    usual = rules.where(F.col("rank").isNotNull())
    n_usual = usual.count()
    broken = met.where("bad").groupBy(*keys).agg(F.count("*").alias("n_bad"), F.min("score").alias("low_bad"))
    judged = (
        systems.select(*keys).distinct().join(broken, list(keys), "left").join(_gaps(met, keys), list(keys), "left")
        .withColumn("rank", F.coalesce("first_left", F.lit(1).cast("long")))
        .join(usual.select("rank", F.col("score").alias("low_left")), "rank", "left")
    )
    left = F.lit(n_usual) - F.coalesce("n_set", F.lit(0))
    return judged.select(
        *keys, (left + F.coalesce("n_bad", F.lit(0))).cast("long").alias("n_warnings"),
        F.least(F.lit(1.0), F.coalesce("low_bad", F.lit(1.0)), F.coalesce("low_left", F.lit(1.0))).alias("score"))


def table_violations(systems: DataFrame, entries: DataFrame, rules: DataFrame, keys: Sequence[str] = ("system",)) -> DataFrame:
    """One row (keys, key, warning, score) per violated rule of each system.

    Rules a system leaves at a bad default are the stretches between the ranks it sets, so the work
    for them is what they amount to.
    """
    listed = systems.select(*keys).distinct()
    met = _met(entries, rules, keys).join(listed, list(keys), "left_semi")
    usual = rules.where(F.col("rank").isNotNull())
    n_usual = usual.count()
    set_ranks = met.where(F.col("rank").isNotNull()).select(*keys, "rank")
    edges = set_ranks.unionByName(listed.withColumn("rank", F.lit(n_usual + 1).cast("long")))
    before = F.lag("rank", 1, 0).over(Window.partitionBy(*keys).orderBy("rank"))
    between = edges.withColumn("before", before).where(F.col("rank") > F.col("before") + 1)
    absent = between.select(*keys, F.explode(F.sequence(F.col("before") + 1, F.col("rank") - 1)).alias("rank"))
    by_default = absent.join(usual.select("rank", "key", "warning", "score"), "rank").select(*keys, "key", "warning", "score")
    broken = met.where("bad").select(*keys, "rule").join(rules.select("rule", "key", "warning", "score"), "rule")
    return broken.select(*keys, "key", "warning", "score").unionByName(by_default)


def table_rows(systems: DataFrame, entries: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every system's own row and one per violated rule (see ``scoring.ROW``)."""
    hits = table_violations(systems, entries, rules, keys).select(*keys, *row_columns(F.col("warning"), 1, F.col("score")))
    return systems.select(*keys).distinct().select(*keys, *row_columns(score=1.0)).unionByName(hits)

"""Configuration rules: a key with a bad value, or a bad default where the key is absent."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.operators.scoring import row_columns


class Rule(NamedTuple):
    """``key`` violates the rule when its value equals ``bad``; ``default`` stands in for an
    absent key. A key that is present with a null value does not violate."""

    key: str
    default: str
    bad: str
    warning: str
    score: float


# Keys, defaults, bad values, warnings and sub-scores of the four rule sets.
STORAGE_ENCRYPTION = [
    Rule("dfs.encrypt.data.transfer", "false", "false", "In-transit data encryption is disabled", 0.1),
    Rule("yarn.intermediate-data-encryption.enable", "false", "false",
         "Intermediate data encryption is disabled", 0.1),
]
STORAGE_SECURITY = [
    Rule("dfs.permissions.enabled", "false", "false", "FS access control is disabled", 0.1),
    Rule("dfs.permissions.superusergroup", "supergroup", "supergroup",
         "Task is running with default unrestricted permissions", 0.5),
    Rule("hadoop.registry.secure", "false", "false", "Registry security is not enabled", 0.5),
    Rule("hadoop.security.authorization", "false", "false", "Authentication is disabled", 0.1),
]
ENGINE = [
    Rule("spark.network.crypto.enabled", "false", "false", "Network encryption is disabled", 0.1),
    Rule("spark.io.encryption.enable", "false", "false", "IO encryption is disabled", 0.1),
]
SCHEDULER = [
    Rule("core.fernet_key", "", "", "Fernet key is not set", 0.1),
    Rule("kubernetes.verify_ssl", "False", "False", "SSL cert. check is disabled", 0.1),
]

def _judged(systems: DataFrame, entries: DataFrame, rules: Sequence[Rule], keys: Sequence[str],
            labels: Sequence[str] | None) -> DataFrame:
    """One row per system with ``hits``, its violated rules.

    Instead of pairing every system with every rule, each system is aggregated once into two
    values per rule, which combine map-side: that is the only shuffle. With a column
    ``position`` in the entries the last value of a key counts, as in a file read top to bottom;
    without one any bad value does.
    """
    if not rules:
        raise ValueError("no rules given")
    ordered = "position" in entries.columns
    text, place = F.lit(None).cast("string"), F.lit(None).cast("long")
    relevant = entries.where(F.col("key").isin([rule.key for rule in rules])).select(
        *keys, "key", "value", (F.col("position") if ordered else place).cast("long").alias("position"), F.lit(False).alias("listed"))
    listed = systems.select(*keys, text.alias("key"), text.alias("value"), place.alias("position"), F.lit(True).alias("listed"))
    flags = []
    for number, rule in enumerate(rules):
        here = F.coalesce(F.col("key") == rule.key, F.lit(False))
        bad = F.coalesce(F.col("value") == rule.bad, F.lit(False))
        flags += [F.max(here).alias(f"present_{number}"),
                  (F.max_by(F.when(here, bad), F.when(here, F.struct("position", bad))) if ordered
                   else F.max(here & bad)).alias(f"bad_{number}")]
    wide = listed.unionByName(relevant).groupBy(*keys).agg(F.max("listed").alias("listed"), *flags).where("listed")

    def hit(number: int, rule: Rule) -> Column:
        fields = [F.lit(rule.key).alias("key"), F.lit(rule.warning).alias("warning"),
                  F.lit(rule.score).alias("score")]
        if labels:
            fields.append(F.lit(labels[number]).alias("label"))
        absent = ~F.col(f"present_{number}") & F.lit(rule.default == rule.bad)
        return F.when(F.coalesce(F.col(f"bad_{number}"), F.lit(False)) | absent, F.struct(*fields))

    hits = F.array_compact(F.array(*[hit(number, rule) for number, rule in enumerate(rules)]))
    return wide.select(*keys, hits.alias("hits"))


def rule_violations(systems: DataFrame, entries: DataFrame, rules: Sequence[Rule],
                    keys: Sequence[str] = ("system",), labels: Sequence[str] | None = None) -> DataFrame:
    """One row (keys, key, warning, score) per violated rule of each system; ``labels`` names each
    rule in a column ``label``."""
    return _judged(systems, entries, rules, keys, labels).select(*keys, F.explode("hits").alias("hit")).select(*keys, "hit.*")


def rule_scores(systems: DataFrame, entries: DataFrame, rules: Sequence[Rule],
                keys: Sequence[str] = ("system",), labels: Sequence[str] | None = None) -> DataFrame:
    """(keys, n_warnings, score) of every system, and per ``label`` if the rules have any, computed
    in the row that judges it."""
    judged = _judged(systems, entries, rules, keys, labels)

    def score(hits: Column) -> list[Column]:
        low = F.array_min(F.transform(hits, lambda h: h["score"]))
        return [F.size(hits).cast("long").alias("n_warnings"), F.least(F.coalesce(low, F.lit(1.0)), F.lit(1.0)).alias("score")]

    if not labels:
        return judged.select(*keys, *score(F.col("hits")))
    each = judged.select(*keys, "hits", F.explode(F.array(*[F.lit(n) for n in dict.fromkeys(labels)])).alias("label"))
    return each.select(*keys, "label", *score(F.filter("hits", lambda h: h["label"] == F.col("label"))))


def rule_rows(systems: DataFrame, entries: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Every system's own row and one per violated rule (see ``scoring.ROW``)."""
    own = F.struct(*row_columns(score=1.0))
    hits = F.transform("hits", lambda h: F.struct(*row_columns(h["warning"], 1, h["score"])))
    return _judged(systems, entries, rules, keys, None).select(
        *keys, F.explode(F.concat(F.array(own), hits)).alias("row")).select(*keys, "row.*")

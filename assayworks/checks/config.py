"""Configuration audits by rule set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from assayworks.checks.outcome import Outcome
from assayworks.operators.rule_tables import ranked_rules, table_rows, table_scores, table_violations
from assayworks.operators.rules import Rule, rule_rows, rule_scores, rule_violations


def config_check(systems: DataFrame, entries: DataFrame, rules: Sequence[Rule] | DataFrame,
                 keys: Sequence[str] = ("system",)) -> Outcome:
    """Lowest sub-score of the violated rules per system.

    The rule sets are :data:`~assayworks.operators.rules.STORAGE_ENCRYPTION`,
    ``STORAGE_SECURITY``, ``ENGINE`` and ``SCHEDULER``; users add their own rules, as a list or, in
    any number, as a table (key, default_value, bad_value, warning, score), which is ranked and
    written when this is called.
    """
    if isinstance(rules, DataFrame):
        ranked = ranked_rules(rules)
        return Outcome(table_scores(systems, entries, ranked, keys), table_violations(systems, entries, ranked, keys),
                       table_rows(systems, entries, ranked, keys))
    return Outcome(rule_scores(systems, entries, rules, keys), rule_violations(systems, entries, rules, keys),
                   rule_rows(systems, entries, rules, keys))


def config_checks(systems: DataFrame, entries: DataFrame, rulesets: Mapping[str, Sequence[Rule]],
                  keys: Sequence[str] = ("system",)) -> Outcome:
    """Several rule sets over the same entries in one pass; results and warnings gain the
    column ``ruleset``."""
    rules = [rule for ruleset in rulesets.values() for rule in ruleset]
    names = [name for name, ruleset in rulesets.items() for _ in ruleset]
    violations = rule_violations(systems, entries, rules, keys, labels=names).withColumnRenamed("label", "ruleset")
    results = rule_scores(systems, entries, rules, keys, labels=names).withColumnRenamed("label", "ruleset")
    return Outcome(results, violations)

"""Known vulnerabilities: in dependencies and on hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.checks.outcome import Outcome
from assayworks.operators.severity import (
    dependency_rows, scan_documents, scan_hosts, scan_rows, scan_scores)
from assayworks.operators.scoring import scored


def dependency_check(projects: DataFrame, findings: DataFrame, advisories: DataFrame,
                     cve_scores: DataFrame, keys: Sequence[str] = ("project",)) -> Outcome:
    """Score per project by the worst rated CVE among its vulnerable libraries."""
    warnings = findings.withColumn("warning", F.concat_ws(" ", "lib", "advisory_id"))
    rows = dependency_rows(projects, findings, advisories, cve_scores, keys)
    return Outcome(scored(rows, keys), warnings, rows)


def scan_check(scans: DataFrame, keys: Sequence[str] = ("scan_id",)) -> Outcome:
    """Score per scan (keys, returncode, report) by the worst severity on any host."""
    parsed = scan_documents(scans.select(*keys, "returncode", "report"))
    return Outcome(scan_scores(parsed, keys), scan_hosts(parsed, keys), scan_rows(parsed, keys))

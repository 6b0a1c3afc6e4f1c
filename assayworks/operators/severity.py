"""Scores from findings: lint messages, dependency advisories, vulnerability scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.functions.text import strip
from assayworks.operators.scoring import row_columns, scored, subject_rows, warning_rows
from assayworks.schemas import SCAN_REPORT

# Message classes and the score each leads to; the prefix of advisory ids;
# scores of unrated findings; the severity of a vulnerability without one.
LINT_BROKEN = ["error", "fatal"]
LINT_WEAK = ["refactor", "warning"]
LINT_SCORES = {"clean": 1.0, "broken": 0.0, "weak": 0.75, "style": 0.90}
ADVISORY_PREFIX = "pyup.io-"
UNRATED_SCORE = 0.5
DEFAULT_CVSS = 10.0


def lint_score(kind: Column) -> Column:
    """The score a message class leads to; a file has the worst of its messages."""
    return (
        F.when(kind.isin(LINT_BROKEN), LINT_SCORES["broken"]).when(kind.isin(LINT_WEAK), LINT_SCORES["weak"])
        .otherwise(LINT_SCORES["style"])
    )


def lint_scores(files: DataFrame, findings: DataFrame, keys: Sequence[str] = ("file_path",)) -> DataFrame:
    """Score per file from the worst class of message found in it."""
    found = warning_rows(findings.withColumn("warning", F.col("type")), keys, lint_score(F.col("type")))
    return scored(subject_rows(files, keys).unionByName(found), keys)


def known_cves(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings (…, lib, advisory_id) with the CVEs their advisories name.

    The database spells ids with a prefix; a finding may match several CVEs or none. Equal
    rows come once, with their number of ``times``.
    """
    prefixed = findings.withColumn("advisory_id", F.concat(F.lit(ADVISORY_PREFIX), F.col("advisory_id")))
    repeated = prefixed.groupBy(*prefixed.columns).agg(F.count(F.lit(1)).alias("times"))
    named = advisories.where(F.col("cve").isNotNull()).groupBy("lib", "advisory_id", "cve").agg(
        F.count(F.lit(1)).alias("_copies"))
    return repeated.join(named, ["lib", "advisory_id"]).withColumn(
        "times", F.col("times") * F.col("_copies")).drop("_copies")


def rated_cves(cves: DataFrame, scores: DataFrame) -> DataFrame:
    """Add the score of each CVE, null when it has none."""
    return cves.join(scores.select("cve", "score"), ["cve"], "left")


def rated_findings(findings: DataFrame, advisories: DataFrame, cve_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct findings (keys, lib, advisory_id, times, risk, warning); risk is null where nothing is rated.

    Only the worst score counts, so the advisory table is reduced to one row per advisory before
    the (much larger) findings meet it, and repeated findings are counted, not joined.
    """
    worst = (
        rated_cves(advisories.where(F.col("cve").isNotNull()).select("lib", "advisory_id", "cve").distinct(), cve_scores)
        .groupBy("lib", "advisory_id").agg(F.max(F.col("score") / 10.0).alias("risk"))
    )
    repeated = findings.groupBy(*keys, "lib", F.concat(F.lit(ADVISORY_PREFIX), F.col("advisory_id")).alias("advisory_id")).agg(
        F.count(F.lit(1)).alias("times"))
    plain = F.substring(F.col("advisory_id"), len(ADVISORY_PREFIX) + 1, 1_000)
    return repeated.join(worst, ["lib", "advisory_id"], "left").select(
        *keys, "lib", "advisory_id", "times", "risk", F.concat_ws(" ", "lib", plain).alias("warning"))


def dependency_rows(projects: DataFrame, findings: DataFrame, advisories: DataFrame, cve_scores: DataFrame,
                    keys: Sequence[str]) -> DataFrame:
    rated = rated_findings(findings, advisories, cve_scores, keys)
    return subject_rows(projects, keys).unionByName(
        warning_rows(rated, keys, F.lit(1.0) - F.col("risk"), UNRATED_SCORE))


def dependency_scores(projects: DataFrame, findings: DataFrame, advisories: DataFrame,
                      cve_scores: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """1 - worst CVE score / 10; 0.5 when nothing is rated; 1.0 without findings."""
    return scored(dependency_rows(projects, findings, advisories, cve_scores, keys), keys)


def scan_documents(scans: DataFrame, report: str = "report") -> DataFrame:
    """Parse the text each scanner printed into ``data`` (host -> vulnerabilities) and
    ``readable``.

    The last line is a document, and the lines between the first and the last are a second
    one laid over it; the first line is dropped. ``readable`` is false when either of the two
    is no JSON.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}

    def parsed(document: str) -> Column:
        return F.col(document).isNotNull() & F.col(f"{document}._corrupt_record").isNull()

    return (
        scans.withColumn("_text", strip(F.col(report)))
        .withColumn("_last", F.from_json(F.substring_index("_text", "\n", -1), SCAN_REPORT, options))
        .withColumn("_body", F.from_json(
            F.regexp_extract("_text", r"(?s)^[^\n]*\n(.*)\n[^\n]*\z", 1), SCAN_REPORT, options))
        .withColumn("data", F.coalesce("_body.data", "_last.data"))
        .withColumn("readable", parsed("_last") & parsed("_body"))
        .drop(report, "_text", "_last", "_body")
    )


def _hosts(data: Column) -> Column:
    nothing = F.array().cast("array<double>")
    severity = F.transform(
        F.map_values(data),
        lambda host: F.coalesce(
            F.transform(F.map_values(host["vulnerabilities"]),
                        lambda found: F.coalesce(found["cvss"], F.lit(DEFAULT_CVSS)) * 0.1),
            nothing))
    return F.coalesce(F.flatten(severity), nothing)


def scan_scores(scans: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """1 - worst severity / 10 per scan, 0.0 for a scan that failed.

    ``scans`` has keys and returncode, and what :func:`scan_documents` adds. Each report is
    scored where it lies: nothing is exploded or shuffled. A successful scan whose report
    cannot be read has a null score.
    """
    failed = F.col("returncode") != 0
    worst = F.greatest(F.coalesce(F.array_max(_hosts(F.col("data"))), F.lit(0.0)), F.lit(0.0))
    return scans.select(
        *keys,
        F.when(failed, F.lit(1)).otherwise(F.coalesce(F.size(F.map_keys("data")), F.lit(0)))
        .cast("long").alias("n_warnings"),
        F.when(failed, F.lit(0.0)).when(F.col("readable"), F.lit(1.0) - worst).alias("score"))


def scan_hosts(scans: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One warning row per scanned host (even a clean one), or the return code of a failed scan."""
    code = F.struct(
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("int").alias("n_vulnerabilities"),
        F.concat(F.lit("returncode "), F.col("returncode").cast("string")).alias("warning"))

    def host(entry: Column) -> Column:
        found = entry["value"]
        return F.struct(
            entry["key"].alias("host"),
            F.coalesce(F.size(F.map_keys(found["vulnerabilities"])), F.lit(0)).alias("n_vulnerabilities"),
            F.concat_ws(" ", entry["key"], F.to_json(found)).alias("warning"))

    rows = F.when(F.col("returncode") != 0, F.array(code)).otherwise(F.transform(F.map_entries("data"), host))
    return scans.select(*keys, F.explode(rows).alias("row")).select(*keys, "row.*")


def scan_rows(scans: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """A scan's own row and one per host, made where the report lies (see ``scoring.ROW``)."""
    failed = F.col("returncode") != 0

    def host(entry: Column) -> Column:
        found = entry["value"]
        worst = F.array_max(F.transform(
            F.map_values(found["vulnerabilities"]), lambda v: F.coalesce(v["cvss"], F.lit(DEFAULT_CVSS)) * 0.1))
        return F.struct(*row_columns(F.concat_ws(" ", entry["key"], F.to_json(found)), 1, F.lit(1.0) - F.coalesce(worst, F.lit(0.0))))

    code = F.struct(*row_columns(F.concat(F.lit("returncode "), F.col("returncode").cast("string")), 1, 0.0))
    hosts = F.when(failed, F.array(code)).otherwise(F.coalesce(F.transform(F.map_entries("data"), host), F.slice(F.array(code), 1, 0)))
    own = F.struct(*row_columns(score=1.0, unknown=~failed & ~F.coalesce(F.col("readable"), F.lit(False))))
    return scans.select(*keys, F.explode(F.concat(F.array(own), hosts)).alias("row")).select(*keys, "row.*")

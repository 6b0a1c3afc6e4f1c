"""Lint messages, dependency advisories and vulnerability scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.checks import dependency_check, lint_check, scan_check
from assayworks.operators.severity import known_cves, rated_cves, scan_documents

# Lint: an order is a file, each of its items a message.
_TYPE = """CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'error'
    WHEN l_linenumber = 6 AND l_linestatus = 'O' AND l_returnflag = 'A' THEN 'fatal'
    WHEN l_returnflag = 'N' AND l_linenumber > 3 THEN 'refactor'
    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'warning' ELSE 'convention' END"""


@CATALOG.add(f"""
    WITH findings AS (SELECT l_orderkey, {_TYPE} AS type FROM lineitem)
    SELECT o_orderkey AS file, CAST(count(type) AS BIGINT) AS n_warnings,
           CASE WHEN count(type) = 0 THEN 1.0::DOUBLE
                WHEN bool_or(type IN ('error', 'fatal')) THEN 0.0::DOUBLE
                WHEN bool_or(type IN ('refactor', 'warning')) THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END AS score
    FROM orders LEFT JOIN findings ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def lint_score(spark, folder):
    files = table(spark, folder, "orders").selectExpr("o_orderkey AS file")
    findings = table(spark, folder, "lineitem").selectExpr("l_orderkey AS file", f"{_TYPE} AS type")
    return lint_check(files, findings, ["file"]).results


# Dependencies: an order is a project, each of its items a vulnerable library.
_HITS_SQL = """
    hits AS (SELECT l_orderkey AS project, 'lib-' || l_partkey AS lib, CAST(l_suppkey % 4 AS VARCHAR) AS advisory_id FROM lineitem),
    db AS (
        SELECT 'lib-' || p_partkey AS lib, 'pyup.io-' || i AS advisory_id,
               CASE WHEN (p_partkey + i) % 5 <> 0 THEN 'CVE-' || (p_partkey * 3 + i) END AS cve
        FROM part, range(3) AS r(i)
        UNION ALL
        SELECT 'lib-' || p_partkey, 'pyup.io-0', 'CVE-' || (p_partkey * 3 + 1) FROM part WHERE p_partkey % 7 = 0),
    scores AS (SELECT 'CVE-' || c_custkey AS cve, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 101 / 10.0 END AS score FROM customer)
"""


def _hits(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS project", "concat('lib-', l_partkey) AS lib", "CAST(l_suppkey % 4 AS STRING) AS advisory_id")


def _db(spark, folder):
    part = table(spark, folder, "part")
    each = part.selectExpr("p_partkey", "explode(sequence(0, 2)) AS i").selectExpr(
        "concat('lib-', p_partkey) AS lib", "concat('pyup.io-', i) AS advisory_id",
        "CASE WHEN (p_partkey + i) % 5 <> 0 THEN concat('CVE-', p_partkey * 3 + i) END AS cve")
    second = part.where("p_partkey % 7 = 0").selectExpr(
        "concat('lib-', p_partkey) AS lib", "'pyup.io-0' AS advisory_id", "concat('CVE-', p_partkey * 3 + 1) AS cve")
    return each.unionByName(second)


def _scores(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        "concat('CVE-', c_custkey) AS cve",
        "CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 101 AS DOUBLE) / 10 END AS score")


@CATALOG.add(f"""
    WITH {_HITS_SQL}
    SELECT project, h.lib, 'pyup.io-' || h.advisory_id AS advisory_id, cve, count(*) AS times
    FROM hits h JOIN db ON db.lib = h.lib AND db.advisory_id = 'pyup.io-' || h.advisory_id WHERE cve IS NOT NULL
    GROUP BY ALL
""")
def advisory_cve_join(spark, folder):
    return known_cves(_hits(spark, folder), _db(spark, folder))


@CATALOG.add(f"""
    WITH {_HITS_SQL}
    SELECT lib, advisory_id, db.cve, CAST(score AS DOUBLE) AS score FROM db LEFT JOIN scores USING (cve)
""")
def cve_score_join(spark, folder):
    return rated_cves(_db(spark, folder), _scores(spark, folder))


@CATALOG.add(f"""
    WITH {_HITS_SQL},
    rated AS (
        SELECT h.project, h.lib, s.score FROM hits h
        LEFT JOIN db ON db.lib = h.lib AND db.advisory_id = 'pyup.io-' || h.advisory_id AND db.cve IS NOT NULL
        LEFT JOIN scores s ON s.cve = db.cve),
    risk AS (SELECT project, max(CAST(score AS DOUBLE) / 10.0) AS risk FROM rated GROUP BY project),
    counts AS (SELECT project, count(*) AS n FROM hits GROUP BY project)
    SELECT o_orderkey AS project, coalesce(n, 0) AS n_warnings,
           round(CASE WHEN n IS NULL THEN 1.0::DOUBLE WHEN risk IS NULL THEN 0.5::DOUBLE ELSE 1.0 - risk END, 6) AS score
    FROM orders LEFT JOIN counts c ON c.project = o_orderkey LEFT JOIN risk r ON r.project = o_orderkey
""")
def dep_risk(spark, folder):
    projects = table(spark, folder, "orders").selectExpr("o_orderkey AS project")
    results = dependency_check(
        projects, _hits(spark, folder), _db(spark, folder), _scores(spark, folder)).results
    return results.withColumn("score", F.round("score", 6))


# Scans: an order is a scan of one or two hosts; its text has a first line, a document over
# several lines, and a last line with a second document.
_BODY = """CASE o_orderkey % 5
    WHEN 0 THEN '{}'
    WHEN 1 THEN concat('{', chr(10), '"scan": ', o_orderkey, '}')
    WHEN 3 THEN '{"data": {"host'
    ELSE concat('{"data": {"host-', o_custkey, '":', chr(10), ' {"vulnerabilities": {"v1": {"cvss": ',
                CAST(o_custkey % 101 AS STRING), 'e-1}, "v2": {"cvss": 0.5}', CASE WHEN o_custkey % 13 = 0 THEN ', "v3": {}' ELSE '' END,
                '}}, "clean": {"vulnerabilities": {}}}}') END"""
_LAST = """CASE o_orderkey % 5
    WHEN 0 THEN '{"other": 1}'
    ELSE '{"data": {"late": {"vulnerabilities": {"v9": {"cvss": 2.5}}}}}' END"""
_CODE = "CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_orderkey % 3 AS INTEGER) ELSE 0 END"


def _scans(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS scan_id", f"{_CODE} AS returncode",
        f"concat('  scan started', chr(10), {_BODY}, chr(10), {_LAST}, chr(10)) AS report")


# What the documents above hold, stated directly.
_SCANS_SQL = f"""
    scans AS (
        SELECT o_orderkey AS scan_id, {_CODE} AS returncode, o_orderkey % 5 AS form, o_custkey,
               CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS n_hosts,
               CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 2.5 WHEN 3 THEN 2.5
                    ELSE greatest(o_custkey % 101 / 10.0, 0.5, CASE WHEN o_custkey % 13 = 0 THEN 10.0 ELSE 0.0 END) END AS worst
        FROM orders)
"""


@CATALOG.add(f"""
    WITH {_SCANS_SQL}
    SELECT scan_id, form <> 3 AS readable, CASE WHEN form <> 0 AND form <> 3 THEN CAST(n_hosts AS INTEGER) END AS n_hosts
    FROM scans
""")
def scan_report_json(spark, folder):
    return scan_documents(_scans(spark, folder)).select(
        "scan_id", "readable", F.when(F.col("readable"), F.size(F.map_keys("data"))).alias("n_hosts"))


@CATALOG.add(f"""
    WITH {_SCANS_SQL}
    SELECT scan_id, CAST(CASE WHEN returncode <> 0 THEN 1 ELSE n_hosts END AS BIGINT) AS n_warnings,
           CASE WHEN returncode <> 0 THEN 0.0::DOUBLE WHEN form = 3 THEN NULL
                ELSE round(1.0 - CAST(worst AS DOUBLE) * 0.1, 6) END AS score
    FROM scans
""")
def scan_risk(spark, folder):
    return scan_check(_scans(spark, folder)).results.withColumn("score", F.round("score", 6))


@CATALOG.add(f"""
    WITH {_SCANS_SQL}
    SELECT scan_id, NULL AS host, NULL AS n_vulnerabilities, 'returncode ' || returncode AS warning FROM scans WHERE returncode <> 0
    UNION ALL
    SELECT scan_id, 'late', 1, 'late {{"vulnerabilities":{{"v9":{{"cvss":2.5}}}}}}' FROM scans WHERE form IN (1, 3)
    UNION ALL
    SELECT scan_id, 'clean', 0, 'clean {{"vulnerabilities":{{}}}}' FROM scans WHERE form IN (2, 4) AND returncode = 0
    UNION ALL
    SELECT scan_id, 'host-' || o_custkey, CASE WHEN o_custkey % 13 = 0 THEN 3 ELSE 2 END,
           'host-' || o_custkey || ' {{"vulnerabilities":{{"v1":{{"cvss":' || CAST(o_custkey % 101 / 10.0 AS DOUBLE) ||
           '}},"v2":{{"cvss":0.5}}' || CASE WHEN o_custkey % 13 = 0 THEN ',"v3":{{}}' ELSE '' END || '}}}}'
    FROM scans WHERE form IN (2, 4) AND returncode = 0
""")
def scan_hosts(spark, folder):
    return scan_check(_scans(spark, folder)).warnings

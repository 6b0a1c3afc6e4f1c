"""File modes against users and expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.checks import can_read_check, can_write_check, permission_check

# Every customer owns a file; some modes have a leading sticky digit.
_FILE = """
    concat('/data/', c_name) AS path,
    concat('u', c_nationkey) AS owner,
    concat('g', c_custkey % 7) AS "group",
    CAST(floor(c_custkey % 512 / 64) * 100 + floor(c_custkey % 64 / 8) * 10 + c_custkey % 8
         + CASE WHEN c_custkey % 11 = 0 THEN 1000 ELSE 0 END AS INTEGER) AS perm,
    CASE WHEN c_custkey % 13 <> 0 THEN concat('u', c_custkey % 25) END AS who,
    CASE WHEN c_custkey % 17 <> 0 THEN concat('g', c_custkey % 14) END AS whose,
    CASE WHEN c_custkey % 3 <> 0 THEN concat('u', c_custkey % 5 * 5) END AS want_owner,
    CASE WHEN c_custkey % 4 <> 0 THEN concat('g', c_nationkey % 7) END AS want_group,
    CASE WHEN c_custkey % 2 = 0 THEN 644 END AS want_perm
"""
_FILES_SQL = f"WITH files AS (SELECT {_FILE} FROM customer)"


def _files(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        *[part.strip().replace('"group"', "`group`") for part in _split(_FILE)])


def _split(columns: str) -> list[str]:
    """Cut a select list at the commas that end its lines."""
    parts, depth, part = [], 0, ""
    for letter in columns:
        depth += (letter == "(") - (letter == ")")
        if letter == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += letter
    return [*parts, part]


def _access_sql(digits: str, text: str) -> str:
    return _FILES_SQL + f""",
    judged AS (SELECT path, lpad(CAST(perm AS VARCHAR), 4, '0') AS mode, owner, "group", who, whose FROM files),
    allowed AS (
        SELECT path, coalesce(who = owner, FALSE) AND contains('{digits}', mode[-3])
            OR coalesce(whose = "group", FALSE) AND contains('{digits}', mode[-2])
            OR contains('{digits}', mode[-1]) AS ok
        FROM judged)
    SELECT path, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS n_warnings,
           CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
           CASE WHEN NOT ok THEN '{text}' || path END AS warning
    FROM allowed
    """


def _with_warning(outcome):
    return outcome.results.join(outcome.warnings, "path", "left")


@CATALOG.add(_access_sql("4567", "Cannot read from "))
def can_read(spark, folder):
    return _with_warning(can_read_check(_files(spark, folder), F.col("who"), F.col("whose")))


@CATALOG.add(_access_sql("2367", "Cannot write to "))
def can_write(spark, folder):
    return _with_warning(can_write_check(_files(spark, folder), F.col("who"), F.col("whose")))


_EXPECT_SQL = _FILES_SQL + """,
    found AS (
        SELECT path, 'Unexpected owner ' || owner || ' for ' || path AS warning FROM files WHERE owner <> want_owner
        UNION ALL
        SELECT path, 'Unexpected group ' || "group" || ' for ' || path FROM files WHERE "group" <> want_group
        UNION ALL
        SELECT path, 'Unexpected permissions ' || perm || ' for ' || path FROM files WHERE perm <> want_perm)
"""


def _expectations(spark, folder):
    return permission_check(_files(spark, folder), F.col("want_owner"), F.col("want_group"), F.col("want_perm"))


@CATALOG.add(_EXPECT_SQL + "SELECT path, warning FROM found")
def perm_expectations(spark, folder):
    return _expectations(spark, folder).warnings


@CATALOG.add(_EXPECT_SQL + """
    SELECT files.path, CAST(count(warning) AS BIGINT) AS n_warnings,
           CASE WHEN count(warning) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM files LEFT JOIN found USING (path) GROUP BY files.path
""")
def perm_expectations_score(spark, folder):
    return _expectations(spark, folder).results

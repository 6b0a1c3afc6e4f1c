"""Paths and URLs in page texts."""

from __future__ import annotations

from urllib.parse import uses_netloc, uses_params

from pyspark.sql import functions as F

from assayworks.catalog import CATALOG, table
from assayworks.checks import paths_check, urls_check
from assayworks.checks.code import detected_paths
from assayworks.functions.text import urls_in_code

# A page is a task: its markup is the task source, a call with its address the job source,
# and the quoted address once more an argument.
_JOB = "concat('df = spark.read.csv( \"', url, '\" )\ny = load(''HDFS:///in/', page_id, ';'') # done')"
_ARG = "concat('[''', url, ''']')"


def _texts(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.selectExpr("page_id", f"explode(array(html, {_JOB}, {_ARG})) AS text")


def _tasks(spark, folder):
    return table(spark, folder, "pages").select("page_id")


_TEXTS_SQL = f"""
    texts AS (
        SELECT page_id, html AS text FROM pages
        UNION ALL SELECT page_id, {_JOB} FROM pages
        UNION ALL SELECT page_id, {_ARG} FROM pages)
"""
# The patterns of locations and, below, of URLs, for the SQL engine. Schemes are Python's own lists.
_QUOTE = """["'']"""
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_SPACE = _SPACES.replace("[", "[^", 1)
_URI = rf"{_QUOTE}{_SPACES}*([\p{{L}}\p{{N}}_]+:/?/?{_NO_SPACE}+){_SPACES}*{_QUOTE}"
_SLASHED = rf"{_QUOTE}{_SPACES}*(.+/.+){_SPACES}*{_QUOTE}"
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def _strings(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_PATHS_SQL = f"""
    hits AS (
        SELECT page_id, unnest(regexp_extract_all(text, '{_URI}', 1)) AS hit FROM texts
        UNION ALL
        SELECT page_id, unnest(regexp_extract_all(text, '{_SLASHED}', 1)) FROM texts),
    locations AS (
        SELECT DISTINCT page_id, regexp_replace(
            regexp_replace(hit, '^{_SPACES}+', ''), '{_SPACES}+$', '') AS found FROM hits),
    cleaned AS (
        SELECT page_id, translate(regexp_replace(found, '^[\\x00-\\x20]+', ''), chr(9) || chr(13) || chr(10), '') AS url
        FROM locations),
    schemes AS (
        SELECT *, lower(regexp_extract(url, '^({_SCHEME}):', 1)) AS scheme,
               regexp_extract(url, '(?s)^(?:{_SCHEME}:)?(.*)$', 1) AS rest
        FROM cleaned),
    split AS (
        SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS host,
               regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1) AS whole_path,
               regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query,
               regexp_extract(rest, '(?s)^[^#]*#(.*)$', 1) AS fragment
        FROM schemes),
    parts AS (
        SELECT *, CASE WHEN scheme IN ({_strings(uses_params)})
                       THEN regexp_replace(whole_path, '(?s)^(|.*/)([^/;]*);$', '\\1\\2')
                       ELSE whole_path END AS path
        FROM split),
    paths AS (
        SELECT DISTINCT page_id,
            CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END
            || CASE WHEN host <> '' THEN '//' || host || CASE WHEN path <> '' AND path[1] <> '/' THEN '/' ELSE '' END || path
                    WHEN path LIKE '//%' THEN '//' || path
                    WHEN scheme IN ({_strings([s for s in uses_netloc if s])}) AND (path = '' OR path[1] = '/') THEN '//' || path
                    ELSE path END
            || CASE WHEN query <> '' THEN '?' || query ELSE '' END
            || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS path
        FROM parts WHERE contains(host, '[') = contains(host, ']'))
"""


@CATALOG.add(f"""
    WITH texts AS (SELECT page_id, html AS text FROM pages), {_PATHS_SQL}
    SELECT page_id, path FROM paths
""")
def extract_paths(spark, folder):
    pages = table(spark, folder, "pages").selectExpr("page_id", "html AS text")
    return detected_paths(pages, ["page_id"])


@CATALOG.add(f"WITH {_TEXTS_SQL}, {_PATHS_SQL} SELECT page_id, path FROM paths")
def distinct_paths(spark, folder):
    return detected_paths(_texts(spark, folder), ["page_id"])


_ALLOWED = [r"^https?://([a-z]+\.)?[a-z]+\.example\.(com|net)", r"^/", "^hdfs:/in/1"]
_NOT_ALLOWED = " AND ".join(f"NOT regexp_matches(path, '{pattern}')" for pattern in _ALLOWED)
_OUTSIDE_SQL = f"WITH {_TEXTS_SQL}, {_PATHS_SQL}, outside AS (SELECT page_id, path FROM paths WHERE {_NOT_ALLOWED})"


def _paths(spark, folder):
    return paths_check(_tasks(spark, folder), _texts(spark, folder), _ALLOWED, ["page_id"])


@CATALOG.add(_OUTSIDE_SQL + " SELECT page_id, path, 'Unexpected path ' || path AS warning FROM outside")
def unexpected_paths(spark, folder):
    return _paths(spark, folder).warnings


@CATALOG.add(_OUTSIDE_SQL + """
    SELECT p.page_id, CAST(count(o.path) AS BIGINT) AS n_warnings,
           CASE WHEN count(o.path) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM pages p LEFT JOIN outside o USING (page_id) GROUP BY p.page_id
""")
def unexpected_paths_score(spark, folder):
    return _paths(spark, folder).results


# Allow-lists that differ per task.
_PATTERNS = {"^https://": "page_id % 2 = 0", "^http": "page_id % 3 = 0", "/in/": "page_id % 5 <> 0", "^/": "true"}


@CATALOG.add(f"""
    WITH {_TEXTS_SQL}, {_PATHS_SQL}, allowed AS ({" UNION ALL ".join(
        f"SELECT page_id, '{pattern}' AS pattern FROM pages WHERE {test}" for pattern, test in _PATTERNS.items())})
    SELECT page_id, path, 'Unexpected path ' || path AS warning FROM paths
    WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.page_id = paths.page_id AND regexp_matches(paths.path, a.pattern))
""")
def unexpected_paths_listed(spark, folder):
    allowed = table(spark, folder, "pages").select("page_id", F.explode(F.array_compact(F.array(*[
        F.when(F.expr(test), F.lit(pattern)) for pattern, test in _PATTERNS.items()]))).alias("pattern"))
    return paths_check(_tasks(spark, folder), _texts(spark, folder), allowed, ["page_id"]).warnings


# Fixed value: the URL pattern.
_URLS_SQL = f"""
    WITH {_TEXTS_SQL},
    urls AS (
        SELECT page_id, unnest(regexp_extract_all(text,
            'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+')) AS url
        FROM texts)
"""


@CATALOG.add(_URLS_SQL + " SELECT page_id, url FROM urls")
def extract_urls(spark, folder):
    return _texts(spark, folder).select("page_id", F.explode(urls_in_code(F.col("text"))).alias("url"))


_SERVICES = ["example.com/", "example.net/"]
_NO_SERVICE = " AND ".join(f"NOT contains(url, '{service}')" for service in _SERVICES)


def _urls(spark, folder):
    return urls_check(_tasks(spark, folder), _texts(spark, folder), _SERVICES, ["page_id"])


@CATALOG.add(_URLS_SQL + f" SELECT page_id, url, 'Unexpected url ' || url AS warning, count(*) AS times FROM urls WHERE {_NO_SERVICE} GROUP BY page_id, url")
def unexpected_urls(spark, folder):
    return _urls(spark, folder).warnings


@CATALOG.add(_URLS_SQL + f""",
    found AS (SELECT page_id FROM urls WHERE {_NO_SERVICE})
    SELECT p.page_id, CAST(count(f.page_id) AS BIGINT) AS n_warnings,
           CASE WHEN count(f.page_id) = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score
    FROM pages p LEFT JOIN found f USING (page_id) GROUP BY p.page_id
""")
def unexpected_urls_score(spark, folder):
    return _urls(spark, folder).results


@CATALOG.add(_URLS_SQL + """,
    allowed AS (SELECT page_id, 'example.' || CASE page_id % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'org' END AS service FROM pages)
    SELECT page_id, url, 'Unexpected url ' || url AS warning, count(*) AS times FROM urls
    WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.page_id = urls.page_id AND contains(urls.url, a.service))
    GROUP BY page_id, url
""")
def unexpected_urls_listed(spark, folder):
    services = table(spark, folder, "pages").selectExpr(
        "page_id", "concat('example.', CASE page_id % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'org' END) AS service")
    return urls_check(_tasks(spark, folder), _texts(spark, folder), services, ["page_id"]).warnings

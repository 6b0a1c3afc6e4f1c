"""Text functions against Python's own `re` and `urllib`, on random texts."""

from __future__ import annotations

import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from assayworks.checks.code import detected_paths, paths_check, urls_check
from assayworks.functions.patterns import java_pattern
from assayworks.functions.text import job_stem, quoted_locations, strip, urls_in_code
from assayworks.functions.urls import rebuild_url
from assayworks.operators import differences
from assayworks.operators.literals import candidates, needed_literal

# The patterns the checks are defined by.
URI = r"""["\']\s*(\w+:(\/?\/?)[^\s]+)\s*["\']"""
SLASHED = r"""["\']\s*(.+/.+)\s*["\']"""
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"

PIECES = [
    *"ab/'\":: \n\t4%!~\\^{_-", '"', "'", "/", "\r", "\r\n", "  ", "\x1c", "\x0b", "\x85", "\u00a0", "\u2028", "\u3000",
    "\u00e9", "\u00b2", "e\u0301", "\u0663", "http://", "https://", "x:/",
]


def random_texts(pieces, count, longest, seed):
    rng = random.Random(seed)
    texts = {"".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(count)}
    return sorted(texts)


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_locations_and_urls_agree_with_python(spark):
    texts = random_texts(PIECES, 30_000, 24, 5)
    found = frame(spark, texts).select(
        "text", quoted_locations(F.col("text")).alias("places"), urls_in_code(F.col("text")).alias("urls")).collect()
    hits = 0
    for row in found:
        places = [m.group(1).strip() for pattern in (URI, SLASHED) for m in re.finditer(pattern, row.text)]
        assert row.places == places, repr(row.text)
        assert row.urls == re.findall(URL, row.text), repr(row.text)
        hits += len(places)
    assert hits > 3_000


def test_long_texts_do_not_overflow_or_stall(spark):
    url = "http://example.org/" + "a" * 200_000
    line = "it's " * 4_000 + "/" + "x" * 50_000
    text = f"'{url}'\n{line}"
    row = frame(spark, [text]).select(
        F.size(quoted_locations(F.col("text"))).alias("n"), urls_in_code(F.col("text")).alias("urls")).first()
    assert row.n == len(list(re.finditer(URI, text))) + 1
    assert row.urls[0].startswith(url)


def test_strip_agrees_with_python(spark):
    texts = random_texts(PIECES, 3_000, 6, 8)
    for row in frame(spark, texts).select("text", strip(F.col("text")).alias("s")).collect():
        assert row.s == row.text.strip(), repr(row.text)


def python_url(text):
    try:
        return urlparse(text).geturl()
    except ValueError:
        return None


def test_rebuilding_agrees_with_python(spark):
    pieces = [
        *"aB1:/?#;]@.+-%& \t\n", "//", "http:", "HTTPS:", "hdfs:", "file:", "ftp:", "x;", "\u2100", "\u00e9", "::1",
        "sip:", "svn+ssh:", "://", "///", "/;", ";?", "?#",
    ]
    texts = random_texts(pieces, 20_000, 9, 3)
    for row in frame(spark, texts).select("text", rebuild_url(F.col("text")).alias("url")).collect():
        assert row.url == python_url(row.text), repr(row.text)


@pytest.mark.parametrize("text, expected", [
    ("kmeans/model", "hdfs://localhost/kmeans/model"),
    ("/kmeans/model", "hdfs://localhost/kmeans/model"),
    ("hdfs://other/x", "hdfs://other/x"),
    ("//host/x", "//host/x"),
])
def test_default_file_system(spark, text, expected):
    assert frame(spark, [text]).select(rebuild_url(F.col("text"), "hdfs://localhost/")).first()[0] == expected


def test_mismatched_brackets_are_dropped(spark):
    texts = frame(spark, ["open('http://[::1/x')", "open('http://[::1]/x')"]).withColumn("task", F.lit("t"))
    assert [r.path for r in detected_paths(texts, ["task"]).collect()] == ["http://[::1]/x"]


def test_job_stem(spark):
    names = frame(spark, ["collect at KMeans.scala:10", "json at Native.java:0", "a.scala.scala"])
    assert [r[0] for r in names.select(job_stem(F.col("text"))).collect()] == [
        "collect at KMeans", "json at Native.java:0", "a"]


def tasks(spark, texts):
    return spark.createDataFrame(texts, "task string, text string")


def test_paths_check(spark, rows):
    texts = tasks(spark, [("a", "x = 'hdfs://localhost/in'"), ("a", "y = 'out/model'"), ("b", "none"), ("a", "'out/model'")])
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    outcome = paths_check(subjects, texts, [r"hdfs://localhost.+"])
    assert rows(outcome.warnings) == [("a", "out/model", "Unexpected path out/model")]
    assert rows(outcome.results) == [("a", 1, 0.0), ("b", 0, 1.0), ("c", 0, 1.0)]
    assert rows(paths_check(subjects, texts).results)[0] == ("a", 2, 0.0)
    qualified = paths_check(subjects, texts, [r"hdfs://localhost.+"], default_fs="hdfs://localhost")
    assert rows(qualified.results) == [("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 1.0)]


def test_paths_check_with_a_list_per_task(spark, rows):
    texts = tasks(spark, [("a", "'out/model'"), ("b", "'out/model'")])
    allowed = spark.createDataFrame([("a", "^out"), ("a", "x")], "task string, pattern string")
    outcome = paths_check(texts.select("task"), texts, allowed)
    assert rows(outcome.results) == [("a", 0, 1.0), ("b", 1, 0.0)]


def test_long_lists_are_compared_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(differences, "LIST_PIECE", 7)
    texts = spark.range(60).selectExpr("CASE WHEN id < 40 THEN 'hot' ELSE 'b' END AS task",
                                       """concat('"x/', id, '"') AS text""")
    allowed = spark.range(0, 60, 2).selectExpr("explode(array('hot', 'b')) AS task", "concat('^x/', id, '$') AS pattern")
    outcome = paths_check(texts.select("task"), texts, allowed)
    assert rows(outcome.warnings, "task", "path") == sorted(
        ("hot" if i < 40 else "b", f"x/{i}") for i in range(1, 60, 2))
    assert rows(outcome.results) == [("b", 10, 0.0), ("hot", 20, 0.0)]


def test_urls_check_keeps_duplicates(spark, rows):
    texts = tasks(spark, [("a", "http://x.org/1 http://x.org/1"), ("b", "http://ok.org"), ("c", "")])
    outcome = urls_check(texts.select("task"), texts, ["ok.org"])
    assert rows(outcome.warnings) == [("a", "http://x.org/1", "Unexpected url http://x.org/1", 2)]
    assert rows(outcome.results) == [("a", 2, 0.1), ("b", 0, 1.0), ("c", 0, 1.0)]
    assert rows(urls_check(texts.select("task"), texts).results)[1] == ("b", 1, 0.1)
    services = spark.createDataFrame([("a", "x.org")], "task string, service string")
    assert rows(urls_check(texts.select("task"), texts, services).results) == [
        ("a", 0, 1.0), ("b", 1, 0.1), ("c", 0, 1.0)]


def test_allow_list_patterns_read_like_pythons(spark):
    """Random patterns and values, against Python's own search."""
    rng = random.Random(3)
    pieces = ["a", "b+", r"\w", r"\s", r"\d", ".", "[^b]", r"\.", "(a|b)", "(?:bc)?", "é", r"(?P<h>a)x(?P=h)", r"(b)\1", "$", "^", r"\Z"]
    values = ["".join(rng.choice("ab c.é1\n٣xß\u2028\x85") for _ in range(rng.randint(0, 8))) for _ in range(150)]
    df = spark.createDataFrame([(i % 5, v) for i, v in enumerate(dict.fromkeys(values))], "k int, v string")
    rows = df.collect()
    for _ in range(12):
        patterns = ["".join(rng.choice(pieces[:-5] if rng.random() < 0.7 else pieces) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 3))]
        try:
            for p in patterns:
                re.compile(p)
        except re.error:
            continue
        want = sorted((r.k, r.v) for r in rows if not any(re.search(p, r.v) for p in patterns))
        assert sorted(map(tuple, differences.unmatched(df, "v", patterns).collect())) == want, patterns
        listing = spark.createDataFrame([(k, p) for k in range(5) for p in patterns], "k int, p string")
        assert sorted(map(tuple, differences.unlisted_patterns(df, listing, "v", "p", ["k"]).collect())) == want, patterns


def test_patterns_java_cannot_express_are_refused():
    assert java_pattern(r"(?P<my_host>hdfs)://(?P=my_host)\Z") == r"(?<g0>hdfs)://\k<g0>\z"
    for wrong in ("(", r"(a)?(?(1)b|c)"):
        with pytest.raises(ValueError):
            java_pattern(wrong)


def test_needed_literals(spark):
    cases = {r"^hdfs://data/\d+/x\.csv$": "hdfs://data/", r"ab*cd?e": "a", r"abc+d": "abc", "a{2}bc": "bc", "[xyz]": None, "[]x]yz": "yz", r"[^\]ab]yz": "yz",
             "(abc)": None, "a|b": None, r"\x41bcd\101e": "bcd", r"\\d": "\\d", r"\d": None, ".*": None, "": None, "a{b": "a{b", r"\.\.\/up": "../up", r"é.ß": "ß",
             r"ab\Z": "ab", r"a++b": "a", r"tail*?": "tai", "[\n]x": "x", "a\\\nb": "a\nb"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", needed_literal(F.col("p")).alias("literal"))
    assert {r.p: r.literal for r in df.collect()} == cases


def test_literals_stand_in_every_match(spark):
    rng = random.Random(11)
    pieces = ["a", "b+", "ab", r"\.", "x?", "c*", "d{0,1}", "e{2}", "[ab]", ".", r"\d", "/", r"\\", "-"]
    patterns = list({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(300)})
    values = ["".join(rng.choice("abcde./\\-x1") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", needed_literal(F.col("p")).alias("literal"))
    for r in df.collect():
        assert r.literal is None or all(r.literal in v for v in values if re.search(r.p, v)), r


def test_lists_per_subject_try_only_what_can_match(spark):
    """3,000 values of a hot subject against 3,000 patterns and services: nine million pairs, few of them tried."""
    values = spark.range(3_000).selectExpr("'hot' AS k", "concat('hdfs://name/data/set-', id, '/part.csv') AS v").unionByName(
        spark.createDataFrame([("cold", "hdfs://name/data/set-7/part.csv"), ("hot", None), (None, "x"), ("bare", "")], "k string, v string"))
    listing = spark.range(3_000).selectExpr("'hot' AS k", r"concat('^hdfs://name/data/set-', id * 2, '/.*\\.csv$') AS p", "concat('set-', id * 3, '/') AS s")
    plain = [(r.k, r.v) for r in values.collect()]
    tried = candidates(values, listing.withColumn("literal", needed_literal(F.col("p"))), "v", "literal", ["k"])
    assert 1_500 <= tried.count() <= 60_000
    got = sorted(map(tuple, differences.unlisted_patterns(values, listing, "v", "p", ["k"]).collect()), key=repr)
    assert got == sorted([(k, v) for k, v in plain if k != "hot" or v is None or int(re.search(r"set-(\d+)", v)[1]) % 2], key=repr)
    outside = differences.unlisted_parts(values, listing, "v", "s", ["k"])
    assert sorted(map(tuple, outside.collect()), key=repr) == sorted(
        [(k, v) for k, v in plain if k != "hot" or v is None or int(re.search(r"set-(\d+)", v)[1]) % 3], key=repr)
    assert "exists" not in outside._jdf.queryExecution().optimizedPlan().toString().lower()


def test_services_per_subject(spark):
    rng = random.Random(4)
    values = list({(rng.randrange(4), "".join(rng.choice("aé/.") for _ in range(rng.randint(0, 9)))) for _ in range(120)})
    listing = [(rng.randrange(3), "".join(rng.choice("aé/.") for _ in range(rng.randint(0, 5)))) for _ in range(25)] + [(1, None)]
    got = differences.unlisted_parts(spark.createDataFrame(values, "k int, v string"), spark.createDataFrame(listing, "k int, s string"), "v", "s", ["k"])
    assert sorted(map(tuple, got.collect())) == sorted((k, v) for k, v in values if not any(k == j and s is not None and s in v for j, s in listing))


def test_a_value_is_not_cut_up_for_a_short_list(spark):
    """Rows made before the pairs: one for a value whose list is short, as many as grams where it is long."""
    values = spark.range(200).selectExpr("'short' AS k", "concat('hdfs://name/data/set-', id, '/part.csv') AS v").unionByName(
        spark.range(200).selectExpr("'long' AS k", "concat('hdfs://name/data/set-', id, '/part.csv') AS v"))
    listing = spark.range(100).selectExpr("CASE WHEN id < 4 THEN 'short' ELSE 'long' END AS k", "concat('set-', id, '/') AS s")
    tried = candidates(values, listing, "v", "s", ["k"])
    found = tried.where("contains(v, s)").groupBy("k").count()
    assert {r["k"]: r["count"] for r in found.collect()} == {"short": 4, "long": 96}
    assert tried.where("k = 'short'").count() == 200 * 4

    plan = tried.select("k", "v", "s").where("k = 'short'")
    plan.collect()
    made, nodes = [], [plan._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert made == [200]

"""Checks on source texts: paths, URLs, lint findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.checks.outcome import Outcome, judged
from assayworks.functions.text import quoted_locations, urls_in_code
from assayworks.functions.urls import rebuild_url
from assayworks.operators.differences import unlisted_parts, unlisted_patterns, unmatched, without_any
from assayworks.operators.severity import lint_score

# Fixed value: the score of a subject that reaches for an unexpected service.
SERVICE_FLOOR = 0.1


def detected_paths(texts: DataFrame, keys: Sequence[str], default_fs: str | None = None) -> DataFrame:
    """Distinct (keys, path) of all locations in the texts of each subject.

    ``texts`` has one row per text: a subject's task source, arguments and job source are
    stacked before. Locations are parsed and rebuilt; unreadable ones drop out.
    """
    # Repeats in a text go before anything is rebuilt; a rebuilt path is computed once, where it
    # is exploded, and the only shuffle is on what is left.
    found = texts.select(*keys, F.array_distinct(quoted_locations(F.col("text"))).alias("found"))
    paths = F.transform("found", lambda one: rebuild_url(one, default_fs))
    return found.select(*keys, F.explode(F.array_distinct(F.array_compact(paths))).alias("path")).distinct()


def paths_check(subjects: DataFrame, texts: DataFrame, allowed: Sequence[str] | DataFrame = (),
                keys: Sequence[str] = ("task",), default_fs: str | None = None) -> Outcome:
    """0.0 for a subject that names a path outside the allowed patterns.

    ``allowed`` is a list of patterns, or a table (keys, pattern) when subjects differ.
    """
    paths = detected_paths(texts, keys, default_fs)
    if isinstance(allowed, DataFrame):
        outside = unlisted_patterns(paths, allowed, "path", "pattern", keys)
    else:
        outside = unmatched(paths, "path", allowed)
    warnings = outside.select(*keys, "path", F.concat(F.lit("Unexpected path "), F.col("path")).alias("warning"))
    return judged(subjects, warnings, keys)


def urls_check(subjects: DataFrame, texts: DataFrame, services: Sequence[str] | DataFrame = (),
               keys: Sequence[str] = ("task",)) -> Outcome:
    """0.1 for a subject that names a URL without any expected service in it.

    Every occurrence counts; a URL repeated in a subject is one warning with its number of
    ``times``. ``services`` is a list, or a table (keys, service).
    """
    urls = texts.select(*keys, F.explode(urls_in_code(F.col("text"))).alias("url"))
    if not isinstance(services, DataFrame):
        urls = without_any(urls, "url", services)
    outside = urls.groupBy(*keys, "url").agg(F.count(F.lit(1)).alias("times"))
    if isinstance(services, DataFrame):
        outside = unlisted_parts(outside, services, "url", "service", keys)
    warnings = outside.select(
        *keys, "url", F.concat(F.lit("Unexpected url "), F.col("url")).alias("warning"), "times")
    return judged(subjects, warnings, keys, SERVICE_FLOOR)


def lint_check(files: DataFrame, findings: DataFrame, keys: Sequence[str] = ("file_path",)) -> Outcome:
    """Score per file by its worst lint message."""
    return judged(files, findings.withColumn("warning", F.col("type")), keys, lint_score(F.col("type")))

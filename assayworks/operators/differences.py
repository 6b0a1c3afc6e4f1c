"""One-sided differences: what is there but was not expected."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.functions.patterns import FLAGS, REFERS, java_pattern, java_patterns
from assayworks.functions.text import version_order
from assayworks.operators.literals import candidates, needed_literal

#: About how many entries of one allow-list are compared as one piece.
LIST_PIECE = 1_000


def shown(value: Column) -> Column:
    """A value as it appears in a warning."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def acl_differences(acl: DataFrame, expected: DataFrame, keys: Sequence[str] = ("object",)) -> DataFrame:
    """Roles whose permissions differ from the expected ones.

    A role that is not expected counts as expected without permissions, and null permissions
    as none; permissions are sets. Roles that are expected but missing are no violation.
    """
    nothing = F.array().cast("array<string>")
    perms = F.array_sort(F.array_distinct(F.coalesce("perms", nothing)))
    have = acl.select(*keys, "role", perms.alias("perms")).distinct()
    # A role that is expected more than once may have any of the lists.
    want = expected.select(*keys, "role", perms.alias("perms")).groupBy(*keys, "role").agg(F.collect_set("perms").alias("_want"))
    return (
        have.join(want, [*keys, "role"], "left")
        .where(~F.array_contains(F.coalesce("_want", F.array(nothing)), F.col("perms")))
        .select(*keys, "role", F.format_string(
            "Unexpected (%s,[%s])", F.col("role"), F.array_join("perms", ", ")).alias("warning"))
    )


def args_differences(args: DataFrame, expected: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Arguments that were not expected, or have another value; null equals null."""
    want = expected.select(*keys, "arg", F.col("value").alias("_want"), F.lit(True).alias("_listed"))
    return (
        args.select(*keys, "arg", "value").distinct()
        .join(want, [*keys, "arg"], "left")
        .where(F.col("_listed").isNull() | ~F.col("value").eqNullSafe(F.col("_want")))
        .select(*keys, "arg", F.concat(
            F.lit("Unexpected arg "), F.col("arg"), F.lit(" with value "), shown(F.col("value")))
            .alias("warning"))
        .distinct()
    )


def unmatched(values: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose value matches none of the patterns (searched, not matched in full).

    Patterns are Python's (see :mod:`~assayworks.functions.patterns`). The allow-list becomes part
    of the filter, so nothing is joined or shuffled. An empty list lets every row through.
    """
    # One alternation looks at a value once; groups that are referred to keep their own pattern.
    alone = [p for p in patterns if re.search(REFERS, p) or re.match(r"\(\?[aiLmsux]+\)", p)]
    joined = "|".join(f"(?:{java_pattern(p)})" for p in patterns if p not in alone)
    tests = [*([joined] if joined else []), *[java_pattern(p) for p in alone]]
    return values.where(~reduce(lambda a, b: a | b, [F.col(column).rlike(FLAGS + t) for t in tests], F.lit(False)))


def without_any(values: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose value contains none of the given strings."""
    return values.where(~reduce(lambda a, b: a | b, [F.col(column).contains(p) for p in parts], F.lit(False)))


def _pieces(listing: DataFrame, allowed: str, keys: Sequence[str]) -> DataFrame:
    """(keys, _allowed): each key's list in pieces of about LIST_PIECE entries, so none is one huge row."""
    entries = listing.select(*keys, allowed).distinct()
    pieces = entries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LIST_PIECE).alias("_pieces"))
    return (
        entries.join(pieces, list(keys)).groupBy(*keys, F.pmod(F.xxhash64(allowed), F.col("_pieces")).alias("_piece"))
        .agg(F.array_sort(F.collect_set(allowed)).alias("_allowed")).drop("_piece")
    )


def _without_match(values: DataFrame, pieces: DataFrame, keys: Sequence[str], match: Column) -> DataFrame:
    """A value meets every piece of its key's list and stays when none of them has a match."""
    return (
        values.join(pieces, list(keys), "left").withColumn("_matched", F.coalesce(match, F.lit(False)))
        .groupBy(*values.columns).agg(F.max("_matched").alias("_matched"))
        .where(~F.col("_matched")).drop("_matched")
    )


def _outside(values: DataFrame, column: str, keys: Sequence[str], met: DataFrame) -> DataFrame:
    """The values that met nothing of their key's list."""
    return values.join(met.select(*keys, column).distinct(), [*keys, column], "left_anti").select(*values.columns)


def unlisted_parts(values: DataFrame, listing: DataFrame, column: str, allowed: str, keys: Sequence[str]) -> DataFrame:
    """Like :func:`without_any` with an allow-list per key, held in a table (keys, allowed).

    Values meet the entries of a short list, and of a long one those whose gram they hold (see
    :mod:`~assayworks.operators.literals`), and only these are compared. An empty entry is part of every value. ``values`` are distinct.
    """
    entries = listing.select(*keys, F.col(allowed).alias("_entry")).where(F.col("_entry").isNotNull()).distinct()
    met = candidates(values.select(*keys, column), entries, column, "_entry", keys).where(F.col(column).contains(F.col("_entry")))
    everything = entries.where("_entry = ''").select(*keys)
    rest = values.where(F.col(column).isNull()).unionByName(
        values.where(F.col(column).isNotNull()).join(everything, list(keys), "left_anti").select(*values.columns))
    return _outside(rest, column, keys, met)


def unlisted_patterns(values: DataFrame, listing: DataFrame, column: str, allowed: str, keys: Sequence[str]) -> DataFrame:
    """The same for patterns, searched in the values.

    A pattern with a literal that all its matches need is tried on the values that hold it; in long
    lists their grams find these values. The others make alternations, in pieces per key; a value meets every piece of its key's
    list, and rows of a key that follow each other share the compiled pattern.
    """
    entries = listing.select(*keys, F.col(allowed).alias("_entry")).where(F.col("_entry").isNotNull()).distinct()
    entries = entries.withColumn("_literal", needed_literal(F.col("_entry")))
    tried = candidates(values.select(*keys, column), entries.where(F.col("_literal").isNotNull()), column, "_literal", keys)
    # The literal itself first: it is cheaper to look for than the pattern.
    met = tried.where(F.col(column).contains(F.col("_literal")) & F.rlike(F.col(column), F.concat(F.lit(FLAGS), java_patterns(F.col("_entry")))))
    return _outside(_unlisted_pieces(values, entries.where(F.col("_literal").isNull()), column, "_entry", keys), column, keys, met)


def _unlisted_pieces(values: DataFrame, listing: DataFrame, column: str, allowed: str, keys: Sequence[str]) -> DataFrame:
    pieces = _pieces(listing, allowed, keys)
    alone = F.filter("_allowed", lambda p: p.rlike(REFERS) | p.rlike(r"^\(\?[aimsux]+\)"))
    together = F.array_except("_allowed", alone)
    folded = F.when(F.size(together) > 0, F.concat(
        F.lit(FLAGS), F.array_join(F.transform(together, lambda p: F.concat(F.lit("(?:"), java_patterns(p), F.lit(")"))), "|")))
    made = pieces.select(*keys, folded.alias("_folded"),
                         F.transform(alone, lambda p: F.concat(F.lit(FLAGS), java_patterns(p))).alias("_alone"))
    hit = F.coalesce(F.rlike(F.col(column), F.col("_folded")), F.lit(False)) | F.exists("_alone", lambda p: F.rlike(F.col(column), p))
    return _without_match(values, made, keys, hit)


def unexpected_jobs(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct (app_id, app_name, job) of ``jobs`` that ``expected`` (app_name, job) does
    not list.

    Names of jobs depend on the Spark release: an entry may hold from the release ``since`` and up
    to, but without, ``until``, null being open. It is compared with the jobs' ``spark_version``; of a
    run whose release is not known, only entries that hold for all releases are expected.
    """
    ranged = {"since", "until"} & set(expected.columns)
    if not ranged:
        left = jobs.select("app_id", "app_name", "job").distinct().join(
            expected.select("app_name", "job").distinct(), ["app_name", "job"], "left_anti")
    else:
        bounds = {c: version_order(F.col(c)) if c in ranged else F.lit(None).cast("array<long>") for c in ("since", "until")}
        given = {c: F.col(c).isNotNull() if c in ranged else F.lit(False) for c in bounds}
        want = expected.select(F.col("app_name").alias("_app"), F.col("job").alias("_job"), *[v.alias(f"_{c}") for c, v in bounds.items()],
                               (given["since"] | given["until"]).alias("_bound")).distinct()
        release = version_order(F.col("spark_version")) if "spark_version" in jobs.columns else F.lit(None).cast("array<long>")
        have = jobs.select("app_id", "app_name", "job", release.alias("_release")).distinct()
        holds = ~F.col("_bound") | (F.coalesce(F.col("_release") >= F.col("_since"), F.col("_release").isNotNull())
                                    & F.coalesce(F.col("_release") < F.col("_until"), F.col("_release").isNotNull()))
        left = have.join(want, (F.col("app_name") == F.col("_app")) & (F.col("job") == F.col("_job")) & holds, "left_anti")
    return (
        left
        .select("app_id", "app_name", "job",
                F.concat(F.lit("Unexpected job "), F.col("job")).alias("warning"))
    )


def new_jobs(jobs: DataFrame, previous: DataFrame) -> DataFrame:
    """Distinct (app_id, app_name, job) absent from the previous run of the same application.

    ``previous`` (app_id, app_name, previous_app_id) names that run; without one nothing is new.
    The final join is on (run, job), so a single busy application spreads over its jobs.
    """
    distinct = jobs.select("app_id", "job").distinct()
    # One row per run on the right.
    known = previous.where(F.col("previous_app_id").isNotNull()).select(
        "app_id", "app_name", "previous_app_id")
    now = distinct.join(known, ["app_id"])
    before = distinct.select(F.col("app_id").alias("previous_app_id"), "job")
    return (
        now.join(before, ["previous_app_id", "job"], "left_anti")
        .select("app_id", "app_name", "job", F.concat(
            F.lit("New job "), F.col("job"), F.lit(" not present in previous logs")).alias("warning"))
    )

"""Filter interaction audit: Shapley shares by exact constrained least squares, step counts by coalitions."""

from __future__ import annotations

import json
import math
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.llm.common import WORD, bind, text_key, written

FILTERS = "ABCDE"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, fails): which of the five filters each document fails, as bits from A = 1 to E = 16.

    A null text counts as empty. E compares whole texts over the table, by 128 bits of their SHA-256,
    with the smallest doc_id that holds them; a null doc_id is neither smaller nor larger than any.
    """
    text = F.coalesce("text", F.lit(""))
    sizes = bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    measured = docs.select(
        "doc_id", "lang", text_key(text).alias("key"), sizes.alias("w"), capitals.alias("capitals"),
        F.length(text).alias("points"), text.rlike("[#$%&*|]").alias("odd"))
    tests = (F.col("w.n") < 100, F.col("w.d") * F.lit(100).cast("long") < F.col("w.n") * F.lit(80).cast("long"),
             F.col("capitals") * 100 > F.col("points").cast("long") * 10, F.col("odd"))
    rows = written(measured.select("doc_id", "lang", "key", _bits(tests).alias("fails")), "audit-documents")
    # A row meets the first of its text on text and id, so many copies of a text spread by their ids.
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["key", "doc_id"], "left").select(
        "doc_id", "lang", (F.col("fails") + F.when(repeated, 1 << len(tests)).otherwise(0)).alias("fails"))


def _bits(tests) -> Column:
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def shapley_weights(n: int) -> list[list[Fraction]]:
    """How the removals of all 2^n coalitions make each filter's Shapley share, solved exactly.

    The shares x minimise the sum over proper coalitions S of w(S) * (x(S) - v(S))^2, with the kernel
    w(S) = (n - 1) / (C(n, s) s (n - s)), while x(all) = v(all). Its normal equations, with one
    multiplier for the constraint, are solved by elimination in rationals; the right-hand side keeps
    one column for each coalition's unknown removals v(S), so the solution holds for any counts.
    """
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    all_of_them = (1 << n) - 1
    system = [[Fraction(0)] * (n + 1 + (1 << n)) for _ in range(n + 1)]
    for coalition in range(1, all_of_them):
        s = coalition.bit_count()
        weight = Fraction(n - 1, math.comb(n, s) * s * (n - s))
        members = [i for i in range(n) if coalition >> i & 1]
        for i in members:
            for j in members:
                system[i][j] += weight
            system[i][n + 1 + coalition] += weight
    for i in range(n):
        system[i][n] = system[n][i] = Fraction(1)
    system[n][n + 1 + all_of_them] = Fraction(1)
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if system[r][i])
        system[i], system[pivot] = system[pivot], system[i]
        system[i] = [x / system[i][i] for x in system[i]]
        for r in range(n + 1):
            if r != i and system[r][i]:
                system[r] = [x - system[r][i] * y for x, y in zip(system[r], system[i], strict=True)]
    return [row[n + 1:] for row in system[:n]]


def interaction_audit(documents: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter removes, at each step of each order of the filters, in each part.

    ``documents`` has doc_id, lang and fails (bits in the order of ``filters``); ``labels`` has doc_id,
    quality and toxic. A part is a language, null the empty string. A document is good or toxic if any
    label row of its id says 1; a null doc_id has no labels. Repeated rows count as often as they occur.
    An empty table has no parts. Rows: part, filter_order, step, and the counts of the step's filter;
    shapley is its Shapley share times the number of orders, a whole number.

    Documents are reduced map-side to at most 2^n counts a part. All coalitions' removals are one
    array per part; a step's counts are differences of two of its entries.
    """
    n = len(filters)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    tall = (
        documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "fails").join(marks, "doc_id", "left")
        .groupBy("part", "fails").agg(F.count("*").alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
                                      F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    )

    def removals(count: str) -> Column:
        hit = [F.sum(F.when(F.col("fails").bitwiseAND(c) != 0, F.col(count)).otherwise(0)) for c in range(1 << n)]
        return F.array(*hit).alias(f"{count}_removed")

    parts = tall.groupBy("part").agg(F.sum("docs").alias("docs"), removals("docs"), removals("good"), removals("bad"))
    orders = math.factorial(n)
    shares = [sum((F.lit(int(w * orders)) * F.col("docs_removed")[c] for c, w in enumerate(row) if w), F.lit(0)) for row in shapley_weights(n)]
    steps = json.dumps([
        {"filter_order": "".join(filters[i] for i in order), "step": at + 1, "filter": i, "before": sum(1 << j for j in order[:at])}
        for order in permutations(range(n)) for at, i in enumerate(order)])
    step = F.explode(F.from_json(F.lit(steps), "array<struct<filter_order:string,step:int,filter:int,before:int>>")).alias("s")
    rows = parts.select("*", F.array(*shares).alias("shares"), step).select("*", "s.*")

    own = F.element_at(F.array(*[F.lit(1 << i) for i in range(n)]), F.col("filter") + 1)
    after = F.col("before") + own

    def removed(count: str) -> Column:
        return F.get(f"{count}_removed", after) - F.get(f"{count}_removed", F.col("before"))

    everything = F.get("docs_removed", F.lit((1 << n) - 1))
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - F.get("docs_removed", after)).alias("kept"), removed("docs").alias("removed"),
        (F.get("docs_removed", own) - removed("docs")).alias("redundant"),
        (everything - F.get("docs_removed", F.lit((1 << n) - 1) - own)).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("bad").alias("toxic_lost"),
        F.get("shares", F.col("filter")).alias("shapley"))

"""Substring search as a join: a value can only match an entry whose needed literal it holds.

An entry of a long list is filed under one run of characters (a gram) of its literal, 2^n long; a value is
looked up under its own grams of those lengths. Both meet in an equi-join on key and gram, so a key with a
long list spreads over its grams, and only entries whose gram a value holds are tried on it. The few entries
of a short list are tried on every value of the key, which then moves as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams; a literal is filed under the longest that it has room for.
SIZES = (32, 16, 8, 4, 2, 1)
#: Lists of up to so many entries are tried whole on each value of their key.
SHORT_LIST = 64

# A pattern's parts, left to right: escapes, classes, single characters; then how often they may occur.
_PART = (r"(?s)((?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\N\{[^}]*\}|\\[0-9]{1,3}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.)"
         r"(?:(?:[*+?]|\{[0-9]*,?[0-9]*\})[?+]?)?)")
#: Stands where a pattern has something else than a fixed character.
_GAP = "\x00"


def needed_literal(pattern: Column) -> Column:
    """The longest run of characters that every match of a pattern holds (of equal ones the least); null where none is certain.

    Patterns with groups, alternatives or flags have none, nor have those made of classes only.
    """
    def fixed(part: Column) -> Column:
        escaped = part.startswith("\\")
        sign = F.when(escaped, F.substring(part, 2, 1)).otherwise(F.substring(part, 1, 1))
        often = F.when(escaped, F.substring(part, 3, 99)).otherwise(F.substring(part, 2, 99))
        open_ended = F.when(escaped, sign.rlike(r"[A-Za-z0-9]")).otherwise(part.rlike(r"(?s)^(?:[.^$]|\[.)"))
        return F.when(open_ended, _GAP).when(often == "", sign).when(often.startswith("+"), F.concat(sign, F.lit(_GAP))).otherwise(_GAP)

    runs = F.split(F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_PART), F.lit(1)), fixed), ""), _GAP)
    longest = F.array_min(F.transform(runs, lambda run: F.struct((-F.length(run)).alias("n"), run.alias("run"))))["run"]
    return F.when(~pattern.rlike(r"[()|]") & (F.length(longest) > 0), longest)


def _size(literal: Column) -> Column:
    return F.coalesce(*[F.when(F.length(literal) >= n, F.lit(n)) for n in SIZES])


def candidates(values: DataFrame, listing: DataFrame, column: str, literal: str, keys: Sequence[str]) -> DataFrame:
    """Pairs of a distinct value and a listed entry of its key whose gram the value holds.

    ``listing`` (keys, ``literal``, more) keeps its other columns; empty and null literals meet nothing.
    An entry's gram is its literal's last characters, since paths and URLs differ at their ends. A short list
    is filed under the empty gram, which every value holds once: a value would have more grams than such a
    list has entries. Where lists are long, a value is cut into grams of the sizes its key's entries have.
    """
    filed = listing.where(F.length(literal) > 0).withColumn("_size", _size(F.col(literal)))
    lists = filed.groupBy(*keys).agg((F.count(F.lit(1)) > SHORT_LIST).alias("_long"), F.collect_set("_size").alias("_sizes"))
    filed = filed.join(lists.select(*keys, "_long"), list(keys)).withColumn(
        "_gram", F.when(F.col("_long"), F.right(F.col(literal), F.col("_size"))).otherwise(""))

    def grams(n: Column) -> Column:
        last = F.length(column) - n + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(column), i, n))
        return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))

    held = F.when(F.col("_long"), F.array_distinct(F.flatten(F.transform("_sizes", grams)))).otherwise(F.array(F.lit("")))
    looked_up = values.where(F.col(column).isNotNull()).join(lists, list(keys)).select(*values.columns, F.explode(held).alias("_gram"))
    return looked_up.join(filed.drop("_size", "_long"), [*keys, "_gram"]).drop("_gram")

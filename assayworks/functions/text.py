"""Finding locations and URLs in source texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's `re` and `str.strip` know it. Java's \s is ASCII only, and its
# Unicode mode leaves out \x1c-\x1f.
_BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = f"[{_BLANKS}]"
_BLANK_CHARACTERS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_QUOTE = r"""["\']"""

# What counts as a location, read as Java patterns with (?d), so that a dot stops at \n only.
# Greedy runs that can never give anything back are possessive: a failed start costs one
# look along its line instead of one per slash in it.
#
# A URI: after a quote a word, a colon, and non-blanks up to the last quote they reach.
QUOTED_URI = rf"(?d){_QUOTE}{_BLANK}*+([\p{{L}}\p{{N}}_]++:[^{_BLANKS}]+){_BLANK}*+{_QUOTE}"
# A string with a slash inside, from a quote to the last quote of the line. Whether the slash
# is the first or the last one makes no difference to where the string ends; a slash that
# comes first counts as inside only when a blank precedes it. The look-ahead drops starts
# that no quote follows.
QUOTED_WITH_SLASH = (
    rf"(?d){_QUOTE}{_BLANK}*+((?:.[^\n/]*+/|(?<=[{_BLANKS}&&[^\n]])/)"
    rf"(?=.[^\n\"']*+{_BLANK}*+{_QUOTE})(?:.++(?={_BLANK}*+{_QUOTE})|.+(?={_QUOTE}))){_BLANK}*+{_QUOTE}"
)

# Every character the URL check accepts lies in `!`, `$`..`_` or `a`..`z`; percent escapes
# too, since `%` is inside the range. One character class keeps Java's matcher from
# recursing once per character, which an alternation under `+` would do.
URL_IN_CODE = r"https?://[!$-_a-z]+"


def strip(text: Column) -> Column:
    """Cut white space at both ends, as Python's ``str.strip`` does."""
    return F.btrim(text, F.lit(_BLANK_CHARACTERS))


def quoted_locations(text: Column) -> Column:
    """Array of quoted URIs followed by quoted strings that hold a slash, trimmed."""
    hits = [
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        for pattern in (QUOTED_URI, QUOTED_WITH_SLASH)
    ]
    return F.transform(F.concat(*hits), strip)


def urls_in_code(text: Column) -> Column:
    """Array of all http(s) URLs in a text, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(URL_IN_CODE), F.lit(0))


def version_order(version: Column) -> Column:
    """A release as an array of numbers that compares as releases do; null where it starts with none.

    What follows the numbers, as in 4.0.0-preview1, is left out, and so are zeros at the end.
    """
    numbers = F.regexp_replace(F.regexp_extract(version, r"^[0-9]+(?:\.[0-9]+)*", 0), r"(?:\.0+)+$", "")
    return F.when(numbers != "", F.transform(F.split(numbers, r"\."), lambda n: n.cast("long")))


def job_stem(job_name: Column) -> Column:
    """Job name up to the Scala file it names: ``collect at KMeans.scala:1`` -> ``collect at KMeans``."""
    return F.substring_index(job_name, ".scala", 1)

"""Allow-list patterns, written as Python reads them, for Spark's regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's flags as Java's: classes follow Unicode, and only \n ends a line.
FLAGS = "(?Ud)"
_CONDITION = re.compile(r"(?<!\\)(?:\\\\)*\(\?\(")
_NAME = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P(<|=)([A-Za-z_][A-Za-z0-9_]*)(>|\))")
#: A pattern with groups it refers to, or names, must stay on its own.
REFERS = r"\\[1-9k]|\(\?P?<[A-Za-z]|\(\?P="


def java_pattern(pattern: str) -> str:
    """The same pattern for Spark. One that Python refuses, or whose meaning Java lacks, is refused."""
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise ValueError(f"{pattern!r} is no pattern: {error}") from None
    if _CONDITION.search(pattern):
        raise ValueError(f"{pattern!r}: conditional groups are not supported")
    # Java's group names have letters and digits only.
    names = {name: f"g{number}" for number, name in enumerate(compiled.groupindex)}

    def named(found: re.Match) -> str:
        name = names[found[3]]
        return f"{found[1]}(?<{name}>" if found[2] == "<" else rf"{found[1]}\k<{name}>"

    translated = _NAME.sub(named, pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", translated)


def java_patterns(column: Column) -> Column:
    """The same for a column: named groups, references to them and \\Z; names need letters and digits."""
    out = F.regexp_replace(column, r"\(\?P<", "(?<")
    out = F.regexp_replace(out, r"\(\?P=(\w+)\)", r"\\k<$1>")
    return F.regexp_replace(out, r"\\Z", r"\\z")

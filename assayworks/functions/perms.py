"""File modes: octal digits kept as a decimal-looking integer (644, 1777)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Octal digits that grant writing and reading.
WRITE_DIGITS = ["2", "3", "6", "7"]
READ_DIGITS = ["4", "5", "6", "7"]


def padded_mode(perm: Column) -> Column:
    """644 -> '0644'."""
    return F.format_string("%04d", perm)


def granted(digits: list[str], perm: Column, owner: Column, group: Column,
            user: Column, user_group: Column) -> Column:
    """True when any of owner, group or others grants the access to the user.

    The three classes are OR-ed, not tried in order. A null user or group matches nobody.
    """
    mode = padded_mode(perm)

    def digit(from_right: int) -> Column:
        return F.substring(mode, -from_right, 1).isin(digits)

    owns = F.coalesce(user == owner, F.lit(False))
    belongs = F.coalesce(user_group == group, F.lit(False))
    return (owns & digit(3)) | (belongs & digit(2)) | digit(1)


def symbolic_to_octal(symbolic: Column) -> Column:
    """'rwxr-xr-t' (nine letters) -> 1755. Handles s/S/t/T for the leading digit."""
    def triple(start: int) -> Column:
        letters = F.substring(symbolic, start, 3)
        return (
            F.when(F.substring(letters, 1, 1) == "r", 4).otherwise(0)
            + F.when(F.substring(letters, 2, 1) == "w", 2).otherwise(0)
            + F.when(F.substring(letters, 3, 1).isin("x", "s", "t"), 1).otherwise(0)
        )

    def special(position: int, weight: int) -> Column:
        return F.when(F.substring(symbolic, position, 1).isin("s", "S", "t", "T"), weight).otherwise(0)

    leading = special(3, 4) + special(6, 2) + special(9, 1)
    return (leading * 1000 + triple(1) * 100 + triple(4) * 10 + triple(7)).cast("int")

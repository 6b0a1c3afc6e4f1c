"""Who may do what: access-control lists and file modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.checks.outcome import Outcome, judged
from assayworks.functions.perms import READ_DIGITS, WRITE_DIGITS, granted
from assayworks.operators.differences import acl_differences


def acl_check(objects: DataFrame, acl: DataFrame, expected: DataFrame,
              keys: Sequence[str] = ("object",)) -> Outcome:
    """0.0 for an object that grants a role other permissions than expected."""
    warnings = acl_differences(acl, expected, keys)
    return judged(objects, warnings, keys)


def _column(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def permission_check(files: DataFrame, owner: Column | str | None = None,
                     group: Column | str | None = None, perm: Column | int | None = None,
                     keys: Sequence[str] = ("path",)) -> Outcome:
    """Owner, group and mode against expectations; null is not checked.

    Expectations are values, or columns of ``files`` to expect something else per file.
    """
    want_perm = perm if isinstance(perm, Column) else F.lit(perm).cast("int")
    tests = [
        ("owner", F.col("owner"), _column(owner)),
        ("group", F.col("group"), _column(group)),
        ("permissions", F.col("perm"), want_perm),
    ]
    findings = [
        F.when(want.isNotNull() & ~have.eqNullSafe(want),
               F.format_string(f"Unexpected {name} %s for %s", have.cast("string"), F.col("path")))
        for name, have, want in tests
    ]
    found = F.array_compact(F.array(*findings))
    extra = [name for name in ("path",) if name not in keys]
    warnings = files.select(*keys, *extra, F.explode(found).alias("warning"))
    return judged(files, warnings, keys)


def _access_check(files: DataFrame, user, group, keys: Sequence[str], digits: list[str], text: str) -> Outcome:
    allowed = granted(digits, F.col("perm"), F.col("owner"), F.col("group"), _column(user), _column(group))
    extra = [name for name in ("path",) if name not in keys]
    warnings = files.where(~F.coalesce(allowed, F.lit(False))).select(
        *keys, *extra, F.concat(F.lit(text), F.col("path")).alias("warning"))
    return judged(files, warnings, keys)


def can_write_check(files: DataFrame, user: Column | str | None = None,
                    group: Column | str | None = None, keys: Sequence[str] = ("path",)) -> Outcome:
    """1.0 when the user may write the file through any of owner, group and others."""
    return _access_check(files, user, group, keys, WRITE_DIGITS, "Cannot write to ")


def can_read_check(files: DataFrame, user: Column | str | None = None,
                   group: Column | str | None = None, keys: Sequence[str] = ("path",)) -> Outcome:
    """1.0 when the user may read the file through any of owner, group and others."""
    return _access_check(files, user, group, keys, READ_DIGITS, "Cannot read from ")

"""Parsing and rebuilding URLs by the rules of Python's ``urllib.parse``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes for which an empty host still gets `//`, schemes whose last path
# segment may carry `;parameters`, and characters that compatibility normalisation turns
# into URL punctuation and that are therefore refused in a host.
SCHEMES_WITH_HOST = [
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https",
    "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh",
    "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
]
SCHEMES_WITH_PARAMETERS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
    "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
REFUSED_IN_HOST = (
    "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16"
    "\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20"
)

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_NO_SCHEME = rf"(?!{_SCHEME})"


def _any_of(schemes: list[str]) -> str:
    """Pattern for one of the schemes with its colon; '' stands for no scheme at all."""
    named = "|".join(scheme.replace("+", r"\+") for scheme in schemes if scheme)
    return rf"(?:(?:{named}):{'|' + _NO_SCHEME if '' in schemes else ''})"


# What rebuilding changes, in order, on a location whose scheme is lower case already.
_REBUILDING = [
    # An empty fragment, then an empty query, go away.
    (r"\A([^#]*)#\z", "$1"),
    (r"\A([^?#]*)\?(#.*)?\z", "$1$2"),
    # So does an empty parameter part of the last path segment.
    (rf"\A({_any_of(SCHEMES_WITH_PARAMETERS)}(?://[^/?#]*+)?+(?:[^?#]*/)?[^/;?#]*);(?=[?#]|\z)", "$1"),
    # `//` before an empty host goes away unless the scheme keeps it or the path needs it ...
    (rf"\A((?!{_any_of(SCHEMES_WITH_HOST)})(?:{_SCHEME})?)//(?!//)(?=[/?#]|\z)", "$1"),
    # ... and is added where the scheme wants it.
    (rf"\A({_any_of(SCHEMES_WITH_HOST)})(?=/(?!/)|[?#]|\z)", "$1//"),
]

_HOST = rf"\A(?:{_SCHEME})?//"
_UNREADABLE = (
    rf"{_HOST}(?:[^/?#\[]*\][^/?#\[]*|[^/?#\]]*\[[^/?#\]]*)(?:[/?#]|\z)"
    rf"|{_HOST}[^/?#]*[{REFUSED_IN_HOST}]"
)


def rebuild_url(location: Column, default_fs: str | None = None) -> Column:
    """A location parsed and put together again; NULL when it cannot be parsed.

    The scheme becomes lower case and an empty query, fragment or parameter part goes away.
    A location without scheme stays as it is, unless ``default_fs`` (such as
    ``hdfs://localhost``) is given to qualify it.
    """
    url = F.translate(F.regexp_replace(location, r"\A[\x00-\x20]+", ""), "\t\r\n", "")
    rebuilt = F.concat(
        F.lower(F.regexp_extract(url, rf"\A({_SCHEME})", 1)), F.regexp_replace(url, rf"\A{_SCHEME}", ""))
    for pattern, replacement in _REBUILDING:
        rebuilt = F.regexp_replace(rebuilt, f"(?s){pattern}", replacement)
    if default_fs is not None:
        base = default_fs.rstrip("/").replace("\\", "\\\\").replace("$", "\\$")
        rebuilt = F.regexp_replace(rebuilt, rf"\A{_NO_SCHEME}(?!//)/?", f"{base}/")
    return F.when(~url.rlike(_UNREADABLE), rebuilt)

"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased host without port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[#?].*$", "")


def canonical(url: Column, keep: list[str] | None = None) -> Column:
    """Lower-cased scheme and host, no fragment, kept parameters sorted, no slash at the end (a root keeps it)."""
    bare = F.regexp_replace(url, r"#.*$", "")
    front = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    trimmed = F.regexp_replace(path, r"/+$", "")
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    wanted = F.array_sort(F.filter(pairs, lambda p: F.regexp_extract(p, r"^([^=]*)=.", 1).isin(*(keep or ["id", "p", "page"]))))
    query = F.array_join(wanted, "&")
    return F.concat(F.lower(front), F.when(trimmed == "", "/").otherwise(trimmed), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def registrable(h: Column) -> Column:
    """The last two labels of a host."""
    return F.array_join(F.slice(F.split(h, r"\."), F.greatest(F.size(F.split(h, r"\.")) - 1, F.lit(1)), 2), ".")


def signature(url: Column) -> Column:
    """A URL's shape: digit runs as N, runs outside ASCII as a star, no query."""
    return F.regexp_replace(F.regexp_replace(without_query(url), "[0-9]+", "N"), "[^\\x00-\\x7F]+", "*")


def source_key(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def drive_id(url: Column) -> Column:
    """The file id in a shared-drive link."""
    found = F.regexp_extract(url, r"/d/([A-Za-z0-9_-]{10,})", 1)
    return F.nullif(F.when(found != "", found).otherwise(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]{10,})", 1)), F.lit(""))

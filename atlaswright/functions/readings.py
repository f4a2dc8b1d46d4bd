"""How names found on pages are read: one spelling for each category, location, source or word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _none_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def category_reading(name: Column) -> Column:
    """Cut at the first ``|`` or ``#``, drop a leading ``Category :``, outer blanks; blanks and ``+`` read as ``_``.

    Null and whatever is empty after that read as null.
    """
    cut = F.regexp_replace(name, r"(?s)[|#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(cut, r"^\s*([Cc][Aa][Tt][Ee][Gg][Oo][Rr][Yy]\s*:)?\s*", ""), r"\s+$", "")
    return _none_if_empty(F.regexp_replace(bare, r"[\s+]", "_"))


def location_reading(name: Column) -> Column:
    """Drop outer blanks and ``_``; inner blanks read as ``_``. Null and empty results read as null."""
    return _none_if_empty(F.regexp_replace(F.regexp_replace(name, r"^[\s_]+|[\s_]+$", ""), r"\s", "_"))


def source_reading(name: Column) -> Column:
    """Without outer blanks and in lower case; empty reads as null."""
    return _none_if_empty(F.lower(F.trim(name)))

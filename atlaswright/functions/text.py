"""Titles, tokens and stop words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
STOP_WORDS = """
www http com the be to of and a in that have i it for not on with he as
you do at this but his by from they we say her she or an will my one all would
there their what so up out if about who get go which me when make can like time no just
him know take into year your good some could them see other than then now only come its over also
back after use two how our work first well way even new want any these day most us because is
was are has were more been very where did should may non
""".split()  # fmt: skip
SHORTEST_WORD = 3
DELETED = "['`;,?!]"
SPACED = r"[_@\-\t/\\]"


def normal_title(title: Column) -> Column:
    """Blanks read as ``_``; the escapes of quotation mark and ampersand are undone."""
    return F.replace(F.replace(F.replace(F.trim(title), F.lit(" "), F.lit("_")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def article_title(title: Column, categories: bool = False) -> Column:
    """True for titles of articles: no administrative prefix, no disambiguation, no list. Null titles give false."""
    spaces = "wikipedia:|file:|portal:|template:" + ("" if categories else "|category:")
    tight = F.regexp_replace(F.lower(title), r"[\s_]", "")
    drop = F.lower(title).rlike(spaces) | tight.endswith("(disambiguation)") | tight.startswith("listof")
    return F.coalesce(~drop, F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-case words of a text: marks deleted or read as blanks, other non-word characters stripped, bare numbers dropped.

    Null and empty texts give an empty array.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), DELETED, "")
    t = F.replace(F.regexp_replace(t, SPACED, " "), F.lit("."), F.lit(" "))
    t = F.lower(F.regexp_replace(t, r"(?U)[^\w\s]", ""))
    return F.filter(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), lambda w: (F.length(w) > 0) & ~w.rlike(r"^\d+$"))


def without_stop_words(words: Column) -> Column:
    """Words of at least three characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: (F.length(w) >= SHORTEST_WORD) & ~F.array_contains(stop, w))



def short_number(c: Column) -> Column:
    """A number with at most two decimals (half to even), without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.bround(c.cast("decimal(30,10)"), 2).cast("string"), r"0+$", ""), r"\.$", "")


def elapsed(seconds: Column) -> Column:
    """``h:mm:ss`` of a number of seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def upper_first(c: Column) -> Column:
    """With its first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def irreducible(variants: Column) -> Column:
    """Variants that contain no other variant; the longer of two such says nothing that the shorter does not find."""
    return F.filter(variants, lambda v: ~F.exists(variants, lambda w: (w != v) & F.contains(v, w)))


# fixed values: what may stand before and after a name
BEFORE = [" ", "\n", "[", "{", "(", "-", "_", '"', "'", "|"]
AFTER = [",", ".", " ", "?", "!", "]", "}", ")", "-", "_", '"', "'", "|"]


def _set_of(chars: list[str]) -> str:
    return "[" + "".join("\\" + c if c in "[]-" else c for c in chars) + "]"


def occurrences(text: Column, variant: Column) -> Column:
    """How often a variant stands in a text between delimiters. Null in, null out."""
    quoted = F.concat(F.lit(r"\Q"), variant, F.lit(r"\E"))
    return F.regexp_count(text, F.concat(F.lit(f"(?<={_set_of(BEFORE)})"), quoted, F.lit(f"(?={_set_of(AFTER)})")))

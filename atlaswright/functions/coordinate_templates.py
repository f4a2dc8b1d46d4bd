"""Positions in coordinate templates, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (patterns)
OUTER = r"\{\{(Wikidata)? *[Cc]oor.*?display *= *(([a-zA-Z]* *)[,;:./]? *){0,3}(([Ii][Tt])|([Tt][Ii][Tt][Ll][Ee])).*?}}"
INNER = r"\| *(((-?\d*(\.\d*)?)|N|n|S|s|W|w|E|e) *[|}] *)+"
ESCAPED = r"&lt;.*?&gt;"

# group 1: an escaped < within ten characters before a template; group 2: the template; group 9: what ends in an escaped > within ten after it
FRAMED = rf"(?:(?<=((?i:&lt;)(?s:.{{0,6}})))?)({OUTER})(?:(?=((?s:.{{0,6}}?)(?i:&gt;)))?)"


def template_position(raw: Column) -> Column:
    """``struct<lat, lon>`` of the last valid template with ``display`` in title or inline-title form; null if there is none.

    A template stands on one line. Those of other globes and those inside a comment (an escaped ``<`` just before, ``>`` just after) do not count;
    comments within a template are dropped before its numbers are read.
    """
    part = lambda k: F.regexp_extract_all(raw, F.lit(FRAMED), k)
    framed = F.arrays_zip(part(1).alias("before"), part(2).alias("t"), part(9).alias("after"))
    real = F.filter(framed, lambda m: ~((F.length(m["before"]) > 0) & (F.length(m["after"]) > 0)) & ~(F.contains(m["t"], F.lit("globe")) & ~F.contains(m["t"], F.lit("globe:earth"))))
    spots = F.transform(real, lambda m: _position(F.regexp_replace(m["t"], ESCAPED, "")))
    found = F.filter(spots, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    # most texts have no template at all
    return F.when(raw.rlike(r"\{\{[^\n]*[Cc]oor"), F.try_element_at(found, F.lit(-1)))


def _position(template: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(template, INNER, 0), r"[}]+ *$", "|")
    parts = F.filter(F.transform(F.split(inner, r"\|"), lambda p: F.lower(F.trim(p))), lambda p: F.length(p) > 0)
    ns = F.coalesce(F.array_max(F.array(F.array_position(parts, F.lit("n")), F.array_position(parts, F.lit("s")))), F.lit(0)).cast("int")
    ew = F.coalesce(F.array_max(F.array(F.array_position(parts, F.lit("e")), F.array_position(parts, F.lit("w")))), F.lit(0)).cast("int")
    shaped = (ns >= 2) & (ns <= 4) & (ew - ns >= 2) & (ew - ns <= 4)

    def degrees(first: Column, end: Column, negative: str, mark: Column) -> Column:
        at = lambda k: F.get(parts, first + k).try_cast("double")
        have = end - first
        value = at(0) + F.when(have > 1, at(1)).otherwise(0.0) / 60 + F.when(have > 2, at(2)).otherwise(0.0) / 3600
        return F.when(mark == negative, -value).otherwise(value)

    zero = F.lit(0)
    by_marks = F.struct(degrees(zero, ns - 1, "s", F.get(parts, ns - 1)).alias("lat"), degrees(ns, ew - 1, "w", F.get(parts, ew - 1)).alias("lon"))
    plain = (ns == 0) & (ew == 0) & (F.size(parts) == 2)
    by_pair = F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon"))
    return F.when(shaped, by_marks).when(plain, by_pair)

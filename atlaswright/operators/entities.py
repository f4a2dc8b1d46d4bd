"""Links of pages as named locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaswright.config import DEFAULTS
from atlaswright.functions.text import irreducible, normal_title, occurrences
from atlaswright.functions.wikitext import first_word_index, links, without_bold_title


def page_entities(texts: DataFrame) -> DataFrame:
    """``title, entity, variants, ord, clean``: linked names of each page that occur in its clean text.

    ``texts``: title, text (section with its links), clean. Names are grouped by link target; all parts of its links, in lower
    case, are its variants; ``ord`` is the number of words before the first mention of the target. Links of a page to itself do not count.
    """
    body = F.lower(without_bold_title(F.col("clean")))
    one = texts.where("title is not null and text is not null").select("title", body.alias("clean"), F.explode(links(F.col("text"))).alias("parts"))
    named = one.select("title", "clean", F.trim(F.col("parts")[0]).alias("name"), F.transform("parts", lambda p: F.lower(F.trim(p))).alias("parts"))
    named = named.where((F.length("name") > 0) & (F.lower(normal_title(F.col("name"))) != F.lower("title")))
    grouped = named.groupBy("title", "name").agg(F.first("clean").alias("clean"), F.array_distinct(F.flatten(F.collect_set("parts"))).alias("variants"))
    placed = grouped.withColumn("ord", first_word_index(F.col("clean"), F.lower("name"))).where("ord >= 0")
    return placed.select("title", normal_title(F.col("name")).alias("entity"), F.filter("variants", lambda v: F.length(v) > 0).alias("variants"), "ord", "clean")


def located_names(names: DataFrame, redirects: DataFrame, positions: DataFrame, column: str = "entity") -> DataFrame:
    """``names`` with ``location``: the name itself where it has a position, else its redirect's target where that has; others go."""
    known = positions.select(F.col("title").alias("location")).distinct()
    own = names.join(known.withColumn("own", F.lit(True)), F.col(column) == F.col("location"), "left").drop("location")
    hop = redirects.select(F.col("title").alias(column), F.col("target").alias("hop")).dropDuplicates([column])
    best = own.join(hop, column, "left").withColumn("location", F.when(F.col("own"), F.col(column)).otherwise(F.col("hop"))).drop("own", "hop")
    return best.join(known, "location", "left_semi")


def named_locations(texts: DataFrame, redirects: DataFrame, positions: DataFrame, last_word: int = DEFAULTS.last_location_word) -> DataFrame:
    """``title, location, cnt, ord`` of each page's geolocated links.

    ``cnt`` is how often the name's variants stand between delimiters in the text; names never mentioned, or first after word
    ``last_word``, go. An entity and its redirect on one page are one location: counts add up, the first mention counts.
    """
    found = located_names(page_entities(texts), redirects, positions)
    each = found.withColumn("variant", F.explode(irreducible(F.col("variants"))))
    counted = each.groupBy("title", "location", "entity").agg(F.sum(occurrences(F.concat(F.lit(" "), F.col("clean"), F.lit(" ")), F.col("variant"))).alias("cnt"), F.min("ord").alias("ord"))
    return counted.groupBy("title", "location").agg(F.sum("cnt").alias("cnt"), F.min("ord").alias("ord")).where((F.col("cnt") > 0) & (F.col("ord") <= last_word))

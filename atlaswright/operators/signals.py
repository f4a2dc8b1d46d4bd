"""Statements that an article's subject is located at, or is a thing in, a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.config import DEFAULTS
from atlaswright.functions.geo import haversine_km
from atlaswright.functions.text import normal_title, upper_first
from atlaswright.session import cut

# fixed values
PHRASES = ["located in ", "located at ", "located outside ", "located inside ", "located east ", "located west ", "located north ", "located south ", "located near ", "headquartered in ", "headquartered at ", "found in "]
DISTANCE_IN_LINE = r"\d{2,}\s+(nautical\s+)?(km|kilomet|mile)"
DISTANCE_IN_WINDOW = r"\{\{convert\|\d{2,}\|"
ENTITY = r"\[\[(.*?)(\||(]]))"
SECTION_BREAK = r"(\n\s+\n)|(==.*?==)"
IS_A_DISTANCE = r"\d{2,}\s*(km|kilometer|mile|mi)"
IS_A_SCRUB = [
    (r"\{\{[Cc]onvert.*?\d{2,}.*?((km)|(mi)).*?}}", "---LOCATION DELETE---"),
    (r"\{\s*\{.*?}\s*}", ""),
    (r"(&lt;)|(&gt;)", " "),
    (r"ref name.*?=.*?/ref", " "),
    (r"nbsp;", " "),
    (r"&.{1,4};", " "),
    (r"\s+[,;|?]+\s+", " "),
    (r"\(\s*\)", ""),
]
VERBS = ["is", "was", "are", "were"]
PREPOSITIONS = ["in", "on", "at"]
LEAST_PRIORITY = 3


def phrase_windows(pages: DataFrame) -> DataFrame:
    """``title, phrase, at, words, window``: places where a page says that something is located, in its first sentence.

    ``pages``: title, raw, clean. The phrase must stand before the first full stop, after fewer than 30 words. ``words`` are those of
    the 150 characters after it, up to a section break; ``window`` is the 300 raw characters from the phrase's first mention there on (in any case). Lines
    that speak of a distance, and windows with a converted one, are left out, in any case of letters.
    """
    p = pages.where("title is not null and clean is not null and raw is not null").withColumn("phrase", F.explode(F.array(*[F.lit(x) for x in PHRASES])))
    p = p.withColumn("at", F.instr("clean", F.col("phrase"))).where("at > 0")
    dot = F.instr("clean", F.lit("."))
    before = F.size(F.split(F.regexp_replace(F.col("clean").substr(F.lit(1), F.col("at") - 1), r"\s+$", ""), r"\s"))
    p = p.where((dot > F.col("at")) & (before < DEFAULTS.located_at_words))
    after = F.col("clean").substr(F.col("at") + F.length("phrase"), F.lit(DEFAULTS.located_at_chars))
    p = p.withColumn("line", F.split(after, SECTION_BREAK, 2)[0])
    start = F.instr(F.lower("raw"), F.col("phrase"))
    p = p.withColumn("window", F.when(start > 0, F.col("raw").substr(start, F.lit(2 * DEFAULTS.located_at_chars))).otherwise(""))
    near = ~F.lower("line").rlike(DISTANCE_IN_LINE) & ~F.lower("window").rlike(DISTANCE_IN_WINDOW)
    return p.where(near).select("title", "phrase", "at", F.split("line", r"\s").alias("words"), "window")


def scattered(windows: DataFrame, redirects: DataFrame, positions: DataFrame, types: DataFrame, most_km: float = DEFAULTS.located_at_diameter_km) -> DataFrame:
    """``title, phrase`` of windows naming entities, or redirecting to some, that are too far apart. ``types``: title, priority.

    Only entities of a specific enough type count. A window has at most 300 characters, so its places fit one array.
    """
    e = windows.select("title", "phrase", F.explode(F.regexp_extract_all("window", F.lit(ENTITY), 1)).alias("name")).select("title", "phrase", normal_title(F.col("name")).alias("entity")).distinct()
    hop = redirects.select(F.col("title").alias("entity"), F.col("target").alias("hop")).dropDuplicates(["entity"])
    both = e.unionByName(e.join(hop, "entity").select("title", "phrase", F.col("hop").alias("entity")))
    fine = types.where(F.col("priority") >= LEAST_PRIORITY).select(F.col("title").alias("entity")).distinct()
    p = both.join(fine, "entity", "left_semi").join(positions.select(F.col("title").alias("entity"), "lat", "lon"), "entity")
    p = p.groupBy("title", "phrase").agg(F.collect_set(F.struct("lat", "lon")).alias("ps")).where(F.size("ps") > 1)
    far = F.exists("ps", lambda a: F.exists("ps", lambda b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) > most_km))
    return p.where(far).select("title", "phrase")


def located_at(pages: DataFrame, redirects: DataFrame, positions: DataFrame, types: DataFrame) -> DataFrame:
    """``title, location``: the place that the earliest successful phrase of a page names.

    From the first word on, growing word groups are looked up among the entities linked in the raw window, in any case of letters: one with a position (its own or its
    redirect's) is a place, one without cancels shorter ones. The first starting word with a place left wins, with its longest
    group; a word after ``new`` starts none.
    """
    w, _ = cut(phrase_windows(pages), "windows")  # few, and read twice
    w = w.join(scattered(w, redirects, positions, types), ["title", "phrase"], "left_anti")
    starts = w.select("title", "phrase", "at", F.lower("window").alias("window"), "words", F.posexplode("words").alias("i", "first"))
    starts = starts.where((F.length("first") > 0) & ~F.coalesce(F.lower(F.get("words", F.col("i") - 1)) == "new", F.lit(False)))
    # no group has more words than the longest linked name or redirect (one row)
    pieces = lambda c: F.size(F.split(c, "[_ ]"))
    longest = F.array_max(F.transform(F.regexp_extract_all("window", F.lit(ENTITY), 1), pieces))
    starts = starts.join(F.broadcast(redirects.agg(F.max(pieces(F.col("title"))).alias("hop_words"))))
    starts = starts.withColumn("most", F.least(F.size("words") - F.col("i"), F.greatest(longest, "hop_words"))).where("most >= 1")
    grams = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("most"))))
    text = F.regexp_replace(F.trim(F.array_join(F.expr("slice(words, i + 1, n)"), "_")), r"[,.;?!\-%#]$", "")
    grams = grams.select("title", "phrase", "at", "window", "i", "n", upper_first(text).alias("entity")).where(F.length("entity") > 0)
    hop = redirects.select(F.col("title").alias("entity"), F.col("target").alias("hop")).dropDuplicates(["entity"])
    grams = grams.join(hop, "entity", "left")
    plain = lambda name: F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    linked = lambda name: F.contains(F.col("window"), F.concat(F.lit("[["), plain(name), F.lit("|"))) | F.contains(F.col("window"), F.concat(F.lit("[["), plain(name), F.lit("]]")))
    grams = grams.where(linked(F.col("entity")) | F.coalesce(linked(F.col("hop")), F.lit(False)))
    known = positions.select(F.col("title").alias("entity")).distinct()
    grams = grams.join(known.withColumn("own", F.lit(True)), "entity", "left").join(known.withColumnRenamed("entity", "hop").withColumn("via", F.lit(True)), "hop", "left")
    place = F.when(F.col("own"), F.col("entity")).when(F.col("via"), F.col("hop"))
    last = grams.groupBy("title", "phrase", "at", "i").agg(F.max(F.struct("n", place.alias("location"))).alias("l")).where("l.location is not null")
    best = Window.partitionBy("title").orderBy("at", "i")
    return last.withColumn("k", F.row_number().over(best)).where("k = 1").select("title", F.col("l.location").alias("location"))


def _ends_sentence(word: Column) -> Column:
    return word.endswith("]].") | (word.endswith(".") & ~word.startswith("[["))


def _first(words: Column, wanted: list[str], start: Column, end: Column, shortest: int = 0) -> Column:
    """Index (from 0) of the first wanted word in [start, end) before a word ending a sentence; null if there is none. Shorter words are passed over."""
    spots = F.transform(words, lambda w, k: F.when((k >= start) & (k < end) & (F.length(w) >= shortest) & (F.lower(w).isin(wanted) | _ends_sentence(w)), F.struct(k.alias("k"), F.lower(w).isin(wanted).alias("hit"))))
    head = F.try_element_at(F.array_compact(spots), F.lit(1))
    return F.when(head["hit"], head["k"])


def is_a_in(pages: DataFrame, redirects: DataFrame, positions: DataFrame) -> DataFrame:
    """``title, location, pos``: geolocated links after "is a ... in" in the first sentence behind the bold title.

    Only for articles with a position, whose title has none of ``? * +``; sentences that speak of a distance or never end give nothing.
    """
    plain = F.replace("title", F.lit("_"), F.lit(" "))
    own = pages.where("title is not null and raw is not null").where(~F.col("title").rlike(r"[?*+]")).join(positions.select("title").distinct(), "title", "left_semi")
    text = F.call_function("regexp_extract", F.col("raw"), F.concat(F.lit(r"(?s)'''\s*?\Q"), plain, F.lit(r"\E\s*?'''(.*)")), F.lit(1))
    for pattern, put in IS_A_SCRUB:
        text = F.regexp_replace(text, pattern, put)
    s = own.select("title", text.substr(1, DEFAULTS.is_a_in_chars).alias("s")).where((F.length("s") > 0) & ~F.col("s").rlike(IS_A_DISTANCE) & ~F.col("s").contains("---LOCATION DELETE---"))
    s = s.withColumn("words", F.split("s", r"\s"))
    verb = _first(F.col("words"), VERBS, F.lit(0), F.lit(DEFAULTS.is_a_in_words), 2)
    s = s.withColumn("v", verb).where("v is not null").withColumn("p", _first(F.col("words"), PREPOSITIONS, F.col("v") + 1, F.size("words"))).where("p is not null")
    rest = F.slice("words", F.col("p") + 2, F.size("words"))
    s = s.withColumn("rest", rest).withColumn("ends", F.transform("rest", _ends_sentence)).withColumn("end", F.array_position("ends", F.lit(True))).where("end > 0")
    portion = F.array_join(F.slice("rest", F.lit(1), F.col("end").cast("int")), " ")
    e = s.select("title", F.posexplode(F.regexp_extract_all(portion, F.lit(ENTITY), 1)).alias("pos", "name")).select("title", "pos", normal_title(F.col("name")).alias("entity"))
    hop = redirects.select(F.col("title").alias("entity"), F.col("target").alias("hop")).dropDuplicates(["entity"])
    e = e.join(hop, "entity", "left").select("title", "pos", F.coalesce("hop", "entity").alias("location"))
    return e.join(positions.select(F.col("title").alias("location")).distinct(), "location", "left_semi").select("title", "location", "pos")

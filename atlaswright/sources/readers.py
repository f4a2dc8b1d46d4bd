"""Readers: MediaWiki dumps, SQL dumps, category and view replies, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.functions.readings import category_reading
from atlaswright.functions.text import article_title
from atlaswright.functions.wikitext import page_title, redirect_target

VIEWS_SCHEMA = "items array<struct<timestamp string, views double>>"
MEMBERS_SCHEMA = "query struct<categorymembers: array<struct<pageid: bigint, ns: int, title: string>>>, continue struct<cmcontinue: string>"


def read_pages(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``title, raw, is_redirect`` of every page of a dump, in one splittable scan.

    Pages are cut at their closing tag; whatever stands before the first page is dropped, blank lines too.
    ``limit`` 0 means all pages.
    """
    text = spark.read.option("lineSep", "</page>").text(path)
    pages = text.where(F.col("value").contains("<page>")).select(F.regexp_replace(F.substring_index("value", "<page>", -1), r"\n(\s*\n)+", "\n").alias("raw"))
    pages = pages.select(page_title(F.col("raw")).alias("title"), "raw", F.col("raw").contains("<redirect title").alias("is_redirect"))
    return pages.limit(limit) if limit else pages


def articles_only(pages: DataFrame, categories: bool = False) -> DataFrame:
    """Without redirects and pages that are no articles (category pages only if asked for)."""
    return pages.where(~F.col("is_redirect") & article_title(F.col("title"), categories))


def redirects(pages: DataFrame) -> DataFrame:
    """``title, target_raw, target`` of redirect pages; targets normalised once."""
    rows = pages.where("is_redirect").select("title", redirect_target(F.col("raw")).alias("target_raw"))
    return rows.where("title is not null and target_raw is not null").withColumn("target", F.replace("target_raw", F.lit(" "), F.lit("_")))


def read_category_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names from the INSERT statements of an SQL dump; quoted names may hold commas and escapes."""
    rows = spark.read.text(path).where(F.col("value").startswith("INSERT INTO"))
    names = rows.select(F.explode(F.regexp_extract_all("value", F.lit(r"\(\d+,'((?:[^'\\]|\\.)*)'"), 1)).alias("name"))
    return names.select(F.regexp_replace("name", r"\\(.)", "$1").alias("name")).where("name <> ''").distinct()


def read_subcategories(spark: SparkSession, path: str) -> DataFrame:
    """``counter, category, subcategories`` from a folder of tab-separated files: number, category, ``[a|||b]``."""
    rows = spark.read.csv(path, sep="\t", schema="counter int, category string, kids string", quote="")
    inner = F.regexp_replace("kids", r"^\[|\]$", "")
    return rows.select("counter", "category", F.filter(F.split(inner, r"\|\|\|"), lambda k: F.length(k) > 0).alias("subcategories"))


def member_names(reply: Column, category: Column | None = None) -> Column:
    """Subcategory names of a category-members reply, by their readings; null for malformed replies, empty for those without members.

    With ``category`` a first member that is the category itself is dropped.
    """
    parsed = F.from_json(reply, MEMBERS_SCHEMA)
    names = F.transform(F.coalesce(parsed["query"]["categorymembers"], F.array().cast("array<struct<pageid: bigint, ns: int, title: string>>")), lambda m: category_reading(m["title"]))
    if category is not None:
        names = F.when(F.get(names, F.lit(0)) == category_reading(category), F.slice(names, 2, F.greatest(F.lit(0), F.size(names)))).otherwise(names)
    return F.when(_well_formed(reply), names)


def _well_formed(reply: Column) -> Column:
    return F.try_parse_json(reply).isNotNull()


def member_links(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``category, subcategories``; ``category, cmcontinue`` still to be asked for; ``rejected``, one row: how many replies were malformed) of ``category, reply``."""
    read = replies.withColumn("subcategories", member_names(F.col("reply"), F.col("category")))
    good = read.where(F.col("subcategories").isNotNull())
    more = good.select("category", continuation(F.col("reply")).alias("cmcontinue")).where("cmcontinue is not null")
    return good.select("category", "subcategories"), more, rejected(replies, _well_formed(F.col("reply")))


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    """``category, reply`` of a folder of fetched replies, one JSON file each, named after the URL-encoded category (``name.json`` or, of further pages, ``name~token.json``)."""
    files = spark.read.option("wholetext", True).text(folder).select(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("reply"))
    name = F.regexp_extract("file", r"^(.*?)(~[^~]*)?\.json$", 1)
    return files.where(F.length(name) > 0).select(F.url_decode(name).alias("category"), "reply")


def rejected(rows: DataFrame, good: Column) -> DataFrame:
    """One row, ``rejected``: how many rows do not pass (null counts as not passing). Bad rows end no job; this says how many there were."""
    return rows.agg(F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("rejected"))


def all_category_names(from_sql: DataFrame, from_pages: DataFrame) -> DataFrame:
    """Distinct ``name``s of an SQL dump and of the categories found on pages, by their readings."""
    both = from_sql.select("name").unionByName(from_pages.select(F.col("category").alias("name")))
    return both.select(category_reading(F.col("name")).alias("name")).where("name is not null").distinct()


def views_url(title: Column, pattern: str) -> Column:
    """The address of a title's page views: ``pattern`` with the URL-encoded title put for ``%s``."""
    head, tail = pattern.split("%s")
    return F.concat(F.lit(head), F.url_encode(title), F.lit(tail))


def titles_without_views(titles: DataFrame, views: DataFrame) -> DataFrame:
    """Distinct ``title``s for which no reply is there yet."""
    return titles.where("title is not null").select("title").distinct().join(views.select("title"), "title", "left_anti")


def continuation(reply: Column) -> Column:
    """The token of the next reply; null at the end."""
    return F.get_json_object(reply, "$.continue.cmcontinue")


def view_counts(reply: Column) -> Column:
    """Monthly views of a page-views reply, as an array of integers as long as the reply has items."""
    return F.transform(F.from_json(reply, VIEWS_SCHEMA)["items"], lambda i: i["views"].try_cast("int"))


def read_evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """``title, lat, lon`` of a tab-separated evaluation file without header."""
    return spark.read.csv(path, sep="\t", schema="title string, lat double, lon double", quote="")

"""The assembled article table and the whole build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaswright.functions.coordinate_templates import template_position
from atlaswright.functions.porter import stemmed
from atlaswright.functions.text import tokens, without_stop_words
from atlaswright.functions.wikitext import clean_text, page_categories, page_text
from atlaswright.operators.article_types import PRIORITY, article_types
from atlaswright.operators.entities import named_locations
from atlaswright.operators.signals import is_a_in, located_at
from atlaswright.operators.vectors import location_vectors, term_frequencies, word_vectors
from atlaswright.session import cut
from atlaswright.sources.readers import articles_only, redirects


def assemble(
    words: DataFrame, positions: DataFrame, locations: DataFrame, categories: DataFrame, types: DataFrame, at: DataFrame, inside: DataFrame, vectors: DataFrame
) -> DataFrame:
    """One row for each title with a word vector; every other feature is looked up, absent ones default to NONE, empty or null."""
    arr = lambda d, name, *fields: d.groupBy("title").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    base = arr(words, "words", "word", "score")
    spots = positions.select("title", F.struct("lat", "lon").alias("coords"))
    cats = categories.select("title", "category").distinct().groupBy("title").agg(F.sort_array(F.collect_list("category")).alias("categories"))
    locs = locations.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("ord", "location", "cnt"))).alias("named_locations"))
    ins = inside.groupBy("title").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "location"))), lambda x: x["location"]).alias("is_a_in"))
    out = base
    for d in (spots, types, cats, locs, arr(vectors, "location_vector", "location", "score"), at.withColumnRenamed("location", "located_at"), ins):
        out = out.join(d, "title", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("title", F.coalesce("type", F.lit("NONE")).alias("type"), "coords", empty("categories"), empty("named_locations"), "words", empty("location_vector"), "located_at", empty("is_a_in"))


def build_features(pages: DataFrame) -> dict[str, DataFrame]:
    """All features of a dump from one scan: ``pages`` as the reader gives them.

    Clean text is made once and written to the scratch folder; all features read it from there.
    """
    hops = redirects(pages)
    text = page_text(F.col("raw"))
    parsed = articles_only(pages).select("title", "raw", text.alias("text"), clean_text(text, F.col("title")).alias("clean"), page_categories(F.col("raw")).alias("categories"))
    parsed, _ = cut(parsed, "pages")
    spot = template_position(F.col("raw"))
    positions = parsed.select("title", spot.alias("p")).where("p is not null").select("title", "p.lat", "p.lon")
    counts = term_frequencies(parsed.select("title", without_stop_words(stemmed(tokens(F.col("clean")))).alias("words")))
    locations = named_locations(parsed, hops, positions)
    kinds = article_types(parsed)
    priority = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    ranked = kinds.select("title", F.try_element_at(priority, F.col("type")).alias("priority"))
    features = {
        "redirects": hops, "positions": positions, "counts": counts, "words": word_vectors(counts), "locations": locations,
        "location_vectors": location_vectors(locations), "categories": parsed.select("title", F.explode("categories").alias("category")).where("category <> ''"),
        "types": kinds, "located_at": located_at(parsed, hops, positions, ranked), "is_a_in": is_a_in(parsed, hops, positions),
    }
    features["articles"] = assemble(*(features[k] for k in ("words", "positions", "locations", "categories", "types", "located_at", "is_a_in", "location_vectors")))
    return features

"""Category graphs: edges, augmentation from pages and ancestors by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlaswright.session import cut


def known_edges(links: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``parent, child`` whose two ends are both known ``name``s and differ."""
    known = names.select("name").distinct()
    e = links.where("parent <> child").select("parent", "child").distinct()
    return e.join(known.withColumnRenamed("name", "parent"), "parent", "left_semi").join(known.withColumnRenamed("name", "child"), "child", "left_semi")


def augmented_edges(edges: DataFrame, page_links: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with those of category pages added: a page counts if it is a known name or has a known parent.

    ``page_links``: parent, child as found on pages of categories (child). A page that comes in makes its name known, so this repeats until
    nothing new is known (each round but the last makes a name known, so it ends); the order of pages does not matter. Self-parents do not count.
    """
    pages, _ = cut(page_links.where("parent <> child").select("parent", "child").distinct(), "links")
    known, _ = cut(names.select("name").union(edges.select("parent")).union(edges.select("child")).distinct(), "known")
    while True:
        hit = pages.join(known.withColumnRenamed("name", "parent"), "parent", "left_semi").select(F.col("child").alias("name")).distinct()
        new, _ = cut(hit.join(known, "name", "left_anti"), "new")
        if new.isEmpty():
            break
        known, _ = cut(known.union(new), "known")
    both = pages.join(known.withColumnRenamed("name", "parent"), "parent", "left_semi").join(known.withColumnRenamed("name", "child"), "child", "left_semi")
    return edges.select("parent", "child").unionByName(both).distinct()


def ancestors(edges: DataFrame, starts: DataFrame, levels: int) -> DataFrame:
    """``root, level, category``: categories above each start, level by level.

    ``starts``: root, category (a root may start from several). Level 0 is the start; each further level has the parents not yet
    seen above the start, so a start can come back as its own ancestor through a loop, once. Unknown starts give nothing.
    ``levels`` counts level 0. Each level is one join and one anti-join against what was seen.
    """
    nodes = edges.select(F.col("parent").alias("category")).union(edges.select(F.col("child").alias("category"))).distinct()
    level = starts.where("root is not null").select("root", "category").distinct().join(nodes, "category", "left_semi")
    out = level.select("root", F.lit(0).alias("level"), "category")
    seen = None
    for k in range(1, levels):
        up = level.join(edges.select(F.col("child").alias("category"), "parent"), "category").select("root", F.col("parent").alias("category")).distinct()
        if seen is not None:
            up = up.join(seen, ["root", "category"], "left_anti")
        level, _ = cut(up, "level")
        seen = level if seen is None else seen.union(level)
        out = out.union(level.select("root", F.lit(k).alias("level"), "category"))
    return out

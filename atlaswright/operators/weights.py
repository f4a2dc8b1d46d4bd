"""Weights of entities for a target article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlaswright.config import DEFAULTS, Settings


def neighbor_weights(neighbors: DataFrame) -> DataFrame:
    """``title, entity, weight``: a neighbour weighs as much as it is similar."""
    return neighbors.select("title", F.col("neighbor").alias("entity"), F.col("score").alias("weight"))


def location_weights(locations: DataFrame) -> DataFrame:
    """``title, entity, weight``: square root of a location's share of mentions (an extension)."""
    share = F.sqrt(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("title")))
    return locations.select("title", F.col("location").alias("entity"), share.alias("weight"))


def assign(entities: DataFrame, weights: DataFrame) -> DataFrame:
    """``title, entity, weight`` of the listed entities; 0 for those without a weight."""
    return entities.select("title", "entity").join(weights, ["title", "entity"], "left").select("title", "entity", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def boosted(weights: DataFrame, priorities: DataFrame, is_a_in: DataFrame, located_at: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Weights multiplied where a title is said to be in, or located at, an entity of a specific enough type (an extension).

    ``priorities``: entity, priority. ``is_a_in`` and ``located_at``: title, entity. Both boosts may apply.
    """
    one = lambda d, c: d.select("title", "entity").distinct().withColumn(c, F.lit(True))
    w = weights.join(priorities.select("entity", "priority"), "entity", "left").join(one(is_a_in, "isa"), ["title", "entity"], "left").join(one(located_at, "at"), ["title", "entity"], "left")
    fine = F.col("priority") >= settings.least_boost_priority
    boost = F.when(fine & F.col("isa"), settings.is_a_in_boost).otherwise(1.0) * F.when(fine & F.col("at"), settings.located_at_boost).otherwise(1.0)
    return w.select("title", "entity", (F.col("weight") * boost).alias("weight"))

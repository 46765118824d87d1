"""Entity resolution of surface forms against a registry, by candidate keys instead of a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical


def name_key(name: Column) -> Column:
    """Canonical name without a leading article."""
    return F.regexp_replace(canonical(name), "^the ", "")


def acronym(name: Column) -> Column:
    """First letters of a name of two words or more, else null."""
    parts = F.split(name_key(name), " ")
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def resolve(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, entity_id, how): the first registered entity that a name means, or null.

    registry (entity_id, surface, mention_count). An equal name wins, then an acronym either
    way, then a one-word name that is the first word of a longer one; within a way the
    entity with most mentions, then the least id. A two-word name is not a three-word one.
    """
    word = lambda c: F.when(F.size(F.split(c, " ")) > 1, F.split(c, " ")[0])
    known = registry.select("entity_id", "mention_count", name_key(F.col("surface")).alias("k"), acronym(F.col("surface")).alias("a")).withColumn("w", word(F.col("k")))
    asked = names.select("name").distinct().select("name", name_key(F.col("name")).alias("k"), acronym(F.col("name")).alias("a")).withColumn("w", word(F.col("k")))
    ways = (("k", "k", "exact"), ("k", "a", "acronym"), ("a", "k", "acronym"), ("k", "w", "prefix"), ("w", "k", "prefix"))
    hits = None
    for order, (mine, theirs, how) in enumerate(ways):
        part = asked.join(known.select("entity_id", "mention_count", F.col(theirs).alias("_c")), F.col(mine) == F.col("_c")).select("name", "entity_id", "mention_count", F.lit({"exact": 0, "acronym": 1, "prefix": 2}[how]).alias("o"), F.lit(how).alias("how"))
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy("name").agg(F.min(F.struct("o", -F.col("mention_count"), "entity_id", "how")).alias("_b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", "_b.entity_id", "_b.how")

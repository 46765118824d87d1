"""Wide recall: ten routes to facts and spans, ranked by reciprocal ranks, without rules that leave a topic out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fusion import reciprocal

#: The routes in the order in which they are asked, with the kind of unit that they lead to.
ROUTES = (
    ("memory_unit_bm25", "fact"), ("memory_unit_vector", "fact"), ("message_unit_bm25", "span"), ("message_unit_linked_memory", "fact"), ("message_unit_vector", "span"),
    ("message_unit_vector_memory", "fact"), ("summary_route", "summary"), ("summary_expanded_fact", "fact"), ("mention_message_unit", "span"), ("mention_memory_unit", "fact"),
)


@dataclass(frozen=True)
class Limits:
    # How far each route looks, and what its scores are worth.
    lexical: int = 80
    vector: int = 60
    summary: int = 20
    facts_of_summary: int = 30
    decay: float = 0.03
    linked: float = 0.10
    near: float = 0.9
    near_decay: float = 0.02
    expanded: float = 0.05
    mentioned: float = 0.05


def _route(name: str, hits: DataFrame, unit: str, score: Column, place: str | None = None) -> DataFrame:
    order, kind = next((k, kind) for k, (route, kind) in enumerate(ROUTES) if route == name)
    at = F.lit(0) if place is None else F.col(place)
    return hits.where(F.col(unit).isNotNull()).select("query_id", F.lit(kind).alias("kind"), F.col(unit).cast("string").alias("unit"), F.lit(name).alias("route"), F.lit(order).alias("asked"), F.col("rank").cast("long").alias("rank"), at.cast("long").alias("place"), score.cast("double").alias("score"))


def routes(fact_terms: DataFrame, fact_vectors: DataFrame, span_terms: DataFrame, span_vectors: DataFrame, summary_terms: DataFrame, mentions: DataFrame, links: DataFrame, summaries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(query_id, kind, unit, route, asked, rank, place, score): all hits of the ten routes.

    The first five are hits (query_id, unit, rank, and for terms score) of facts, spans and
    summaries. mentions (query_id, span_id, fact_id, rank, confidence), links (span, fact, seq)
    the facts of a span in their order, summaries (summary, fact, seq). A vector route may be
    empty: then the others stand alone. A fact that a route reaches twice counts twice, as it
    has two ranks.
    """
    step = F.col("rank") - 1
    facts, near = fact_terms.where(F.col("rank") <= limits.lexical), fact_vectors.where(F.col("rank") <= limits.vector)
    spans, near_spans = span_terms.where(F.col("rank") <= limits.lexical), span_vectors.where(F.col("rank") <= limits.vector)
    sums, said = summary_terms.where(F.col("rank") <= limits.summary), mentions.where(F.col("rank") <= limits.lexical)
    decayed = F.greatest(F.lit(0.0), 1 - F.lit(limits.decay) * step)
    linked = lambda hits: hits.join(links, F.col("unit") == F.col("span"))
    first = Window.partitionBy("summary").orderBy("seq", "fact")
    members = summaries.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limits.facts_of_summary)
    found = [
        _route("memory_unit_bm25", facts, "unit", F.col("score")), _route("memory_unit_vector", near, "unit", decayed),
        _route("message_unit_bm25", spans, "unit", F.col("score")), _route("message_unit_linked_memory", linked(spans), "fact", F.col("score") + limits.linked, "seq"),
        _route("message_unit_vector", near_spans, "unit", decayed), _route("message_unit_vector_memory", linked(near_spans), "fact", limits.near - F.lit(limits.near_decay) * step, "seq"),
        _route("summary_route", sums, "unit", F.col("score")), _route("summary_expanded_fact", sums.join(members, F.col("unit") == F.col("summary")), "fact", F.col("score") + limits.expanded, "_r"),
        _route("mention_message_unit", said, "span_id", F.col("confidence")), _route("mention_memory_unit", said, "fact_id", F.col("confidence") + limits.mentioned),
    ]
    out = found[0]
    for each in found[1:]:
        out = out.unionByName(each)
    return out


def active(hits: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, excluded): facts that are not active go, with the reason; spans stay. status (unit, status) of facts."""
    known = hits.join(status.select("unit", "status"), "unit", "left")
    out = (F.col("kind") == "fact") & F.coalesce(F.col("status") != "active", F.lit(True))
    gone = known.where(out).select("query_id", F.col("unit").alias("fact_id"), F.concat(F.lit("status="), F.coalesce("status", F.lit("unknown"))).alias("reason")).distinct()
    return known.where(~out).drop("status"), gone


def evidence(hits: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """(query_id, kind, unit, routes, rrf, score, rank): the best most facts and spans of each query.

    units (unit, tier, has_quantity, n_chars): a lower tier comes first, then what has a
    quantity, the score by reciprocal ranks, the longer support, the id. Summaries are no evidence
    themselves. routes are the routes that led to it, in the order in which they are asked.
    """
    real = hits.where(F.col("kind") != "summary").withColumn("_u", F.concat_ws(":", "kind", "unit"))
    ranked = reciprocal(real.select("query_id", F.col("_u").alias("unit"), "route", "rank", "score")).withColumnRenamed("unit", "_u")
    named = real.groupBy("query_id", "_u").agg(F.first("kind").alias("kind"), F.first("unit").alias("unit"), F.transform(F.array_sort(F.collect_set(F.struct("asked", "route"))), lambda r: r["route"]).alias("routes"))
    whole = named.join(ranked, ["query_id", "_u"]).join(units.select("unit", "tier", "has_quantity", "n_chars"), "unit", "left")
    best = Window.partitionBy("query_id").orderBy(F.coalesce("tier", F.lit(5)), F.when(F.col("has_quantity"), 0).otherwise(1), F.desc(F.round("score", 6)), F.desc(F.coalesce("n_chars", F.lit(0))), "unit")
    return whole.select("query_id", "kind", "unit", "routes", "rrf", F.round("score", 6).alias("score"), F.row_number().over(best).cast("long").alias("rank")).where(F.col("rank") <= most)

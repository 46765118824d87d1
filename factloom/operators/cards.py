"""Evidence cards: facts, spans and turns in one shape, with their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, plain

PREVIEW, SUPPORT = 700, 1800


def fact_cards(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """One card a fact: (evidence_id, fact_id, tier, role, session_id, turn_id, support_text, preview, truncated).

    facts (fact_id, source_type, predicate, support, span_ids array), spans (span_id, turn_id,
    session_id, role, text). The first span says who and where; the support is all spans' texts
    in order, else the extracted text, else the predicate. Tier 1 is stated text, 3 is inferred.
    """
    placed = facts.select("fact_id", F.posexplode("span_ids").alias("pos", "span_id")).join(spans, "span_id")
    each = F.array_sort(F.collect_list(F.struct("pos", "role", "session_id", "turn_id", "text")))
    joined = placed.groupBy("fact_id").agg(each.alias("_s"))
    support = F.coalesce(F.nullif(F.array_join(F.transform("_s", lambda x: x["text"]), "\n"), F.lit("")), F.nullif(plain(F.col("support")), F.lit("")), F.col("predicate"))
    cards = facts.join(joined, "fact_id", "left").select(
        F.concat(F.lit("ev_fact:"), "fact_id").alias("evidence_id"), "fact_id", F.when(F.col("source_type") == "explicit_text", 1).otherwise(3).alias("tier"),
        F.get("_s", F.lit(0))["role"].alias("role"), F.get("_s", F.lit(0))["session_id"].alias("session_id"), F.get("_s", F.lit(0))["turn_id"].alias("turn_id"), support.alias("support_text"),
    )
    return previewed(cards)


def span_cards(spans: DataFrame) -> DataFrame:
    """One card a span, tier 2, its text cut."""
    cards = spans.select(F.concat(F.lit("ev_span:"), "span_id").alias("evidence_id"), F.lit(None).cast("string").alias("fact_id"), F.lit(2).alias("tier"), "role", "session_id", "turn_id", F.substring("text", 1, SUPPORT).alias("support_text"))
    return previewed(cards)


def previewed(cards: DataFrame) -> DataFrame:
    return cards.select("*", F.substring("support_text", 1, PREVIEW).alias("preview"), (F.length("support_text") > PREVIEW).alias("truncated"))


def lineage(cards: DataFrame, supersedes: DataFrame) -> DataFrame:
    """cards with superseded_by, superseded_ids and current_head: one level of SUPERSEDES edges (src wins over dst)."""
    by = supersedes.groupBy(F.col("dst").alias("fact_id")).agg(F.max("src").alias("superseded_by"))
    of = supersedes.groupBy(F.col("src").alias("fact_id")).agg(F.array_sort(F.collect_set("dst")).alias("superseded_ids"))
    return cards.join(by, "fact_id", "left").join(of, "fact_id", "left").select("*", F.coalesce("superseded_by", "fact_id").alias("current_head"))


def order(cards: DataFrame, score: str, quantity: Column, ordinal: str) -> DataFrame:
    """Cards in the wide route's order: by tier, then those with a quantity, score, length, first touch."""
    return cards.orderBy("tier", F.desc(quantity), F.desc(score), F.desc(F.length("support_text")), ordinal)


def compact(cards: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(evidence_id, card): a map of the fields that say something, each cut."""
    fields = F.create_map(*(x for c, n in limits.items() for x in (F.lit(c), excerpt(F.col(c).cast("string"), n))))
    return cards.select("evidence_id", F.map_filter(fields, lambda k, v: v != "").alias("card"))


#: Fields that a card shows as the fact has them; null where it has none.
SHOWN = ("source_type", "kind", "event_type", "modality", "status", "predicate_raw", "predicate_canonical", "entity_roles", "scope", "confidence", "confidence_reason", "provenance", "time_source", "extracted_support_text")


def day(seconds: Column) -> Column:
    """The day of seconds since 1970 as text, in UTC; cards are no more precise."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd")


def evidence_cards(facts: DataFrame, spans: DataFrame, supersedes: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """The whole card of each fact: its source, axes of time, wording, quantity, support, versions and routes.

    facts (fact_id, span_ids array, and of SHOWN, document_time, occurred_start, occurred_end,
    valid_from, valid_until, quantity_value and quantity_unit what there is; times in seconds),
    spans (span_id, turn_id, session_id, role, text, session_time), supersedes (src, dst), routes
    (fact_id, route, score). The first span says who and where; a fact without spans is the
    user's. What a fact lacks is null.
    """
    held = {f.name: f.dataType for f in facts.schema}
    own = lambda c, kind="string": F.col(c) if c in held else F.lit(None).cast(kind)
    placed = facts.select("fact_id", F.posexplode("span_ids").alias("pos", "span_id")).join(spans, "span_id")
    each = F.struct("pos", "role", "session_id", "turn_id", "session_time", "text")
    sources = placed.groupBy("fact_id").agg(F.array_sort(F.collect_list(each)).alias("_s"), F.max("session_time").alias("_latest"))
    first = lambda c: F.get("_s", F.lit(0))[c]
    texts = F.array_join(F.transform(F.filter("_s", lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    support = F.coalesce(F.nullif(F.regexp_replace(texts, r"^\s+|\s+$", ""), F.lit("")), F.nullif(own("extracted_support_text"), F.lit("")), own("predicate_raw"))
    given = facts.join(sources, "fact_id", "left").select(
        F.concat(F.lit("ev_fact:"), "fact_id").alias("evidence_id"), "fact_id", F.col("span_ids").alias("source_span_ids"), F.col("span_ids").alias("source_trace_ids"),
        F.coalesce(first("role"), F.lit("user")).alias("source_role"), first("session_id").alias("source_session_id"), first("turn_id").alias("source_turn_id"),
        day(first("session_time")).alias("session_time"), day(F.coalesce(own("document_time", "double"), "_latest")).alias("document_time"),
        *(own(c).alias(c) for c in SHOWN), *(day(own(c, "double")).alias(c) for c in ("occurred_start", "occurred_end", "valid_from", "valid_until")), day(own("valid_until", "double")).alias("valid_to"),
        F.struct(own("quantity_value", "double").alias("value"), own("quantity_unit").alias("unit")).alias("quantity"), support.alias("support_text"),
    )
    placed = lineage(given, supersedes).withColumnsRenamed({"superseded_ids": "superseded_fact_ids", "current_head": "current_head_id"})
    version = F.when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("status") == "active", "current").otherwise(F.col("status"))
    older = F.coalesce(F.size("superseded_fact_ids"), F.lit(0))
    summary = F.when(older > 0, F.format_string("current version; supersedes %d older fact(s)", older)).when(F.col("superseded_by").isNotNull(), F.concat(F.lit("superseded by "), "superseded_by")).otherwise("")
    told = placed.select("*", version.alias("version_status"), summary.alias("update_chain_summary"))
    if routes is None:
        none = F.array().cast("array<struct<route: string, score: double>>")
        told = told.withColumn("routes", none)
    else:
        told = told.join(routes.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("route", "score"))).alias("routes")), "fact_id", "left")
    best = F.coalesce(F.array_max(F.transform("routes", lambda r: r["score"])), F.lit(0.0))
    return told.withColumn("rank", F.struct(F.when(F.col("source_type") == "explicit_text", 1).otherwise(3).alias("tier"), best.alias("score")))

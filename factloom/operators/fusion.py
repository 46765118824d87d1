"""Fusion of ranked channels: Noisy-OR of constant contributions, and reciprocal ranks.

Ties are the rule here, so every hit carries an ordinal (its place of first touch), and
every order ends in it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Weights:
    # Contributions of the channels and the boost for a matching year.
    strong_direct: float = 0.4
    weak_direct: float = 0.2
    strong_derived: float = 0.1
    weak_derived: float = 0.05
    temporal: float = 0.3
    heads: int = 10


def channel(hits: DataFrame, name: str, contribution: float, order: int, heads: int) -> DataFrame:
    """(query_id, unit, head, contribution, ordinal): the first hits of a ranked channel."""
    ordinal = F.lit(order).cast("long") * 1_000_000 + F.col("rank")
    return hits.where(F.col("rank") <= heads).select("query_id", F.col("unit").cast("string").alias("unit"), F.concat(F.lit(name + ":"), F.col("unit").cast("string")).alias("head"), F.lit(contribution).alias("contribution"), ordinal.alias("ordinal"))


def direct(hits: DataFrame, units: DataFrame, name: str, contribution: float, order: int, heads: int = 10) -> DataFrame:
    """As ``channel``, but hits count only where units (unit, eligible) has them eligible, and the first ``heads`` of those are taken.

    So what is superseded takes no other fact's place.
    """
    fit = hits.join(units.where("eligible").select("unit"), "unit", "left_semi")
    order_ = Window.partitionBy("query_id").orderBy("rank", "unit")
    return channel(fit.withColumn("rank", F.row_number().over(order_)), name, contribution, order, heads)


def through_spans(hits: DataFrame, links: DataFrame, units: DataFrame, name: str, contribution: float, order: int, heads: int = 10, per_span: int = 10) -> DataFrame:
    """A channel of hits of spans (query_id, unit, rank) that lead to their facts: links (span, unit, seq), units (unit, eligible).

    Each span brings its first eligible facts, at most per_span, under the head of the fact, which a direct hit in the same index
    shares; a span without any is a unit itself. Spans count in their order until ``heads`` different heads are there.
    """
    fit = links.join(units.where("eligible").select("unit"), "unit", "left_semi")
    near = hits.select("query_id", F.col("unit").alias("span"), "rank").join(fit, "span", "left")
    first = Window.partitionBy("query_id", "span").orderBy("seq", "unit")
    placed = near.select("*", F.row_number().over(first).alias("_r")).where(F.col("_r") <= per_span)
    head = F.when(F.col("unit").isNotNull(), F.concat(F.lit(name + ":"), F.col("unit").cast("string"))).otherwise(F.concat(F.lit(name + ":span:"), F.col("span").cast("string")))
    each = placed.select("query_id", F.coalesce(F.col("unit").cast("string"), F.col("span").cast("string")).alias("unit"), head.alias("head"), "rank", "_r")
    # A span is looked at as long as the spans before it brought fewer heads.
    new = each.withColumn("_new", F.row_number().over(Window.partitionBy("query_id", "head").orderBy("rank", "_r")) == 1)
    by_rank = Window.partitionBy("query_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    taken = new.withColumn("_before", F.coalesce(F.count_if("_new").over(by_rank), F.lit(0))).where(F.col("_before") < heads)
    return taken.select("query_id", "unit", "head", F.lit(contribution).alias("contribution"), (F.lit(order).cast("long") * 1_000_000 + F.col("rank") * 1000 + F.col("_r")).alias("ordinal"))


def noisy_or(contributions: Column) -> Column:
    """1 - prod(1 - c) of an array, multiplied in sorted order."""
    return 1 - F.aggregate(F.sort_array(contributions), F.lit(1.0), lambda a, c: a * (1 - c))


def fuse(channels: list[DataFrame], boosts: DataFrame | None = None) -> DataFrame:
    """(query_id, unit, confidence, n_heads, ordinal, rank): each head counts once, at its largest contribution.

    boosts (query_id, unit, boost) are added, up to 1.
    """
    hits = reduce(DataFrame.unionByName, channels)
    heads = hits.groupBy("query_id", "unit", "head").agg(F.max("contribution").alias("c"), F.min("ordinal").alias("ordinal"))
    units = heads.groupBy("query_id", "unit").agg(noisy_or(F.collect_list("c")).alias("confidence"), F.count(F.lit(1)).alias("n_heads"), F.min("ordinal").alias("ordinal"))
    if boosts is not None:
        units = units.join(boosts, ["query_id", "unit"], "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + F.coalesce("boost", F.lit(0.0)))).drop("boost")
    return units.select("*", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("confidence", 9)), "ordinal", "unit")).alias("rank"))


def merge_events(heads: DataFrame, facts: DataFrame) -> DataFrame:
    """Units of one event become one: (query_id, unit, members, n_heads, confidence, ordinal).

    heads (query_id, unit, head, c, ordinal): what supports a unit. facts (unit, fingerprint,
    completeness): of a fingerprint's units the one with most heads, of these the most complete,
    of these the first stands for all and takes over their heads, each at its largest
    contribution. Units without a fingerprint stay and come before the groups.
    """
    units = heads.groupBy("query_id", "unit").agg(F.countDistinct("head").alias("_n"), F.min("ordinal").alias("_o"))
    known = units.join(facts.select("unit", "fingerprint", "completeness"), "unit", "left")
    same = Window.partitionBy("query_id", "fingerprint")
    order = same.orderBy(F.desc("_n"), F.desc("completeness"), "_o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grouped = F.col("fingerprint").isNotNull()
    placed = known.where(grouped).select("query_id", "unit", F.first("unit").over(order).alias("to"), F.min("_o").over(same).alias("_at"), F.lit(1).alias("_g"))
    placed = placed.unionByName(known.where(~grouped).select("query_id", "unit", F.col("unit").alias("to"), F.col("_o").alias("_at"), F.lit(0).alias("_g")))
    moved = heads.join(placed, ["query_id", "unit"]).groupBy("query_id", "to", "_g", "_at", "head").agg(F.max("c").alias("c"), F.collect_set("unit").alias("_us"))
    merged = moved.groupBy("query_id", F.col("to").alias("unit"), "_g", "_at").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_us")))).cast("long").alias("members"), F.count(F.lit(1)).alias("n_heads"), noisy_or(F.collect_list("c")).alias("confidence"))
    return merged.select("query_id", "unit", "members", "n_heads", "confidence", F.row_number().over(Window.partitionBy("query_id").orderBy("_g", "_at", "unit")).cast("long").alias("ordinal"))


def reciprocal(routes: DataFrame, k: int = 60, cap: float = 5.0, weight: float = 0.05) -> DataFrame:
    """(query_id, unit, rrf, score) from routes (query_id, unit, route, rank, score)."""
    return routes.groupBy("query_id", "unit").agg(
        F.aggregate(F.sort_array(F.collect_list(1 / (k + F.greatest(F.lit(1), F.col("rank"))))), F.lit(0.0), lambda a, x: a + x).alias("rrf"), F.max("score").alias("_s"),
    ).select("query_id", "unit", "rrf", (F.col("rrf") + F.least(F.coalesce("_s", F.lit(0.0)), F.lit(cap)) * weight).alias("score"))


def date_prefixes(query: Column) -> Column:
    """The dates, months and (if there are none) years that a query names, as ISO prefixes."""
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    iso = F.regexp_extract_all(query, F.lit(r"\b(\d{4}-\d{2}(?:-\d{2})?)\b"), F.lit(1))
    named = F.regexp_extract_all(F.lower(query), F.lit(r"\b((?:" + "|".join(months) + r")\s+\d{4})\b"), F.lit(1))
    number = F.create_map(*(F.lit(x) for k, m in enumerate(months, 1) for x in (m, f"{k:02d}")))
    month = F.transform(named, lambda m: F.concat(F.regexp_extract(m, r"(\d{4})$", 1), F.lit("-"), F.element_at(number, F.regexp_extract(m, r"^(\w+)", 1))))
    years = F.regexp_extract_all(query, F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1))
    first = F.concat(iso, month)
    return F.array_distinct(F.when(F.size(first) > 0, first).otherwise(years))


def temporal_boost(prefixes: Column, seconds: Column, amount: float, exact: bool = False) -> Column:
    """The boost for facts in the named time. By default any date matches its whole year; exact asks for the date itself."""
    day = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")
    hit = (lambda p: day.startswith(p)) if exact else (lambda p: F.substring(p, 1, 4) == F.substring(day, 1, 4))
    return F.when(seconds.isNotNull() & F.exists(prefixes, hit), amount).otherwise(0.0)

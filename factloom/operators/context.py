"""Packing evidence for a reader: deduplication, budgets, histories, sweeps and boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import plain

ADVICE = r"(?i)\b(plan(?:ning)? to|thinking of|going to|will|next (?:week|weekend|month|year)|hope to|want to)\b"


def budget(rows: DataFrame, group: Sequence[str], order: Sequence[Column], line: Column, tokens: int, per_token: int = 4) -> DataFrame:
    """The rows before the first that no longer fits: each line costs its length and a line break."""
    w = Window.partitionBy(*group).orderBy(*order)
    cost = rows.select("*", F.row_number().over(w).alias("position"), F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    # Costs are positive, so once the running sum is over the budget it stays over it.
    return cost.where(F.col("used") - 1 <= tokens * per_token)


def content_key(text: Column, most: int = 400) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(plain(text)), r"(?U)\W+", " ")), 1, most)


def dedup_rows(rows: DataFrame, scope: Sequence[str], text: str, rich: Column, order: str) -> DataFrame:
    """One row a content within scope: the first rich one, else the first, in the place of the first; empty texts go."""
    known = rows.where(plain(F.col(text)) != "").withColumn("_k", content_key(F.col(text)))
    best = Window.partitionBy(*scope, "_k").orderBy(F.when(rich, 0).otherwise(1), order)
    ranked = known.select("*", F.row_number().over(best).alias("_r"), F.min(order).over(Window.partitionBy(*scope, "_k")).alias("slot"))
    return ranked.where(F.col("_r") == 1).drop("_r", "_k")


def ordered_text(rows: DataFrame, group: Sequence[str], order: Sequence[str], text: Column, separator: str, most_rows: int | None = None, most_chars: int | None = None) -> DataFrame:
    """Texts of a group in order as one, of at most so many rows and characters."""
    chosen = rows
    if most_rows is not None:
        chosen = rows.select("*", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("_r")).where(F.col("_r") <= most_rows)
    joined = chosen.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda x: x["_t"]), separator).alias("text"), F.count(F.lit(1)).alias("n_rows"))
    return joined if most_chars is None else joined.withColumn("text", F.substring("text", 1, most_chars))


def roster(hits: DataFrame, fact: str, label: str, day: str, seen: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, fact, labels, day): each fact once, its labels in first-seen order.

    With a group (a query or user) also the position in it: by day with undated last, facts of one day in first-seen order.
    """
    each = hits.groupBy(*group, fact, label).agg(F.min(seen).alias("_s"), F.min(day).alias("_d"))
    facts = each.groupBy(*group, fact).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", label))), lambda x: x[label]).alias("labels"), F.min("_d").alias("day"), F.min("_s").alias("_s"))
    if not group:
        return facts.drop("_s")
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_last("day"), "_s", fact)
    return facts.withColumn("position", F.row_number().over(order)).drop("_s")


def sweep(rows: DataFrame, text: str, objects: Sequence[str], actions: Sequence[str]) -> DataFrame:
    """rows with n_hits and status: stem hits of objects and actions; 'plan' if a sentence with a hit speaks of plans."""
    low = F.lower(plain(F.col(text)))

    def hit(term: str) -> Column:
        stem = term[: max(4, len(term) - 2)] if len(term) > 4 else term
        return low.contains(term) | low.rlike(rf"\b{stem}\w*")

    terms = [*objects, *actions]
    sentences = F.filter(F.split(F.col(text), r"(?<=[.!?\n])\s+"), lambda s: F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(s).contains(t)))
    total = sum((F.when(hit(t), 1).otherwise(0) for t in terms), F.lit(0))
    return rows.select("*", total.alias("n_hits"), F.when(F.exists(sentences, lambda s: s.rlike(ADVICE)), "plan").otherwise("actual").alias("status"))


def value_board(rows: DataFrame, group: Sequence[str], value: str, time: str, hits: Column, most: int = 8) -> DataFrame:
    """The latest and best values of a group: by time and score, at most so many."""
    order = Window.partitionBy(*group).orderBy(F.desc(time), F.desc("score"), F.desc(value))
    return rows.select("*", hits.alias("score")).select("*", F.row_number().over(order).alias("position")).where(F.col("position") <= most)


# What plans a board and a sweep are made for.
BOARD_SHAPES = ("single_slot_current_value", "current_value", "historical_value")
BOARD_INTENTS = ("current", "latest")
SWEEP_SHAPES = ("enumeration", "aggregate_sum", "sum")


def _sure(plan: Column, least: float) -> Column:
    return F.coalesce(plan["confidence"].cast("string").try_cast("double"), F.lit(0.0)) >= least


def _said(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def board_is_due(plan: Column, least: float = 0.55) -> Column:
    """Whether a plan (confidence, answer_shape, temporal_intent, metric, value_type) asks for a value board."""
    shape = F.coalesce(plan["answer_shape"].isin(*BOARD_SHAPES) & plan["temporal_intent"].isin(*BOARD_INTENTS), F.lit(False))
    return _sure(plan, least) & shape & _said(plan["metric"]) & _said(plan["value_type"])


def sweep_is_due(plan: Column, least: float = 0.55) -> Column:
    """Whether a plan (confidence, answer_shape, requires_sweep, object_type, actions array) asks for a sweep."""
    wanted = F.coalesce(plan["requires_sweep"] & plan["answer_shape"].isin(*SWEEP_SHAPES), F.lit(False))
    return wanted & _sure(plan, least) & (_said(plan["object_type"]) | (F.coalesce(F.size(plan["actions"]), F.lit(0)) > 0))

"""Planner traces: repeated calls, stalls, abstention, owed capabilities, tool order, first-seen ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def call_counters(calls: DataFrame) -> DataFrame:
    """calls (question_id, step, signature, returned_rows, new_evidence) with is_duplicate, n_duplicates, n_empty and barren_run."""
    past = Window.partitionBy("question_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("question_id", "signature").orderBy("step")
    known = calls.select("*", (F.row_number().over(same) > 1).alias("is_duplicate"))
    # A run of steps without new evidence starts anew after each step that brought some.
    known = known.select("*", F.sum(F.when(F.col("new_evidence") > 0, 1).otherwise(0)).over(past).alias("_island"))
    run = Window.partitionBy("question_id", "_island").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return known.select(
        "*", F.sum(F.col("is_duplicate").cast("int")).over(past).alias("n_duplicates"), F.sum(F.when(F.col("returned_rows") == 0, 1).otherwise(0)).over(past).alias("n_empty"),
        F.sum(F.when(F.col("new_evidence") == 0, 1).otherwise(0)).over(run).alias("barren_run"),
    ).drop("_island")


def stall_verdicts(calls: DataFrame, duplicates: int = 1, empty: int = 3, barren: int = 2) -> DataFrame:
    """(question_id, step, verdict): the first step at which a question's planner stalls, and why."""
    verdict = F.when(F.col("n_duplicates") >= duplicates, "duplicate_call").when(F.col("n_empty") >= empty, "empty_results").when(F.col("barren_run") >= barren, "no_new_evidence")
    tripped = call_counters(calls).select("question_id", "step", verdict.alias("verdict")).where(F.col("verdict").isNotNull())
    return tripped.groupBy("question_id").agg(F.min_by(F.struct("step", "verdict"), "step").alias("_v")).select("question_id", "_v.step", "_v.verdict")


def may_abstain(calls: DataFrame) -> DataFrame:
    """(question_id, allowed): a question may be given up only after a retrieval that worked and found nothing."""
    return calls.groupBy("question_id").agg(F.bool_or(F.col("success") & (F.col("returned_rows") == 0)).alias("allowed"))


def owed(required: Column, seen: Column, most: int = 8) -> Column:
    """What is required and has not been seen, sorted, at most so many."""
    return F.slice(F.array_sort(F.array_except(required, seen)), 1, most)


def tool_errors(calls: DataFrame, needs: Mapping[str, Sequence[str]]) -> DataFrame:
    """calls with missing: the tools that a call's tool needs before it and that the question has not used."""
    before = Window.partitionBy("question_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    table = F.create_map(*(x for k, v in needs.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if needs else F.create_map().cast("map<string,array<string>>")
    return calls.select("*", F.array_except(F.coalesce(F.try_element_at(table, F.col("tool")), F.array().cast("array<string>")), F.collect_set("tool").over(before)).alias("missing"))


def finalization_errors(decisions: DataFrame) -> DataFrame:
    """decisions with errors: what keeps a final answer from being accepted.

    decisions (question_id, owed array, cited array, known array, is_sufficient, open_questions,
    open_conflicts, claims_absence, searched_empty).
    """
    checks = (
        (F.size("owed") > 0, "capability_debt"), (F.size(F.array_except("cited", "known")) > 0, "unknown_evidence"), (~F.col("is_sufficient"), "insufficient"),
        (F.col("open_questions") > 0, "open_questions"), (F.col("open_conflicts") > 0, "open_conflicts"), (F.col("claims_absence") & ~F.col("searched_empty"), "absence_not_searched"),
    )
    return decisions.select("*", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks))).alias("errors"))


def first_seen(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, key, ordinal, alias): each id with its place of first touch and a short name."""
    once = rows.groupBy(group, key).agg(F.min(order).alias("_o"))
    ordinal = F.row_number().over(Window.partitionBy(group).orderBy("_o", key))
    return once.select(group, key, ordinal.alias("ordinal"), F.concat(F.lit("e"), ordinal.cast("string")).alias("alias"))


def delivery(rows: DataFrame, group: str, key: str, step: str, hot: int, warm: int) -> DataFrame:
    """(group, key, state): evidence seen in the last steps is hot, then warm, then folded."""
    last = rows.groupBy(group).agg(F.max(step).alias("_now"))
    seen = rows.groupBy(group, key).agg(F.max(step).alias("_at")).join(last, group)
    age = F.col("_now") - F.col("_at")
    return seen.select(group, key, F.when(age < hot, "hot").when(age < warm, "warm").otherwise("folded").alias("state"))

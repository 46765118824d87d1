"""Versions of facts: currency, supersession, contradiction, duplicates, expiry.

Every operator takes the time it speaks about as a parameter and no clock. Slots are
(user, predicate) groups; an order ends in an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of facts whose validity can run out.
EXPIRING_KINDS = ("state", "preference", "profile")


def supersede(facts: DataFrame, slot: Sequence[str], order: Sequence[str], key: str = "fact_id", start: str = "valid_from") -> DataFrame:
    """facts with valid_until, superseded_by and status: the next version in a slot closes the one before."""
    w = Window.partitionBy(*slot).orderBy(*order)
    nxt = F.lead(key).over(w)
    return facts.select("*", F.lead(start).over(w).alias("valid_until"), nxt.alias("superseded_by"), F.when(nxt.isNull(), "active").otherwise("superseded").alias("status"))


def current_at(versions: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """The versions that hold at a time: from their start, up to but not at their end."""
    return versions.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def as_of(facts: DataFrame, at: Column, slot: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The value of each slot at a time, without building chains: the greatest version not after it."""
    rest = [c for c in facts.columns if c not in slot]
    held = facts.where(F.col(order[0]) <= at).groupBy(*slot).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return held.select(*slot, "_v.*")


def contradict(facts: DataFrame, slot: Sequence[str], is_correction: Column, seq: str = "seq", key: str = "fact_id") -> DataFrame:
    """facts with contradicted_by: the first later correction in the slot."""
    w = Window.partitionBy(*slot).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    return facts.select("*", F.first(F.when(is_correction, F.col(key)), ignorenulls=True).over(w).alias("contradicted_by"))


def merge_duplicates(facts: DataFrame, signature: Sequence[str], seq: str = "seq", key: str = "fact_id", sets: Sequence[str] = (), largest: Sequence[str] = ()) -> DataFrame:
    """One row a signature: the first fact's id, how many merged, their ids in order, unions of sets and maxima."""
    return facts.groupBy(*signature).agg(
        F.min_by(key, seq).alias(key), F.count(F.lit(1)).alias("n_merged"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(key).alias("k")))), lambda x: x["k"]).alias("merged_ids"),
        *(F.array_sort(F.array_distinct(F.collect_list(c))).alias(c) for c in sets), *(F.max(c).alias(c) for c in largest),
    )


def expire(facts: DataFrame, at: Column, kind: Column, until: str = "valid_until", status: str = "status") -> DataFrame:
    """Active facts of an expiring kind whose validity has run out become stale."""
    out = (F.col(status) == "active") & kind.isin(*EXPIRING_KINDS) & (F.col(until) < at)
    return facts.withColumn(status, F.when(out, "stale").otherwise(F.col(status)))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """A snapshot with new over old by key; columns in keep stay as they were first written.

    new may hold a key several times: its row with the greatest seq counts.
    """
    both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, *keep, "_new")]
    at = F.struct("_new", seq)
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_r"), *(F.min_by(c, at).alias(c) for c in keep)).select(*key, *(F.col(c) if c in keep else F.col(f"_r.{c}").alias(c) for c in old.columns if c not in key))


def confidence(traced: Column, exact: Column, complete: Column, explicit: Column, alignment: Column, timed: Column, measured: Column, own: Column) -> Column:
    """The system's confidence in a fact: a weighted sum, held between .05 and .98."""
    # The weights.
    flag = lambda c, yes, no=0.0: F.when(c, yes).otherwise(no)
    total = flag(traced, 0.30) + flag(exact, 0.20, 0.08) + 0.20 * complete + 0.15 * flag(explicit, 1.0, 0.65) + 0.10 * alignment + flag(timed, 0.03) + flag(measured, 0.02) + F.when(own.isNotNull(), 0.05 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), own))).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.98), total))

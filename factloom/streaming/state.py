"""Streams of facts: windows of time, dirty counters, and heads of slots out of order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ledger import Ledger


def dirty_counters(facts: DataFrame, entity: str) -> DataFrame:
    """(entity, n_new, first, last) of a stream of facts, to be drained by ``foreachBatch`` (update mode)."""
    return facts.groupBy(entity).agg(F.count(F.lit(1)).alias("n_new"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))


def idempotent(facts: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, however often a source sends it again within the delay."""
    return facts.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, size: str, slide: str | None, delay: str, keys: list[str]) -> DataFrame:
    """Counts and sums over tumbling or sliding windows with late rows up to the delay."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(span, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def closings(rows: DataFrame, heads: DataFrame, slot: list[str]) -> DataFrame:
    """(slot, loser, winner, valid_until) of the facts of a batch, which arrive in the order of their keys after the heads of their slots.

    rows and heads (slot, valid_from, fact_id). What is under a slot's head is closed by it; the others close each other
    and the head in a row. Equal keys are one fact.
    """
    marked = [df.select(*slot, F.struct("valid_from", "fact_id").alias("_k"), F.lit(old).alias("_old")) for df, old in ((heads, True), (rows, False))]
    whole = Window.partitionBy(*slot)
    order = whole.orderBy("_k", F.desc("_old"))
    # One sort gives both: the head among all rows of the slot, and the row before.
    seen = marked[0].unionByName(marked[1]).select("*", F.lag("_k").over(order).alias("_before"), F.max(F.when(F.col("_old"), F.col("_k"))).over(whole).alias("_head"))
    closed = lambda loser, winner: F.struct(loser["fact_id"].alias("loser"), winner["fact_id"].alias("winner"), winner["valid_from"].alias("valid_until"))
    k, before, head = F.col("_k"), F.col("_before"), F.col("_head")
    pair = F.when(k < head, closed(k, head)).when(before.isNotNull() & (k > before), closed(before, k))
    return seen.where(~F.col("_old")).select(*slot, pair.alias("_p")).where(F.col("_p").isNotNull()).select(*slot, "_p.loser", "_p.winner", "_p.valid_until")


def superseding(closed: Ledger, heads: Ledger, slot: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: closings of facts as they arrive, in any order, go to ``closed`` as (slot, loser, winner, valid_until).

    The state of a slot is its head (the greatest valid_from and id so far); ``heads`` has them as of each batch, of which the last
    two stay. A greater fact closes the head, a lesser one is closed on arrival by the head. Late facts are compared by key, so
    none is dropped by a watermark. A batch that comes again starts from the heads of the one before, so it writes the same.
    """

    def put(rows: DataFrame, batch: int) -> None:
        given = rows.select(*slot, "valid_from", "fact_id")
        now = heads.batch(batch - 1, given) if batch else given.where("false")
        greatest = given.unionByName(now).groupBy(*slot).agg(F.max(F.struct("valid_from", "fact_id")).alias("_k"))
        heads.write(greatest.select(*slot, "_k.valid_from", "_k.fact_id"), batch)
        closed.write(closings(given, now, slot), batch)
        heads.forget(batch - 2)

    return put

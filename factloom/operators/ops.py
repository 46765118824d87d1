"""Statistics of operation: latencies, tails, feeds, counts and paired runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Which change a trace action is.
CHANGES = {
    "extract": "memory_add", "delete": "memory_delete", "supersede": "memory_supersede", "supersede_observed": "memory_supersede",
    "contradict": "memory_supersede", "contradict_observed": "memory_supersede", "duplicate_merge": "memory_supersede",
    "same_event_extend": "memory_supersede",
}


def tail(rows: DataFrame, group: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The first rows of each group in an order that puts the newest first."""
    return rows.select("*", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("position")).where(F.col("position") <= keep)


def latency(samples: DataFrame, route: str, value: str, seq: str, last: int = 1024) -> DataFrame:
    """Nearest-rank percentiles of the last samples of each route."""
    recent = tail(samples, [route], [F.desc(seq)], last)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return recent.groupBy(route).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("most"))


def feed(traces: DataFrame, action: str) -> DataFrame:
    """traces with their change; bookkeeping rows go."""
    table = F.create_map(*(F.lit(x) for pair in CHANGES.items() for x in pair))
    return traces.select("*", F.try_element_at(table, F.col(action)).alias("change")).where(F.col("change").isNotNull())


def mcnemar(anchor: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """(n, b, c, p): exact two-sided test of paired labels; p is null without discordant pairs."""
    pairs = anchor.select(key, F.col("label").alias("x")).join(run.select(key, F.col("label").alias("y")), key)
    counts = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    # log C(n, i) - n log 2, added up from i = 0: no overflow at any n.
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.struct((-n * F.log(F.lit(2.0))).alias("l"), F.exp(-n * F.log(F.lit(2.0))).alias("s")),
                       lambda a, i: F.struct((a["l"] + F.log((n - i + 1) / i)).alias("l"), (a["s"] + F.when(i <= k, F.exp(a["l"] + F.log((n - i + 1) / i))).otherwise(0.0)).alias("s")))
    return counts.select("n", "b", "c", F.when(n > 0, F.least(F.lit(1.0), 2 * logs["s"])).alias("p"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def usage(rows: DataFrame, group: Sequence[str], numbers: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """Numbers added and names collected, by group."""
    return rows.groupBy(*group).agg(*(F.sum(c).alias(c) for c in numbers), *(F.array_sort(F.collect_set(c)).alias(c) for c in sets))


def run_summary(results: DataFrame, key: str, line: str, correct: str, category: str) -> DataFrame:
    """(category, n_correct, n_answered, accuracy): the last line of each key counts, null verdicts are errors."""
    last = results.groupBy(key).agg(F.max_by(F.struct(correct, category), line).alias("_r")).select(f"_r.{correct}", f"_r.{category}")
    return last.groupBy(category).agg(F.count_if(F.col(correct)).alias("n_correct"), F.count(correct).alias("n_answered"), F.round(F.avg(F.col(correct).cast("int")), 4).alias("accuracy"))

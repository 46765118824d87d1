"""Filters, look-ups and paging over evidence rows."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def narrow(rows: DataFrame, scope: DataFrame, wanted: Mapping[str, str], keys: Sequence[str] = ("user_id", "session_id")) -> DataFrame:
    """Rows whose session's scope has, for each wanted key, no stamp or that stamp.

    A row without a scope row is kept. The scope table is left to the planner: it is
    broadcast only where its measured size allows.
    """
    joined = rows.join(scope.select(*keys, *(F.col(c).alias(f"_scope_{c}") for c in wanted)), list(keys), "left")
    for c, value in wanted.items():
        stamp = F.coalesce(f"_scope_{c}", F.lit(""))
        joined = joined.where((stamp == "") | (stamp == value))
    return joined.drop(*(f"_scope_{c}" for c in wanted))


@dataclass
class Refinement:
    """equal: any of the values. least: at least. occurred: (low, high), rows without the time go;
    valid_from / valid_to: rows without the time stay. include: all terms; exclude: none."""

    equal: Mapping[str, Sequence] = field(default_factory=dict)
    least: Mapping[str, float] = field(default_factory=dict)
    occurred: Mapping[str, tuple] = field(default_factory=dict)
    valid_from: Mapping[str, Column] = field(default_factory=dict)
    valid_to: Mapping[str, Column] = field(default_factory=dict)
    include: Mapping[str, Sequence[str]] = field(default_factory=dict)
    exclude: Mapping[str, Sequence[str]] = field(default_factory=dict)


def refine(rows: DataFrame, wanted: Refinement) -> DataFrame:
    """One conjunction of all conditions, so that what can be pushed to the scan is."""
    has = lambda c, t: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(t.lower())
    conditions = [
        *(F.col(c).isin(*v) for c, v in wanted.equal.items()),
        *(F.col(c) >= v for c, v in wanted.least.items()),
        *(F.col(c).between(*v) for c, v in wanted.occurred.items()),
        *(F.col(c).isNull() | (F.col(c) >= v) for c, v in wanted.valid_from.items()),
        *(F.col(c).isNull() | (F.col(c) <= v) for c, v in wanted.valid_to.items()),
        *(has(c, t) for c, terms in wanted.include.items() for t in terms),
        *(~has(c, t) for c, terms in wanted.exclude.items() for t in terms),
    ]
    for condition in conditions:
        rows = rows.where(condition)
    return rows


def boundary(value: object, upper: bool = False) -> float:
    """Epoch seconds of a time limit; a bare date as an upper limit covers its whole day."""
    if isinstance(value, bool) or value is None or value == "":
        raise ValueError(f"not a time: {value!r}")
    if isinstance(value, (int, float)) or re.fullmatch(r"-?\d+(\.\d+)?(e\d+)?", str(value).strip(), re.I) and not re.fullmatch(r"\d{4}", str(value).strip()):
        seconds = float(value)  # type: ignore[arg-type]
        if not math.isfinite(seconds):
            raise ValueError(f"not a finite time: {value!r}")
        return seconds
    text = str(value).strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        start = datetime.fromisoformat(text).replace(tzinfo=UTC)
        return (start + timedelta(days=1) - timedelta(microseconds=1) if upper else start).timestamp()
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp()


def window(rows: DataFrame, time: str, low: float | None, high: float | None) -> DataFrame:
    """Rows within the limits; rows without a time always stay."""
    if low is not None and high is not None and low > high:
        raise ValueError("the window ends before it starts")
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(time) >= low)
    if high is not None:
        inside = inside & (F.col(time) <= high)
    return rows.where(F.col(time).isNull() | inside)


def multi_get(rows: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """rows with these ids, with pos, the place of the id among those asked for; misses are left out."""
    asked = rows.sparkSession.createDataFrame([(list(ids),)], f"ids array<{rows.schema[key].dataType.simpleString()}>").select(F.posexplode("ids").alias("pos", key))
    return rows.join(asked, key)


def page(rows: DataFrame, group: Sequence[str], order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """A page of each group with its position and the group's total."""
    counted = rows.select("*", F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("total"), F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("position"))
    return counted.where(F.col("position").between(offset + 1, offset + size))


def date_difference(start: Column, end: Column) -> Column:
    """Struct of days, abs_days, weeks, months_approx, years_approx and direction."""
    days = F.datediff(end, start).cast("long")
    return F.struct(days.alias("days"), F.abs(days).alias("abs_days"), F.round(days / 7, 2).alias("weeks"), F.round(days / 30.4375, 2).alias("months_approx"), F.round(days / 365.25, 2).alias("years_approx"), F.when(days >= 0, "after").otherwise("before").alias("direction"))


def strip_evidence_prefix(value: Column) -> Column:
    """The id behind ev_...: prefixes: what follows the last colon."""
    return F.element_at(F.split(F.regexp_replace(value, r"^ev_[a-z_]+:", ""), ":"), -1)


def lookup(key: Column, tables: Sequence[tuple[str, DataFrame, str]], asked: DataFrame) -> DataFrame:
    """(id, kind, row as JSON) of asked ids in the first table that has them, else kind not_found. A key column that starts with _ is no part of the row."""
    parts = None
    for priority, (kind, df, column) in enumerate(tables):
        hit = asked.join(df, asked["id"] == df[column]).select(asked["id"], F.lit(priority).alias("p"), F.lit(kind).alias("kind"), F.to_json(F.struct(*(df[c] for c in df.columns if c != column or not column.startswith("_")))).alias("row"))
        parts = hit if parts is None else parts.unionByName(hit)
    best = parts.groupBy("id").agg(F.min(F.struct("p", "kind", "row")).alias("_b"))
    return asked.join(best, "id", "left").select("id", F.coalesce("_b.kind", F.lit("not_found")).alias("kind"), F.col("_b.row").alias("row"))

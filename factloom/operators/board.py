"""Boards of a slot's current value: candidates from evidence, their order, and whether the first one may stand for the rest.

Plans and evidence meet by query in one join; candidates of a query are ordered and judged in
one shuffle by query. What a unit may count for and what speaks against narrowing are tables
that are compiled into one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantities import WORDS
from ..functions.text import excerpt, plain, query_terms

# Wording that asks for older values, speaks of changes, of sums and of places; how
# ranges and times of day are written; the numbers that ranges have as words.
HISTORY = r"(?iU)\b(previous|former|formerly|used to|earlier|before |prior|originally|initial(?:ly)?|at first|old|last time|history|past)\b"
DELTA = r"(?iU)\b(new\s+followers?|additional|gained|growth|increase|delta|last\s+\w+\s+weeks?)\b"
AGGREGATE = r"(?iU)\b(total|sum|combined|altogether|overall|all|in\s+total|plus|together|completed\s+.*courses?|course[s]?\s+.*completed|donations?|expenses?)\b"
STATE = r"(?iU)\b(where|location|stored?|keep|kept|put|place)\b"
TIME = r"(?iU)\b(\d{1,2}:\d{2})\s*(am|pm)?\b"
_WORD = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
RANGE = rf"(?iU)\b(?:(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)|({_WORD})\s*[-–]\s*({_WORD}))\s+(hours?|minutes?|days?|weeks?)\b"
DELTA_PREDICATES = ("growth", "engagement", "likes", "comments")
TOTAL_PREDICATES = ("count", "total", "nearing")
VALUE_TYPES = ("money", "count", "time", "duration")
# The units that a type of value admits, and the ending of others.
UNIT_FAMILIES = {
    "money": (("", "money"), None),
    "count": (("", "count", "item_count"), "_count"),
    "duration": (("", "duration", "hours", "minutes", "days", "weeks", "months", "years"), None),
    "time": (("", "time"), None),
}
CURRENT_SHAPES = ("single_slot_current_value", "current_value")
CURRENT_INTENTS = ("current", "latest")
SAFE = "single_slot_current_value"


def admits(value_type: Column, unit: Column) -> Column:
    """Whether a stated unit may be a value of the type; a type without a family admits all."""
    rule = F.lit(None).cast("boolean")
    for kind, (units, ending) in UNIT_FAMILIES.items():
        fits = unit.isin(*units)
        rule = F.when(value_type == kind, fits if ending is None else fits | unit.endswith(ending)).otherwise(rule)
    return F.coalesce(rule, F.lit(True))


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def stated(text: Column, value_type: Column) -> Column:
    """Struct (value, unit) that a text states without a quantity: a time of day, or for counts and durations a range; null without one."""
    part = lambda pattern, k: F.regexp_extract(plain(text), pattern, k)
    suffix = F.lower(part(TIME, 2))
    clock = F.struct(F.concat(part(TIME, 1), F.when(suffix != "", F.concat(F.lit(" "), suffix)).otherwise("")).alias("value"), F.lit("time").alias("unit"))
    names = F.create_map(*(F.lit(x) for w in _WORD.split("|") for x in (w, str(WORDS[w]))))
    end = lambda figure, word: F.when(part(RANGE, figure) != "", part(RANGE, figure)).otherwise(F.try_element_at(names, F.lower(part(RANGE, word))))
    span = F.struct(F.concat(end(1, 3), F.lit("-"), end(2, 4)).alias("value"), F.lower(part(RANGE, 5)).alias("unit"))
    return F.when((value_type == "time") & (part(TIME, 1) != ""), clock).when(value_type.isin("duration", "count") & (part(RANGE, 5) != ""), span)


def candidates(plans: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, evidence_id, place, value, unit, time, predicate, support, score): evidence that may hold a plan's value.

    plans (query_id, metric, entities array, value_type, total_vs_delta). rows (query_id,
    evidence_id, place, text, predicate_canonical, predicate_raw, entity_roles, quantity_value,
    quantity_unit, modality, time string), where place is the reader's order. A row counts if it
    states a value that the type admits and, where the plan names a metric or entities, one of
    each; plans that name neither have no board. Plans for the future and, where a total is
    asked, changes do not count. Nulls are empty.
    """
    terms = plans.select(
        "query_id", query_terms(F.col("metric")).alias("_metric"),
        F.array_distinct(F.flatten(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: query_terms(excerpt(e, 80))))).alias("_entities"),
        F.lower(F.coalesce(F.nullif("value_type", F.lit("")), F.lit("unknown"))).alias("_type"), (F.lower(plain(F.col("total_vs_delta"))) == "total").alias("_total"),
    ).where((F.size("_metric") > 0) | (F.size("_entities") > 0))
    joined = rows.where(~F.coalesce(F.col("modality") == "external_info", F.lit(False))).join(terms, "query_id")
    text, unit = plain(F.col("text")), plain(F.col("quantity_unit"))
    figure = F.when(admits(F.col("_type"), unit), F.struct(F.col("quantity_value").cast("string").alias("value"), F.when(unit != "", unit).otherwise(F.col("_type")).alias("unit")))
    found = joined.withColumn("_v", F.when(F.col("quantity_value").isNotNull(), figure).otherwise(stated(text, F.col("_type")))).where("_v IS NOT NULL")
    hay = F.lower(F.concat_ws(" ", text, plain(F.col("predicate_canonical")), plain(F.col("predicate_raw")), plain(F.col("entity_roles"))))
    placed = found.withColumns({"_hay": hay, "_p": F.lower(plain(F.col("predicate_canonical")))})
    hits = lambda terms: F.size(F.filter(F.col(terms), lambda t: F.col("_hay").contains(t)))
    counted = placed.withColumns({"_m": hits("_metric"), "_e": hits("_entities")}).where("(size(_metric) = 0 OR _m > 0) AND (size(_entities) = 0 OR _e > 0)")
    p, one = F.col("_p"), lambda c, n: F.when(c, n).otherwise(0)
    future = p.startswith("plan_") | p.contains("future")
    delta = F.col("_hay").rlike(DELTA) | _any(p, DELTA_PREDICATES)
    score = F.col("_m") * 2 + F.col("_e") + one(F.exists("_metric", lambda t: p.contains(t)), 2)
    score = score + one(F.col("_total") & _any(p, TOTAL_PREDICATES), 1) + one(F.col("_total") & (p.contains("nearing") | F.col("_hay").contains("close to")), 2)
    scored = counted.withColumn("score", F.when(future | (F.col("_total") & delta), 0).otherwise(score)).where("score > 0")
    named = F.coalesce(F.nullif("predicate_canonical", F.lit("")), plain(F.col("predicate_raw")))
    return scored.select("query_id", "evidence_id", "place", "_v.value", "_v.unit", plain(F.col("time")).alias("time"), named.alias("predicate"), excerpt(text, 360).alias("support"), F.col("score").cast("long").alias("score"))


def _objections(least: float) -> list[tuple[str, Column]]:
    """What speaks against letting the first candidate stand for the rest, in the order in which it is asked."""
    c = F.col
    said = lambda x: F.coalesce(x != "", F.lit(False))
    kind, change, top = F.lower(plain(c("value_type"))), F.lower(plain(c("total_vs_delta"))), c("_top")
    return [
        ("low_plan_confidence", F.coalesce(c("confidence").cast("string").try_cast("double"), F.lit(0.0)) < least),
        ("history_intent_question", plain(c("question")).rlike(HISTORY)),
        ("not_current_value_shape", ~plain(c("answer_shape")).isin(*CURRENT_SHAPES)),
        ("not_current_or_latest", ~plain(c("temporal_intent")).isin(*CURRENT_INTENTS)),
        ("unsupported_value_type", ~kind.isin(*VALUE_TYPES)),
        ("delta_metric", change == "delta"),
        ("aggregate_scope", plain(c("metric")).rlike(AGGREGATE)),
        ("state_scope", plain(c("metric")).rlike(STATE)),
        ("enumeration_hint_present", said(c("object_type")) | (F.coalesce(F.size("actions"), F.lit(0)) > 0)),
        ("no_competing_values", c("n_candidates") < 2),
        ("top_future_plan", top["predicate"].startswith("plan_") | F.lower(top["predicate"]).contains("future")),
        ("top_delta_for_total", (change == "total") & F.concat_ws(" ", top["predicate"], top["support"]).rlike(DELTA)),
        ("top_time_missing", top["time"] == ""),
        ("no_different_same_unit_value", c("_competing") == 0),
        ("competing_time_missing", c("_timed") == 0),
    ]


def boards(plans: DataFrame, rows: DataFrame, strong: bool = True, most: int = 8, most_strong: int = 4, least: float = 0.75) -> DataFrame:
    """(query_id, value, unit, evidence_id, time, n_candidates, narrowed, reason, kept_ids): one row for each plan with a candidate.

    The latest candidate comes first, of one time the one with the highest score, then the
    reader's order. With strong, reason says what speaks against narrowing (the first of 15
    objections) or is "single_slot_current_value"; then only the first most_strong stay, else the
    first most. plans also has confidence, answer_shape, temporal_intent, object_type, actions
    array and question (see ``candidates`` for the rest).
    """
    by_query = Window.partitionBy("query_id").orderBy(F.desc("time"), F.desc("score"), "place")
    top = F.first(F.struct("value", "unit", "evidence_id", "time", "predicate", "support")).over(by_query)
    ranked = candidates(plans, rows).withColumns({"_top": top, "_r": F.row_number().over(by_query)})
    competes = (F.col("value") != F.col("_top.value")) & (F.col("unit") == F.col("_top.unit"))
    ids = F.array_sort(F.collect_list(F.when(F.col("_r") <= max(most, most_strong), F.struct("_r", "evidence_id"))))
    judged = ranked.groupBy("query_id").agg(
        F.first("_top").alias("_top"), F.count(F.lit(1)).alias("n_candidates"), F.count_if(competes).alias("_competing"), F.count_if(competes & (F.col("time") != "")).alias("_timed"), F.transform(ids, lambda x: x["evidence_id"]).alias("_ids"),
    ).join(plans, "query_id")
    reason = F.coalesce(*(F.when(objection, F.lit(name)) for name, objection in _objections(least)), F.lit(SAFE)) if strong else F.lit(None).cast("string")
    said = judged.withColumn("reason", reason).withColumn("narrowed", F.coalesce(F.col("reason") == SAFE, F.lit(False)))
    return said.select("query_id", "_top.value", "_top.unit", "_top.evidence_id", "_top.time", "n_candidates", "narrowed", "reason", F.slice("_ids", 1, F.when(F.col("narrowed"), most_strong).otherwise(most)).alias("kept_ids"))


def lines(plans: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, text): what a reader is told of each board."""
    head = F.concat_ws(" ", F.col("value"), F.col("unit"))
    slot = F.concat(F.lit("slot: "), excerpt(F.col("metric"), 120), F.lit(", "), F.lower(plain(F.col("value_type"))))
    sure = F.concat(F.lit("resolved value: "), head, F.lit(" (verify against the evidence)"))
    open_ = F.concat(F.lit("candidate value: "), head, F.lit(" (advisory"), F.coalesce(F.concat(F.lit("; not narrowed: "), F.col("reason")), F.lit("")), F.lit(")"))
    rest = F.concat(F.lit("evidence: "), F.array_join("kept_ids", ", "))
    when_ = F.concat(F.lit("time: "), F.when(F.col("time") != "", F.col("time")).otherwise("unknown"))
    return found.join(plans.select("query_id", "metric", "value_type"), "query_id").select("query_id", F.concat_ws("\n", F.when(F.col("narrowed"), sure).otherwise(open_), when_, slot, rest).alias("text"))

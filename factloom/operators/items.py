"""From an extractor's items to facts: source type, dates, intervals, backfill, fallbacks, scopes.

Items are a table of a model's answers (see ``ingest.parse_items``); nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, quantities
from ..functions.text import canonical, canonical_predicate, entity_id, modality, plain, polarity, stable_id, word_tokens
from .facts import confidence
from .maintenance import update_like

# The wording of corrections, guesses, plans and likings.
CORRECTING = ("correction", "correcting", "actually", "rather", "instead", "not .*, but")
HEDGING = ("probably", "maybe", "likely", "might", "seems?", "appears?", "guess", "assume", "infer")
FORWARD = (
    r"scheduled\s+for", r"will\s+(?:be|take|start|happen|open|visit|attend)", "upcoming", r"planning\s+to", r"planned\s+for", r"coming\s+up", r"booked\s+for",
    r"reservation\s+for", r"appointment\s+(?:is\s+)?(?:on|for)", r"due\s+(?:on|in|by)", "rsvp", r"save\s+the\s+date", r"looking\s+forward\s+to", r"next\s+(?:week|month|year)",
)
LIKING = ("prefer", "like", "love", "hate", "enjoy")
FALLBACK_CAP, FALLBACK_CHARS = 0.72, 500


def _says(text: Column, words: tuple[str, ...]) -> Column:
    return plain(text).rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def source_type(text: Column) -> Column:
    """A correction, else a guess, else stated text, by the wording of predicate and support together."""
    return F.when(_says(text, CORRECTING), "user_correction").when(_says(text, HEDGING), "inferred_llm").otherwise("explicit_text")


def direction(given: Column, text: Column) -> Column:
    """Which way a date without direction points: a plan's forward, a past event's back unless its text looks forward."""
    forward = given.isin("future_plan", "intent") | ((given == "past_event") & _says(text, FORWARD))
    return F.when(forward, "future").when(given == "past_event", "past_event").otherwise("past")


def field_date(rows: DataFrame, raw: str, expr: str, anchor: str, session_date: str, prefer: str, text: str, name: str) -> DataFrame:
    """rows with date ``name``: the resolver's where it can read the expression, else the given value.

    "session_date" itself means the session's day, "before session_date" no day at all; without
    expression and value the text is searched for one. Without a session's date the value stays.
    """
    e = F.lower(F.trim(plain(F.col(expr))))
    asked = F.when(e.isin("session_date", "session date"), "today").when(e.isin("before session_date", "before session"), None)
    own = (e != "") & ((plain(F.col(anchor)) == "") | (F.col(anchor) == "session_date"))
    asked = asked.when(own, F.col(expr)).when((plain(F.col(raw)) == "") & (e == ""), F.col(text))
    found = rows.withColumn("_asked", asked)
    resolved = dates.resolve("_asked", session_date, F.col(prefer))
    value = F.nullif(plain(F.col(raw)), F.lit(""))
    return found.withColumn(name, F.when(plain(F.col(session_date)) == "", value).otherwise(F.coalesce(resolved, value))).drop("_asked")


def sane_intervals(facts: DataFrame) -> DataFrame:
    """A validity that ends before it begins stays open; an occurrence that does ends where it starts."""
    return facts.withColumns({
        "valid_until": F.when(F.col("valid_until") < F.col("valid_from"), None).otherwise(F.col("valid_until")),
        "occurred_end": F.when(F.col("occurred_end") < F.col("occurred_start"), F.col("occurred_start")).otherwise(F.col("occurred_end")),
    })


def backfill_time(facts: DataFrame, on: bool = True) -> DataFrame:
    """facts with time_source: those without any time take the time of the statement (preferences do not)."""
    bare = F.lit(on) & (F.col("kind") != "preference") & F.col("occurred_start").isNull() & F.col("valid_from").isNull() & F.col("document_time").isNotNull()
    state = F.col("kind") == "state"
    marked = facts.withColumn("_bare", bare)
    return marked.withColumns({
        "valid_from": F.when(F.col("_bare") & state, F.col("document_time")).otherwise(F.col("valid_from")),
        "occurred_start": F.when(F.col("_bare") & ~state, F.col("document_time")).otherwise(F.col("occurred_start")),
        "time_source": F.when(F.col("_bare"), "inferred_session"),
    }).drop("_bare")


def document_times(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """facts with document_time, the latest session time of their spans, else what they had."""
    placed = facts.select("fact_id", F.explode("span_ids").alias("span_id")).join(spans.select("span_id", "session_time"), "span_id")
    last = placed.groupBy("fact_id").agg(F.max("session_time").alias("_last"))
    known = facts if "document_time" in facts.columns else facts.withColumn("document_time", F.lit(None).cast("double"))
    return known.join(last, "fact_id", "left").withColumn("document_time", F.coalesce("_last", "document_time")).drop("_last")


def fallback_facts(spans: DataFrame, parsed: DataFrame) -> DataFrame:
    """One plain fact for each span with text that gave no item: without dates, of capped confidence."""
    left = spans.where(F.trim(plain(F.col("text"))) != "").join(parsed.select("span_id").distinct(), "span_id", "left_anti")
    likes = (F.col("role") == "user") & _says(F.col("text"), LIKING)
    text = F.substring("text", 1, FALLBACK_CHARS)
    return left.select(
        stable_id("fact", F.col("span_id"), F.lit("fallback")).alias("fact_id"), "user_id", F.array("span_id").alias("span_ids"), text.alias("predicate_raw"), text.alias("support_text"),
        F.lit("message_unit_statement").alias("predicate"), F.lit("other").alias("event_type"), F.when(likes, "preference").otherwise("fact").alias("kind"),
        F.when(likes, "preference").when(F.col("role") == "assistant", "assistant_advice").otherwise("past_event").alias("modality"), F.lit(FALLBACK_CAP).alias("most_confidence"),
    )


def stamp_scope(facts: DataFrame, scope: DataFrame, fields: tuple[str, ...] = ("agent_id", "run_id")) -> DataFrame:
    """facts with the scope of their session as a struct, null where the session has none."""
    held = [c for c in fields if c in scope.columns]
    return facts.join(scope.select("user_id", "session_id", F.struct(*held).alias("scope")), ["user_id", "session_id"], "left")


def user_only(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """facts without those that only the assistant's spans support."""
    placed = facts.select("fact_id", F.explode("span_ids").alias("span_id")).join(spans.select("span_id", "role"), "span_id")
    only = placed.groupBy("fact_id").agg(F.bool_and(F.col("role") == "assistant").alias("_only")).where("_only").select("fact_id")
    return facts.join(only, "fact_id", "left_anti")


def alignment(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items with exact (the span holds the support as it stands) and aligned (the share of the support's words that the span has)."""
    words = lambda c: F.array_distinct(F.filter(word_tokens(F.col(c)), lambda t: F.length(t) > 2))
    held = items.join(spans.select("span_id", F.col("text").alias("_span")), "span_id", "left").withColumns({"_sw": words("support_text"), "_tw": words("_span")})
    share = F.when(F.size("_sw") > 0, F.size(F.array_intersect("_sw", "_tw")) / F.size("_sw")).otherwise(0.0)
    exact = F.coalesce((canonical(F.col("support_text")) != "") & canonical(F.col("_span")).contains(canonical(F.col("support_text"))), F.lit(False))
    return held.withColumns({"exact": exact, "aligned": share}).drop("_span", "_sw", "_tw")


def facts_of_items(items: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Facts from items (item_id, user_id, session_id, span_id, role, session_time, session_date, predicate_raw,
    event_type, kind, modality, subject, support_text, occurred_start, occurred_expr, occurred_anchor, confidence).

    Where items also have quantity_value and quantity_unit, facts have quantity, unit, low, high and grounded; where they have
    objects, object_ids; where they have valid_from or valid_until (dates or partial dates), these times. The steps in
    order: wording (source type, modality, polarity), predicate and subject, quantity, dates, backfill, confidence, and
    whether the fact is update-like. With spans (span_id, text) the confidence measures how the support stands in its span; without, the
    item's word is taken for it.
    """
    has = set(items.columns)
    said = F.concat_ws(" ", "predicate_raw", "support_text")
    worded = (items if spans is None else alignment(items, spans)).select(
        "*", stable_id("fact", F.col("item_id")).alias("fact_id"), F.array("span_id").alias("span_ids"), source_type(said).alias("source_type"),
        modality(F.lower(F.trim(plain(F.col("modality")))), said).alias("_m"), canonical_predicate(F.col("predicate_raw"), F.col("event_type"), F.col("kind")).alias("predicate"),
        entity_id(F.when(plain(F.col("subject")) == "", "user").otherwise(F.col("subject"))).alias("subject_entity_id"),
    ).withColumn("modality", F.col("_m")).drop("_m")
    if "quantity_value" in has:
        stated = worded.withColumns({"quantity": F.col("quantity_value").try_cast("double"), "unit": quantities.unit(F.col("quantity_unit"))})
        stated = stated.withColumns({"_range": quantities.quantity_range(F.col("quantity"), F.col("unit"), F.col("support_text")), "grounded": quantities.grounded(F.col("quantity"), said)})
        worded = stated.withColumns({"low": F.col("_range.low"), "high": F.col("_range.high")}).drop("_range", "quantity_value", "quantity_unit")
    if "objects" in has:
        worded = worded.withColumn("object_ids", F.array_distinct(F.transform(F.filter("objects", lambda o: F.trim(plain(o)) != ""), lambda o: entity_id(o))))
    worded = worded.withColumns({"polarity": polarity(F.concat_ws(" ", "predicate_raw", "predicate", "support_text")), "_prefer": direction(F.col("modality"), said), "_text": said})
    dated = field_date(worded, "occurred_start", "occurred_expr", "occurred_anchor", "session_date", "_prefer", "_text", "occurred_date")
    epoch = lambda c: F.unix_timestamp(F.coalesce(*(F.try_to_timestamp(F.substring(c, 1, n), F.lit(f)) for n, f in ((10, "yyyy-MM-dd"), (7, "yyyy-MM"), (4, "yyyy"))))).cast("double")
    times = {"occurred_start": F.unix_timestamp(F.try_to_timestamp(F.substring("occurred_date", 1, 10), F.lit("yyyy-MM-dd"))).cast("double"), "time_precision": dates.precision(F.col("occurred_date")), "valid_from": epoch("valid_from") if "valid_from" in has else F.lit(None).cast("double"), "document_time": F.col("session_time")}
    if "valid_until" in has:
        times |= {"valid_until": epoch("valid_until"), "occurred_end": times["occurred_start"]}
    timed = dated.withColumns(times)
    filled = backfill_time(sane_intervals(timed) if "valid_until" in has else timed)
    explicit = F.col("source_type") == "explicit_text"
    exact, aligned = (F.lit(True), F.lit(1.0)) if spans is None else (F.col("exact"), F.col("aligned"))
    complete = F.lit(1.0) if not has & {"objects", "quantity_value"} else (F.lit(1.0) + F.col("occurred_date").isNotNull().cast("int") + (F.coalesce(F.size("object_ids"), F.lit(0)) > 0 if "objects" in has else F.lit(False)).cast("int")) / 3
    measured = F.coalesce(F.col("grounded"), F.lit(False)) if "quantity_value" in has else F.lit(False)
    scored = confidence(F.col("span_id").isNotNull(), exact, complete, explicit, aligned, F.col("occurred_date").isNotNull(), measured, F.col("confidence").try_cast("double"))
    return filled.withColumns({"confidence": F.round(scored, 3), "update_like": update_like(F.col("kind"), F.col("modality"), F.col("source_type"), F.col("_text"))}).drop("_prefer", "_text", "occurred_expr", "occurred_anchor")


def extraction_traces(windows: DataFrame, spans: DataFrame, facts: DataFrame, actions: DataFrame) -> DataFrame:
    """(stage, action, status, subject): a row a window, a row a maintenance action, and a row a span with or without a fact."""
    got = facts.select(F.explode("span_ids").alias("span_id")).distinct().withColumn("_got", F.lit(True))
    each = spans.join(got, "span_id", "left").select(F.lit("extract").alias("stage"), F.lit("span").alias("action"), F.when(F.col("_got"), "ok").otherwise("no_fact").alias("status"), F.col("span_id").alias("subject"))
    opened = windows.select(F.lit("extract_window").alias("stage"), F.col("reason").alias("action"), F.lit("ok").alias("status"), F.concat_ws(":", "session_id", F.col("window").cast("string")).alias("subject"))
    return opened.unionByName(actions.select(F.lit("maintain").alias("stage"), "action", F.lit("ok").alias("status"), F.col("fact_id").alias("subject"))).unionByName(each)

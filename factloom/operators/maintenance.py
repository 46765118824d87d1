"""Changes to stored facts, edges and summaries: slots, folds, archives, revisions.

Every operator takes snapshots and requests as tables and returns the changed snapshot (and
the rows it adds); times are parameters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import plain, stable_id

# Predicates and types that name no slot, and roles that bear a version's value.
NO_SLOT = ("", "message_unit_statement")
GENERIC_TYPES = ("", "other")
VALUE_ROLES = ("value", "time", "duration", "count", "quantity", "amount", "number", "score")
# The wording that makes a statement an update.
UPDATE_WORDS = (
    "current", "currently", "now", "still", "actually", "correction", "correcting", "rather", "instead", "personal best", "record",
    "best time", "total", "count", "collection", "own", "have", "has", "live", "living", "located", "based", "moved", "changed",
    "started", "stopped", "in the last", r"last \d+", r"past \d+", "recent", "recently",
)


def update_like(kind: Column, modality: Column, source_type: Column, text: Column) -> Column:
    """Whether a fact may replace an earlier one: corrections, profiles and states do, others by their wording."""
    worded = plain(text).rlike(r"(?i)\b(" + "|".join(UPDATE_WORDS) + r")\b")
    always = (source_type == "user_correction") | (kind == "profile")
    preference = (kind == "preference") | (modality == "preference")
    state = (kind == "state") | (modality == "current_state")
    return F.coalesce(always | F.when(preference, worded).otherwise(state | worded), F.lit(False))


def slot_roles(roles: Column) -> Column:
    """The sorted roles that tell one slot from another."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(roles, F.array().cast("array<string>")), lambda r: ~r.isin("subject", *VALUE_ROLES))))


def materialise_validity(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """facts with valid_from: update-like ones without it are valid from their first span's time."""
    placed = facts.select("fact_id", F.explode("span_ids").alias("span_id")).join(spans.select("span_id", "session_time"), "span_id")
    first = placed.groupBy("fact_id").agg(F.min("session_time").alias("_first"))
    return facts.join(first, "fact_id", "left").withColumn("valid_from", F.coalesce("valid_from", F.when(F.col("update_like"), F.col("_first")))).drop("_first")


def fold(facts: DataFrame) -> DataFrame:
    """(user_id, fact_id, status, valid_until, superseded_by) after ingesting facts one by one, in order of seq.

    facts (user_id, fact_id, seq, predicate, event_type, kind, unit, roles array, valid_from,
    document_time, quantity, low, high, role, update_like and, where known, occurred_start and
    support). Two facts share a slot by their
    predicate (never by one that names no slot) or by their type and equal roles; units have
    to agree, roles too where both have some; profiles go by the predicate alone. Of two, the
    greater key wins, the earlier one of equal keys, if the newcomer is update-like, or has
    a quantity and the other one is; the assistant never beats the user, and a point in a range
    is no conflict. The key (``order_key``) is made once, for windows and fold alike.

    Slots in which no such exception can occur (most) are windows; only the others are
    folded in Python, one (user, predicate) at a time, or one user where slots cross predicates.
    """
    f = order_key(facts).select("*", slot_roles(F.col("roles")).alias("_roles"), (~F.col("predicate").isin(*NO_SLOT) & F.col("predicate").isNotNull()).alias("_open"))
    typed = F.col("_open") & (F.col("kind") != "profile") & ~F.col("event_type").isin(*GENERIC_TYPES) & (F.size("_roles") > 0)
    tag = F.array_join("_roles", "|")
    by_type = Window.partitionBy("user_id", F.when(typed, F.col("event_type")), F.when(typed, tag), F.when(typed, F.col("unit")))
    f = f.withColumn("_crossed", typed & (F.min("predicate").over(by_type) != F.max("predicate").over(by_type)))
    slot = Window.partitionBy("user_id", "predicate")
    same = lambda c: F.min(c).over(slot).eqNullSafe(F.max(c).over(slot))
    kinds = F.when(F.col("kind") == "profile", "profile").otherwise("other")
    told = F.when(F.size("_roles") > 0, tag)
    plain_slot = same(F.coalesce("unit", F.lit(""))) & same(told) & same(F.coalesce("role", F.lit(""))) & same(kinds) & F.min("update_like").over(slot) & F.max("low").over(slot).isNull()
    f = f.select("*", plain_slot.alias("_plain"), F.max("_crossed").over(slot).alias("_cross"))
    closed = f.where(~F.col("_open")).select("user_id", "fact_id", F.lit("active").alias("status"), F.lit(None).cast("double").alias("valid_until"), F.lit(None).cast("string").alias("superseded_by"))
    simple = _fold_windows(f.where(F.col("_open") & F.col("_plain") & ~F.col("_cross")))
    rest = f.where(F.col("_open") & (~F.col("_plain") | F.col("_cross"))).withColumn("_group", F.when(F.col("_cross"), "").otherwise(F.col("predicate")))
    folded = rest.drop("_open", "_plain", "_cross", "_crossed", "roles", "support").groupBy("user_id", "_group").applyInPandas(_fold_group, "user_id string, fact_id string, status string, valid_until double, superseded_by string")
    return closed.unionByName(simple).unionByName(folded)


def order_key(facts: DataFrame) -> DataFrame:
    """facts with what decides between two of a slot: _time, _said and _content, in this order, and with _closes, the end it gives a loser.

    The time is valid_from, where that is null or 0 occurred_start, else 0; then comes when it was said; then a hash of predicate,
    quantity and support, so that no id decides, which a second ingest would make anew.
    """
    column = lambda name, kind: F.col(name).cast(kind) if name in facts.columns else F.lit(None).cast(kind)
    start = F.coalesce(F.nullif(F.nanvl(column("valid_from", "double"), F.lit(None)), F.lit(0.0)), F.nanvl(column("occurred_start", "double"), F.lit(None)))
    content = stable_id("sig", plain(F.col("predicate")), F.coalesce(column("quantity", "string"), F.lit("None")), plain(column("support", "string")))
    return facts.select("*", F.coalesce(start, F.lit(0.0)).alias("_time"), F.coalesce(F.nanvl(column("document_time", "double"), F.lit(None)), F.lit(0.0)).alias("_said"), content.alias("_content"), start.alias("_closes"))


def _fold_windows(f: DataFrame) -> DataFrame:
    """The fold of slots in which the greatest key so far is always the active fact."""
    key = F.struct("_time", "_said", "_content")
    # Of equal keys the first stays in the lead.
    lead = F.struct("_time", "_said", "_content", (-F.col("seq")).alias("_first"), "fact_id", "_closes")
    before = Window.partitionBy("user_id", "predicate").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranked = f.select("user_id", "predicate", "seq", "fact_id", "_closes", key.alias("_key"), F.max(lead).over(before).alias("_top"))
    top = F.struct("_top._time", "_top._said", "_top._content")
    ranked = ranked.withColumn("_leads", F.col("_top").isNull() | (top < F.col("_key")))
    # Facts that take the lead close each other in order of arrival; any other is closed on arrival.
    after = Window.partitionBy("user_id", "predicate", "_leads").orderBy("seq")
    nxt = F.lead(F.struct("fact_id", "_closes")).over(after)
    closer = F.when(F.col("_leads"), nxt).otherwise(F.struct("_top.fact_id", "_top._closes"))
    out = ranked.withColumn("_c", closer)
    return out.select("user_id", "fact_id", F.when(F.col("_c").isNull(), "active").otherwise("superseded").alias("status"), F.col("_c._closes").alias("valid_until"), F.col("_c.fact_id").alias("superseded_by"))


def _competes(old: dict, new: dict) -> bool:
    same = old["predicate"] == new["predicate"]
    if "profile" in (old["kind"], new["kind"]):
        if not same:
            return False
    else:
        a, b = tuple(old["_roles"]), tuple(new["_roles"])
        if (old["unit"] or "") != (new["unit"] or "") or (a and b and a != b):
            return False
        if not same and not (old["event_type"] == new["event_type"] and new["event_type"] not in (None, *GENERIC_TYPES) and a and a == b):
            return False
    if not (new["update_like"] or (pd.notna(new["quantity"]) and old["update_like"])):
        return False
    for a, b in ((old, new), (new, old)):
        if pd.notna(a["low"]) and pd.isna(b["low"]) and pd.notna(b["quantity"]) and a["low"] <= b["quantity"] <= a["high"]:
            return False
    return True


def _fold_group(group: pd.DataFrame) -> pd.DataFrame:
    done: list[dict] = []
    active: list[dict] = []  # the only ones that can still compete
    for new in group.sort_values("seq").to_dict("records"):
        new |= {"status": "active", "valid_until": None, "superseded_by": None}
        key, best, beaten = (new["_time"], new["_said"], new["_content"]), None, []
        for old in active:
            if not _competes(old, new):
                continue
            rank = (old["_time"], old["_said"], old["_content"])
            winner, loser = (old, new) if rank >= key else (new, old)
            if winner["role"] == "assistant" and loser["role"] == "user":
                continue
            if loser is old:
                old |= {"status": "superseded", "valid_until": new["_closes"], "superseded_by": new["fact_id"]}
                beaten.append(old)
            elif best is None or rank > best[0]:
                best = (rank, old)
        if beaten:
            active = [f for f in active if f["status"] == "active"]
        if best:
            new |= {"status": "superseded", "valid_until": best[1]["_closes"], "superseded_by": best[1]["fact_id"]}
        else:
            active.append(new)
        done.append(new)
    columns = ["user_id", "fact_id", "status", "valid_until", "superseded_by"]
    return pd.DataFrame([[f[c] for c in columns] for f in done], columns=columns)


EVENT = ("user_id", "event_type", "predicate", "modality", "day")


def same_event(facts: DataFrame) -> DataFrame:
    """facts with event_id: the first fact of the same event, itself if it is the first.

    facts (user_id, event_type, predicate, modality, day, kind, objects array, seq, fact_id).
    Events are the same if they agree in user, type, predicate, modality and day and share an
    object with what has been merged so far; facts of other kinds stay alone. Where all facts
    of a day name at most one object a window does; only the other days are folded.
    """
    f = facts.select("*", F.when(F.col("kind") == "event", F.array_distinct(F.coalesce("objects", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")).alias("_objects"))
    many = F.max(F.size("_objects")).over(Window.partitionBy(*EVENT)) > 1
    f = f.withColumn("_many", many)
    one = f.where(~F.col("_many"))
    first = Window.partitionBy(*EVENT, F.get("_objects", F.lit(0))).orderBy("seq", "fact_id")
    alone = one.withColumn("event_id", F.when(F.size("_objects") == 0, F.col("fact_id")).otherwise(F.first("fact_id").over(first)))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        events: list[tuple[str, set]] = []
        out = []
        rows = group.sort_values(["seq", "fact_id"])
        for r in rows[["fact_id", "_objects"]].itertuples(index=False):
            own = set(r[1])
            hit = next((e for e in events if e[1] & own), None)
            if hit is None:
                events.append((r[0], own))
            else:
                hit[1].update(own)
            out.append(hit[0] if hit else r[0])
        return rows.assign(event_id=out)

    # Whole rows go through the fold, as a fact_id may stand in several.
    folded = f.where("_many").groupBy(*EVENT).applyInPandas(merge, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in f.schema) + ", event_id string")
    return alone.unionByName(folded).drop("_many", "_objects")


def supersede_explicitly(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, new edges, refused): requests (user_id, loser_id, winner_id) close losers at their winners' start.

    Refused, with a reason: a fact that would supersede itself, an unknown winner, facts of another
    user. An unknown loser is no error and changes nothing.
    """
    known = facts.select("fact_id", F.col("user_id").alias("_u"), F.coalesce("valid_from", "occurred_start").alias("_start"))
    r = requests.join(known.select(F.col("fact_id").alias("loser_id"), F.col("_u").alias("_lu")), "loser_id", "left")
    r = r.join(known.select(F.col("fact_id").alias("winner_id"), F.col("_u").alias("_wu"), "_start"), "winner_id", "left")
    reason = F.when(F.col("loser_id") == F.col("winner_id"), "self").when(F.col("_lu").isNull(), "unknown loser").when(F.col("_wu").isNull(), "unknown winner").when((F.col("_lu") != F.col("user_id")) | (F.col("_wu") != F.col("user_id")), "other user")
    judged = r.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).groupBy("loser_id").agg(F.max(F.struct("_start", "winner_id")).alias("_w"))
    closed = facts.join(good.withColumnRenamed("loser_id", "fact_id"), "fact_id", "left")
    changed = closed.withColumns({"status": F.when(F.col("_w").isNotNull(), "superseded").otherwise(F.col("status")), "valid_until": F.when(F.col("_w").isNotNull(), F.col("_w._start")).otherwise(F.col("valid_until"))}).drop("_w")
    edges = good.select(stable_id("edge", F.col("_w.winner_id"), F.col("loser_id"), F.lit("SUPERSEDES")).alias("edge_id"), F.col("_w.winner_id").alias("src"), F.lit("SUPERSEDES").alias("edge_type"), F.col("loser_id").alias("dst"), F.lit(1.0).alias("confidence"))
    return changed.select(facts.columns), edges, judged.where(F.col("reason").isNotNull()).select("user_id", "loser_id", "winner_id", "reason")


def archive(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, outcomes): requests (user_id, fact_id) archive facts; the outcome is archived, already, missing or refused."""
    asked = requests.distinct().join(facts.select("fact_id", F.col("user_id").alias("_owner"), "status"), "fact_id", "left")
    outcome = F.when(F.col("_owner").isNull(), "missing").when(F.col("_owner") != F.col("user_id"), "refused").when(F.col("status") == "archived", "already").otherwise("archived")
    outcomes = asked.select("user_id", "fact_id", outcome.alias("outcome"))
    gone = outcomes.where(F.col("outcome") == "archived").select("fact_id", F.lit(True).alias("_gone")).distinct()
    changed = facts.join(gone, "fact_id", "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).select(facts.columns)
    return changed, outcomes


def purge(fact_ids: DataFrame, facts: DataFrame, roles: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, roles and edges without the given facts, whichever end of an edge they are."""
    gone = fact_ids.select("fact_id").distinct()
    ends = edges.join(gone.withColumnRenamed("fact_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("fact_id", "dst"), "dst", "left_anti")
    return facts.join(gone, "fact_id", "left_anti"), roles.join(gone, "fact_id", "left_anti"), ends.select(edges.columns)


SCOPE = ("user_id", "scope_type", "scope_id")


def dependents(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """(summary_id) of the summaries that depend on changed objects (object_type, object_id)."""
    return dependencies.join(changed.select("object_type", "object_id").distinct(), ["object_type", "object_id"]).select("summary_id").distinct()


def mark_dirty(summaries: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Active summaries whose scope changed get a revision more for each change, the reasons in order, and are dirty.

    changes (user_id, scope_type, scope_id, reason, seq).
    """
    found = changes.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"]).alias("_why"))
    hit = F.col("_n").isNotNull() & (F.col("status") == "active")
    return summaries.join(found, list(SCOPE), "left").withColumns({
        "dirty": F.when(hit, True).otherwise(F.col("dirty")), "scope_revision": F.col("scope_revision") + F.when(hit, F.col("_n")).otherwise(0),
        "dirty_reason": F.when(hit, F.concat("dirty_reason", "_why")).otherwise(F.col("dirty_reason")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }).select(summaries.columns)


def commit_summaries(summaries: DataFrame, built: DataFrame, at: Column) -> DataFrame:
    """Store rebuilt summaries; one whose scope went on beyond what it was built from stays dirty, with its reasons.

    built (user_id, scope_type, scope_id, summary_id, text, built_from_revision). A first summary of a
    scope is added.
    """
    new = built.select(*SCOPE, F.col("summary_id").alias("_id"), F.col("text").alias("_text"), F.col("built_from_revision").alias("_from"))
    both = summaries.join(new, list(SCOPE), "full")
    written, late = F.col("_from").isNotNull(), F.coalesce(F.col("scope_revision") > F.col("_from"), F.lit(False))
    none = F.array().cast("array<string>")
    return both.withColumns({
        "summary_id": F.coalesce("summary_id", "_id"), "text": F.when(written, F.col("_text")).otherwise(F.col("text")), "status": F.when(written, "active").otherwise(F.col("status")),
        "dirty": F.when(written, late).otherwise(F.col("dirty")), "dirty_reason": F.when(written & ~late, none).otherwise(F.coalesce("dirty_reason", none)),
        "built_from_revision": F.when(written, F.col("_from")).otherwise(F.col("built_from_revision")),
        "scope_revision": F.greatest(F.coalesce("scope_revision", F.lit(0)), F.coalesce("_from", F.lit(0))), "updated_at": F.when(written, at).otherwise(F.col("updated_at")),
    }).select(summaries.columns)


def archive_empty(summaries: DataFrame, scopes: DataFrame) -> DataFrame:
    """Active summaries of scopes without an active fact are archived. scopes: the scopes that have one."""
    alive = scopes.select(*SCOPE).distinct().withColumn("_alive", F.lit(True))
    gone = (F.col("status") == "active") & F.col("_alive").isNull()
    return summaries.join(alive, list(SCOPE), "left").withColumns({"status": F.when(gone, "archived").otherwise(F.col("status")), "dirty": F.col("dirty") & ~gone}).select(summaries.columns)


def scan_summaries(summaries: DataFrame, mode: str = "active") -> DataFrame:
    """Summaries, the newest first: all, active, or those fit for routing (active, clean and built from the last revision)."""
    keep = {"all": F.lit(True), "active": F.col("status") == "active", "routing": (F.col("status") == "active") & ~F.col("dirty") & (F.col("built_from_revision") == F.col("scope_revision"))}[mode]
    newest = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "summary_id")
    return summaries.where(keep).select("*", F.row_number().over(newest).alias("position"))


#: Columns that a second write of a row leaves as they are, and the key, by table.
KEPT = {
    "facts": (("fact_id",), ("user_id", "created_at")), "edges": (("src", "edge_type", "dst"), ("edge_id", "created_at")),
    "spans": (("span_id",), ("created_at",)), "turns": (("turn_id",), ()), "mentions": (("mention_id",), ("created_at",)), "scopes": (("user_id", "session_id"), ()),
}


def missing_vectors(rows: DataFrame, vectors: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with content that have no vector yet."""
    return rows.where(F.trim(plain(F.col(text))) != "").join(vectors.select(key), key, "left_anti")


def scan(facts: DataFrame, at: Column | None = None, active_only: bool = True) -> DataFrame:
    """facts of each user in order of ingest; by default active ones whose kind has not run out at the time."""
    from .facts import EXPIRING_KINDS

    kept = facts.where(F.col("status") == "active") if active_only else facts
    if at is not None:
        kept = kept.where(~(F.col("kind").isin(*EXPIRING_KINDS) & F.coalesce(F.col("valid_until") < at, F.lit(False))))
    return kept.select("*", F.row_number().over(Window.partitionBy("user_id").orderBy("seq")).alias("position"))


def registry_order(registry: DataFrame) -> DataFrame:
    """A user's entities by mentions, the most mentioned first."""
    return registry.select("*", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("mention_count"), "entity_id")).alias("position"))


def facts_of_spans(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """(span_id, fact_id, seq): the facts drawn from given spans, by equality of ids."""
    return facts.select("fact_id", "seq", F.explode(F.array_distinct("span_ids")).alias("span_id")).join(spans.select("span_id").distinct(), "span_id").select("span_id", "fact_id", "seq")


def targets_of_mentions(mentions: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """mentions with the text of the span and the predicate of the fact that they point to."""
    return mentions.join(spans.select("span_id", F.col("text").alias("span_text")), "span_id", "left").join(facts.select("fact_id", "predicate"), "fact_id", "left")


def sibling_spans(spans: DataFrame) -> DataFrame:
    """spans with their place among those of their turn, by where they start."""
    return spans.select("*", F.row_number().over(Window.partitionBy("turn_id").orderBy("char_start", "span_id")).alias("position"))

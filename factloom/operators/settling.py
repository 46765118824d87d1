"""What is settled between rounds: a planner's claims, questions, conflicts and aims, profiles of entities, and how far transcripts are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("supported", "disputed", "hypothesis")


def _tidy(c: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")), 1, most)


def _line(c: str, most: int) -> Column:
    return _tidy(F.col(c), most)


def claims(updates: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, claim_id, statement, evidence_ids, dropped_ids, status, material, position) after all updates.

    updates (question_id, step, ordinal, action, claim_id, statement, evidence_ids array, status,
    material): of a step the retractions come first; an upsert replaces the claim in its place.
    known (question_id, evidence_id): other ids are dropped and listed. A claim that is to be
    supported and has no evidence left is a hypothesis, as is one of an unknown status.
    """
    tidy = updates.withColumns({"claim_id": _line("claim_id", 80), "statement": _line("statement", 500)}).where("claim_id <> '' AND (action = 'retract' OR statement <> '')")
    cut = F.max(F.when(F.col("action") == "retract", F.col("step"))).over(Window.partitionBy("question_id", "claim_id"))
    live = tidy.withColumn("_cut", cut).where((F.col("action") == "upsert") & (F.col("_cut").isNull() | (F.col("step") >= F.col("_cut"))))
    at = F.struct("step", "ordinal")
    last = live.groupBy("question_id", "claim_id").agg(F.min(at).alias("_since"), F.max_by(F.struct("statement", "evidence_ids", "status", "material"), at).alias("_c")).select("question_id", "claim_id", "_since", "_c.*")
    ids = last.select("question_id", "claim_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).groupBy("question_id", "claim_id", "evidence_id").agg(F.min("pos").alias("pos"))
    found = ids.join(known.select("question_id", "evidence_id").distinct().withColumn("_known", F.lit(True)), ["question_id", "evidence_id"], "left")
    order = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "evidence_id")))), lambda x: x["evidence_id"])
    sorted_ids = found.groupBy("question_id", "claim_id").agg(order(F.col("_known").isNotNull()).alias("_held"), order(F.col("_known").isNull()).alias("_dropped"))
    none = F.array().cast("array<string>")
    joined = last.drop("evidence_ids").join(sorted_ids, ["question_id", "claim_id"], "left").withColumns({"evidence_ids": F.coalesce("_held", none), "dropped_ids": F.coalesce("_dropped", none)})
    asked = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("supported"))
    status = F.when(~asked.isin(*STATUSES) | ((asked == "supported") & (F.size("evidence_ids") == 0)), "hypothesis").otherwise(asked)
    position = F.row_number().over(Window.partitionBy("question_id").orderBy("_since", "claim_id")).cast("long")
    return joined.select("question_id", "claim_id", "statement", "evidence_ids", "dropped_ids", status.alias("status"), F.coalesce("material", F.lit(True)).alias("material"), position.alias("position"))


def open_questions(updates: DataFrame, most: int = 12) -> DataFrame:
    """(run_id, question, material, position): what is open after all updates of a planner's run.

    updates (run_id, step, questions array of (question, material), resolved array of strings). A
    list of questions replaces all before it, of which the first most count and blank ones
    go; without a list (null, not empty) the earlier ones stay but those resolved since. So only the last
    list and what was resolved after it matter, and no update has to wait for the one before it.
    """
    last = updates.where("questions IS NOT NULL").groupBy("run_id").agg(F.max_by(F.struct("step", F.slice("questions", 1, most).alias("q")), "step").alias("_l"))
    asked = last.select("run_id", "_l.step", F.posexplode("_l.q").alias("_pos", "_q")).withColumns({"question": _tidy(F.col("_q.question"), 500), "material": F.coalesce("_q.material", F.lit(True))}).where("question <> ''")
    gone = updates.select("run_id", F.explode("resolved").alias("_q"), F.col("step").alias("_at")).select("run_id", _tidy(F.col("_q"), 500).alias("question"), "_at").groupBy("run_id", "question").agg(F.max("_at").alias("_at"))
    left = asked.join(gone, ["run_id", "question"], "left").where("_at IS NULL OR _at <= step")
    position = F.row_number().over(Window.partitionBy("run_id").orderBy("_pos")).cast("long")
    return left.select("run_id", "question", "material", position.alias("position"))


def conflicts(updates: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """(run_id, position, description, evidence_ids, resolved, resolution): the conflicts of the last update that lists any.

    updates (run_id, step, conflicts array of (description, evidence_ids, resolved, resolution));
    of a list the first most count, null entries go. known (run_id, given, evidence_id): what a
    given id stands for; ids that are not given there are dropped, others keep their order.
    """
    last = updates.where("conflicts IS NOT NULL").groupBy("run_id").agg(F.max_by(F.slice("conflicts", 1, most), "step").alias("_c"))
    each = last.select("run_id", F.posexplode("_c").alias("_pos", "_c")).where("_c IS NOT NULL")
    ids = each.select("run_id", "_pos", F.posexplode("_c.evidence_ids").alias("_at", "given")).join(known.select("run_id", "given", "evidence_id").distinct(), ["run_id", "given"])
    held = ids.groupBy("run_id", "_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "evidence_id"))), lambda x: x["evidence_id"]).alias("_ids"))
    position = F.row_number().over(Window.partitionBy("run_id").orderBy("_pos")).cast("long")
    return each.join(held, ["run_id", "_pos"], "left").select(
        "run_id", position.alias("position"), _tidy(F.col("_c.description"), 500).alias("description"), F.coalesce("_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.coalesce("_c.resolved", F.lit(False)).alias("resolved"), _tidy(F.col("_c.resolution"), 500).alias("resolution"),
    )


# The kinds of question that a planner may name.
CLASSES = ("ordinary", "enumeration", "count", "sum", "comparison")


def aims(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """(run_id, objective, kind, needs_numbers): the last objective that is not blank, and the last kind that is one of CLASSES.

    runs (run_id, objective), updates (run_id, step, objective, kind, needs_numbers); only
    comparisons may need a count or sum (needs_numbers).
    """
    said, named = _tidy(F.col("objective"), 500), F.coalesce(F.col("kind").isin(*CLASSES), F.lit(False))
    needs = (F.col("kind") == "comparison") & F.coalesce("needs_numbers", F.lit(False))
    last = updates.groupBy("run_id").agg(F.max_by(said, F.when(said != "", F.col("step"))).alias("_o"), F.max_by(F.struct("kind", needs.alias("needs")), F.when(named, F.col("step"))).alias("_k"))
    return runs.join(last, "run_id", "left").select("run_id", F.coalesce("_o", "objective").alias("objective"), F.col("_k.kind").alias("kind"), F.col("_k.needs").alias("needs_numbers"))


def profile_id(user: str, entity: str, text: str) -> Column:
    return F.concat(F.lit("profile_"), F.substring(F.sha2(F.concat_ws("\x1f", user, entity, text).cast("binary"), 256), 1, 32))


def profile_cycle(profiles: DataFrame, made: DataFrame, stale: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, edges, stale) after one cycle.

    profiles (user_id, entity_id, profile_id, text, status, valid_from, valid_until), made
    (user_id, entity_id, text): one new text for each entity that was worked on, stale (user_id,
    entity_id). A new text has a new id and supersedes the entity's active profile; the same
    text changes nothing, so a cycle can run again. Entities worked on are stale no more.
    """
    key = ["user_id", "entity_id"]
    new = made.select(*key, profile_id("user_id", "entity_id", "text").alias("new_id"), F.col("text").alias("new_text"))
    placed = profiles.join(new.select(*key, "new_id"), key, "left")
    loses = (F.col("status") == "active") & F.col("new_id").isNotNull() & (F.col("profile_id") != F.col("new_id"))
    after = placed.select(*key, "profile_id", "text", F.when(loses, "superseded").otherwise(F.col("status")).alias("status"), "valid_from", F.when(loses, now).otherwise(F.col("valid_until")).alias("valid_until"))
    added = new.join(profiles.where("status = 'active'").select(*key, F.col("profile_id").alias("new_id")), [*key, "new_id"], "left_anti")
    whole = after.unionByName(added.select(*key, F.col("new_id").alias("profile_id"), F.col("new_text").alias("text"), F.lit("active").alias("status"), now.alias("valid_from"), F.lit(None).cast("long").alias("valid_until")))
    edges = placed.where(loses).select("user_id", F.col("new_id").alias("src"), F.lit("SUPERSEDES").alias("edge_type"), F.col("profile_id").alias("dst"))
    return whole, edges, stale.join(made.select(key).distinct(), key, "left_anti")


def settle_cursors(cursors: DataFrame, jobs: DataFrame) -> DataFrame:
    """cursors (session_id, committed, pending, job_id) once their jobs (job_id, status) are known.

    A job that succeeded commits what was pending, one that failed forgets it (those turns are
    sent again); while its outcome is unknown the cursor waits.
    """
    done = F.col("status") == "succeeded"
    over = F.coalesce(F.col("status").isin("succeeded", "failed"), F.lit(False))
    joined = cursors.join(jobs.select("job_id", "status"), "job_id", "left")
    return joined.select("session_id", F.when(done, F.col("pending")).otherwise(F.col("committed")).alias("committed"), F.when(over, 0).otherwise(F.col("pending")).cast("long").alias("pending"), F.when(~over, F.col("job_id")).alias("job_id"))


def unsent(turns: DataFrame, cursors: DataFrame) -> DataFrame:
    """turns (session_id, idx) from the committed place on, of sessions whose last job is over or that have no cursor."""
    joined = turns.join(cursors.select("session_id", "committed", "job_id"), "session_id", "left")
    return joined.where(F.col("job_id").isNull() & (F.col("idx") >= F.coalesce("committed", F.lit(0)))).select(turns.columns)


def sent(cursors: DataFrame, accepted: DataFrame) -> DataFrame:
    """cursors after sessions were handed over: accepted (session_id, end, new_job); without a job the turns are stored already."""
    joined = cursors.join(accepted, "session_id", "full")
    direct = F.col("end").isNotNull() & F.col("new_job").isNull()
    waits = F.col("new_job").isNotNull()
    return joined.select("session_id", F.when(direct, F.col("end")).otherwise(F.coalesce("committed", F.lit(0))).alias("committed"), F.when(direct, 0).when(waits, F.col("end")).otherwise(F.col("pending")).cast("long").alias("pending"), F.when(waits, F.col("new_job")).when(~direct, F.col("job_id")).alias("job_id"))

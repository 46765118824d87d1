"""Queries over whole evidence cards, a planner's claims, profiles' versions and cursors of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards, ingest, settling
from ..sources.adapters import facts, turns
from .answering import SQL_FACTS, SQL_TURNS

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_query("evidence_cards", f"""WITH {SQL_TURNS}, t AS (SELECT *, 1704067200 + conv_id * 3600 AS said FROM turns WHERE trim(text) <> ''),
c AS (SELECT conv_id, any_value(session_id) AS s, arg_min(role, turn) AS role, arg_min(turn_id, turn) AS turn_id, any_value(said) AS said, trim(string_agg(text, chr(10) ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM t GROUP BY conv_id),
e AS (SELECT 'fact_' || a.s AS src, 'fact_' || b.s AS dst FROM c a JOIN c b ON b.conv_id = a.conv_id - 20 WHERE a.conv_id % 3 = 0)
SELECT 'ev_fact:fact_' || s AS evidence_id, role AS source_role, s AS source_session_id, turn_id AS source_turn_id, strftime(to_timestamp(said) AT TIME ZONE 'UTC', '%Y-%m-%d') AS session_time, strftime(to_timestamp(said) AT TIME ZONE 'UTC', '%Y-%m-%d') AS document_time,
  md5(body) AS support, conv_id::DOUBLE AS quantity, CASE WHEN o.src IS NOT NULL THEN 'superseded' WHEN conv_id % 5 = 0 THEN 'expired' ELSE 'current' END AS version_status, o.src AS superseded_by, coalesce(o.src, 'fact_' || s) AS current_head_id, coalesce(u.dst, '') AS superseded,
  CASE WHEN u.dst IS NOT NULL THEN 'current version; supersedes 1 older fact(s)' WHEN o.src IS NOT NULL THEN 'superseded by ' || o.src ELSE '' END AS update_chain_summary, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 3 END AS tier, conv_id / 7 AS score
FROM c LEFT JOIN e o ON o.dst = 'fact_' || s LEFT JOIN e u ON u.src = 'fact_' || s""")
def evidence_cards(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    n = F.substring("session_id", 2, 20).cast("long")
    made = s.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "span_id"))), lambda x: x["span_id"]).alias("span_ids"))
    given = made.select(
        F.concat(F.lit("fact_"), "session_id").alias("fact_id"), "span_ids", F.when(n % 2 == 0, "explicit_text").otherwise("inferred").alias("source_type"),
        F.when(n % 5 == 0, "expired").otherwise("active").alias("status"), F.lit("said").alias("predicate_raw"), n.cast("double").alias("quantity_value"), n.alias("n"),
    )
    newer = given.where("n % 3 = 0").select(F.col("fact_id").alias("src"), (F.col("n") - 20).alias("n"))
    edges = newer.join(given.select("n", F.col("fact_id").alias("dst")), "n").select("src", "dst")
    routes = given.select("fact_id", F.lit("lexical").alias("route"), (F.col("n") / 7).alias("score")).union(given.select("fact_id", F.lit("entity"), F.col("n") / 9))
    out = cards.evidence_cards(given.drop("n"), s, edges, routes)
    return out.select(
        "evidence_id", "source_role", "source_session_id", "source_turn_id", "session_time", "document_time", F.md5(F.col("support_text").cast("binary")).alias("support"), F.col("quantity.value").alias("quantity"), "version_status", "superseded_by",
        "current_head_id", F.coalesce(F.array_join("superseded_fact_ids", ","), F.lit("")).alias("superseded"), "update_chain_summary", F.col("rank.tier").alias("tier"), F.col("rank.score").alias("score"),
    )


@_query("planner_claims", f"""WITH {SQL_FACTS}, u AS (SELECT user_id AS q, seq, event_type || ':' || coalesce(object, '') AS c, coalesce(quantity < 20, false) AS gone, fact_id, event_type, coalesce(quantity >= 60, false) AS known FROM facts),
l AS (SELECT q, c, max(CASE WHEN gone THEN seq END) AS cut FROM u GROUP BY ALL),
k AS (SELECT u.* FROM u JOIN l ON u.q = l.q AND u.c = l.c WHERE NOT gone AND (cut IS NULL OR seq >= cut)),
z AS (SELECT q, c, min(seq) AS since, max(seq) AS seq FROM k GROUP BY ALL)
SELECT z.q AS question_id, z.c AS claim_id, 'seen ' || k.event_type AS statement, CASE WHEN known THEN fact_id ELSE '' END AS evidence, CASE WHEN known THEN 'none' ELSE fact_id || ',none' END AS dropped,
  CASE WHEN k.event_type = 'view' THEN 'hypothesis' WHEN k.event_type = 'click' THEN 'disputed' WHEN known THEN 'supported' ELSE 'hypothesis' END AS status, row_number() OVER (PARTITION BY z.q ORDER BY since, z.c) AS position
FROM z JOIN k ON z.q = k.q AND z.c = k.c AND z.seq = k.seq""")
def planner_claims(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    updates = f.select(
        F.col("user_id").alias("question_id"), F.col("seq").alias("step"), F.lit(0).alias("ordinal"), F.when(F.col("quantity") < 20, "retract").otherwise("upsert").alias("action"), F.concat(F.lit(" "), "event_type", F.lit(":"), F.coalesce("object", F.lit(""))).alias("claim_id"),
        F.concat(F.lit("seen  "), "event_type").alias("statement"), F.array("fact_id", F.lit("none"), "fact_id").alias("evidence_ids"), F.when(F.col("event_type") == "view", "certain").when(F.col("event_type") == "click", "disputed").alias("status"), F.lit(None).cast("boolean").alias("material"),
    )
    known = f.where("quantity >= 60").select(F.col("user_id").alias("question_id"), F.col("fact_id").alias("evidence_id"))
    out = settling.claims(updates, known)
    return out.select("question_id", "claim_id", "statement", F.array_join("evidence_ids", ",").alias("evidence"), F.array_join("dropped_ids", ",").alias("dropped"), "status", "position")


@_query("profile_versions", f"""WITH {SQL_FACTS}, a AS (SELECT user_id, event_type AS entity_id, 'n' || count(*) FILTER (WHERE seq % 2 = 0) AS old, 'n' || count(*) FILTER (WHERE quantity >= 50) AS new FROM facts GROUP BY ALL)
SELECT user_id, entity_id, old AS text, CASE WHEN old = new OR entity_id = 'error' THEN 'active' ELSE 'superseded' END AS status, CASE WHEN old = new OR entity_id = 'error' THEN NULL ELSE 9 END::BIGINT AS valid_until FROM a
UNION ALL SELECT user_id, entity_id, new, 'active', NULL FROM a WHERE old <> new AND entity_id <> 'error'""")
def profile_versions(spark: SparkSession, d: str) -> DataFrame:
    return _profile_cycle(spark, d)[0].select("user_id", "entity_id", "text", "status", "valid_until")


@_query("profile_stale_left", f"WITH {SQL_FACTS} SELECT DISTINCT user_id, event_type AS entity_id FROM facts WHERE event_type = 'error'")
def profile_stale_left(spark: SparkSession, d: str) -> DataFrame:
    return _profile_cycle(spark, d)[2]


def _profile_cycle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of a user's event types from one half of the facts, and then from another."""
    text = lambda c: F.concat(F.lit("n"), F.count_if(c).cast("string"))
    named = facts(spark, d).withColumn("entity_id", F.col("event_type")).groupBy("user_id", "entity_id").agg(text(F.col("seq") % 2 == 0).alias("text"), text(F.col("quantity") >= 50).alias("new"))
    old = named.select("user_id", "entity_id", settling.profile_id("user_id", "entity_id", "text").alias("profile_id"), "text", F.lit("active").alias("status"), F.lit(1).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"))
    made = named.where("entity_id <> 'error'").select("user_id", "entity_id", F.col("new").alias("text"))
    return settling.profile_cycle(old, made, named.select("user_id", "entity_id"), F.lit(9).cast("long"))


SQL_CURSORS = "c AS (SELECT conv_id, 's' || conv_id AS session_id, count(*) AS n FROM conversations GROUP BY conv_id), s AS (SELECT *, CASE WHEN conv_id % 2 = 1 THEN NULL WHEN conv_id % 8 = 0 THEN 'succeeded' WHEN conv_id % 8 = 2 THEN 'failed' WHEN conv_id % 8 = 4 THEN 'running' END AS status FROM c WHERE conv_id % 5 <> 0), r AS (SELECT session_id, n, CASE WHEN status = 'succeeded' THEN n ELSE 1 END AS committed, CASE WHEN status IN ('succeeded', 'failed') OR conv_id % 2 = 1 THEN 0 ELSE n END AS pending, CASE WHEN conv_id % 8 IN (4, 6) THEN 'j' || conv_id END AS job_id FROM s)"


def _cursors(spark: SparkSession, d: str) -> DataFrame:
    """Cursors of four sessions in five; every second one has a job, of which one in four is not known."""
    n = F.substring("session_id", 2, 20).cast("long")
    each = turns(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", n).where("k % 5 <> 0")
    cursors = each.select("session_id", F.lit(1).cast("long").alias("committed"), F.when(n % 2 == 0, F.col("n")).otherwise(0).alias("pending"), F.when(n % 2 == 0, F.concat(F.lit("j"), F.col("k").cast("string"))).alias("job_id"))
    status = F.when(n % 8 == 0, "succeeded").when(n % 8 == 2, "failed").when(n % 8 == 4, "running")
    jobs = each.select(F.concat(F.lit("j"), F.col("k").cast("string")).alias("job_id"), status.alias("status")).where("status IS NOT NULL")
    return settling.settle_cursors(cursors, jobs)


@_query("resume_cursors", f"WITH {SQL_CURSORS} SELECT session_id, committed, pending, job_id FROM r")
def resume_cursors(spark: SparkSession, d: str) -> DataFrame:
    return _cursors(spark, d)


@_query("unsent_turns", f"WITH {SQL_CURSORS} SELECT 's' || t.conv_id AS session_id, t.turn AS idx FROM conversations t LEFT JOIN r ON r.session_id = 's' || t.conv_id WHERE r.job_id IS NULL AND t.turn >= coalesce(r.committed, 0)")
def unsent_turns(spark: SparkSession, d: str) -> DataFrame:
    return settling.unsent(turns(spark, d), _cursors(spark, d)).select("session_id", "idx")


@_query("sent_cursors", f"WITH {SQL_CURSORS}, w AS (SELECT c.session_id, c.n, c.conv_id, r.committed, r.pending, r.job_id FROM c LEFT JOIN r ON r.session_id = c.session_id) SELECT session_id, CASE WHEN job_id IS NULL AND conv_id % 3 = 0 THEN n ELSE coalesce(committed, 0) END AS committed, CASE WHEN job_id IS NOT NULL THEN pending WHEN conv_id % 3 = 0 THEN 0 ELSE n END AS pending, CASE WHEN job_id IS NOT NULL THEN job_id WHEN conv_id % 3 = 0 THEN NULL ELSE 'k' || conv_id END AS job_id FROM w")
def sent_cursors(spark: SparkSession, d: str) -> DataFrame:
    cursors = _cursors(spark, d)
    n = F.substring("session_id", 2, 20).cast("long")
    ends = turns(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("end"))
    accepted = ends.join(cursors.where("job_id IS NOT NULL"), "session_id", "left_anti").withColumn("new_job", F.when(n % 3 != 0, F.concat(F.lit("k"), n.cast("string"))))
    return settling.sent(cursors, accepted)

"""Queries over boards of current values and a planner's questions, conflicts and aims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board, settling
from ..sources.adapters import facts
from .answering import SQL_FACTS

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# Plans and evidence are written in SQL that Spark and DuckDB both read: a user is a query, an event its evidence.
PLANS = """SELECT user_id AS query_id, CASE WHEN n % 11 = 0 THEN 0.5 ELSE 0.9 END AS confidence, CASE WHEN n % 13 = 0 THEN 'what was the previous one' ELSE 'what is it' END AS question,
  CASE WHEN n % 17 = 0 THEN 'historical_value' ELSE 'current_value' END AS answer_shape, CASE WHEN n % 19 = 0 THEN 'past' ELSE 'current' END AS temporal_intent,
  CASE WHEN n % 23 = 0 THEN NULL WHEN n % 7 = 0 THEN 'view expenses' WHEN n % 7 = 1 THEN 'the place of click' WHEN n % 7 = 2 THEN 'purchase' WHEN n % 7 < 5 THEN 'error' ELSE 'signup' END AS metric,
  CASE WHEN n % 3 = 0 THEN 'key' || (n % 4) END AS entity, CASE WHEN n % 5 = 0 THEN 'Money' WHEN n % 5 = 1 THEN 'duration' WHEN n % 5 = 2 THEN 'time' WHEN n % 31 = 0 THEN 'location' ELSE 'count' END AS value_type,
  CASE WHEN n % 4 = 0 THEN 'total' WHEN n % 12 = 1 THEN 'delta' ELSE 'unknown' END AS total_vs_delta, CASE WHEN n % 29 = 0 THEN 'thing' END AS object_type
FROM (SELECT DISTINCT user_id, CAST(substr(user_id, 2) AS BIGINT) AS n FROM facts)"""
EVIDENCE = """SELECT user_id AS query_id, fact_id AS evidence_id, seq AS place, 'a ' || event_type || CASE WHEN seq % 6 = 0 THEN ' gained' WHEN seq % 6 = 1 THEN ' for two-Three weeks' WHEN seq % 6 = 2 THEN ' at 7:30 PM' WHEN seq % 6 = 3 THEN ' for 2.5 - 4 Hours' ELSE '' END AS text,
  CASE WHEN seq % 8 = 0 THEN 'plan_' || event_type WHEN seq % 8 = 1 THEN event_type || '_growth' WHEN seq % 8 = 2 THEN event_type || '_nearing' WHEN seq % 8 = 3 THEN event_type || '_count' WHEN seq % 8 < 6 THEN 'seen' END AS predicate_canonical,
  'said' AS predicate_raw, 'object: key' || (seq % 4) AS entity_roles, CASE WHEN seq % 7 < 5 THEN CAST(floor(quantity / 20) AS DOUBLE) END AS quantity_value,
  CASE WHEN seq % 5 = 0 THEN 'item_count' WHEN seq % 5 = 1 THEN 'money' WHEN seq % 5 = 2 THEN 'days' WHEN seq % 5 = 3 THEN 'step_count' END AS quantity_unit, CASE WHEN seq % 9 = 0 THEN 'external_info' END AS modality,
  CASE WHEN seq % 10 > 0 THEN CAST(CAST(floor(valid_from / 86400000000.0) AS BIGINT) AS VARCHAR(20)) END AS time FROM facts"""
_DELTA = r"(?i)\b(new\s+followers?|additional|gained|growth|increase|delta|last\s+\w+\s+weeks?)\b"


@_query("value_boards", f"""WITH {SQL_FACTS}, p AS ({PLANS}), e AS ({EVIDENCE}), t AS (SELECT *, CASE WHEN metric IS NULL THEN [] ELSE list_filter(string_split(metric, ' '), lambda w: len(w) > 2 AND w <> 'the') END AS ms, lower(value_type) AS kind FROM p WHERE metric IS NOT NULL OR entity IS NOT NULL),
j AS (SELECT e.*, t.* EXCLUDE (query_id), coalesce(predicate_canonical, '') AS pred, lower(concat_ws(' ', text, coalesce(predicate_canonical, ''), predicate_raw, entity_roles)) AS hay FROM e JOIN t ON e.query_id = t.query_id WHERE modality IS NULL),
v AS (SELECT *, CASE WHEN quantity_value IS NOT NULL THEN CASE WHEN quantity_unit IS NULL OR kind NOT IN ('money', 'count', 'duration', 'time') OR (kind = 'money' AND quantity_unit = 'money') OR (kind = 'count' AND quantity_unit LIKE '%count') OR (kind = 'duration' AND quantity_unit = 'days') THEN quantity_value::VARCHAR END
    WHEN kind = 'time' AND text LIKE '%7:30%' THEN '7:30 pm' WHEN kind IN ('duration', 'count') AND text LIKE '%weeks' THEN '2-3' WHEN kind IN ('duration', 'count') AND text LIKE '%Hours' THEN '2.5-4' END AS value,
  CASE WHEN quantity_value IS NOT NULL THEN coalesce(quantity_unit, kind) WHEN kind = 'time' THEN 'time' WHEN text LIKE '%weeks' THEN 'weeks' ELSE 'hours' END AS unit, len(list_filter(ms, lambda w: contains(hay, w))) AS mh, CASE WHEN contains(hay, coalesce(entity, '-none-')) THEN 1 ELSE 0 END AS eh FROM j),
s AS (SELECT *, coalesce(time, '') AS said, coalesce(predicate_canonical, predicate_raw) AS predicate, CASE WHEN pred LIKE 'plan%' OR (total_vs_delta = 'total' AND (regexp_matches(hay, '{_DELTA}') OR pred LIKE '%growth%')) THEN 0 ELSE mh * 2 + eh + CASE WHEN len(list_filter(ms, lambda w: contains(pred, w))) > 0 THEN 2 ELSE 0 END
  + CASE WHEN total_vs_delta = 'total' AND (pred LIKE '%count%' OR pred LIKE '%nearing%') THEN 1 ELSE 0 END + CASE WHEN total_vs_delta = 'total' AND pred LIKE '%nearing%' THEN 2 ELSE 0 END END AS score FROM v WHERE value IS NOT NULL AND (len(ms) = 0 OR mh > 0) AND (entity IS NULL OR eh > 0)),
r AS (SELECT *, row_number() OVER w AS r, first(value) OVER w AS tv, first(unit) OVER w AS tu, first(evidence_id) OVER w AS te, first(said) OVER w AS tt, first(predicate || ' ' || text) OVER w AS tx FROM s WHERE score > 0 WINDOW w AS (PARTITION BY query_id ORDER BY said DESC, score DESC, place)),
g AS (SELECT query_id, any_value(tv) AS value, any_value(tu) AS unit, any_value(te) AS evidence_id, any_value(tt) AS time, any_value(tx) AS tx, count(*) AS n_candidates, count(*) FILTER (WHERE value <> tv AND unit = tu) AS nc, count(*) FILTER (WHERE value <> tv AND unit = tu AND said <> '') AS nt, list(evidence_id ORDER BY r) AS ids FROM r GROUP BY query_id),
a AS (SELECT g.*, CASE WHEN confidence < 0.75 THEN 'low_plan_confidence' WHEN question LIKE '%previous%' THEN 'history_intent_question' WHEN answer_shape <> 'current_value' THEN 'not_current_value_shape' WHEN temporal_intent <> 'current' THEN 'not_current_or_latest' WHEN kind = 'location' THEN 'unsupported_value_type'
  WHEN total_vs_delta = 'delta' THEN 'delta_metric' WHEN metric LIKE '%expenses' THEN 'aggregate_scope' WHEN metric LIKE '%place%' THEN 'state_scope' WHEN object_type IS NOT NULL THEN 'enumeration_hint_present' WHEN n_candidates < 2 THEN 'no_competing_values' WHEN total_vs_delta = 'total' AND regexp_matches(tx, '{_DELTA}') THEN 'top_delta_for_total'
  WHEN g.time = '' THEN 'top_time_missing' WHEN nc = 0 THEN 'no_different_same_unit_value' WHEN nt = 0 THEN 'competing_time_missing' ELSE 'single_slot_current_value' END AS reason FROM g JOIN t ON g.query_id = t.query_id)
SELECT query_id, value, unit, evidence_id, time, n_candidates, reason = 'single_slot_current_value' AS narrowed, reason, array_to_string(ids[1:CASE WHEN reason = 'single_slot_current_value' THEN 4 ELSE 8 END], ',') AS kept FROM a""")
def value_boards(spark: SparkSession, d: str) -> DataFrame:
    given = facts(spark, d)
    plans = spark.sql(PLANS.replace("FROM facts", "FROM {facts}"), facts=given)
    rows = spark.sql(EVIDENCE.replace("FROM facts", "FROM {facts}"), facts=given)
    asked = plans.withColumns({"entities": F.when(F.col("entity").isNotNull(), F.array("entity")), "actions": F.lit(None).cast("array<string>")})
    return board.boards(asked, rows).withColumn("kept", F.array_join("kept_ids", ",")).drop("kept_ids")


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Events as a planner's updates: a run is a user, a step an event."""
    f = facts(spark, d)
    k, is_ = F.col("object").cast("long"), lambda t: F.col("event_type") == t
    q = lambda n, material: F.struct(F.concat(F.lit(" q "), (k % n).cast("string")).alias("question"), material.alias("material"))
    asked = F.array(q(5, F.lit(None).cast("boolean")), F.struct(F.lit("  ").alias("question"), F.lit(True).alias("material")), q(7, F.col("quantity") > 30), q(3, F.lit(False)))
    clash = lambda text, ids, done: F.struct(text.alias("description"), ids.alias("evidence_ids"), done.alias("resolved"), F.when(done, F.lit(" so  it is ")).alias("resolution"))
    listed = F.array(clash(F.concat(F.lit("on "), "object"), F.array("fact_id", F.lit("none"), F.concat(F.lit("old-"), "fact_id")), F.col("quantity") < 10), clash(F.lit("none"), F.array(F.lit("none")), F.lit(None).cast("boolean")), clash(F.lit("over"), F.array("fact_id"), F.lit(True)))
    return f.select(
        F.col("user_id").alias("run_id"), F.col("seq").alias("step"), "fact_id", F.when(is_("view"), F.concat(F.lit(" look  at "), "object")).when(is_("error"), " ").alias("objective"), F.when(is_("purchase"), "comparison").when(is_("click"), "count").otherwise("guess").alias("kind"),
        (F.col("quantity") > 30).alias("needs_numbers"), F.when(is_("signup") & (F.col("quantity") >= 40), asked).alias("questions"), F.when(is_("error"), F.array(F.concat(F.lit("q   "), (k % 5).cast("string")))).alias("resolved"), F.when(is_("click") & (F.col("quantity") < 25), listed).alias("conflicts"),
    )


@_query("planner_questions", f"""WITH {SQL_FACTS}, f AS (SELECT user_id, seq, event_type, quantity, object::BIGINT AS k FROM facts), l AS (SELECT user_id, max(seq) AS seq FROM f WHERE event_type = 'signup' AND quantity >= 40 GROUP BY ALL),
a AS (SELECT f.*, u.pos, u.n, u.m FROM f JOIN l ON f.user_id = l.user_id AND f.seq = l.seq, (VALUES (1, 5, true), (3, 7, NULL), (4, 3, false)) u(pos, n, m) WHERE u.pos < 4)
SELECT user_id AS run_id, 'q ' || (k % n) AS question, coalesce(m, quantity > 30) AS material, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS position FROM a WHERE NOT EXISTS (SELECT 1 FROM f r WHERE r.user_id = a.user_id AND r.event_type = 'error' AND r.seq > a.seq AND r.k % 5 = a.k % a.n)""")
def planner_questions(spark: SparkSession, d: str) -> DataFrame:
    return settling.open_questions(_updates(spark, d), 3)


@_query("planner_conflicts", f"""WITH {SQL_FACTS}, l AS (SELECT user_id, max(seq) AS seq FROM facts WHERE event_type = 'click' AND quantity < 25 GROUP BY ALL)
SELECT f.user_id AS run_id, pos::BIGINT AS position, CASE pos WHEN 1 THEN 'on ' || object ELSE 'none' END AS description, CASE pos WHEN 1 THEN fact_id || ',' || fact_id ELSE '' END AS evidence, pos = 1 AND quantity < 10 AS resolved, CASE WHEN pos = 1 AND quantity < 10 THEN 'so it is' ELSE '' END AS resolution
FROM facts f JOIN l ON f.user_id = l.user_id AND f.seq = l.seq, (VALUES (1), (2)) u(pos)""")
def planner_conflicts(spark: SparkSession, d: str) -> DataFrame:
    updates = _updates(spark, d)
    known = updates.select("run_id", F.explode(F.array("fact_id", F.concat(F.lit("old-"), "fact_id"))).alias("given"), F.col("fact_id").alias("evidence_id"))
    return settling.conflicts(updates, known, 2).withColumn("evidence", F.array_join("evidence_ids", ",")).drop("evidence_ids")


@_query("planner_aims", f"""WITH {SQL_FACTS} SELECT user_id AS run_id, coalesce(arg_max('look at ' || object, seq) FILTER (WHERE event_type = 'view'), 'start') AS objective, arg_max(CASE event_type WHEN 'click' THEN 'count' ELSE 'comparison' END, seq) FILTER (WHERE event_type IN ('click', 'purchase')) AS kind,
  arg_max(event_type = 'purchase' AND quantity > 30, seq) FILTER (WHERE event_type IN ('click', 'purchase')) AS needs_numbers FROM facts GROUP BY user_id""")
def planner_aims(spark: SparkSession, d: str) -> DataFrame:
    updates = _updates(spark, d)
    return settling.aims(updates.select("run_id").distinct().withColumn("objective", F.lit("start")), updates)

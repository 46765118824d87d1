"""Queries over evidence cards and planner traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards, ingest, trace
from ..sources.adapters import facts, turns

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


SQL_FACTS = "facts AS (SELECT 'f' || event_id AS fact_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) AS valid_from, value AS quantity, json_extract_string(props, '$.k') AS object, event_id AS seq FROM events)"
SQL_CALLS = SQL_FACTS + ", calls AS (SELECT user_id AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS step, event_type AS tool, event_type || ':' || object AS signature, CASE WHEN quantity < 10 THEN 0 ELSE floor(quantity)::BIGINT END AS returned_rows, CASE WHEN quantity < 40 THEN 0 ELSE 1 END AS new_evidence, event_type <> 'error' AS success FROM facts)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as a planner's calls: a question is a user, a tool an event type."""
    from pyspark.sql.window import Window

    return facts(spark, d).select(
        F.col("user_id").alias("question_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("seq")).cast("long").alias("step"), F.col("event_type").alias("tool"), F.concat_ws(":", "event_type", "object").alias("signature"),
        F.when(F.col("quantity") < 10, 0).otherwise(F.floor("quantity")).alias("returned_rows"), F.when(F.col("quantity") < 40, 0).otherwise(1).alias("new_evidence"), (F.col("event_type") != "error").alias("success"),
    )


SQL_COUNTERS = SQL_CALLS + """, a AS (SELECT *, row_number() OVER (PARTITION BY question_id, signature ORDER BY step) > 1 AS dup, sum(new_evidence) OVER (PARTITION BY question_id ORDER BY step) AS island FROM calls),
b AS (SELECT *, sum(dup::INT) OVER (PARTITION BY question_id ORDER BY step) AS n_dup, sum((returned_rows = 0)::INT) OVER (PARTITION BY question_id ORDER BY step) AS n_empty, sum((new_evidence = 0)::INT) OVER (PARTITION BY question_id, island ORDER BY step) AS barren FROM a)"""


@_query("call_counters", f"WITH {SQL_COUNTERS} SELECT question_id, step, n_dup::BIGINT AS n_duplicates, n_empty::BIGINT AS n_empty, barren::BIGINT AS barren_run FROM b")
def call_counters(spark: SparkSession, d: str) -> DataFrame:
    return trace.call_counters(calls(spark, d)).select("question_id", "step", "n_duplicates", "n_empty", "barren_run")


@_query("stall_verdicts", f"WITH {SQL_COUNTERS}, v AS (SELECT question_id, step, CASE WHEN n_dup >= 1 THEN 'duplicate_call' WHEN n_empty >= 3 THEN 'empty_results' WHEN barren >= 2 THEN 'no_new_evidence' END AS verdict FROM b) SELECT question_id, min(step) AS step, arg_min(verdict, step) AS verdict FROM v WHERE verdict IS NOT NULL GROUP BY question_id")
def stall_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return trace.stall_verdicts(calls(spark, d))


@_query("may_abstain", f"WITH {SQL_CALLS} SELECT question_id, bool_or(success AND returned_rows = 0) AS allowed FROM calls GROUP BY question_id")
def may_abstain(spark: SparkSession, d: str) -> DataFrame:
    return trace.may_abstain(calls(spark, d))


@_query("tool_order", f"WITH {SQL_CALLS} SELECT question_id, step, tool FROM calls c WHERE tool = 'purchase' AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.question_id = c.question_id AND p.tool = 'view' AND p.step < c.step)")
def tool_order(spark: SparkSession, d: str) -> DataFrame:
    return trace.tool_errors(calls(spark, d), {"purchase": ["view"]}).where(F.size("missing") > 0).select("question_id", "step", "tool")


@_query("first_seen_aliases", f"WITH {SQL_CALLS}, o AS (SELECT question_id, signature, min(step) AS s FROM calls GROUP BY ALL) SELECT question_id, signature, row_number() OVER w AS ordinal, 'e' || row_number() OVER w AS alias FROM o WINDOW w AS (PARTITION BY question_id ORDER BY s, signature)")
def first_seen_aliases(spark: SparkSession, d: str) -> DataFrame:
    return trace.first_seen(calls(spark, d), "question_id", "signature", "step").withColumn("ordinal", F.col("ordinal").cast("long"))


@_query("delivery_states", f"WITH {SQL_CALLS}, n AS (SELECT question_id, max(step) AS now FROM calls GROUP BY ALL), a AS (SELECT c.question_id, signature, any_value(now) - max(step) AS age FROM calls c JOIN n ON c.question_id = n.question_id GROUP BY c.question_id, signature) SELECT question_id, signature, CASE WHEN age < 5 THEN 'hot' WHEN age < 20 THEN 'warm' ELSE 'folded' END AS state FROM a")
def delivery_states(spark: SparkSession, d: str) -> DataFrame:
    return trace.delivery(calls(spark, d), "question_id", "signature", "step", 5, 20)


SQL_TURNS = "turns AS (SELECT 's' || conv_id AS session_id, 's' || conv_id || '_turn_' || turn AS turn_id, conv_id, turn, role, text FROM conversations)"


@_query("fact_cards", f"WITH {SQL_TURNS} SELECT 'ev_fact:fact_' || session_id AS evidence_id, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 3 END AS tier, arg_min(role, turn) AS role, left(string_agg(text, chr(10) ORDER BY turn), 700) AS preview, length(string_agg(text, chr(10) ORDER BY turn)) > 700 AS truncated FROM turns WHERE trim(text) <> '' GROUP BY session_id, conv_id")
def fact_cards(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    made = s.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "span_id"))), lambda x: x["span_id"]).alias("span_ids"))
    n = F.substring("session_id", 2, 20).cast("long")
    given = made.select(F.concat(F.lit("fact_"), "session_id").alias("fact_id"), F.when(n % 2 == 0, "explicit_text").otherwise("inferred").alias("source_type"), F.lit("said").alias("predicate"), F.lit("").alias("support"), "span_ids")
    return cards.fact_cards(given, s).select("evidence_id", "tier", "role", "preview", "truncated")


@_query("card_lineage", f"WITH {SQL_FACTS}, e AS (SELECT lead(fact_id) OVER (PARTITION BY user_id, event_type ORDER BY valid_from, seq) AS src, fact_id AS dst FROM facts) SELECT f.fact_id, coalesce(a.src, f.fact_id) AS current_head, coalesce(b.dst, '') AS superseded_ids FROM facts f LEFT JOIN e a ON a.dst = f.fact_id LEFT JOIN e b ON b.src = f.fact_id")
def card_lineage(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import facts as fx

    f = facts(spark, d)
    edges = fx.supersede(f, ("user_id", "event_type"), ("valid_from", "seq")).where(F.col("superseded_by").isNotNull()).select(F.col("superseded_by").alias("src"), F.col("fact_id").alias("dst"))
    out = cards.lineage(f.select("fact_id"), edges)
    return out.select("fact_id", "current_head", F.coalesce(F.array_join("superseded_ids", ","), F.lit("")).alias("superseded_ids"))

"""Queries over evidence rows: payloads, aliases, ranking, gates, pools, projections, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain
from ..operators import evidence, ingest
from ..sources.adapters import facts, table, turns

QUERIES: dict = {}
ORACLES: dict = {}

SQL_FACTS = """facts AS (
  SELECT 'f' || event_id AS fact_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) AS valid_from, value AS quantity, json_extract_string(props, '$.k') AS object, event_id AS seq FROM events)"""
SQL_TURNS = """turns AS (
  SELECT 'u' || (conv_id % 20) AS user_id, 's' || conv_id AS session_id, 's' || conv_id || '_turn_' || turn AS turn_id, conv_id, turn, role, text AS content, conv_id * 100 + turn AS place FROM conversations)"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _placed(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("session_id", 2, 20).cast("long")
    return turns(spark, d).select("*", n.alias("conv_id"), (n * 100 + F.col("idx")).alias("place"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """One JSON answer a fact, of the shapes that tools return."""
    row = F.format_string('{"fact_id": "%s", "status": "active", "quantity": {"value": "%d", "unit": "k"}, "text": "t%d"}', "fact_id", F.floor("quantity").cast("long"), "seq")
    other = F.format_string('{"id": "x%d", "content": "c"}', "seq")
    shapes = [F.format_string('{"items": [%s, %s]}', row, other), F.format_string('{"memory": %s, "groups": [{"items": [%s]}, {}]}', row, other), F.format_string("[%s]", row), row, F.format_string('{"total": %d}', "seq"), F.lit("not json")]
    out = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        out = F.when(F.col("seq") % len(shapes) == k, shape).otherwise(out)
    return facts(spark, d).select("seq", out.alias("payload"))


@_query("payload_rows", f"WITH {SQL_FACTS} SELECT seq, 0 AS place, 'ev_fact:' || fact_id AS evidence_id, 't' || seq AS support FROM facts WHERE seq % 6 < 4 UNION ALL SELECT seq, 1, 'x' || seq, 'c' FROM facts WHERE seq % 6 < 2")
def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.rows_of_payload(_payloads(spark, d), "payload")
    return rows.select("seq", "place", evidence.evidence_id(F.col("row")).alias("evidence_id"), evidence.first_text(F.col("row"), evidence.SUPPORT_ORDER).alias("support"))


@_query("reader_projection", f"WITH {SQL_FACTS} SELECT 'ev_fact:' || fact_id AS id, fact_id, 't' || seq AS support_text, floor(quantity)::BIGINT::VARCHAR AS value, 'k' AS unit, 'active' AS status, 'user' AS source_role FROM facts WHERE seq % 6 < 4")
def reader_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.rows_of_payload(_payloads(spark, d), "payload").where("place = 0").withColumn("eid", evidence.evidence_id(F.col("row")))
    return evidence.reader_rows(rows, "eid", "row").select("id", "fact_id", "support_text", "value", "unit", "status", "source_role")


@_query("alias_resolution", f"WITH {SQL_FACTS} SELECT user_id, fact_id AS evidence_id, CASE seq % 4 WHEN 3 THEN 'f' || (seq - 3) WHEN 2 THEN 'f' || (seq - 2) WHEN 1 THEN 'f' || (seq - 1) ELSE fact_id END AS canonical FROM (SELECT 'all' AS user_id, fact_id, seq FROM facts)")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    # Each fact of a run of four lists the next one as its alias.
    nxt = F.when(F.col("seq") % 4 < 3, F.array(F.concat(F.lit("f"), (F.col("seq") + 1).cast("string"))))
    rows = facts(spark, d).select(F.lit("all").alias("user_id"), F.col("fact_id").alias("evidence_id"), nxt.alias("aliases"), F.col("seq").alias("place"))
    return evidence.resolve_aliases(rows, ["user_id"]).select("user_id", "evidence_id", "canonical")


@_query("merged_records", f"""WITH {SQL_FACTS}, v AS (SELECT user_id || ':' || event_type AS key, seq, unnest(['object', 'tag', 'note']) AS field, unnest([object, repeat('x', (seq % 7)::INT), CASE WHEN seq % 2 = 0 THEN 'n' || (seq % 10) ELSE '[]' END]) AS value FROM facts)
SELECT key, field, arg_max(value, (length(value), -seq)) AS value FROM v WHERE value NOT IN ('', '[]') GROUP BY ALL""")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("n"), F.col("seq") % 10)).otherwise("[]")
    row = F.create_map(F.lit("object"), F.col("object"), F.lit("tag"), F.repeat(F.lit("x"), (F.col("seq") % 7).cast("int")), F.lit("note"), n)
    rows = facts(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("seq").alias("place"), row.alias("row"))
    return evidence.merge_records(rows, ["key"]).select("key", F.explode("record").alias("field", "value"))


SQL_OVER = "(contains(lower(coalesce(content, '')), 'lake')::INT + contains(lower(coalesce(content, '')), 'er th')::INT + contains(lower(coalesce(content, '')), 'ing')::INT)"


@_query("ranked_evidence", f"""WITH {SQL_TURNS}, k AS (
  SELECT *, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN -conv_id END AS p, {SQL_OVER} AS rel, (role = 'user')::INT AS usr, turn % 3 AS step FROM turns),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (p IS NOT NULL) DESC, rel DESC, usr DESC, step DESC, place) AS rk FROM k),
f AS (SELECT *, CASE WHEN p IS NOT NULL THEN 0 WHEN row_number() OVER (PARTITION BY user_id, session_id ORDER BY rk) = 1 AND conv_id % 5 <> 0 THEN 1 ELSE 2 END AS phase FROM r)
SELECT * FROM (SELECT user_id, turn_id, row_number() OVER (PARTITION BY user_id ORDER BY phase, p, rk) AS position FROM f) WHERE position <= 24""")
def ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = _placed(spark, d).withColumn("identity", F.when(F.col("conv_id") % 5 != 0, F.col("session_id")).otherwise(""))
    terms = F.array(*map(F.lit, ("lake", "er th", "ing")))
    keys = [evidence.overlap(terms, F.lower(plain(F.col("content")))), (F.col("role") == "user").cast("int"), F.col("idx") % 3]
    preferred = F.when((F.col("idx") == 1) & (F.col("conv_id") % 3 == 0), -F.col("conv_id"))
    return evidence.rank_evidence(t, "user_id", preferred, keys, "identity", "place").select("user_id", "turn_id", F.col("position").cast("long").alias("position"))


@_query("evidence_backfill", f"""WITH {SQL_TURNS}, k AS (
  SELECT *, {SQL_OVER} AS asked, (contains(lower(coalesce(content, '')), 'the')::INT + contains(lower(coalesce(content, '')), 'st an')::INT) AS near, (role = 'user')::INT AS usr, regexp_matches(coalesce(content, ''), '\\b\\d[\\d,]*(\\.\\d+)?\\b')::INT AS num FROM turns WHERE turn <> 0)
SELECT * FROM (SELECT user_id, turn_id, asked + near AS score, row_number() OVER (PARTITION BY user_id ORDER BY asked + near DESC, usr DESC, num DESC, asked DESC, place) AS position FROM k WHERE asked + near > 0) WHERE position <= 6""")
def evidence_backfill(spark: SparkSession, d: str) -> DataFrame:
    t = _placed(spark, d).where("idx <> 0")
    asked, near = F.array(*map(F.lit, ("lake", "er th", "ing"))), F.array(*map(F.lit, ("the", "st an")))
    return evidence.backfill(t, "user_id", asked, near, F.col("content"), "place").select("user_id", "turn_id", F.col("score").cast("long").alias("score"), F.col("position").cast("long").alias("position"))


@_query("enumeration_dedup", """WITH k AS (SELECT source, doc_id, substr(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\p{M}]+', ' ', 'g'), 1, 90) AS key FROM documents),
f AS (SELECT source, min(doc_id) AS doc_id FROM k GROUP BY source, key)
SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM f) WHERE position <= 40""")
def enumeration_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", "text")
    return evidence.dedup_enumeration(rows, ["source"], "text", [F.col("doc_id")], 40).select("source", "doc_id", F.col("position").cast("long").alias("position"))


@_query("messages_once", f"WITH {SQL_TURNS} SELECT session_id, min(turn) AS idx, role FROM turns GROUP BY session_id, role, content")
def messages_once(spark: SparkSession, d: str) -> DataFrame:
    return evidence.once(turns(spark, d), ["session_id", "role", "content"], ["idx"]).select("session_id", "idx", "role")


@_query("fresh_facts", f"WITH {SQL_FACTS} SELECT fact_id FROM facts WHERE seq % 3 <> 0")
def fresh_facts(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return evidence.fresh(f, f.where("seq % 3 = 0"), "fact_id").select("fact_id")


@_query("ordered_union", f"WITH {SQL_FACTS} SELECT fact_id, CASE WHEN object = event_type THEN object ELSE object || ',' || event_type END || CASE WHEN user_id IN (object, event_type) THEN '' ELSE ',' || user_id END AS ids FROM facts")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    lists = evidence.ordered_union(F.array("object", "event_type"), F.array("event_type", "user_id"), F.lit(None).cast("array<string>"))
    return facts(spark, d).select("fact_id", F.array_join(lists, ",").alias("ids"))


@_query("status_gate", f"WITH {SQL_FACTS} SELECT fact_id, CASE WHEN quantity > 60 THEN 'status:archived' WHEN quantity > 30 THEN 'status:superseded' ELSE '' END AS reason FROM facts")
def status_gate(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("status", F.when(F.col("quantity") > 60, "archived").when(F.col("quantity") > 30, "superseded").otherwise("active"))
    eligible, excluded = evidence.gate(f)
    return eligible.select("fact_id", F.lit("").alias("reason")).unionByName(excluded.select("fact_id", "reason"))


@_query("external_dropped", f"WITH {SQL_TURNS} SELECT turn_id FROM turns WHERE role <> 'assistant' OR user_id IN ('u1', 'u2', 'u3') OR (conv_id % 20 = 4)")
def external_dropped(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    question = F.when(u == "u1", "what did you recommend?").when(u == "u2", "your suggestions please").when(u == "u3", "so, in our last conversation").otherwise("where is my bike")
    external = (F.col("role") == "assistant") | (F.col("conv_id") % 20 == 4)
    rows = _placed(spark, d).withColumns({"question": question, "modality": F.when(external, "external_info").otherwise("past_event")})
    return evidence.drop_external(rows, "user_id", "question").select("turn_id")


@_query("reader_pool", f"""WITH {SQL_TURNS}, a AS (SELECT user_id, turn_id, 0 AS part, -place AS pos FROM turns WHERE turn = 1 UNION ALL SELECT user_id, turn_id, 1, place FROM turns),
f AS (SELECT user_id, turn_id, min((part, pos)) AS pos FROM a GROUP BY ALL) SELECT user_id, turn_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, turn_id) AS position FROM f""")
def reader_pool(spark: SparkSession, d: str) -> DataFrame:
    t = _placed(spark, d)
    chosen = t.where("idx = 1").withColumn("place", -F.col("place"))
    return evidence.pool([chosen, t], "user_id", "turn_id", "place").withColumn("position", F.col("position").cast("long"))


@_query("turn_cards", f"WITH {SQL_TURNS} SELECT 'ev_turn:' || turn_id AS id, role, session_id, turn_id, 2 AS tier, sha256(substr(content, 1, 700)) AS preview_hash, length(content) > 700 AS truncated FROM turns")
def turn_cards(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    seen = evidence.project(evidence.turn_cards(t, ingest.spans(t)), "tool")
    return seen.select("id", "role", "session_id", "turn_id", "tier", F.sha2(F.col("content_preview").cast("binary"), 256).alias("preview_hash"), "truncated")


@_query("agent_projection", f"WITH {SQL_TURNS} SELECT 'ev_turn:' || turn_id AS id, session_id FROM turns")
def agent_projection(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return evidence.project(evidence.turn_cards(t, ingest.spans(t)), "agent").select("id", "session_id")


@_query("valid_users", "SELECT s_suppkey, (s_suppkey % 3 <> 1) AS valid FROM supplier")
def valid_users(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    user = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("user.a-b_"), n)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("-no/"), n)).otherwise(n)
    return table(spark, d, "supplier").select("s_suppkey", evidence.valid_user(user).alias("valid"))


SQL_ROUTES = SQL_FACTS + ", hits AS (SELECT user_id AS query_id, event_type AS route, object AS unit, CASE WHEN quantity > 60 THEN 'status:archived' WHEN quantity > 50 THEN 'scope' END AS reason FROM facts)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("quantity") > 60, "status:archived").when(F.col("quantity") > 50, "scope")
    return facts(spark, d).select(F.col("user_id").alias("query_id"), F.col("event_type").alias("route"), F.col("object").alias("unit"), reason.alias("reason"))


@_query("route_counts", f"WITH {SQL_ROUTES} SELECT query_id, route, count(*) AS n_hits, count(DISTINCT unit) AS n_units FROM hits GROUP BY ALL")
def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.route_counts(_hits(spark, d))


@_query("audit_bundle", f"""WITH {SQL_ROUTES}, a AS (SELECT query_id, string_agg(route || '=' || n, ',' ORDER BY route) AS routes FROM (SELECT query_id, route, count(*) AS n FROM hits GROUP BY ALL) GROUP BY query_id),
b AS (SELECT query_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT query_id, reason, count(*) AS n FROM hits WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY query_id)
SELECT query_id, routes, coalesce(reasons, '') AS reasons FROM a LEFT JOIN b USING (query_id)""")
def audit_bundle(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    told = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit(""))
    return evidence.audit(h, h.where(F.col("reason").isNotNull())).select("query_id", told(F.col("routes")).alias("routes"), told(F.col("reasons")).alias("reasons"))


@_query("span_channel", f"""WITH {SQL_TURNS}, h AS (SELECT *, 'span_' || session_id || '_' || turn AS span_id FROM turns WHERE turn < 3),
l AS (SELECT 'span_' || session_id || '_0' AS span_id, turn_id AS fact_id, place FROM turns WHERE turn > 0)
SELECT query_id, unit, head FROM (SELECT user_id AS query_id, fact_id AS unit, 'span:' || h.span_id AS head, row_number() OVER (PARTITION BY user_id, h.span_id ORDER BY l.place, fact_id) AS r FROM h JOIN l ON h.span_id = l.span_id) WHERE r <= 2
UNION ALL SELECT user_id, h.span_id, 'span:' || h.span_id FROM h LEFT JOIN l ON h.span_id = l.span_id WHERE l.span_id IS NULL""")
def span_channel(spark: SparkSession, d: str) -> DataFrame:
    t = _placed(spark, d)
    span = F.concat(F.lit("span_"), "session_id", F.lit("_"), F.col("idx").cast("string"))
    f = t.where("idx > 0").select(F.col("turn_id").alias("fact_id"), F.col("place").alias("seq"), F.array(F.concat(F.lit("span_"), "session_id", F.lit("_0"))).alias("span_ids"))
    hits = t.where("idx < 3").select(F.col("user_id").alias("query_id"), span.alias("span_id"), F.col("idx").alias("rank"))
    return evidence.facts_of_hit_spans(hits, f, 2, orphans=True).select("query_id", "unit", "head")


@_query("request_counters", "SELECT format('requests{{method=\"{}\",route=\"/{}\",status=\"{}\"}} {}', m, event_type, s, n) AS line FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, event_type, CASE WHEN value > 50 THEN '500' ELSE '200' END AS s, count(*) AS n FROM events GROUP BY ALL)")
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select(F.when(F.col("seq") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("route"), F.when(F.col("quantity") > 50, "500").otherwise("200").alias("status"))
    return evidence.exposition(evidence.counters(f), "requests")


@_query("batch_outcomes", f"WITH {SQL_FACTS} SELECT user_id, count(*) FILTER (quantity <= 50) AS succeeded, count(*) FILTER (quantity > 50) AS failed FROM facts GROUP BY user_id")
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.batch_outcome(facts(spark, d).withColumn("ok", F.col("quantity") <= 50), "user_id", "ok")


@_query("compact_trace", f"WITH {SQL_TURNS} SELECT session_id AS question_id, turn AS step, 'search' AS tool, role AS query, turn * 2 AS returned FROM turns UNION ALL SELECT session_id, turn, 'timeline', 'e' || turn, 0 FROM turns")
def compact_trace(spark: SparkSession, d: str) -> DataFrame:
    seen = lambda tool, name, value, n: F.struct(F.lit(tool).alias("tool"), F.create_map(F.lit(name), value).alias("args"), n.cast("long").alias("returned_rows"))
    steps = turns(spark, d).select(F.col("session_id").alias("question_id"), F.col("idx").alias("step"), F.array(seen("search", "query", F.col("role"), F.col("idx") * 2), seen("timeline", "entity", F.concat(F.lit("e"), F.col("idx").cast("string")), F.lit(0))).alias("observations"))
    return evidence.compact_trace(steps)

"""Queries that read, filter, pack and count evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import context, filters, nested, ops
from ..sources.adapters import facts, table, turns

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


SQL_TURNS = "turns AS (SELECT 'u' || (conv_id % 20) AS user_id, 's' || conv_id AS session_id, 's' || conv_id || '_turn_' || turn AS turn_id, turn AS idx, role, text AS content, 1704067200.0::DOUBLE + conv_id * 3600 + turn / 1000.0::DOUBLE AS timestamp FROM conversations)"
SQL_FACTS = "facts AS (SELECT 'f' || event_id AS fact_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) AS valid_from, value AS quantity, json_extract_string(props, '$.k') AS object, event_id AS seq, strftime(ts, '%Y-%m-%d') AS day FROM events)"
SQL_SCOPE = "scope AS (SELECT DISTINCT 'u' || (conv_id % 20) AS user_id, 's' || conv_id AS session_id, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a' ELSE 'b' END AS agent_id FROM conversations)"


@_query("scope_narrow", f"WITH {SQL_TURNS}, {SQL_SCOPE} SELECT turn_id FROM turns LEFT JOIN scope USING (user_id, session_id) WHERE agent_id IS NULL OR agent_id IN ('', 'a')")
def scope_narrow(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    n = F.substring("session_id", 2, 20).cast("long") % 4
    scope = t.select("user_id", "session_id").distinct().select("*", F.when(n == 1, "").when(n == 2, "a").when(n == 3, "b").alias("agent_id"))
    return filters.narrow(t, scope, {"agent_id": "a"}).select("turn_id")


@_query("refine_filter", """
SELECT o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('O', 'P') AND l_returnflag = 'N' AND l_quantity >= 10 AND (l_shipdate IS NULL OR l_shipdate >= DATE '1996-01-01') AND contains(lower(o_orderpriority), 'high')
AND NOT contains(lower(l_linestatus), 'f')""")
def refine_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wanted = filters.Refinement(
        equal={"o_orderstatus": ["O", "P"], "l_returnflag": ["N"]}, least={"l_quantity": 10},
        valid_from={"l_shipdate": F.lit("1996-01-01").cast("timestamp")}, include={"o_orderpriority": ["HIGH"]}, exclude={"l_linestatus": ["f"]},
    )
    return filters.refine(rows, wanted).select("o_orderkey", "l_linenumber", "l_partkey")


@_query("raw_window", f"WITH {SQL_FACTS} SELECT fact_id FROM facts WHERE (CASE WHEN event_type = 'error' THEN NULL ELSE valid_from END) IS NULL OR valid_from BETWEEN 1704672000000000 AND 1705276799999999")
def raw_window(spark: SparkSession, d: str) -> DataFrame:
    seen = facts(spark, d).withColumn("session_time", F.when(F.col("event_type") != "error", F.col("valid_from")))
    low, high = (int(filters.boundary(x, upper=u) * 1_000_000) for x, u in (("2024-01-08", False), ("2024-01-14", True)))
    return filters.window(seen, "session_time", low, high).select("fact_id")


@_query("multi_get", f"WITH {SQL_TURNS} SELECT t.turn_id, i.pos::INT AS pos, t.role FROM (SELECT unnest(['s3_turn_1', 's1_turn_0', 'missing', 's2_turn_2']) AS turn_id, unnest([0, 1, 2, 3]) AS pos) i JOIN turns t ON i.turn_id = t.turn_id")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return filters.multi_get(turns(spark, d), "turn_id", ["s3_turn_1", "s1_turn_0", "missing", "s2_turn_2"]).select("turn_id", "pos", "role")


@_query("session_history", f"WITH {SQL_TURNS} SELECT user_id, session_id, string_agg(role || ': ' || content, chr(10) ORDER BY timestamp, turn_id) AS text, count(*) AS n_rows FROM turns GROUP BY ALL")
def session_history(spark: SparkSession, d: str) -> DataFrame:
    return context.ordered_text(turns(spark, d), ["user_id", "session_id"], ["timestamp", "turn_id"], F.concat_ws(": ", "role", "content"), "\n")


@_query("session_summary", f"WITH {SQL_TURNS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY timestamp, turn_id) AS r FROM turns) SELECT user_id, session_id, left(string_agg(content, ' ' ORDER BY timestamp, turn_id), 1800) AS text, count(*) AS n_rows FROM f WHERE r <= 12 GROUP BY ALL")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return context.ordered_text(turns(spark, d), ["user_id", "session_id"], ["timestamp", "turn_id"], F.col("content"), " ", most_rows=12, most_chars=1800)


@_query("entity_profile", f"WITH {SQL_FACTS} SELECT user_id, left(string_agg(event_type || ' ' || object, ' | ' ORDER BY valid_from, fact_id), 1800) AS text, count(*) AS n_rows FROM facts GROUP BY ALL")
def entity_profile(spark: SparkSession, d: str) -> DataFrame:
    return context.ordered_text(facts(spark, d), ["user_id"], ["valid_from", "fact_id"], F.concat_ws(" ", "event_type", "object"), " | ", most_chars=1800)


@_query("context_pack", """
WITH c AS (SELECT source, doc_id, row_number() OVER w AS position, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id))
SELECT source, doc_id, position, used FROM c WHERE used - 1 <= 4000""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = context.budget(table(spark, d, "documents"), ["source"], [F.col("n_chars"), F.col("doc_id")], F.col("text"), 1000)
    return packed.select("source", "doc_id", F.col("position").cast("long").alias("position"), "used")


@_query("reader_dedup", r"""
WITH k AS (SELECT doc_id, lang, n_chars, left(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')), 400) AS key FROM documents WHERE text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY CASE WHEN n_chars > 1000 THEN 0 ELSE 1 END, doc_id) AS r, min(doc_id) OVER (PARTITION BY lang, key) AS slot FROM k)
SELECT doc_id, slot FROM r WHERE r = 1""")
def reader_dedup(spark: SparkSession, d: str) -> DataFrame:
    return context.dedup_rows(table(spark, d, "documents"), ["lang"], "text", F.col("n_chars") > 1000, "doc_id").select("doc_id", "slot")


@_query("count_roster", """
WITH h AS (SELECT doc_id, term, pos FROM documents JOIN (SELECT unnest(['schen', 'tion', 'que', 'anon']) AS term, unnest([1, 2, 3, 4]) AS pos) ON contains(lower(text), term))
SELECT doc_id, string_agg(term, ',' ORDER BY pos) AS labels FROM h GROUP BY doc_id""")
def count_roster(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    terms = ["schen", "tion", "que", "anon"]
    hits = docs.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(F.col("t").contains(x), F.struct(F.lit(x).alias("label"), F.lit(k).alias("seen"))) for k, x in enumerate(terms)))))
                       .alias("h")).select("doc_id", "h.label", "h.seen", F.lit(None).cast("string").alias("day"))
    return context.roster(hits, "doc_id", "label", "day", "seen").select("doc_id", F.array_join("labels", ",").alias("labels"))


@_query("dated_roster", f"""
WITH {SQL_FACTS}, h AS (SELECT user_id, fact_id, seq, CASE WHEN event_type <> 'error' THEN strftime(make_timestamp(valid_from), '%Y-%m-%d') END AS day, pos, label FROM facts
  JOIN (SELECT unnest(['sign', 'e', 'r']) AS label, unnest([1, 2, 3]) AS pos) ON contains(event_type, label)),
f AS (SELECT user_id, fact_id, string_agg(label, ',' ORDER BY pos) AS labels, min(day) AS day, min(seq * 10 + pos) AS s FROM h GROUP BY ALL)
SELECT user_id, fact_id, labels, coalesce(day, '') AS day, row_number() OVER (PARTITION BY user_id ORDER BY day NULLS LAST, s, fact_id) AS position FROM f""")
def dated_roster(spark: SparkSession, d: str) -> DataFrame:
    """Each user's facts with their labels by day, undated ones last."""
    day = F.when(F.col("event_type") != "error", F.date_format(F.timestamp_micros("valid_from"), "yyyy-MM-dd"))
    labels = F.array_compact(F.array(*(F.when(F.col("event_type").contains(x), F.struct(F.lit(x).alias("label"), F.lit(k).alias("pos"))) for k, x in enumerate(("sign", "e", "r"), 1))))
    hits = facts(spark, d).select("user_id", "fact_id", day.alias("day"), "seq", F.explode(labels).alias("h")).select("user_id", "fact_id", "day", "h.label", (F.col("seq") * 10 + F.col("h.pos")).alias("seen"))
    rows = context.roster(hits, "fact_id", "label", "day", "seen", ["user_id"])
    return rows.select("user_id", "fact_id", F.array_join("labels", ",").alias("labels"), F.coalesce("day", F.lit("")).alias("day"), F.col("position").cast("long").alias("position"))


@_query("event_timeline_groups", f"WITH {SQL_FACTS} SELECT event_type, fact_id, position FROM (SELECT event_type, fact_id, row_number() OVER (PARTITION BY event_type ORDER BY valid_from DESC, seq) AS position FROM facts) WHERE position <= 5")
def event_timeline_groups(spark: SparkSession, d: str) -> DataFrame:
    return ops.tail(facts(spark, d), ["event_type"], [F.desc("valid_from"), F.col("seq")], 5).select("event_type", "fact_id", F.col("position").cast("long").alias("position"))


@_query("enumeration_sweep", r"""
WITH s AS (SELECT turn, conv_id, text, (contains(lower(text), 'thering') OR regexp_matches(lower(text), '\btherin\w*'))::INT + (contains(lower(text), 'anon') OR regexp_matches(lower(text), '\banon\w*'))::INT AS n_hits FROM conversations)
SELECT conv_id, turn, n_hits FROM s WHERE n_hits > 0""")
def enumeration_sweep(spark: SparkSession, d: str) -> DataFrame:
    hits = context.sweep(table(spark, d, "conversations"), "text", ["thering"], ["anon"])
    return hits.where(F.col("n_hits") > 0).select("conv_id", "turn", "n_hits")


@_query("value_board", f"WITH {SQL_FACTS}, s AS (SELECT *, (quantity > 50)::INT + (event_type = 'purchase')::INT AS score FROM facts) SELECT user_id, fact_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, score DESC, quantity DESC) AS position FROM s) WHERE position <= 8")
def value_board(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("quantity") > 50).cast("int") + (F.col("event_type") == "purchase").cast("int")
    return context.value_board(facts(spark, d), ["user_id"], "quantity", "valid_from", score).select("user_id", "fact_id", "score", F.col("position").cast("long").alias("position"))


@_query("polarity_modality", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '""" + tx.NEGATION.replace("'", "''") + r"""') THEN 'negative' ELSE 'positive' END AS polarity,
CASE WHEN regexp_matches(text, '""" + tx.STATE_CHANGE + r"""') THEN 'current_state' ELSE 'past_event' END AS modality FROM conversations""")
def polarity_modality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tx.polarity(F.col("text")).alias("polarity"), tx.modality(F.lit("past_event"), F.col("text")).alias("modality"))


@_query("quantity_canonical", "SELECT event_id, value, round(CASE event_id % 3 WHEN 0 THEN value * 60 WHEN 1 THEN value * 1000 ELSE NULL END, 2) AS canonical, CASE event_id % 3 WHEN 0 THEN 'minute' WHEN 1 THEN 'gram' END AS unit FROM (SELECT event_id, floor(value)::DOUBLE AS value FROM events)")
def quantity_canonical(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.floor("value").cast("double").alias("value"))
    said = F.concat(F.lit("about "), F.col("value").cast("long").cast("string"), F.when(F.col("event_id") % 3 == 0, " hours of it").when(F.col("event_id") % 3 == 1, " kg of it").otherwise(" of them"))
    q = tx.quantity_canonical(F.col("value"), said)
    return e.select("event_id", "value", F.round(q["value"], 2).alias("canonical"), q["unit"].alias("unit"))


@_query("canonical_predicates", "SELECT o_orderkey, trim(regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS predicate FROM orders")
def canonical_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tx.canonical_predicate(F.col("o_orderpriority"), F.lit("other"), F.lit("fact")).alias("predicate"))


@_query("date_diff_calc", "WITH x AS (SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, l_linenumber, days::BIGINT AS days, CASE WHEN days >= 0 THEN 'after' ELSE 'before' END AS direction, round(days / 30.4375, 2) AS months_approx FROM x")
def date_diff_calc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    calc = filters.date_difference(F.col("o_orderdate"), F.col("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", calc["days"].alias("days"), calc["direction"].alias("direction"), calc["months_approx"].alias("months_approx"))


@_query("latency_percentiles", f"WITH {SQL_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seq DESC) AS r FROM facts) SELECT event_type, count(*) AS n, min(quantity) AS least, quantile_disc(quantity, 0.5) AS p50, quantile_disc(quantity, 0.95) AS p95, quantile_disc(quantity, 0.99) AS p99, max(quantity) AS most FROM r WHERE r <= 1024 GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ops.latency(facts(spark, d), "event_type", "quantity", "seq")


@_query("bounded_tail", f"WITH {SQL_FACTS} SELECT user_id, fact_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS position FROM facts) WHERE position <= 10")
def bounded_tail(spark: SparkSession, d: str) -> DataFrame:
    return ops.tail(facts(spark, d), ["user_id"], [F.desc("seq")], 10).select("user_id", "fact_id", F.col("position").cast("long").alias("position"))


@_query("event_feed", f"WITH {SQL_FACTS}, a AS (SELECT fact_id, CASE event_type WHEN 'signup' THEN 'extract' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'supersede' ELSE 'extract_window' END AS action FROM facts) SELECT fact_id, action, CASE action WHEN 'extract' THEN 'memory_add' WHEN 'delete' THEN 'memory_delete' ELSE 'memory_supersede' END AS change FROM a WHERE action <> 'extract_window'")
def event_feed(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "extract").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "supersede").otherwise("extract_window")
    return ops.feed(facts(spark, d).select("fact_id", action.alias("action")), "action")


@_query("event_feed_page", f"WITH {SQL_FACTS} SELECT user_id, fact_id, total, position FROM (SELECT user_id, fact_id, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, seq DESC) AS position FROM facts) WHERE position BETWEEN 6 AND 10")
def event_feed_page(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(facts(spark, d), ["user_id"], [F.desc("valid_from"), F.desc("seq")], 5, 5).select("user_id", "fact_id", "total", F.col("position").cast("long").alias("position"))


@_query("paired_mcnemar", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels)
SELECT n, b, c, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, least(b, c) + 1) t(i))), 6) AS p FROM c""")
def paired_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    anchor, run = (labels.select("doc_id", (F.col(c) == 1).alias("label")) for c in ("quality", "toxic"))
    return ops.mcnemar(anchor, run, "doc_id").withColumn("p", F.round("p", 6))


@_query("store_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "conversations", "events", "labels", "pages", "orders", "lineitem", "part")))
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.counts({t: table(spark, d, t) for t in ("documents", "conversations", "events", "labels", "pages", "orders", "lineitem", "part")})


@_query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("usage_trees", f"""
WITH {SQL_FACTS}, m AS (SELECT user_id, event_type, 'm' || (seq % 3) AS model, min(seq) AS s FROM facts GROUP BY ALL)
SELECT user_id, 'calls' AS path, count(*)::VARCHAR AS value FROM facts GROUP BY user_id
UNION ALL SELECT user_id, 'phases.' || event_type || '.tokens', sum(floor(quantity)::BIGINT)::VARCHAR FROM facts GROUP BY user_id, event_type
UNION ALL SELECT user_id, 'phases.' || event_type || '.detail', '[' || string_agg(seq, ',' ORDER BY seq) || ']' FROM facts GROUP BY user_id, event_type
UNION ALL SELECT user_id, 'phases.' || event_type || '.models', '[' || string_agg('"' || model || '"', ',' ORDER BY s) || ']' FROM m GROUP BY user_id, event_type""")
def usage_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees of usage, three levels deep, merged by user: numbers added, lists joined, models once each."""
    text = F.format_string('{"calls": 1, "phases": {"%s": {"tokens": %d, "detail": [%d], "models": ["m%d"]}}}', "event_type", F.floor("quantity"), "seq", F.col("seq") % 3)
    rows = facts(spark, d).select("user_id", "seq", text.alias("tree"))
    return nested.merged(rows, ["user_id"], "seq", "tree", ["models"]).select("user_id", nested.names(F.col("path")).alias("path"), "value")


@_query("aliased_trees", f"""
WITH {SQL_FACTS}, a AS (SELECT *, 'e' || row_number() OVER (PARTITION BY user_id ORDER BY seq) AS alias FROM facts),
n AS (SELECT *, lead(alias) OVER (PARTITION BY user_id ORDER BY seq) AS nxt FROM a)
SELECT fact_id, '{{"id":"' || alias || '","kind":"' || event_type || '","near":{{"ids":["' || alias || '"' || coalesce(',"' || nxt || '"', '') || '],"n":' || seq || '}}}}' AS tree FROM n""")
def aliased_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees that name facts, with the short ids that these have for their user."""
    by = Window.partitionBy("user_id").orderBy("seq")
    f = facts(spark, d).select("user_id", "fact_id", "seq", "event_type", F.lead("fact_id").over(by).alias("_next"), F.concat(F.lit("e"), F.row_number().over(by).cast("string")).alias("alias"))
    near = F.struct(F.array_compact(F.array("fact_id", "_next")).alias("ids"), F.col("seq").alias("n"))
    rows = f.select("user_id", "fact_id", F.to_json(F.struct(F.col("fact_id").alias("id"), F.col("event_type").alias("kind"), near.alias("near"))).alias("_t"))
    return nested.aliased(rows, ["user_id", "fact_id"], "_t", f.select("user_id", "fact_id", "alias"), "fact_id", "alias", ["user_id"]).select("fact_id", F.col("json").alias("tree"))


@_query("usage_merge", f"WITH {SQL_FACTS} SELECT user_id, sum(floor(quantity)::BIGINT)::BIGINT AS tokens, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models FROM facts GROUP BY user_id")
def usage_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).select("user_id", F.floor("quantity").alias("tokens"), F.col("event_type").alias("models"))
    return ops.usage(rows, ["user_id"], ["tokens"], ["models"]).withColumn("models", F.array_join("models", ","))


@_query("run_summary", f"WITH {SQL_FACTS}, l AS (SELECT object, arg_max((quantity > 50, event_type), seq) AS r FROM facts GROUP BY object) SELECT r[2] AS category, count(*) FILTER (r[1]) AS n_correct, count(*) AS n_answered, round(avg(r[1]::INT), 4) AS accuracy FROM l GROUP BY r[2]")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).select("object", "seq", (F.col("quantity") > 50).alias("correct"), F.col("event_type").alias("category"))
    return ops.run_summary(rows, "object", "seq", "correct", "category")


@_query("plan_gates", f"""
WITH {SQL_FACTS}, p AS (
  SELECT seq, coalesce(TRY_CAST(['high', '0.55', '0.9', NULL, '0.3', '0.75', ''][seq % 7 + 1] AS DOUBLE), 0) AS c, ['current_value', 'enumeration', 'sum', 'historical_value', 'other'][seq % 5 + 1] AS shape,
    ['current', 'latest', 'past'][seq % 3 + 1] AS intent, event_type AS metric, CASE WHEN seq % 11 <> 0 THEN 'number' ELSE '' END AS kind, object FROM facts)
SELECT seq, c >= 0.55 AND shape IN ('current_value', 'historical_value') AND intent <> 'past' AND metric <> '' AND kind <> '' AS board,
  seq % 2 = 0 AND c >= 0.55 AND shape IN ('enumeration', 'sum') AND (seq % 4 = 0 OR (seq % 13 <> 0 AND coalesce(object, '') <> '')) AS sweep FROM p""")
def plan_gates(spark: SparkSession, d: str) -> DataFrame:
    def one_of(*values: str | None) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.col("seq") % len(values)).cast("int"))

    plan = F.struct(
        one_of("high", "0.55", "0.9", None, "0.3", "0.75", "").alias("confidence"), one_of("current_value", "enumeration", "sum", "historical_value", "other").alias("answer_shape"), one_of("current", "latest", "past").alias("temporal_intent"),
        F.col("event_type").alias("metric"), F.when(F.col("seq") % 11 != 0, "number").otherwise("").alias("value_type"), (F.col("seq") % 2 == 0).alias("requires_sweep"),
        F.when(F.col("seq") % 13 != 0, F.col("object")).alias("object_type"), F.when(F.col("seq") % 4 == 0, F.array(F.lit("buy"))).alias("actions"),
    )
    rows = facts(spark, d).select("seq", plan.alias("plan"))
    return rows.select("seq", context.board_is_due(F.col("plan")).alias("board"), context.sweep_is_due(F.col("plan")).alias("sweep"))

"""Queries over changes: explicit supersession, archives, purges, summaries, scans, items to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, items, maintenance
from ..sources.adapters import facts, graph, table, turns

QUERIES: dict = {}
ORACLES: dict = {}

AT = 1705276800000000  # 2024-01-15T00:00:00Z in microseconds
LATER = 1705881600000000

SQL_FACTS = """facts AS (
  SELECT 'f' || event_id AS fact_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) AS valid_from, value AS quantity, json_extract_string(props, '$.k') AS object, event_id AS seq FROM events)"""
SQL_TURNS = """turns AS (
  SELECT 'u' || (conv_id % 20) AS user_id, 's' || conv_id AS session_id, 's' || conv_id || '_turn_' || turn AS turn_id, conv_id, turn, role, text AS content,
         1704067200.0::DOUBLE + conv_id * 3600 + turn / 1000.0::DOUBLE AS timestamp FROM conversations)"""
SQL_SPANS = SQL_TURNS + ", spans AS (SELECT *, 'span_' || session_id || '_' || turn AS span_id, timestamp AS session_time FROM turns WHERE trim(content) <> '')"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """facts as a store holds them: status and the times of the model."""
    none = F.lit(None).cast("long")
    return facts(spark, d).withColumns({"status": F.when(F.col("quantity") > 90, "archived").otherwise("active"), "valid_until": none, "occurred_start": none})


def _supersede(spark: SparkSession, d: str):
    f = _stored(spark, d)
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    winner = F.when(F.col("seq") % 40 == 0, F.col("seq")).when(F.col("seq") % 40 == 20, F.lit(-1)).otherwise(F.col("seq") + F.col("seq") % 150)
    asked = f.where(F.col("seq") % 10 == 0).select("user_id", F.col("fact_id").alias("loser_id"), name(winner).alias("winner_id"))
    return maintenance.supersede_explicitly(f, asked)


SQL_ASKED = SQL_FACTS + """,
asked AS (SELECT user_id, fact_id AS loser_id, 'f' || CASE WHEN seq % 40 = 0 THEN seq WHEN seq % 40 = 20 THEN -1 ELSE seq + seq % 150 END AS winner_id FROM facts WHERE seq % 10 = 0),
judged AS (
  SELECT a.*, w.valid_from AS start, CASE WHEN a.loser_id = a.winner_id THEN 'self' WHEN w.fact_id IS NULL THEN 'unknown winner' WHEN w.user_id <> a.user_id THEN 'other user' END AS reason
  FROM asked a LEFT JOIN facts w ON a.winner_id = w.fact_id)"""


@_query("explicit_supersede", f"""WITH {SQL_ASKED}
SELECT fact_id, CASE WHEN j.loser_id IS NOT NULL THEN 'superseded' WHEN quantity > 90 THEN 'archived' ELSE 'active' END AS status, coalesce(j.start, -1) AS valid_until
FROM facts LEFT JOIN judged j ON fact_id = j.loser_id AND reason IS NULL""")
def explicit_supersede(spark: SparkSession, d: str) -> DataFrame:
    return _supersede(spark, d)[0].select("fact_id", "status", F.coalesce("valid_until", F.lit(-1).cast("long")).alias("valid_until"))


@_query("explicit_supersede_edges", f"WITH {SQL_ASKED} SELECT winner_id AS src, 'SUPERSEDES' AS edge_type, loser_id AS dst, 1.0::DOUBLE AS confidence, 'done' AS outcome FROM judged WHERE reason IS NULL UNION ALL SELECT winner_id, 'SUPERSEDES', loser_id, 0.0, reason FROM judged WHERE reason IS NOT NULL")
def explicit_supersede_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges, refused = _supersede(spark, d)
    done = edges.select("src", "edge_type", "dst", "confidence", F.lit("done").alias("outcome"))
    return done.unionByName(refused.select(F.col("winner_id").alias("src"), F.lit("SUPERSEDES").alias("edge_type"), F.col("loser_id").alias("dst"), F.lit(0.0).alias("confidence"), F.col("reason").alias("outcome")))


def _archive(spark: SparkSession, d: str):
    f = _stored(spark, d)
    user = F.when(F.col("seq") % 14 == 0, "nobody").otherwise(F.col("user_id"))
    asked = f.where(F.col("seq") % 7 == 0).select(user.alias("user_id"), F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), "fact_id")).otherwise(F.col("fact_id")).alias("fact_id"))
    return maintenance.archive(f, asked)


@_query("archive_outcomes", f"""WITH {SQL_FACTS}
SELECT CASE WHEN seq % 14 = 0 THEN 'nobody' ELSE user_id END AS user_id, CASE WHEN seq % 5 = 0 THEN 'x' || fact_id ELSE fact_id END AS fact_id,
  CASE WHEN seq % 5 = 0 THEN 'missing' WHEN seq % 14 = 0 THEN 'refused' WHEN quantity > 90 THEN 'already' ELSE 'archived' END AS outcome FROM facts WHERE seq % 7 = 0""")
def archive_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d)[1]


@_query("archive_facts", f"WITH {SQL_FACTS} SELECT fact_id, CASE WHEN quantity > 90 OR (seq % 7 = 0 AND seq % 14 <> 0 AND seq % 5 <> 0) THEN 'archived' ELSE 'active' END AS status FROM facts")
def archive_facts(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d)[0].select("fact_id", "status")


@_query("purge_cascade", """
SELECT 'facts' AS name, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'roles', count(*) FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'edges', (SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 5 <> 0))
  + (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)""")
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("fact_id"), "s_nationkey", "s_suppkey")
    left = maintenance.purge(suppliers.where("s_suppkey % 5 = 0"), suppliers, suppliers.select("fact_id", "s_nationkey"), graph(spark, d))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in zip(("facts", "roles", "edges"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# One summary a user and type; what came after AT made it dirty.
SQL_SUMMARIES = SQL_FACTS + f""",
summaries AS (
  SELECT user_id, event_type AS scope_id, user_id || ':' || event_type AS summary_id, CASE WHEN event_type = 'error' THEN 'archived' ELSE 'active' END AS status,
         coalesce(bool_or(valid_from >= {AT}), false) AND user_id NOT LIKE '%5' AS dirty, count(*) AS scope_revision, count(*) FILTER (valid_from < {AT} OR user_id LIKE '%5') AS built, max(valid_from) AS updated_at
  FROM facts GROUP BY user_id, event_type)"""


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.col("user_id").endswith("5")
    per = facts(spark, d).groupBy("user_id", F.col("event_type").alias("scope_id")).agg(
        F.max(F.col("valid_from") >= AT).alias("_late"), F.count(F.lit(1)).alias("scope_revision"), F.count_if((F.col("valid_from") < AT) | fixed).alias("built_from_revision"), F.max("valid_from").alias("updated_at"))
    return per.select(
        "user_id", F.lit("type").alias("scope_type"), "scope_id", F.concat_ws(":", "user_id", "scope_id").alias("summary_id"), F.lit("").alias("text"),
        F.when(F.col("scope_id") == "error", "archived").otherwise("active").alias("status"), (F.col("_late") & ~fixed).alias("dirty"), F.array().cast("array<string>").alias("dirty_reason"),
        "scope_revision", "built_from_revision", "updated_at",
    )


@_query("summaries_scan", f"""WITH {SQL_SUMMARIES}, m AS (
  SELECT 'all' AS mode, * FROM summaries UNION ALL SELECT 'active', * FROM summaries WHERE status = 'active'
  UNION ALL SELECT 'routing', * FROM summaries WHERE status = 'active' AND NOT dirty AND built = scope_revision)
SELECT mode, summary_id, row_number() OVER (PARTITION BY mode, user_id ORDER BY updated_at DESC, summary_id) AS position FROM m""")
def summaries_scan(spark: SparkSession, d: str) -> DataFrame:
    s = _summaries(spark, d)
    parts = [maintenance.scan_summaries(s, mode).select(F.lit(mode).alias("mode"), "summary_id", F.col("position").cast("long").alias("position")) for mode in ("all", "active", "routing")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("summaries_dirty", f"""WITH {SQL_SUMMARIES}, c AS (SELECT user_id, event_type AS scope_id, count(*) AS n, string_agg('add:' || fact_id, ',' ORDER BY seq) AS why FROM facts WHERE quantity > 70 GROUP BY ALL)
SELECT summary_id, dirty OR (n IS NOT NULL AND status = 'active') AS dirty, scope_revision + CASE WHEN n IS NOT NULL AND status = 'active' THEN n ELSE 0 END AS scope_revision,
  CASE WHEN status = 'active' THEN coalesce(why, '') ELSE '' END AS reasons FROM summaries LEFT JOIN c USING (user_id, scope_id)""")
def summaries_dirty(spark: SparkSession, d: str) -> DataFrame:
    changes = facts(spark, d).where("quantity > 70").select("user_id", F.lit("type").alias("scope_type"), F.col("event_type").alias("scope_id"), F.concat(F.lit("add:"), "fact_id").alias("reason"), "seq")
    return maintenance.mark_dirty(_summaries(spark, d), changes, F.lit(AT)).select("summary_id", "dirty", "scope_revision", F.array_join("dirty_reason", ",").alias("reasons"))


@_query("summaries_commit", f"""WITH {SQL_SUMMARIES}
SELECT summary_id, CASE WHEN scope_id = 'view' THEN dirty ELSE scope_id = 'click' END AS dirty, CASE WHEN scope_id = 'view' THEN built WHEN scope_id = 'click' THEN scope_revision - 1 ELSE scope_revision END AS built_from_revision,
  CASE WHEN scope_id = 'view' THEN status ELSE 'active' END AS status FROM summaries
UNION ALL SELECT DISTINCT user_id || ':new', false, 1, 'active' FROM summaries""")
def summaries_commit(spark: SparkSession, d: str) -> DataFrame:
    s = _summaries(spark, d)
    revision = F.col("scope_revision") - F.when(F.col("scope_id") == "click", 1).otherwise(0)
    built = s.where("scope_id <> 'view'").select("user_id", "scope_type", "scope_id", "summary_id", F.lit("text").alias("text"), revision.alias("built_from_revision"))
    new = s.select("user_id").distinct().select("user_id", F.lit("user").alias("scope_type"), F.lit("all").alias("scope_id"), F.concat(F.col("user_id"), F.lit(":new")).alias("summary_id"), F.lit("text").alias("text"), F.lit(1).cast("long").alias("built_from_revision"))
    return maintenance.commit_summaries(s, built.unionByName(new), F.lit(LATER)).select("summary_id", "dirty", "built_from_revision", "status")


@_query("summaries_archive_empty", f"WITH {SQL_SUMMARIES}, alive AS (SELECT DISTINCT user_id, event_type AS scope_id FROM facts WHERE quantity > 60) SELECT summary_id, CASE WHEN a.user_id IS NULL THEN 'archived' ELSE status END AS status, dirty AND NOT (status = 'active' AND a.user_id IS NULL) AS dirty FROM summaries s LEFT JOIN alive a USING (user_id, scope_id)")
def summaries_archive_empty(spark: SparkSession, d: str) -> DataFrame:
    alive = facts(spark, d).where("quantity > 60").select("user_id", F.lit("type").alias("scope_type"), F.col("event_type").alias("scope_id"))
    return maintenance.archive_empty(_summaries(spark, d), alive).select("summary_id", "status", "dirty")


@_query("summary_dependents", f"WITH {SQL_FACTS} SELECT DISTINCT user_id || ':' || event_type AS summary_id FROM facts WHERE quantity > 45")
def summary_dependents(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumns({"object_type": F.lit("fact"), "object_id": F.col("fact_id"), "summary_id": F.concat_ws(":", "user_id", "event_type")})
    return maintenance.dependents(f, f.where("quantity > 45"))


@_query("facts_scan", f"""WITH {SQL_FACTS}, k AS (SELECT *, CASE event_type WHEN 'view' THEN 'state' ELSE 'event' END AS kind, valid_from + 864000000000 AS ends FROM facts WHERE quantity <= 90)
SELECT fact_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position FROM k WHERE NOT (kind = 'state' AND ends < {LATER})""")
def facts_scan(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d).withColumns({"kind": F.when(F.col("event_type") == "view", "state").otherwise("event"), "valid_until": F.col("valid_from") + 864000000000})
    return maintenance.scan(stored, F.lit(LATER)).select("fact_id", F.col("position").cast("long").alias("position"))


@_query("registry_by_mentions", f"WITH {SQL_FACTS}, e AS (SELECT user_id, event_type || '_' || object AS entity_id, count(*) AS mention_count FROM facts GROUP BY ALL) SELECT user_id, entity_id, mention_count, row_number() OVER (PARTITION BY user_id ORDER BY mention_count DESC, entity_id) AS position FROM e")
def registry_by_mentions(spark: SparkSession, d: str) -> DataFrame:
    e = facts(spark, d).groupBy("user_id", F.concat_ws("_", "event_type", "object").alias("entity_id")).agg(F.count(F.lit(1)).alias("mention_count"))
    return maintenance.registry_order(e).withColumn("position", F.col("position").cast("long"))


@_query("turns_in_order", f"WITH {SQL_TURNS} SELECT turn_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, turn_id) AS position FROM turns")
def turns_in_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    return turns(spark, d).select("turn_id", F.row_number().over(Window.partitionBy("user_id").orderBy("timestamp", "turn_id")).cast("long").alias("position"))


@_query("sibling_spans", f"WITH {SQL_TURNS}, l AS (SELECT turn_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM turns) SELECT turn_id, 'span_' || turn_id || '_' || (k - 1) AS span_id, sha256(line) AS text_hash, k AS position FROM l")
def sibling_spans(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("content", "\n", -1)
    each = turns(spark, d).where(F.col("content").isNotNull()).select("turn_id", lines.alias("_l")).select("turn_id", F.posexplode("_l").alias("k", "text"), "_l")
    start = F.when(F.col("k") > 0, F.length(F.array_join(F.slice("_l", F.lit(1), F.greatest(F.lit(1), F.col("k"))), "\n")) + 1).otherwise(0)
    spans = each.select("turn_id", F.concat_ws("_", F.lit("span"), "turn_id", F.col("k").cast("string")).alias("span_id"), start.alias("char_start"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    return maintenance.sibling_spans(spans).select("turn_id", "span_id", "text_hash", F.col("position").cast("long").alias("position"))


@_query("reindex_missing", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def reindex_missing(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return maintenance.missing_vectors(table(spark, d, "documents").select("doc_id", "text"), vectors, "doc_id", "text").select("doc_id")


@_query("span_to_facts", f"WITH {SQL_SPANS}, l AS (SELECT span_id, turn_id AS fact_id, conv_id * 1000 + turn AS seq FROM spans UNION SELECT 'span_' || session_id || '_' || (turn - 1), turn_id, conv_id * 1000 + turn FROM spans) SELECT l.span_id, l.fact_id, l.seq FROM l JOIN spans s ON l.span_id = s.span_id WHERE s.role = 'user'")
def span_to_facts(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    before = F.concat(F.lit("span_"), "session_id", F.lit("_"), (F.col("idx") - 1).cast("string"))
    f = s.select(F.col("turn_id").alias("fact_id"), (F.substring("session_id", 2, 20).cast("long") * 1000 + F.col("idx")).alias("seq"), F.array("span_id", before).alias("span_ids"))
    return maintenance.facts_of_spans(f, s.where("role = 'user'"))


@_query("mention_targets", f"WITH {SQL_SPANS} SELECT 'm' || s.turn_id AS mention_id, sha256(p.content) AS span_hash, s.role AS predicate FROM spans s LEFT JOIN spans p ON p.span_id = 'span_' || s.session_id || '_' || (s.turn - 1)")
def mention_targets(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    before = F.concat(F.lit("span_"), "session_id", F.lit("_"), (F.col("idx") - 1).cast("string"))
    mentions = s.select(F.concat(F.lit("m"), "turn_id").alias("mention_id"), before.alias("span_id"), F.col("turn_id").alias("fact_id"))
    found = maintenance.targets_of_mentions(mentions, s, s.select(F.col("turn_id").alias("fact_id"), F.col("role").alias("predicate")))
    return found.select("mention_id", F.sha2(F.col("span_text").cast("binary"), 256).alias("span_hash"), "predicate")


# Wordings, one a turn, with what they should come out as.
PHRASES = (
    ("moved to a new flat yesterday", "yesterday"), ("actually the meeting is on another day", ""), ("maybe likes tea", ""), ("no longer drinks coffee", ""),
    ("went to the lake", "3 days ago"), ("has three cats", "session_date"), ("visited an aunt", "before session_date"),
)


def _items(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    n = (F.substring("session_id", 2, 20).cast("long") + F.col("idx")) % len(PHRASES)
    pick = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in PHRASES)), (n + 1).cast("int"))
    kind = F.when(n == 0, "state").when(n == 2, "preference").otherwise("event")
    return s.select(
        F.col("turn_id").alias("item_id"), "user_id", "session_id", "span_id", "role", "session_time", F.date_format(F.timestamp_seconds("session_time"), "yyyy-MM-dd").alias("session_date"), pick(0).alias("predicate_raw"),
        F.lit("other").alias("event_type"), kind.alias("kind"), F.lit("past_event").alias("modality"), F.lit("").alias("subject"), F.lit("").alias("support_text"), F.lit("").alias("occurred_start"),
        pick(1).alias("occurred_expr"), F.lit("").alias("occurred_anchor"), F.lit("0.8").alias("confidence"),
    )


@_query("facts_of_items", f"""WITH {SQL_SPANS}, n AS (SELECT *, (conv_id + turn) % 7 AS n, strptime(strftime(make_timestamp((session_time * 1000000)::BIGINT), '%Y-%m-%d'), '%Y-%m-%d')::DATE AS day FROM spans)
SELECT turn_id AS item_id, CASE n WHEN 1 THEN 'user_correction' WHEN 2 THEN 'inferred_llm' ELSE 'explicit_text' END AS source_type, CASE n WHEN 3 THEN 'negative' ELSE 'positive' END AS polarity,
  CASE n WHEN 0 THEN 'current_state' ELSE 'past_event' END AS modality, n IN (0, 1, 5) AS update_like,
  CASE n WHEN 0 THEN strftime(day - 1, '%Y-%m-%d') WHEN 4 THEN strftime(day - 3, '%Y-%m-%d') WHEN 5 THEN strftime(day, '%Y-%m-%d') ELSE '' END AS occurred_date,
  CASE WHEN n IN (1, 3, 6) THEN 'inferred_session' ELSE '' END AS time_source FROM n""")
def facts_of_items(spark: SparkSession, d: str) -> DataFrame:
    f = items.facts_of_items(_items(spark, d))
    return f.select("item_id", "source_type", "polarity", "modality", "update_like", F.coalesce("occurred_date", F.lit("")).alias("occurred_date"), F.coalesce("time_source", F.lit("")).alias("time_source"))


@_query("quantities_of_items", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_quantity::BIGINT AS q FROM lineitem)
SELECT l_orderkey || '-' || n || '-' || q AS item_id, CASE n WHEN 1 THEN q WHEN 2 THEN q + 2 WHEN 3 THEN 4 WHEN 4 THEN 21 WHEN 5 THEN 1000 + q WHEN 6 THEN q END::DOUBLE AS quantity,
  CASE n WHEN 1 THEN 'count' WHEN 2 THEN 'count' WHEN 3 THEN 'laps' WHEN 4 THEN 'duration' WHEN 5 THEN '' WHEN 6 THEN 'count' ELSE 'money' END AS unit,
  CASE n WHEN 2 THEN q WHEN 3 THEN 3 END::DOUBLE AS low, CASE n WHEN 2 THEN q + 5 WHEN 3 THEN 5 END::DOUBLE AS high, CASE WHEN n IN (2, 3) THEN false WHEN n <= 6 THEN true END AS grounded,
  round(0.30 + 0.20 + 0.20 * 2 / 3 + 0.15 + 0.10 + CASE WHEN n IN (1, 4, 5, 6) THEN 0.02 ELSE 0 END + 0.05 * 0.5, 3) AS confidence FROM l""")
def quantities_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Quantities in figures and words, with their ranges, units and whether the text states them."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    text = F.when(n == 1, F.format_string("bought %d boxes", q)).when(n == 2, F.format_string("between %d and %d visits", q, q + 5)).when(n == 3, "ran three to five laps").when(n == 4, "stayed for Twenty-one days")
    text = text.when(n == 5, F.format_string("had 1,%03d coins", q)).when(n == 6, F.format_string("fell from %d to %d points", q + 5, q)).otherwise("paid well")
    value = F.when(n == 2, q + 2).when(n == 3, 4).when(n == 4, 21).when(n == 5, q + 1000).otherwise(q).cast("string")
    units = F.element_at(F.array(*map(F.lit, ("times", "visit_count", "laps", "days", "none", "count", "money"))), n.cast("int"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", q)
    none = lambda *names: [F.lit("").alias(c) for c in names]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct().select(
        key.alias("item_id"), F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), key.alias("span_id"), F.lit("user").alias("role"), F.lit(0.0).alias("session_time"), F.lit("2024-01-01").alias("session_date"),
        F.lit("said a number").alias("predicate_raw"), F.lit("other").alias("event_type"), F.lit("event").alias("kind"), F.lit("past_event").alias("modality"), *none("subject", "occurred_start", "occurred_expr"),
        F.lit("none").alias("occurred_anchor"), text.alias("support_text"), F.lit("0.5").alias("confidence"), F.when(n == 7, "a lot").otherwise(value).alias("quantity_value"), units.alias("quantity_unit"), F.array(F.lit("thing")).alias("objects"),
    )
    spans = rows.select("span_id", F.concat(F.lit("Well, I "), "support_text", F.lit(" then.")).alias("text"))
    return items.facts_of_items(rows, spans).select("item_id", "quantity", "unit", "low", "high", "grounded", "confidence")


@_query("interval_sanity", """WITH l AS (SELECT l_orderkey, l_linenumber, o_orderdate::DATE + 40 AS a, l_shipdate::DATE AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN b >= a THEN strftime(b, '%Y-%m-%d') END AS valid_until, strftime(greatest(a, b), '%Y-%m-%d') AS occurred_end FROM l""")
def interval_sanity(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.date_add(F.col("o_orderdate").cast("date"), 40), F.col("l_shipdate").cast("date")
    sane = items.sane_intervals(lines.select("l_orderkey", "l_linenumber", start.alias("valid_from"), end.alias("valid_until"), start.alias("occurred_start"), end.alias("occurred_end")))
    return sane.select("l_orderkey", "l_linenumber", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"), F.date_format("occurred_end", "yyyy-MM-dd").alias("occurred_end"))


@_query("fallback_facts", f"""WITH {SQL_SPANS}
SELECT span_id, sha256(substr(content, 1, 500)) AS predicate_hash, CASE WHEN likes THEN 'preference' ELSE 'fact' END AS kind, CASE WHEN likes THEN 'preference' WHEN role = 'assistant' THEN 'assistant_advice' ELSE 'past_event' END AS modality
FROM (SELECT *, role = 'user' AND regexp_matches(content, '(?i)\\b(prefer|like|love|hate|enjoy)\\b') AS likes FROM spans) WHERE turn % 3 <> 0""")
def fallback_facts(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    f = items.fallback_facts(s, s.where("idx % 3 = 0"))
    return f.select(F.get("span_ids", F.lit(0)).alias("span_id"), F.sha2(F.col("predicate_raw").cast("binary"), 256).alias("predicate_hash"), "kind", "modality")


@_query("valid_from_of_updates", f"WITH {SQL_SPANS} SELECT turn_id AS fact_id, CASE WHEN turn % 2 = 0 THEN (SELECT min(session_time) FROM spans p WHERE p.session_id = s.session_id AND p.turn IN (s.turn, s.turn - 1)) END AS valid_from FROM spans s")
def valid_from_of_updates(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    before = F.concat(F.lit("span_"), "session_id", F.lit("_"), (F.col("idx") - 1).cast("string"))
    f = s.select(F.col("turn_id").alias("fact_id"), F.array("span_id", before).alias("span_ids"), (F.col("idx") % 2 == 0).alias("update_like"), F.lit(None).cast("double").alias("valid_from"))
    return maintenance.materialise_validity(f, s).select("fact_id", "valid_from")


@_query("document_times", f"WITH {SQL_SPANS} SELECT session_id AS fact_id, max(session_time) AS document_time FROM spans GROUP BY session_id")
def document_times(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    return items.document_times(s.groupBy(F.col("session_id").alias("fact_id")).agg(F.collect_list("span_id").alias("span_ids")), s).select("fact_id", "document_time")


@_query("user_only_facts", f"WITH {SQL_SPANS} SELECT turn_id AS fact_id FROM spans s WHERE role <> 'assistant' OR EXISTS (SELECT 1 FROM spans p WHERE p.session_id = s.session_id AND p.turn = s.turn - 2 AND p.role <> 'assistant')")
def user_only_facts(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.spans(turns(spark, d))
    before = F.concat(F.lit("span_"), "session_id", F.lit("_"), (F.col("idx") - 2).cast("string"))
    return items.user_only(s.select(F.col("turn_id").alias("fact_id"), F.array("span_id", before).alias("span_ids")), s).select("fact_id")


@_query("scope_stamps", f"WITH {SQL_TURNS} SELECT turn_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'agent' || (conv_id % 3) END AS agent_id FROM turns")
def scope_stamps(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    n = F.substring("session_id", 2, 20).cast("long") % 3
    scope = t.select("user_id", "session_id").distinct().where(n > 0).select("*", F.concat(F.lit("agent"), n.cast("string")).alias("agent_id"))
    return items.stamp_scope(t, scope).select("turn_id", F.coalesce("scope.agent_id", F.lit("")).alias("agent_id"))


@_query("extraction_traces", f"""WITH {SQL_SPANS}
SELECT 'extract' AS stage, 'span' AS action, CASE WHEN turn % 3 = 0 THEN 'ok' ELSE 'no_fact' END AS status, span_id AS subject FROM spans
UNION ALL SELECT 'maintain', 'supersede', 'ok', turn_id FROM turns WHERE turn = 1 UNION ALL SELECT 'extract_window', 'session_end', 'ok', session_id || ':0' FROM turns GROUP BY session_id""")
def extraction_traces(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    s = ingest.spans(t)
    windows = t.select("session_id").distinct().select("session_id", F.lit(0).alias("window"), F.lit("session_end").alias("reason"))
    actions = t.where("idx = 1").select(F.lit("supersede").alias("action"), F.col("turn_id").alias("fact_id"))
    return items.extraction_traces(windows, s, s.where("idx % 3 = 0").select(F.array("span_id").alias("span_ids")), actions)

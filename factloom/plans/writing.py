"""Queries of the write side: windows, dates, provenance, folds and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.runs import Limits
from ..functions.text import word_tokens
from ..operators import ingest, maintenance, matching
from ..sources.adapters import facts, table, turns
from ..streaming import state

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


SQL_TURNS = "turns AS (SELECT 'u' || (conv_id % 20) AS user_id, 's' || conv_id AS session_id, 's' || conv_id || '_turn_' || turn AS turn_id, turn AS idx, role, text AS content FROM conversations)"
SQL_FACTS = "facts AS (SELECT 'f' || event_id AS fact_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) AS valid_from, value AS quantity, json_extract_string(props, '$.k') AS object, event_id AS seq FROM events)"


@_query("extract_windows", f"""
WITH RECURSIVE {SQL_TURNS}, c AS (SELECT user_id, session_id, idx, greatest(1, length(content) // 4) AS cost, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k FROM turns WHERE trim(content) <> ''),
walk AS (
  SELECT user_id, session_id, k, idx, 0 AS win, 1 AS n, cost AS tokens FROM c WHERE k = 1
  UNION ALL SELECT c.user_id, c.session_id, c.k, c.idx, CASE WHEN w.n >= 3 OR w.tokens + c.cost > 120 THEN w.win + 1 ELSE w.win END,
         CASE WHEN w.n >= 3 OR w.tokens + c.cost > 120 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR w.tokens + c.cost > 120 THEN c.cost ELSE w.tokens + c.cost END
  FROM walk w JOIN c ON c.session_id = w.session_id AND c.k = w.k + 1)
SELECT user_id, session_id, win AS "window", min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_turns, max(tokens)::BIGINT AS n_tokens FROM walk GROUP BY ALL""")  # fmt: skip
def extract_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.extract_windows(turns(spark, d), Limits(120, 3)).drop("reason")


@_query("date_resolve_core", """
WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS anchor, phrase, CASE phrase WHEN 'yesterday' THEN strftime(d - 1, '%Y-%m-%d') WHEN 'two weeks ago' THEN strftime(d - 14, '%Y-%m-%d')
  WHEN '3 months ago' THEN strftime(d - INTERVAL 3 MONTH, '%Y-%m-%d') WHEN 'last monday' THEN strftime(date_trunc('week', d)::DATE - 7, '%Y-%m-%d')
  WHEN 'last month' THEN strftime(d - INTERVAL 1 MONTH, '%Y-%m') WHEN 'next year' THEN (year(d) + 1)::VARCHAR WHEN 'in 5 days' THEN strftime(d + 5, '%Y-%m-%d') END AS resolved
FROM o, (SELECT unnest(['yesterday', 'two weeks ago', '3 months ago', 'last monday', 'last month', 'next year', 'in 5 days', 'some days ago']) AS phrase)""")
def date_resolve_core(spark: SparkSession, d: str) -> DataFrame:
    phrases = ["yesterday", "two weeks ago", "3 months ago", "last monday", "last month", "next year", "in 5 days", "some days ago"]
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("anchor")).distinct()
    rows = days.select("anchor", F.explode(F.array(*map(F.lit, phrases))).alias("phrase"))
    return rows.select("anchor", "phrase", dates.resolve("phrase", "anchor", F.lit("past")).alias("resolved"))


@_query("date_range_core", """
WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS anchor, phrase, CASE phrase WHEN 'last week' THEN strftime(date_trunc('week', d)::DATE - 7, '%Y-%m-%d') ELSE strftime(d - INTERVAL 2 MONTH, '%Y-%m-%d') END AS first,
  CASE phrase WHEN 'last week' THEN strftime(date_trunc('week', d)::DATE - 1, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS last
FROM o, (SELECT unnest(['last week', 'past two months']) AS phrase)""")
def date_range_core(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("anchor")).distinct()
    rows = days.select("anchor", F.explode(F.array(F.lit("last week"), F.lit("past two months"))).alias("phrase"))
    return rows.select("anchor", "phrase", dates.resolve_range("phrase", "anchor").alias("r")).select("anchor", "phrase", "r.first", "r.last")


#: Days of two festivals, from almanacs.
SQL_FESTIVALS = """festivals AS (
  SELECT 'spring' AS name, unnest(['1991-02-15', '1992-02-04', '1993-01-23', '1994-02-10', '1995-01-31', '1996-02-19', '1997-02-07', '1998-01-28', '1999-02-16', '2000-02-05', '2001-01-24', '2002-02-12', '2003-02-01'])::DATE AS day
  UNION ALL SELECT 'autumn', unnest(['1991-09-22', '1992-09-11', '1993-09-30', '1994-09-20', '1995-09-09', '1996-09-27', '1997-09-16', '1998-10-05', '1999-09-24', '2000-09-12', '2001-10-01', '2002-09-21', '2003-09-11'])::DATE)"""


@_query("festival_dates", f"""
WITH {SQL_FESTIVALS}, o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
p AS (SELECT unnest(['春节', 'next spring festival', '中秋节', '十五天前', '二十三个星期以后']) AS phrase)
SELECT strftime(d, '%Y-%m-%d') AS anchor, phrase, strftime(CASE phrase
  WHEN '春节' THEN (SELECT max(day) FROM festivals WHERE name = 'spring' AND day <= d)
  WHEN 'next spring festival' THEN (SELECT min(day) FROM festivals WHERE name = 'spring' AND day > d AND year(day) IN (year(d), year(d) + 1))
  WHEN '中秋节' THEN (SELECT max(day) FROM festivals WHERE name = 'autumn' AND day <= d)
  WHEN '十五天前' THEN d - 15 ELSE d + 161 END, '%Y-%m-%d') AS resolved FROM o, p""")
def festival_dates(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("anchor")).distinct()
    rows = days.select("anchor", F.explode(F.array(*map(F.lit, ["春节", "next spring festival", "中秋节", "十五天前", "二十三个星期以后"]))).alias("phrase"))
    return rows.select("anchor", "phrase", dates.resolve("phrase", "anchor", F.lit("past")).alias("resolved"))


@_query("spans_of_turns", f"WITH {SQL_TURNS} SELECT 'span_' || session_id || '_' || idx AS span_id, turn_id, sha256(content) AS text_hash FROM turns WHERE trim(content) <> ''")
def spans_of_turns(spark: SparkSession, d: str) -> DataFrame:
    return ingest.spans(turns(spark, d)).select("span_id", "turn_id", "text_hash")


@_query("provenance_recovery", "WITH q AS (SELECT conv_id, turn, substr(text, 5, 30) AS quote FROM conversations), c AS (SELECT q.conv_id, q.turn, count(*) AS n, min('span_s' || c.conv_id || '_' || c.turn) AS span_id FROM q JOIN conversations c ON q.conv_id = c.conv_id AND contains(trim(regexp_replace(lower(c.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(q.quote), '\\s+', ' ', 'g'))) WHERE length(trim(q.quote)) >= 6 GROUP BY ALL) SELECT 's' || conv_id || '_turn_' || turn AS item_id, span_id FROM c WHERE n = 1")
def provenance_recovery(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    items = t.select(F.col("turn_id").alias("item_id"), "session_id", F.substring("content", 5, 30).alias("quote"))
    return matching.recover_provenance(items, ingest.spans(t))


SQL_WORDS = r"""list_distinct(list_filter(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9''\-]*'), lambda w: CASE WHEN contains(w, '-') THEN list_prepend(w, list_filter(string_split(w, '-'), lambda p: length(p) > 1)) ELSE [w] END)), lambda w: length(w) > 2))"""


@_query("provenance_paraphrase", f"""
WITH t AS (SELECT conv_id, turn, text, {SQL_WORDS.format("text")} AS st FROM conversations),
q AS (SELECT conv_id, turn, array_to_string(list_append(list_reverse(st[3:14]), 'elsewhere'), ' ') AS quote FROM t WHERE len(st) >= 14),
w AS (SELECT *, {SQL_WORDS.format("quote")} AS qt FROM q),
near AS (SELECT w.conv_id, w.turn, c.turn AS found, len(list_intersect(qt, st)) / len(qt) AS o FROM w JOIN t c ON w.conv_id = c.conv_id WHERE NOT contains(lower(c.text), quote))
SELECT 's' || conv_id || '_turn_' || turn AS item_id, 'span_s' || conv_id || '_' || arg_min(found, (-o, found)) AS span_id FROM near WHERE o >= 0.8 GROUP BY conv_id, turn""")
def provenance_paraphrase(spark: SparkSession, d: str) -> DataFrame:
    """Spans found by their words, as no span holds the quote: twelve words in another order, and one of its own."""
    t = turns(spark, d)
    words = F.array_distinct(F.filter(word_tokens(F.col("content")), lambda w: F.length(w) > 2))
    quote = F.array_join(F.array_append(F.reverse(F.slice(words, 3, 12)), F.lit("elsewhere")), " ")
    items = t.where(F.size(words) >= 14).select(F.col("turn_id").alias("item_id"), "session_id", quote.alias("quote"))
    return matching.recover_provenance(items, ingest.spans(t))


@_query("sequential_fold", f"""WITH {SQL_FACTS},
f AS (SELECT *, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS predicate, valid_from - (seq % 7) * 86400000000 AS start FROM facts),
k AS (SELECT *, (start, seq, fact_id) AS key FROM f)
SELECT a.fact_id, CASE WHEN by_id IS NULL THEN 'active' ELSE 'superseded' END AS status, coalesce(by_id, '') AS superseded_by FROM (
  SELECT a.fact_id, CASE WHEN a.predicate = '' THEN NULL WHEN max(b.key) FILTER (b.seq < a.seq) > any_value(a.key) THEN arg_max(b.fact_id, b.key) FILTER (b.seq < a.seq)
         ELSE arg_min(b.fact_id, b.seq) FILTER (b.seq > a.seq AND b.key > a.key) END AS by_id
  FROM k a JOIN k b ON a.user_id = b.user_id AND a.predicate = b.predicate GROUP BY a.fact_id, a.predicate) a""")
def sequential_fold(spark: SparkSession, d: str) -> DataFrame:
    # Late arrivals (up to six days), and a type whose predicate names no slot.
    f = facts(spark, d).select(
        "user_id", "fact_id", "seq", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("predicate"), F.lit("other").alias("event_type"), F.lit("state").alias("kind"), F.lit("").alias("unit"),
        F.array().cast("array<string>").alias("roles"), (F.col("valid_from") - (F.col("seq") % 7) * 86400000000).cast("double").alias("valid_from"), F.col("seq").cast("double").alias("document_time"), "quantity",
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("user").alias("role"), F.lit(True).alias("update_like"),
    )
    return maintenance.fold(f).select("fact_id", "status", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@_query("stale_queue", f"WITH {SQL_FACTS}, e AS (SELECT user_id, event_type || ' ' || object AS entity_id, min(valid_from) AS first_time, max(valid_from) AS last_time, count(*) AS n_new FROM facts GROUP BY ALL) SELECT user_id, entity_id, n_new, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_time, entity_id) AS position FROM e) WHERE position <= 5")
def stale_queue(spark: SparkSession, d: str) -> DataFrame:
    named = facts(spark, d).withColumn("entity_id", F.concat_ws(" ", "event_type", "object"))
    return ingest.drain(ingest.stale_entities(named), 5).select("user_id", "entity_id", "n_new", F.col("position").cast("long").alias("position"))


@_query("event_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = state.windowed(e, "ts", "6 hours", None, "1 day", ["event_type"])
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")

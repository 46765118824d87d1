"""Queries over wide recall by ten routes, and over the whole edges and mentions of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, lexical, refining, vectors, wide
from ..operators.refining import CardFilter
from ..sources.adapters import facts, turns
from ..sources.storage import kept, spread
from .answering import SQL_FACTS
from .retrieval import SQL_TURNS, SQL_VECTORS, sql_bm25

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# Two turns are a fact, three the summary of a session; each user has a corpus of each kind, which is part of its name.
_VECTORS = SQL_VECTORS.replace("__K__", "60").replace("SELECT query_id, a.unit", "SELECT query_id, a.corpus, a.unit").replace("SELECT query_id AS q,", "SELECT query_id AS q, corpus AS qc,").replace("y ON a.query_id = y.q", "y ON a.query_id = y.q AND a.corpus = y.qc").replace("PARTITION BY query_id ORDER", "PARTITION BY query_id, corpus ORDER")
SQL_ROUTES = "WITH" + SQL_TURNS + """
f AS (SELECT user_id, session_id, conv_id, turn // 2 AS half, 'fact_' || session_id || '_' || (turn // 2) AS fact_id, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS text, CASE WHEN conv_id % 7 = 0 AND (turn // 2) % 3 = 0 THEN 'superseded' ELSE 'active' END AS status FROM turn_docs GROUP BY ALL),
sums AS (SELECT user_id, session_id, 'sum_' || session_id AS summary_id, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS text FROM turn_docs WHERE turn < 3 GROUP BY ALL),
docs AS (SELECT 'fact:' || user_id AS corpus, fact_id AS unit, text FROM f UNION ALL SELECT 'span:' || user_id, turn_id, text FROM turn_docs UNION ALL SELECT 'sum:' || user_id, summary_id, text FROM sums),
first AS (SELECT user_id, arg_min(text, conv_id * 1000 + turn) AS text FROM turn_docs GROUP BY user_id),
asked AS (SELECT 'q_' || user_id AS query_id, k || ':' || user_id AS corpus, text FROM first, (VALUES ('fact'), ('span'), ('sum')) u(k)),
""" + sql_bm25(80) + _VECTORS + """,
said AS (SELECT * FROM (SELECT 'q_' || t.user_id AS query_id, turn_id, CASE WHEN turn % 2 = 0 THEN 'fact_' || session_id || '_' || (turn // 2) END AS fact_id, row_number() OVER (PARTITION BY t.user_id ORDER BY conv_id DESC, turn DESC) AS rank
  FROM turn_docs t JOIN first q ON q.user_id = t.user_id WHERE list_contains(regexp_extract_all(lower(q.text), '[a-z]{4,}'), nullif(regexp_extract(lower(t.text), '[a-z]{4,}'), ''))) WHERE rank <= 80),
members AS (SELECT 'sum_' || session_id AS summary_id, fact_id, row_number() OVER (PARTITION BY session_id ORDER BY half, fact_id) AS r FROM f),
own AS (SELECT turn_id, 'fact_' || session_id || '_' || (turn // 2) AS fact_id FROM turn_docs),
routes AS (
  SELECT query_id, 'fact' AS kind, unit, 0 AS asked, 'memory_unit_bm25' AS route, rank, score FROM hits WHERE corpus LIKE 'fact:%'
  UNION ALL SELECT query_id, 'fact', unit, 1, 'memory_unit_vector', rank, greatest(0, 1 - 0.03 * (rank - 1)) FROM vhits WHERE corpus LIKE 'fact:%'
  UNION ALL SELECT query_id, 'span', unit, 2, 'message_unit_bm25', rank, score FROM hits WHERE corpus LIKE 'span:%'
  UNION ALL SELECT query_id, 'fact', fact_id, 3, 'message_unit_linked_memory', rank, score + 0.1 FROM hits JOIN own ON unit = turn_id WHERE corpus LIKE 'span:%'
  UNION ALL SELECT query_id, 'span', unit, 4, 'message_unit_vector', rank, greatest(0, 1 - 0.03 * (rank - 1)) FROM vhits WHERE corpus LIKE 'span:%'
  UNION ALL SELECT query_id, 'fact', fact_id, 5, 'message_unit_vector_memory', rank, 0.9 - 0.02 * (rank - 1) FROM vhits JOIN own ON unit = turn_id WHERE corpus LIKE 'span:%'
  UNION ALL SELECT query_id, 'fact', fact_id, 7, 'summary_expanded_fact', rank, score + 0.05 FROM hits JOIN members ON unit = summary_id WHERE corpus LIKE 'sum:%' AND rank <= 20 AND r <= 30
  UNION ALL SELECT query_id, 'span', turn_id, 8, 'mention_message_unit', rank, 0.91 FROM said UNION ALL SELECT query_id, 'fact', fact_id, 9, 'mention_memory_unit', rank, 0.96 FROM said WHERE fact_id IS NOT NULL),
known AS (SELECT r.*, coalesce(f.status, 'active') AS status FROM routes r LEFT JOIN f ON r.unit = f.fact_id)"""


def _route_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits of the ten routes, status of facts, units)."""
    t = turns(spark, d)
    half = F.floor(F.col("idx") / 2)
    fact = F.concat(F.lit("fact_"), "session_id", F.lit("_"), half.cast("string"))
    conv = F.substring("session_id", 2, 20).cast("long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), " ").alias("content")
    made = t.groupBy("user_id", "session_id", conv.alias("conv"), half.alias("half"), fact.alias("fact_id")).agg(joined)
    sums = t.where("idx < 3").groupBy("user_id", F.concat(F.lit("sum_"), "session_id").alias("summary_id")).agg(joined)
    doc = lambda df, kind, unit: df.select(F.concat(F.lit(kind + ":"), "user_id").alias("corpus"), F.col(unit).alias("unit"), "content")
    docs = kept(doc(made, "fact", "fact_id").unionByName(doc(t, "span", "turn_id")).unionByName(doc(sums, "sum", "summary_id")), "units")
    first = t.groupBy("user_id").agg(F.min_by("content", "timestamp").alias("text"))
    asked = first.select(F.concat(F.lit("q_"), "user_id").alias("query_id"), F.explode(F.transform(F.array(*map(F.lit, ("fact:", "span:", "sum:"))), lambda k: F.concat(k, "user_id"))).alias("corpus"), "text")
    terms = kept(lexical.score(lexical.build(docs, "corpus", "unit", "content"), asked, 80), "hits")
    q = vectors.hashed(asked, "corpus", "query_id", "text").select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    near = kept(vectors.nearest(vectors.hashed(spread(docs), "corpus", "unit", "content"), q, 60).where("similarity > 0"), "vector-hits")
    of = lambda hits, kind: hits.where(F.col("corpus").startswith(kind + ":"))
    word = F.nullif(F.regexp_extract(F.lower("content"), "[a-z]{4,}", 0), F.lit(""))
    words = first.select("user_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("timestamp"))
    said = t.withColumn("word", word).join(words, ["user_id", "word"]).select(F.concat(F.lit("q_"), "user_id").alias("query_id"), F.col("turn_id").alias("span_id"), F.when(F.col("idx") % 2 == 0, fact).alias("fact_id"), F.row_number().over(newest).alias("rank"), F.lit(0.91).alias("confidence"))
    links = t.select(F.col("turn_id").alias("span"), fact.alias("fact"), F.lit(0).alias("seq"))
    summaries = made.select(F.concat(F.lit("sum_"), "session_id").alias("summary"), F.col("fact_id").alias("fact"), F.col("half").alias("seq"))
    hits = kept(wide.routes(of(terms, "fact"), of(near, "fact"), of(terms, "span"), of(near, "span"), of(terms, "sum"), said, links, summaries), "routes")
    status = made.select(F.col("fact_id").alias("unit"), F.when((F.col("conv") % 7 == 0) & (F.col("half") % 3 == 0), "superseded").otherwise("active").alias("status"))
    units = made.select(F.col("fact_id").alias("unit"), F.when(F.col("conv") % 2 == 0, 1).otherwise(3).alias("tier"), (F.col("half") % 2 == 0).alias("has_quantity"), F.length("content").alias("n_chars"))
    return hits, status, units.unionByName(t.select(F.col("turn_id").alias("unit"), F.lit(2).alias("tier"), F.lit(False).alias("has_quantity"), F.coalesce(F.length("content"), F.lit(0)).alias("n_chars")))


@_query("wide_ten_routes", SQL_ROUTES + """,
g AS (SELECT query_id, kind, unit, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY 1.0::DOUBLE / (60 + rank)) + least(max(score), 5) * 0.05, 6) AS score, array_to_string(list_transform(list_sort(list(DISTINCT asked || ' ' || route)), lambda x: x[3:]), ',') AS routes FROM known WHERE status = 'active' GROUP BY ALL),
u AS (SELECT fact_id AS unit, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 3 END AS tier, half % 2 AS q, length(text) AS n FROM f UNION ALL SELECT turn_id, 2, 1, coalesce(length(text), 0) FROM turn_docs),
b AS (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY tier, q, score DESC, n DESC, g.unit) AS rank FROM g JOIN u ON g.unit = u.unit)
SELECT query_id, kind, unit, routes, score, rank FROM b WHERE rank <= 40""")
def wide_ten_routes(spark: SparkSession, d: str) -> DataFrame:
    hits, status, units = _route_hits(spark, d)
    best = wide.evidence(wide.active(hits, status)[0], units, 40)
    return best.select("query_id", "kind", "unit", F.array_join("routes", ",").alias("routes"), "score", "rank")


@_query("wide_excluded", SQL_ROUTES + " SELECT DISTINCT query_id, unit AS fact_id, 'status=' || status AS reason FROM known WHERE status <> 'active'")
def wide_excluded(spark: SparkSession, d: str) -> DataFrame:
    hits, status, _ = _route_hits(spark, d)
    return wide.active(hits, status)[1]


SQL_ROLES = SQL_FACTS + """, s AS (SELECT fact_id, unnest(list_distinct(['span_' || seq, 'span_' || (seq // 10)])) AS span_id FROM facts),
r AS (SELECT fact_id, user_id, 'subject' AS role, 'entity_' || user_id AS entity_id, user_id AS name FROM facts UNION ALL SELECT fact_id, user_id, 'object', 'entity_key_' || object, CASE WHEN seq % 4 = 0 THEN 'key - ' ELSE 'Key ' END || object FROM facts WHERE object IS NOT NULL
  UNION ALL SELECT fact_id, user_id, 'place', 'entity_' || event_type, event_type FROM facts WHERE seq % 3 > 0)"""


def _with_roles(spark: SparkSession, d: str) -> DataFrame:
    """Events as facts with spans, which may be the same, and roles: an object in two spellings, a place that may be null or empty."""
    f, seq = facts(spark, d), F.col("seq")
    role = lambda kind, name: F.struct(F.lit(kind).alias("role"), name.alias("name"))
    roles = F.array(role("subject", F.col("user_id")), role("object", F.concat(F.lit("Key "), "object")), role("object", F.when(seq % 4 == 0, F.concat(F.lit("key - "), "object"))), role("place", F.when(seq % 3 > 0, F.col("event_type")).when(seq % 2 == 0, "")))
    spans = F.array(F.concat(F.lit("span_"), seq.cast("string")), F.concat(F.lit("span_"), F.floor(seq / 10).cast("string")))
    return f.select("fact_id", "user_id", spans.alias("span_ids"), roles.alias("roles"), F.when(seq % 2 == 0, F.floor(F.col("valid_from") / 86400000000).cast("string")).alias("day"), F.when(seq % 5 > 1, F.floor("quantity").cast("long")).alias("quantity_value"), F.when(seq % 5 > 0, "count").alias("quantity_unit"))


def _sql_id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || left(sha256(concat_ws('|', {', '.join(parts)})), 24)"


@_query("edges_whole", f"""WITH {SQL_ROLES}, e AS (SELECT fact_id, user_id, 'EVIDENCES' AS edge_type, span_id AS dst, 'source trace evidences memory unit' AS predicate_raw, 'evidenced_by_source_trace' AS predicate, 0.98 AS confidence, [span_id] AS parts FROM s JOIN facts USING (fact_id)
  UNION ALL SELECT fact_id, user_id, CASE role WHEN 'subject' THEN 'SUBJECT_OF' ELSE 'OBJECT_OF' END, entity_id, role || ': ' || name, role, 0.9, [entity_id, role] FROM r UNION ALL SELECT fact_id, user_id, 'MENTIONS', entity_id, 'mentions ' || name, 'mentions', 0.9, [entity_id, role] FROM r
  UNION ALL SELECT fact_id, user_id, 'OCCURRED_DURING', floor(valid_from / 86400000000.0)::BIGINT::VARCHAR, 'fact occurred during date', 'occurred_during', 0.86, [floor(valid_from / 86400000000.0)::BIGINT::VARCHAR] FROM facts WHERE seq % 2 = 0
  UNION ALL SELECT fact_id, user_id, 'HAS_QUANTITY', q, 'fact has quantity', 'has_quantity', 0.86, [q] FROM (SELECT *, CASE WHEN seq % 5 > 1 THEN coalesce(floor(quantity)::BIGINT::VARCHAR, 'None') ELSE 'None' END || ':count' AS q FROM facts WHERE seq % 5 > 0))
SELECT {_sql_id('fact_edge', 'fact_id', "array_to_string(parts, '|')", 'edge_type')} AS edge_id, user_id, fact_id AS src, edge_type, dst, predicate_raw, predicate, confidence::DOUBLE AS confidence FROM e""")
def edges_whole(spark: SparkSession, d: str) -> DataFrame:
    return graph.materialise(_with_roles(spark, d))


@_query("mention_rows", f"WITH {SQL_ROLES} SELECT {_sql_id('mention', 'span_id', 'r.fact_id', 'role', 'entity_id')} AS mention_id, user_id, entity_id, name AS entity_name, span_id, r.fact_id, role, 0.91::DOUBLE AS link_confidence FROM r JOIN s ON r.fact_id = s.fact_id")
def mention_rows(spark: SparkSession, d: str) -> DataFrame:
    return graph.mention_rows(_with_roles(spark, d))


# Each filter with the condition that DuckDB has for it.
FILTERS = {
    "by_source": (CardFilter(source_types=["view"], channels=["click", "view"]), "source IN ('view', 'click')"),
    "by_type_or_kind": (CardFilter(event_types=["view"], types=["odd"]), "event_type = 'view' OR seq % 2 = 1"),
    "by_roles": (CardFilter(entity_roles={"object": ["KEY 1", "key 2"]}), "object IS NOT NULL AND (object LIKE '1%' OR object LIKE '2%')"),
    "by_missing_role": (CardFilter(entity_roles={"place": "key"}), "false"),
    "by_entity": (CardFilter(entity="Key 4"), "coalesce(object LIKE '4%', false)"),
    "by_session_status_unit": (CardFilter(session_id="s3", status="current", quantity_units=["count", "money"]), "seq % 5 = 3 AND seq % 4 > 0 AND seq % 3 > 0"),
    "by_confidence": (CardFilter(min_confidence=0.5, modalities=["fact"]), "quantity >= 50 AND seq % 7 > 0"),
    "by_occurred": (CardFilter(occurred_from="2024-01-05", occurred_to="2024-01-20T12:00:00"), "seq % 6 > 0 AND said BETWEEN 5 AND 20"),
    "by_created": (CardFilter(created_from="2024-01-09", created_to="not a day"), "seq % 9 > 0 AND said >= 9"),
    "by_valid": (CardFilter(valid_from="2024-01-05", valid_to="2024-01-20"), "(seq % 6 = 0 OR said >= 5) AND (seq % 9 = 0 OR said <= 20)"),
    "by_terms": (CardFilter(include_terms=["A", "Key 1"], exclude_terms=["view"], kinds=["even"], source_roles=["user"]), "seq % 2 = 0 AND event_type <> 'view' AND coalesce(object LIKE '1%', false)"),
}


@_query("refine_cards", f"WITH {SQL_FACTS}, c AS (SELECT *, seq % 28 + 1 AS said, CASE WHEN seq % 8 > 0 THEN event_type END AS source FROM facts) SELECT fact_id, {', '.join(f'coalesce({sql}, false) AS {name}' for name, (_, sql) in FILTERS.items())} FROM c")
def refine_cards(spark: SparkSession, d: str) -> DataFrame:
    f, seq = facts(spark, d), F.col("seq")
    day = F.concat(F.lit("2024-01-"), F.lpad((seq % 28 + 1).cast("string"), 2, "0"))
    undated, unsaid = F.when(seq % 6 > 0, day), F.when(seq % 9 > 0, day).otherwise(F.when(seq % 2 == 0, "someday"))
    rows = f.select(
        "fact_id", F.when(seq % 8 > 0, F.col("event_type")).alias("source_type"), F.col("event_type").alias("type"), F.when(seq % 2 == 0, "even").otherwise("odd").alias("kind"), F.when(seq % 7 > 0, "fact").alias("modality"), F.lit("user").alias("role"), F.concat(F.lit("s"), (seq % 5).cast("string")).alias("session_id"),
        F.when(seq % 4 > 0, "current").alias("status"), F.when(seq % 3 > 0, "count").alias("quantity_unit"), F.concat(F.lit("a "), F.col("event_type")).alias("content"), (F.col("quantity") / 100).alias("confidence"), undated.alias("occurred"), unsaid.alias("created"), undated.alias("valid_from"), unsaid.alias("valid_until"),
        F.array(F.struct(F.lit("object").alias("role"), F.concat(F.lit("Key "), "object").alias("name"))).alias("roles"),
    )
    return refining.cards(rows).select("fact_id", *(refining.matches(wanted).alias(name) for name, (wanted, _) in FILTERS.items()))

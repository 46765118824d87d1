"""Queries over versions of facts, and over the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as fx
from ..operators import fusion, graph, maintenance, matching
from ..sources.adapters import facts, table
from ..sources.adapters import graph as star
from ..sources.storage import kept

QUERIES: dict = {}
ORACLES: dict = {}

AT = 1705276800000000  # 2024-01-15T00:00:00Z in microseconds
SLOT = ("user_id", "event_type")

SQL_FACTS = """
facts AS (
  SELECT 'f' || event_id AS fact_id, 'u' || user_id AS user_id, event_type, epoch_us(ts) AS valid_from, value AS quantity,
         json_extract_string(props, '$.k') AS object, event_id AS seq, strftime(ts, '%Y-%m-%d') AS day
  FROM events)
"""
SQL_CHAIN = SQL_FACTS + """,
chain AS (
  SELECT *, lead(valid_from) OVER w AS valid_until, lead(fact_id) OVER w AS superseded_by FROM facts
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY valid_from, seq))
"""
SQL_STAR = """
star AS (
  SELECT 'customer:' || o_custkey AS src, 'PLACED' AS edge_type, 'order:' || o_orderkey AS dst FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'IN', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'IN', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'IN', 'region:' || n_regionkey FROM nation)
"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def day(us) -> F.Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def chains(spark: SparkSession, d: str) -> DataFrame:
    return fx.supersede(facts(spark, d), SLOT, ("valid_from", "seq"))


@_query("supersede_chain", "WITH" + SQL_CHAIN + "SELECT fact_id, coalesce(valid_until, -1) AS valid_until, coalesce(superseded_by, '') AS superseded_by, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS status FROM chain")
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    return chains(spark, d).select("fact_id", F.coalesce("valid_until", F.lit(-1).cast("long")).alias("valid_until"), F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), "status")


@_query("fact_current_as_of", f"WITH {SQL_FACTS} SELECT user_id, event_type, arg_max(fact_id, (valid_from, seq)) AS fact_id, arg_max(quantity, (valid_from, seq)) AS quantity FROM facts WHERE valid_from <= {AT} GROUP BY ALL")
def fact_current_as_of(spark: SparkSession, d: str) -> DataFrame:
    return fx.as_of(facts(spark, d), F.lit(AT), SLOT, ("valid_from", "seq")).select("user_id", "event_type", "fact_id", "quantity")


@_query("facts_valid_at", f"WITH {SQL_CHAIN} SELECT fact_id, user_id, event_type FROM chain WHERE valid_from <= {AT} AND (valid_until IS NULL OR {AT} < valid_until)")
def facts_valid_at(spark: SparkSession, d: str) -> DataFrame:
    return fx.current_at(chains(spark, d), F.lit(AT)).select("fact_id", "user_id", "event_type")


@_query("contradict_prior", f"""WITH {SQL_FACTS}
SELECT fact_id, coalesce(by_id, '') AS contradicted_by FROM (
  SELECT fact_id, first_value(CASE WHEN quantity > 50 THEN fact_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS by_id FROM facts)""")
def contradict_prior(spark: SparkSession, d: str) -> DataFrame:
    out = fx.contradict(facts(spark, d), SLOT, F.col("quantity") > 50)
    return out.select("fact_id", F.coalesce("contradicted_by", F.lit("")).alias("contradicted_by"))


@_query("duplicate_merge", f"""WITH {SQL_FACTS}
SELECT user_id, event_type, object, arg_min(fact_id, seq) AS fact_id, count(*) AS n_merged, string_agg(fact_id, ',' ORDER BY seq) AS merged_ids, max(quantity) AS quantity
FROM facts GROUP BY user_id, event_type, object""")
def duplicate_merge(spark: SparkSession, d: str) -> DataFrame:
    return fx.merge_duplicates(facts(spark, d), ("user_id", "event_type", "object"), largest=("quantity",)).withColumn("merged_ids", F.array_join("merged_ids", ","))


@_query("same_event_merge", f"""WITH {SQL_FACTS}
SELECT fact_id, CASE WHEN object LIKE '%0' THEN fact_id ELSE first_value(fact_id) OVER (PARTITION BY user_id, event_type, day, object ORDER BY seq) END AS event_id FROM facts""")
def same_event_merge(spark: SparkSession, d: str) -> DataFrame:
    objects = F.when(F.col("object").endswith("0"), F.array().cast("array<string>")).otherwise(F.array("object"))
    dated = facts(spark, d).withColumns({"day": day(F.col("valid_from")), "predicate": F.col("event_type"), "modality": F.lit("past_event"), "kind": F.lit("event"), "objects": objects})
    return maintenance.same_event(dated).select("fact_id", "event_id")


@_query("stale_expire", f"""WITH {SQL_FACTS}, lim AS (SELECT *, valid_from + 864000000000 AS valid_until, CASE event_type WHEN 'view' THEN 'state' WHEN 'signup' THEN 'profile' WHEN 'click' THEN 'preference' ELSE 'event' END AS kind FROM facts)
SELECT fact_id, kind, CASE WHEN kind <> 'event' AND valid_until < {AT} THEN 'stale' ELSE 'active' END AS status FROM lim""")
def stale_expire(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "state").when(F.col("event_type") == "signup", "profile").when(F.col("event_type") == "click", "preference").otherwise("event")
    limited = facts(spark, d).select("fact_id", kind.alias("kind"), (F.col("valid_from") + 864000000000).alias("valid_until"), F.lit("active").alias("status"))
    return fx.expire(limited, F.lit(AT), F.col("kind")).select("fact_id", "kind", "status")


@_query("upsert_snapshot", f"""WITH {SQL_FACTS}, k AS (SELECT user_id || ':' || event_type AS key, valid_from, quantity, seq, valid_from >= {AT} AS is_new FROM facts)
SELECT key, arg_max(quantity, (is_new::INT, seq)) AS quantity, arg_min(valid_from, (is_new::INT, seq)) AS created_at FROM k GROUP BY key""")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "quantity", F.col("valid_from").alias("created_at"), "seq")
    old, new = rows.where(F.col("created_at") < AT), rows.where(F.col("created_at") >= AT)
    return fx.upsert(old, new, ["key"], keep=["created_at"]).select("key", "quantity", "created_at")


@_query("event_fusion_merge", f"""WITH {SQL_FACTS},
units AS (
  SELECT user_id AS query_id, fact_id AS unit, seq, quantity, CASE WHEN event_type <> 'error' THEN event_type || '|' || object END AS fingerprint, (quantity > 20)::INT + (quantity > 60)::INT * 3 AS completeness FROM facts),
heads AS (
  SELECT query_id, unit, 'a' || (seq % 3) AS head, 0.4::DOUBLE AS c, seq AS ordinal FROM units
  UNION ALL SELECT query_id, unit, 'b' || (seq % 5), 0.2, seq FROM units WHERE quantity < 30
  UNION ALL SELECT query_id, unit, 'a' || (seq % 3), 0.1, seq FROM units WHERE quantity < 10),
sized AS (SELECT u.*, n, o FROM units u JOIN (SELECT query_id, unit, count(DISTINCT head) AS n, min(ordinal) AS o FROM heads GROUP BY ALL) h USING (query_id, unit)),
best AS (SELECT query_id, fingerprint, arg_max(unit, (n, completeness, -o)) AS chosen, min(o) AS pos, count(*) AS members FROM sized WHERE fingerprint IS NOT NULL GROUP BY ALL),
owner AS (
  SELECT s.query_id, s.unit, b.chosen, b.pos, b.members, 1 AS g FROM sized s JOIN best b USING (query_id, fingerprint)
  UNION ALL SELECT query_id, unit, unit, o, 1, 0 FROM sized WHERE fingerprint IS NULL),
tops AS (SELECT o.query_id, o.chosen AS unit, g, pos, o.members, head, max(c) AS c FROM owner o JOIN heads h ON o.query_id = h.query_id AND o.unit = h.unit GROUP BY ALL)
SELECT query_id, unit, members, count(*) AS n_heads, round(1 - product(1 - c), 9) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY g, pos, unit) AS ordinal
FROM tops GROUP BY query_id, unit, members, g, pos""")
def event_fusion_merge(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("query_id", F.col("user_id"))
    head = lambda rows, name, c: rows.select("query_id", F.col("fact_id").alias("unit"), name.alias("head"), F.lit(c).alias("c"), F.col("seq").alias("ordinal"))
    a, b = F.concat(F.lit("a"), F.col("seq") % 3), F.concat(F.lit("b"), F.col("seq") % 5)
    heads = head(f, a, 0.4).unionByName(head(f.where("quantity < 30"), b, 0.2)).unionByName(head(f.where("quantity < 10"), a, 0.1))
    complete = (F.col("quantity") > 20).cast("int") + (F.col("quantity") > 60).cast("int") * 3
    prints = f.select(F.col("fact_id").alias("unit"), F.when(F.col("event_type") != "error", F.concat_ws("|", "event_type", "object")).alias("fingerprint"), complete.alias("completeness"))
    return fusion.merge_events(heads, prints).withColumn("confidence", F.round("confidence", 9))


@_query("edge_materialize", f"""WITH {SQL_FACTS}
SELECT fact_id AS src, 'SUBJECT_OF' AS edge_type, 'entity_' || user_id AS dst FROM facts
UNION ALL SELECT fact_id, 'OCCURRED_DURING', day FROM facts UNION ALL SELECT fact_id, 'HAS_QUANTITY', CAST(CAST(floor(quantity) AS BIGINT) AS VARCHAR) || ':count' FROM facts
UNION ALL SELECT fact_id, k, 'entity_' || event_type || '_' || object FROM facts, (SELECT unnest(['OBJECT_OF', 'MENTIONS']) AS k)""")
def edge_materialize(spark: SparkSession, d: str) -> DataFrame:
    named = facts(spark, d).withColumn("objects", F.array(F.concat_ws(" ", "event_type", "object")))
    return graph.edges_of_facts(named, "fact_id", "user_id", "objects", day(F.col("valid_from")), F.concat(F.floor("quantity").cast("string"), F.lit(":count")))


@_query("edge_type_counts", f"WITH {SQL_STAR} SELECT edge_type, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM star GROUP BY edge_type")
def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@_query("entity_registry", f"""WITH {SQL_FACTS}, m AS (SELECT event_type || CASE WHEN seq % 2 = 0 THEN ' ' ELSE '-' END || object AS name, CASE WHEN quantity > 50 THEN event_type ELSE 'concept' END AS kind, fact_id, seq FROM facts),
e AS (SELECT *, 'entity_' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS entity_id FROM m),
forms AS (SELECT entity_id, name, min(seq) AS s FROM e GROUP BY ALL), f2 AS (SELECT entity_id, string_agg(name, '|' ORDER BY s) AS surface_forms FROM forms GROUP BY ALL)
SELECT e.entity_id, coalesce(arg_min(kind, seq) FILTER (kind <> 'concept'), 'concept') AS entity_type, surface_forms, count(DISTINCT fact_id) AS mention_count FROM e JOIN f2 ON e.entity_id = f2.entity_id GROUP BY e.entity_id, surface_forms""")
def entity_registry(spark: SparkSession, d: str) -> DataFrame:
    m = facts(spark, d).select(F.concat("event_type", F.when(F.col("seq") % 2 == 0, " ").otherwise("-"), "object").alias("name"), F.when(F.col("quantity") > 50, F.col("event_type")).otherwise("concept").alias("kind"), "fact_id", "seq")
    return graph.registry(m, "name", "kind", "fact_id", "seq").withColumn("surface_forms", F.array_join("surface_forms", "|"))


@_query("entity_timeline", f"""WITH {SQL_FACTS} SELECT 'entity_' || event_type || '_' || object AS entity_id, fact_id, row_number() OVER (PARTITION BY event_type, object ORDER BY valid_from, seq) AS position FROM facts""")
def entity_timeline(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    from ..functions.text import entity_id

    named = facts(spark, d).select(entity_id(F.concat_ws(" ", "event_type", "object")).alias("entity_id"), "fact_id", "valid_from", "seq")
    return named.select("entity_id", "fact_id", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.coalesce("valid_from", F.lit(0)), "seq")).cast("long").alias("position"))


@_query("two_hop", """
WITH m AS (SELECT 'supplier:' || s_suppkey AS unit, 'nation:' || s_nationkey AS entity FROM supplier),
deg AS (SELECT entity, count(*) AS degree FROM m GROUP BY entity),
near AS (SELECT a.unit AS head, b.unit AS other, min((degree, a.entity)) AS v FROM m a JOIN m b ON a.entity = b.entity AND a.unit <> b.unit JOIN deg ON a.entity = deg.entity GROUP BY ALL)
SELECT head, other, v[2] AS via, rank FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY v, other) AS rank FROM near) WHERE rank <= 10""")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("unit"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("entity"))
    m = m.join(m.groupBy("entity").agg(F.count(F.lit(1)).alias("degree")), "entity")
    return graph.two_hop(m.select(F.col("unit").alias("head")).distinct(), m, 10).withColumn("rank", F.col("rank").cast("long"))


@_query("explore_bfs3", f"""WITH {SQL_STAR},
s1 AS (SELECT src AS start, 1 AS step, src, edge_type, dst FROM star WHERE src LIKE 'customer:%'),
f1 AS (SELECT DISTINCT start, dst AS node FROM s1 WHERE dst <> start),
s2 AS (SELECT start, 2 AS step, src, edge_type, dst FROM f1 JOIN star ON node = src),
f2 AS (SELECT DISTINCT start, dst AS node FROM s2 EXCEPT SELECT start, node FROM f1),
s3 AS (SELECT start, 3 AS step, src, edge_type, dst FROM f2 JOIN star ON node = src),
every AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
SELECT start, step, src, edge_type, dst FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY step, src, edge_type, dst) AS r FROM every) WHERE r <= 25""")
def explore_bfs3(spark: SparkSession, d: str) -> DataFrame:
    edges = kept(star(spark, d), "star")
    starts = edges.where(F.col("src").startswith("customer:")).select(F.col("src").alias("start")).distinct()
    return graph.explore(starts, edges, 3, limit=25)


@_query("mentions_by_terms", """
WITH terms AS (SELECT unnest(['red', 'blue', 'steel', 'a', 'part']) AS term),
held AS (SELECT term, p_partkey AS unit, p_name AS name, row_number() OVER (PARTITION BY term ORDER BY p_retailprice DESC, p_partkey DESC) AS rank FROM part JOIN terms ON contains(lower(p_name), term))
SELECT * FROM held WHERE rank <= 20""")
def mentions_by_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("red",), ("blue",), ("steel",), ("a",), ("part",)], "term string")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("seq"))
    return graph.mentions_of(terms, names, 20).withColumn("rank", F.col("rank").cast("long"))


@_query("query_mentions", """
WITH m AS (SELECT p_partkey AS mention_id, 'u' || (p_size % 4) AS user_id, p_name AS name, p_retailprice AS confidence, p_partkey AS seq FROM part),
t AS (SELECT s_suppkey AS query_id, 'u' || (s_nationkey % 4) AS user_id, unnest([1, 2, 3, 4]) AS place, unnest([split_part(s_name, '#', 1)[1:2], 're', ' b', 'steel']) AS term FROM supplier),
each AS (SELECT query_id, mention_id, name, place, row_number() OVER (PARTITION BY query_id, place ORDER BY confidence DESC, seq DESC) AS r FROM t JOIN m ON t.user_id = m.user_id AND contains(lower(name), lower(trim(term)))),
once AS (SELECT query_id, mention_id, min((place, r)) AS f FROM each WHERE r <= 15 GROUP BY ALL)
SELECT query_id, mention_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS position FROM once) WHERE position <= 15""")
def query_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by each query's own terms, of its user, in the order of terms."""
    mentions = table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.concat(F.lit("u"), (F.col("p_size") % 4).cast("string")).alias("user_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("seq"))
    given = F.array(F.substring("s_name", 1, 2), F.lit("re"), F.lit(" b"), F.lit("steel"))
    terms = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("u"), (F.col("s_nationkey") % 4).cast("string")).alias("user_id"), F.posexplode(given).alias("place", "term"))
    return matching.mentions_by_terms(terms, mentions, 15).select("query_id", "mention_id", F.col("position").cast("long").alias("position"))


@_query("mention_timeline", f"""WITH {SQL_FACTS},
t AS (SELECT DISTINCT user_id AS query_id, user_id, unnest([1, 2]) AS place, unnest(['sign', 'k']) AS term FROM facts),
m AS (SELECT fact_id, user_id, event_type AS name, quantity AS confidence, seq, valid_from FROM facts),
each AS (SELECT query_id, m.fact_id, m.valid_from, place, row_number() OVER (PARTITION BY query_id, place ORDER BY confidence DESC, seq DESC) AS r FROM t JOIN m ON t.user_id = m.user_id AND contains(lower(name), term)),
once AS (SELECT query_id, fact_id, any_value(valid_from) AS v, min((place, r)) AS f FROM each WHERE r <= 30 GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS p FROM once)
SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(v, 0), p) AS position FROM kept WHERE p <= 30""")
def mention_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The facts whose mentions hold a term, by time."""
    f = facts(spark, d)
    mentions = f.select(F.col("fact_id").alias("mention_id"), "fact_id", "user_id", F.col("event_type").alias("name"), F.col("quantity").alias("confidence"), "seq")
    terms = f.select("user_id").distinct().select(F.col("user_id").alias("query_id"), "user_id", F.posexplode(F.array(F.lit("sign"), F.lit("k"))).alias("place", "term"))
    return matching.timeline_by_terms(terms, mentions, f, 30, "valid_from").select("query_id", "fact_id", F.col("position").cast("long").alias("position"))


@_query("whole_lineage", f"WITH {SQL_FACTS}, r AS (SELECT fact_id, user_id, event_type, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n, last_value(fact_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM facts WINDOW w AS (PARTITION BY user_id, event_type ORDER BY valid_from, seq)) SELECT fact_id, head, n - k AS n_steps FROM r")
def whole_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The current head of each fact over all its successors."""
    f = facts(spark, d)
    closed = fx.supersede(f, ("user_id", "event_type"), ("valid_from", "seq")).where(F.col("superseded_by").isNotNull())
    return graph.whole_lineage(f, closed.select(F.col("superseded_by").alias("src"), F.col("fact_id").alias("dst"))).select("fact_id", "head", "n_steps")


@_query("reverse_edge_lookup", f"WITH {SQL_STAR} SELECT n_name, edge_type, count(*) AS n, min(src) AS first_src FROM star JOIN nation ON dst = 'nation:' || n_nationkey WHERE edge_type = 'IN' GROUP BY ALL")
def reverse_edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select("n_name", F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("dst"))
    return star(spark, d).where(F.col("edge_type") == "IN").join(nations, "dst").groupBy("n_name", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"))


@_query("occurred_prefix", f"WITH {SQL_FACTS} SELECT fact_id, day FROM facts WHERE day LIKE '2024-01-1%'")
def occurred_prefix(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("fact_id", day(F.col("valid_from")).alias("day")).where(F.col("day").startswith("2024-01-1"))


@_query("confidence_score", f"""WITH {SQL_FACTS} SELECT fact_id, round(greatest(0.05, least(0.98, 0.30 + CASE WHEN quantity > 50 THEN 0.20 ELSE 0.08 END + 0.20 * 0.75 + 0.15 * CASE WHEN event_type = 'error' THEN 0.65 ELSE 1.0 END + 0.10 * 0.5 + 0.03 + 0.02 + 0.05 * 0.7)), 4) AS confidence FROM facts""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    yes = F.lit(True)
    c = fx.confidence(yes, F.col("quantity") > 50, F.lit(0.75), F.col("event_type") != "error", F.lit(0.5), yes, yes, F.lit(0.7))
    return facts(spark, d).select("fact_id", F.round(c, 4).alias("confidence"))

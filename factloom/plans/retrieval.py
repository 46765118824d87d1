"""Retrieval queries: lexical, vector, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..operators import fusion, lexical, vectors
from ..operators.index import Index
from ..sources.adapters import table, turns
from ..sources.storage import kept, shared_folder, spread

QUERIES: dict = {}
ORACLES: dict = {}

SQL_TOKENS = r"""flatten(list_transform(regexp_extract_all(lower(coalesce(__TEXT__, '')), '[a-z0-9][a-z0-9''\-]*'), lambda w: list_filter(list_concat(list_concat([w],
  CASE WHEN contains(w, '-') THEN list_filter(string_split(w, '-'), lambda p: length(p) > 1) ELSE []::VARCHAR[] END),
  [CASE WHEN length(w) > 4 AND suffix(w, 'ies') THEN w[:length(w)-3] || 'y' WHEN length(w) > 4 AND suffix(w, 'es') THEN w[:length(w)-2] WHEN length(w) > 3 AND suffix(w, 's') THEN w[:length(w)-1] END]), lambda x: x IS NOT NULL)))"""

#: docs (corpus, unit, text) and asked (query_id, corpus, text) come before, hits after.
SQL_BM25 = """
tok AS (SELECT corpus, unit, __DOCTOK__ AS t FROM docs),
post AS (SELECT corpus, unit, len(t) AS length, term, count(*) AS tf FROM (SELECT corpus, unit, t, unnest(t) AS term FROM tok) GROUP BY ALL),
corp AS (SELECT corpus, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY corpus),
idf AS (SELECT p.corpus, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post p JOIN corp c ON p.corpus = c.corpus GROUP BY p.corpus, term, n),
mean AS (SELECT corpus, avg(idf) AS m FROM idf GROUP BY corpus),
ask AS (SELECT query_id, corpus, term, count(*) AS times FROM (SELECT query_id, corpus, unnest(__ASKTOK__) AS term FROM asked) GROUP BY ALL),
tot AS (
  SELECT a.query_id, a.corpus, p.unit, sum(times * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) ORDER BY a.term) AS score
  FROM ask a JOIN post p ON a.corpus = p.corpus AND a.term = p.term JOIN idf i ON a.corpus = i.corpus AND a.term = i.term JOIN corp c ON a.corpus = c.corpus JOIN mean ON a.corpus = mean.corpus
  GROUP BY a.query_id, a.corpus, p.unit),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY round(score, 9) DESC, unit) AS rank FROM tot) WHERE rank <= __K__ AND score > 0)
"""


def sql_bm25(k: int) -> str:
    return SQL_BM25.replace("__DOCTOK__", SQL_TOKENS.replace("__TEXT__", "text")).replace("__ASKTOK__", SQL_TOKENS.replace("__TEXT__", "text")).replace("__K__", str(k))


SQL_TURNS = """
turn_docs AS (SELECT 'u' || (conv_id % 20) AS user_id, 's' || conv_id AS session_id, 's' || conv_id || '_turn_' || turn AS turn_id, conv_id, turn, role, text FROM conversations),
"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@_query("token_stats", f"""
WITH tok AS (SELECT doc_id, unnest({SQL_TOKENS.replace('__TEXT__', 'text')}) AS term FROM documents)
SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS df FROM tok GROUP BY term
""")  # fmt: skip
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    each = spread(table(spark, d, "documents")).select("doc_id", F.explode(search_tokens(F.col("text"))).alias("term"))
    # All rows of a document are in one task, so counts by document are cheap before the shuffle.
    return each.groupBy("term", "doc_id").count().groupBy("term").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("df"))


def _turn_queries(t: DataFrame) -> DataFrame:
    """Each user's first turn, asked of that user's corpus."""
    return t.groupBy("user_id").agg(F.min_by("content", F.struct("timestamp")).alias("text")).select(F.concat(F.lit("q_"), "user_id").alias("query_id"), F.col("user_id").alias("corpus"), "text")


SQL_TURN_ASK = SQL_TURNS + """
docs AS (SELECT user_id AS corpus, turn_id AS unit, text FROM turn_docs),
asked AS (SELECT 'q_' || user_id AS query_id, user_id AS corpus, arg_min(text, conv_id * 1000 + turn) AS text FROM turn_docs GROUP BY user_id),
"""


def turn_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    t = turns(spark, d)
    return kept(lexical.score(lexical.build(t, "user_id", "turn_id", "content"), _turn_queries(t), k), "hits")


@_query("bm25_turns", "WITH" + SQL_TURN_ASK + sql_bm25(10) + "SELECT query_id, unit, rank, round(score, 4) AS score FROM hits")
def bm25_turns(spark: SparkSession, d: str) -> DataFrame:
    return turn_hits(spark, d, 10).select("query_id", "unit", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@_query("bm25_growing_index", ORACLES["bm25_turns"])
def bm25_growing_index(spark: SparkSession, d: str) -> DataFrame:
    """The same hits from an index that was written in three versions, of which the first two were made one."""
    t = turns(spark, d)
    index = Index(spark, shared_folder(spark, "index"))
    third = F.pmod(F.xxhash64("session_id"), F.lit(3))
    index.append(t.where(third == 0), "user_id", "turn_id", "content")
    index.append(t.where(third == 1), "user_id", "turn_id", "content")
    index.compact()
    index.append(t.where(third == 2), "user_id", "turn_id", "content")
    return index.score(_turn_queries(t), 10).select("query_id", "unit", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


ASKED_TERMS = "thering anon de la schen then"


@_query("bm25_documents", f"""
WITH docs AS (SELECT source AS corpus, doc_id AS unit, text FROM documents),
asked AS (SELECT DISTINCT 'q' AS query_id, source AS corpus, '{ASKED_TERMS}' AS text FROM documents),
""" + sql_bm25(10) + "SELECT corpus, unit, rank, round(score, 4) AS score FROM hits")  # fmt: skip
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.select(F.col("source").alias("corpus")).distinct().select(F.lit("q").alias("query_id"), "corpus", F.lit(ASKED_TERMS).alias("text"))
    return lexical.score(lexical.build(docs, "source", "doc_id", "text"), asked, 10).select("corpus", "unit", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@_query("knn_cosine", """
WITH near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS unit, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 20 = 0)
SELECT query_id, unit, rank, round(s, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, unit) AS rank FROM near) WHERE rank <= 10
""")  # fmt: skip
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("corpus"), F.col("vec_id").alias("unit"), F.col("embedding").alias("v"))
    q = e.where(F.col("unit") % 20 == 0).select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    return vectors.nearest_in_blocks(e, q, 10).select("query_id", "unit", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


@_query("knn_by_cells", ORACLES["knn_cosine"])
def knn_by_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours, without the cells that cannot hold any."""
    e = spread(table(spark, d, "embeddings")).select(F.col("label").alias("corpus"), F.col("vec_id").alias("unit"), F.col("embedding").alias("v"))
    q = e.where(F.col("unit") % 20 == 0).select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    near, _ = vectors.nearest_by_cells(e, q, 10)
    return near.select("query_id", "unit", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


SQL_SPANS = SQL_TURN_ASK + sql_bm25(80) + """,
f AS (SELECT 'f_' || turn_id AS unit, turn_id AS span, turn AS seq, turn % 4 <> 3 AS eligible FROM turn_docs WHERE length(text) % 3 > 0 UNION ALL SELECT 'g_' || turn_id, turn_id, 1000 + turn, true FROM turn_docs WHERE role = 'user'),
fh AS (SELECT query_id, f.unit, row_number() OVER (PARTITION BY query_id ORDER BY rank, f.seq, f.unit) AS rank FROM hits JOIN f ON hits.unit = f.span),
d AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY rank, unit) AS r FROM fh WHERE unit IN (SELECT unit FROM f WHERE eligible)),
direct AS (SELECT query_id, unit, 'bm25:' || unit AS head, 0.4 AS c, 1000000 + r AS ordinal FROM d WHERE r <= 10),
s AS (SELECT h.query_id, h.unit AS span, h.rank, f.unit, row_number() OVER (PARTITION BY h.query_id, h.unit ORDER BY f.seq, f.unit) AS k FROM hits h LEFT JOIN f ON h.unit = f.span AND f.eligible),
s2 AS (SELECT query_id, rank, k, coalesce(unit, span) AS unit, CASE WHEN unit IS NULL THEN 'bm25:span:' || span ELSE 'bm25:' || unit END AS head FROM s WHERE k <= 10),
s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY rank, k) = 1 AS new FROM s2),
s4 AS (SELECT *, coalesce(count(*) FILTER (new) OVER (PARTITION BY query_id ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s3),
spans AS (SELECT query_id, unit, head, 0.4 AS c, 2000000 + rank * 1000 + k AS ordinal FROM s4 WHERE b < 10),
heads AS (SELECT query_id, unit, head, max(c) AS c, min(ordinal) AS ordinal FROM (SELECT * FROM direct UNION ALL SELECT * FROM spans) GROUP BY ALL),
units AS (SELECT query_id, unit, 1 - product(1 - c) AS confidence, count(*) AS n_heads, min(ordinal) AS ordinal FROM heads GROUP BY ALL)
"""


@_query("facts_and_spans", "WITH" + SQL_SPANS + "SELECT query_id, unit, n_heads, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, ordinal, unit) AS rank FROM units")
def facts_and_spans(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are hit themselves and through their spans, one head each; superseded ones take no place."""
    from pyspark.sql.window import Window

    w, t = fusion.Weights(), turns(spark, d).select(F.col("turn_id").alias("span"), "idx", "role", F.length("content").alias("_l"))
    first = t.where(F.col("_l") % 3 > 0).select(F.concat(F.lit("f_"), "span").alias("unit"), "span", F.col("idx").alias("seq"), (F.col("idx") % 4 != 3).alias("eligible"))
    f = kept(first.unionByName(t.where("role = 'user'").select(F.concat(F.lit("g_"), "span").alias("unit"), "span", (F.col("idx") + 1000).alias("seq"), F.lit(True).alias("eligible"))), "facts-of-spans")
    hits = turn_hits(spark, d, 80)
    of_facts = hits.select("query_id", F.col("unit").alias("span"), "rank").join(f, "span").select("query_id", "unit", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "seq", "unit")).alias("rank"))
    channels = [fusion.direct(of_facts, f, "bm25", w.strong_direct, 1), fusion.through_spans(hits, f.select("span", "unit", "seq"), f, "bm25", w.strong_direct, 2)]
    return fusion.fuse(channels).select("query_id", "unit", "n_heads", F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


SQL_CHANNELS = SQL_TURN_ASK + sql_bm25(80) + """,
near AS (SELECT query_id, unit, unit AS head_unit, 'bm25_turn' AS chan, 0.4 AS c, 1000000 + rank AS ordinal FROM hits WHERE rank <= 10),
same AS (SELECT t.user_id, t.turn_id, t.session_id, t.turn, h.query_id, h.rank FROM hits h JOIN turn_docs t ON h.unit = t.turn_id),
summ AS (
  SELECT query_id, turn_id AS unit, session_id AS head_unit, 'summary' AS chan, 0.05 AS c, 2000000 + rank AS ordinal FROM (
    SELECT s.query_id, o.turn_id, s.session_id, s.rank FROM (SELECT query_id, session_id, min(rank) AS rank FROM same GROUP BY ALL) s
    JOIN turn_docs o ON s.session_id = o.session_id WHERE s.rank <= 10)),
ent AS (
  SELECT query_id, unit, role AS head_unit, 'entity' AS chan, 0.1 AS c, 3000000 + rank AS ordinal
  FROM (SELECT h.*, t.role, row_number() OVER (PARTITION BY h.query_id, t.role ORDER BY h.rank) AS rr FROM hits h JOIN turn_docs t ON h.unit = t.turn_id) WHERE rr <= 3),
chans AS (SELECT * FROM near UNION ALL SELECT * FROM summ UNION ALL SELECT * FROM ent),
heads AS (SELECT query_id, unit, chan, head_unit, max(c) AS c, min(ordinal) AS ordinal FROM chans GROUP BY ALL),
units AS (SELECT query_id, unit, 1 - product(1 - c) AS confidence, count(*) AS n_heads, min(ordinal) AS ordinal FROM heads GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, ordinal, unit) AS rank FROM units)
"""


def fused_turns(spark: SparkSession, d: str, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Three channels over turns: direct hits, the sessions of the first hits, and the speakers'; and any more."""
    w = fusion.Weights()
    t = turns(spark, d)
    hits = turn_hits(spark, d, 80).join(t.select(F.col("turn_id").alias("unit"), "session_id", "role"), "unit")
    direct = fusion.channel(hits, "bm25_turn", w.strong_direct, 1, w.heads)
    first = hits.groupBy("query_id", "session_id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= w.heads)
    ordinal = lambda n: F.lit(n * 1_000_000).cast("long") + F.col("rank")
    summary = first.join(t.select("session_id", F.col("turn_id").alias("unit")), "session_id").select("query_id", "unit", F.concat(F.lit("summary:"), "session_id").alias("head"), F.lit(w.weak_derived).alias("contribution"), ordinal(2).alias("ordinal"))
    from pyspark.sql.window import Window

    per_role = hits.select("*", F.row_number().over(Window.partitionBy("query_id", "role").orderBy("rank")).alias("_rr")).where(F.col("_rr") <= 3)
    entity = per_role.select("query_id", "unit", F.concat(F.lit("entity:"), "role").alias("head"), F.lit(w.strong_derived).alias("contribution"), ordinal(3).alias("ordinal"))
    return fusion.fuse([direct, summary, entity, *more])


@_query("noisy_or_fusion", "WITH" + SQL_CHANNELS + "SELECT query_id, unit, rank, n_heads, round(confidence, 6) AS confidence FROM fused WHERE rank <= 20")
def noisy_or_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused_turns(spark, d).where(F.col("rank") <= 20).select("query_id", "unit", F.col("rank").cast("long").alias("rank"), "n_heads", F.round("confidence", 6).alias("confidence"))


@_query("rrf_wide", "WITH" + SQL_TURN_ASK + sql_bm25(80) + """,
routes AS (
  SELECT query_id, unit, rank, score FROM hits
  UNION ALL SELECT h.query_id, h.unit, row_number() OVER (PARTITION BY h.query_id ORDER BY length(t.text) DESC, h.unit), greatest(0, 1 - 0.03 * (row_number() OVER (PARTITION BY h.query_id ORDER BY length(t.text) DESC, h.unit) - 1))
  FROM hits h JOIN turn_docs t ON h.unit = t.turn_id),
u AS (SELECT query_id, unit, sum(1.0::DOUBLE / (60 + rank) ORDER BY 1.0::DOUBLE / (60 + rank)) AS rrf, max(score) AS s FROM routes GROUP BY ALL)
SELECT query_id, unit, round(rrf + least(s, 5) * 0.05, 5) AS score FROM u
""")  # fmt: skip
def rrf_wide(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    hits = turn_hits(spark, d, 80)
    long = hits.join(turns(spark, d).select(F.col("turn_id").alias("unit"), F.length("content").alias("_l")), "unit")
    second = long.select("query_id", "unit", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_l"), "unit")).alias("rank"))
    second = second.select("query_id", "unit", "rank", F.greatest(F.lit(0.0), 1 - F.lit(0.03) * (F.col("rank") - 1)).alias("score"))
    routes = hits.select("query_id", "unit", "rank", "score").unionByName(second)
    return fusion.reciprocal(routes).select("query_id", "unit", F.round("score", 5).alias("score"))


# Turns and questions as counts of tokens in 64 places.
SQL_VECTORS = """,
vt AS (SELECT corpus, unit, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*)::DOUBLE AS w FROM (SELECT corpus, unit, unnest(t) AS term FROM tok) GROUP BY ALL),
vq AS (SELECT query_id, corpus, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, sum(times)::DOUBLE AS w FROM ask GROUP BY ALL),
vd AS (SELECT query_id, vt.corpus, unit, sum(vt.w * vq.w) AS dot FROM vt JOIN vq ON vt.corpus = vq.corpus AND vt.b = vq.b GROUP BY ALL),
vs AS (
  SELECT query_id, a.unit, dot / (n * m) AS similarity FROM vd a JOIN (SELECT corpus, unit, sqrt(sum(w * w)) AS n FROM vt GROUP BY ALL) x ON a.corpus = x.corpus AND a.unit = x.unit
  JOIN (SELECT query_id AS q, sqrt(sum(w * w)) AS m FROM vq GROUP BY ALL) y ON a.query_id = y.q),
vhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, unit) AS rank FROM vs) WHERE rank <= __K__)
"""


def vector_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    t = turns(spark, d)
    asked = vectors.hashed(_turn_queries(t), "corpus", "query_id", "text").select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    return vectors.nearest(vectors.hashed(spread(t), "user_id", "turn_id", "content"), asked, k).where(F.col("similarity") > 0).select("query_id", "unit", "similarity", "rank")


@_query("vector_turns", "WITH" + SQL_TURN_ASK + sql_bm25(10) + SQL_VECTORS.replace("__K__", "10") + "SELECT query_id, unit, rank, round(similarity, 6) AS similarity FROM vhits")
def vector_turns(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(spark, d, 10).select("query_id", "unit", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@_query("fused_with_vectors", "WITH" + (SQL_CHANNELS.replace(",\nnear AS", SQL_VECTORS.replace("__K__", "10") + ",\nnear AS", 1)
        .replace("UNION ALL SELECT * FROM ent)", "UNION ALL SELECT * FROM ent UNION ALL SELECT query_id, unit, unit, 'vector_turn', 0.2, 4000000 + rank FROM vhits)"))
        + "SELECT query_id, unit, rank, n_heads, round(confidence, 6) AS confidence FROM fused WHERE rank <= 20")
def fused_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    w = fusion.Weights()
    near = fusion.channel(vector_hits(spark, d, w.heads), "vector_turn", w.weak_direct, 4, w.heads)
    fused = fused_turns(spark, d, (near,)).where(F.col("rank") <= 20)
    return fused.select("query_id", "unit", F.col("rank").cast("long").alias("rank"), "n_heads", F.round("confidence", 6).alias("confidence"))


@_query("rrf_four_routes", "WITH" + SQL_TURN_ASK + sql_bm25(80) + SQL_VECTORS.replace("__K__", "40") + """,
place AS (SELECT h.query_id, h.rank AS pos, t.session_id, h.unit FROM hits h JOIN turn_docs t ON h.unit = t.turn_id),
linked AS (
  SELECT query_id, turn_id AS unit, row_number() OVER (PARTITION BY query_id ORDER BY pos, turn) AS rank
  FROM (SELECT query_id, session_id, min(pos) AS pos FROM place GROUP BY ALL) s JOIN turn_docs t USING (session_id) WHERE pos <= 3),
routes AS (
  SELECT query_id, unit, rank, score, 'bm25' AS route FROM hits UNION ALL SELECT query_id, unit, rank, greatest(0, 1 - 0.03 * (rank - 1)), 'vector' FROM vhits
  UNION ALL SELECT query_id, unit, rank, 0.9 - 0.02 * (rank - 1), 'linked' FROM linked UNION ALL SELECT query_id, unit, rank, 0.0, 'first' FROM hits WHERE rank <= 5),
u AS (SELECT query_id, unit, sum(1.0::DOUBLE / (60 + rank) ORDER BY 1.0::DOUBLE / (60 + rank)) AS rrf, max(score) AS s, string_agg(route, ',' ORDER BY route) AS routes FROM routes GROUP BY ALL)
SELECT query_id, unit, routes, round(rrf + least(s, 5) * 0.05, 5) AS score FROM u
""")
def rrf_four_routes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    t = turns(spark, d).select(F.col("turn_id").alias("unit"), "session_id", "idx")
    hits, near = turn_hits(spark, d, 80), kept(vector_hits(spark, d, 40), "vector-hits")
    first = hits.join(t, "unit").groupBy("query_id", "session_id").agg(F.min("rank").alias("_at")).where(F.col("_at") <= 3)
    linked = first.join(t, "session_id").select("query_id", "unit", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "idx")).alias("rank"))
    route = lambda df, name, score: df.select("query_id", "unit", F.lit(name).alias("route"), "rank", score.cast("double").alias("score"))
    step = F.col("rank") - 1
    routes = route(hits, "bm25", F.col("score")).unionByName(route(near, "vector", F.greatest(F.lit(0.0), 1 - F.lit(0.03) * step)))
    routes = kept(routes.unionByName(route(linked, "linked", 0.9 - F.lit(0.02) * step)).unionByName(route(hits.where("rank <= 5"), "first", F.lit(0.0))), "routes")
    named = routes.groupBy("query_id", "unit").agg(F.array_join(F.array_sort(F.collect_list("route")), ",").alias("routes"))
    return fusion.reciprocal(routes).join(named, ["query_id", "unit"]).select("query_id", "unit", "routes", F.round("score", 5).alias("score"))


@_query("degraded_routes", "WITH" + SQL_TURNS + "q AS (SELECT DISTINCT user_id FROM turn_docs) SELECT 'q_' || user_id AS query_id, CASE WHEN user_id LIKE '%3' THEN 'vector' ELSE '' END AS degraded FROM q")
def degraded_routes(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    have = t.where(~F.col("user_id").endswith("3")).select(F.col("user_id").alias("corpus"))
    return vectors.degraded(_turn_queries(t), have).select("query_id", F.array_join("degraded", ",").alias("degraded"))

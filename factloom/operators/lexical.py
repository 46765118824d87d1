"""BM25 over many corpora and many queries at once.

``postings`` is the index: it can be written, bucketed by term and read again, and
``statistics`` of it are aggregated per corpus. ``score`` joins the few query terms to the
postings by term, so only the postings of terms that are asked for take part.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_tokens
from ..sources.storage import kept, spread

# The usual constants of BM25, and the floor for terms in most documents.
K1, B, FLOOR = 1.5, 0.75, 0.25


def postings(docs: DataFrame, corpus: str, unit: str, text: str) -> DataFrame:
    """(corpus, unit, length, term, tf); a unit without tokens has one row with a null term."""
    tokens = docs.select(F.col(corpus).alias("corpus"), F.col(unit).alias("unit"), search_tokens(F.col(text)).alias("_t"))
    each = tokens.select("corpus", "unit", F.size("_t").alias("length"), F.explode_outer("_t").alias("term"))
    return each.groupBy("corpus", "unit", "length", "term").agg(F.count("term").alias("tf"))


def build(docs: DataFrame, corpus: str, unit: str, text: str) -> DataFrame:
    """The postings, written once to the shared folder: statistics, queries and hits read them from there."""
    return kept(postings(spread(docs), corpus, unit, text), "postings")


def stored(docs: DataFrame, corpus: str, unit: str, text: str, folder: str, version: str) -> DataFrame:
    """The postings of a version of docs: read if that version was written to its end before, else made and written."""
    spark, path = docs.sparkSession, f"{folder.rstrip('/')}/version={version}"
    try:
        spark.read.parquet(f"{path}/mark")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        # What a writer left that did not come to its mark is overwritten.
        postings(docs, corpus, unit, text).write.mode("overwrite").parquet(f"{path}/postings")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")
    return spark.read.parquet(f"{path}/postings")


def counts(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, n, total) and (corpus, term, df): what statistics are made of, and what can be added up over parts of an index."""
    units = index.groupBy("corpus", "unit").agg(F.first("length").alias("length"))
    corpora = units.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    return corpora, index.where(F.col("term").isNotNull()).groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))


def statistics(units: DataFrame, frequency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, n, avgdl, mean_idf) and (corpus, term, idf), idf before the floor, from counts."""
    corpora = units.select("corpus", "n", (F.col("total") / F.col("n")).alias("avgdl"))
    idf = frequency.join(corpora, "corpus").select("corpus", "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.groupBy("corpus").agg(F.avg("idf").alias("mean_idf"))
    return corpora.join(mean, "corpus"), idf


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, corpus, term, times) of queries (query_id, corpus, text)."""
    return queries.select("query_id", "corpus", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "corpus", "term").agg(F.count(F.lit(1)).alias("times"))


def score(index: DataFrame, queries: DataFrame, k: int, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, corpus, unit, score, rank) from queries (query_id, corpus, text): the k best, then those above 0.

    known: the index's counts, where they are stored.
    """
    corpora, idf = statistics(*(known or counts(index)))
    asked = asked_terms(queries)
    weighted = asked.join(idf, ["corpus", "term"]).join(corpora, "corpus").select(
        "query_id", "corpus", "term", "times", "avgdl", F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf")).alias("w"))
    hits = index.join(weighted, ["corpus", "term"])
    part = F.col("times") * F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    # Parts are added in term order, so that equal texts have equal sums.
    parts = F.array_sort(F.collect_list(F.struct("term", part.alias("p"))))
    total = hits.groupBy("query_id", "corpus", "unit").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["p"]).alias("score"))
    ranked = total.select("*", F.row_number().over(Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("score", 9)), "unit")).alias("rank"))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > 0))

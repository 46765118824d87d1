"""Exact cosine neighbours of a stated set of queries, per corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_tokens
from ..sources.storage import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed(docs: DataFrame, corpus: str, unit: str, text: str, size: int = 64) -> DataFrame:
    """(corpus, unit, v) without a model: tokens counted in as many places as v is long, a token's place by its hash."""
    place = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("int") % size
    each = docs.select(F.col(corpus).alias("corpus"), F.col(unit).alias("unit"), F.explode(search_tokens(F.col(text))).alias("term"))
    counted = each.groupBy("corpus", "unit", place.alias("b")).count().groupBy("corpus", "unit").agg(F.map_from_entries(F.collect_list(F.struct("b", "count"))).alias("_m"))
    return counted.select("corpus", "unit", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0)).cast("double")).alias("v"))


def degraded(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, degraded): the routes that a query has to do without, as its corpus has no vectors."""
    known = vectors.select("corpus").distinct().withColumn("_k", F.lit(True))
    return queries.join(known, "corpus", "left").select("query_id", F.when(F.col("_k"), F.array().cast("array<string>")).otherwise(F.array(F.lit("vector"))).alias("degraded"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, corpus, unit, similarity, rank) from vectors (corpus, unit, v) and queries (query_id, corpus, q).

    Norms are taken once a vector; the k best of each task survive the shuffle
    (``row_number() <= k`` is planned as a group limit).
    """
    v = vectors.select("corpus", "unit", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("_nv"))
    q = queries.select("query_id", "corpus", "q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("_nq"))
    near = v.join(q, "corpus").select("query_id", "corpus", "unit", (dot(F.col("v"), F.col("q")) / (F.col("_nv") * F.col("_nq"))).alias("similarity"))
    order = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("similarity", 9)), "unit")
    return near.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


#: Numbers in a block of vectors, and half as many in one of queries; products that one task holds at a time.
BLOCK = 2**21
PRODUCTS = 2**22


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The scalar products of rows, added up place by place as ``dot`` does; a and b transposed."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _near(v: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of v, similarities): at least all pairs that can be among the k nearest of a query, the exact way.

    Matrix products find them with a margin far beyond their error and beyond nine places; what has no finite length is taken whole.
    """
    with np.errstate(all="ignore"):
        vt, qt = np.ascontiguousarray(v.T), np.ascontiguousarray(q.T)
        nv, nq = np.sqrt(_sums(vt, vt)), np.sqrt(_sums(qt, qt))
        fine_v, fine_q = np.isfinite(nv) & (nv > 0), np.isfinite(nq) & (nq > 0)
        unit = np.where(fine_v, vt / nv, 0.0)
        step = max(1, PRODUCTS // len(v))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            about = (q[some] / nq[some, None]) @ unit
            about[:, ~fine_v] = -np.inf
            least = np.partition(about, -k, axis=1)[:, -k, None] if len(v) > k else np.full((len(about), 1), -np.inf)
            rows, cols = np.nonzero((about >= least - 1e-8) | ~fine_v | ~fine_q[some, None])
            rows += at
            yield rows, cols, _sums(vt[:, cols], qt[:, rows]) / (nv[cols] * nq[rows])


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What ``nearest`` gives, by matrix products of blocks: each block of a corpus's vectors meets each block of its queries in one task.

    All pairs are compared. Of equal vectors the k first units can be neighbours, so no more are taken to the blocks. A corpus with nulls or
    with vectors of several lengths goes through ``nearest``. Without a length a similarity is NaN here, which ranks first, as in SQL.
    """
    whole = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))
    known = lambda df, c: df.groupBy("corpus").agg(F.count(F.lit(1)).alias("_n" + c), F.min(F.size(c)).alias("_lo" + c), F.max(F.size(c)).alias("_hi" + c), F.min(whole(F.col(c))).alias("_w" + c))
    even = F.col("_wv") & F.col("_wq") & (F.col("_lov") == F.col("_hiv")) & (F.col("_loq") == F.col("_hiq")) & (F.col("_lov") == F.col("_loq")) & (F.col("_lov") > 0)
    blocks = lambda n, size: F.ceil(F.col(n) * F.col("_hiv") / size)
    both = known(vectors, "v").join(known(queries, "q"), "corpus")
    corpora = kept(both.select("corpus", even.alias("_even"), blocks("_nv", BLOCK).alias("_vs"), blocks("_nq", BLOCK // 2).alias("_qs")), "corpora")
    plain = corpora.where("_even").drop("_even")
    first = Window.partitionBy("corpus", "v").orderBy("unit")
    v = vectors.join(plain, "corpus").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    v = v.select("corpus", "unit", "v", F.pmod(F.xxhash64("unit"), F.col("_vs")).alias("_b"), every("_qs").alias("_c"))
    q = queries.join(plain, "corpus").select(F.col("corpus").alias("_of"), "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("_qs")).alias("_d"), every("_vs").alias("_a"))

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["query_id"][:0], "corpus": left["corpus"][:0], "unit": left["unit"][:0], "similarity": np.zeros(0)})
        left, out = left.sort_values("unit", ignore_index=True), []
        for rows, cols, similarity in _near(np.array(left["v"].tolist(), np.float64), np.array(right["q"].tolist(), np.float64), k):
            found = pd.DataFrame({"row": rows, "col": cols, "similarity": similarity})
            # Units are in order, and of one similarity the first k can count.
            out.append(found[found.groupby(["row", "similarity"], dropna=False).cumcount() < k])
        found = pd.concat(out)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[found["row"]], "corpus": left["corpus"].iloc[0], "unit": left["unit"].to_numpy()[found["col"]], "similarity": found["similarity"].to_numpy()})

    kinds = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    near = v.groupBy("corpus", "_b", "_c").cogroup(q.groupBy("_of", "_a", "_d")).applyInPandas(compared, f"query_id {kinds['query_id']}, corpus {kinds['corpus']}, unit {kinds['unit']}, similarity double")
    order = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("similarity", 9)), "unit")
    near = near.withColumn("similarity", F.coalesce("similarity", F.lit(float("nan"))))  # pandas hands NaN over as null
    top = near.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    odd = corpora.where(~F.col("_even")).select("corpus")
    if odd.isEmpty():
        return top
    return top.unionByName(nearest(vectors.join(odd, "corpus", "left_semi"), queries.join(odd, "corpus", "left_semi"), k))


def embedder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A function from a text column to a column of vectors by a model: ``encode`` gets a batch of texts and gives a row each.

    It is loaded where the batches are; null texts have null vectors.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            there = batch.notna()
            made = iter(np.asarray(encode(batch[there].tolist()), np.float64)) if there.any() else iter(())
            yield pd.Series([next(made) if has else None for has in there], dtype=object)

    return embed


def _distances(pivots: list[list[float]], v: Column) -> Column:
    """The distances of a unit vector to each pivot."""
    return F.array(*(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.array(*map(F.lit, p)), v))) for p in pivots))


def _unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cells(vectors: DataFrame, n_pivots: int = 16) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """(vectors with their cell and distance to its pivot, cells with their least and greatest distance and size, pivots).

    vectors (corpus, unit, v) of a length above 0. Pivots are the vectors with the least hashes, n_pivots at most, so they are the same at every
    run; each vector is in the cell of its nearest pivot. The first result is written and can be searched again and again.
    """
    real = vectors.where(dot(F.col("v"), F.col("v")) > 0).select("corpus", "unit", _unit(F.col("v")).alias("u"))
    chosen = real.orderBy(F.xxhash64("corpus", "unit"), "unit").limit(n_pivots).select("u").collect()
    pivots = [list(r["u"]) for r in chosen]
    if not pivots:
        return real.withColumns({"cell": F.lit(0), "d": F.lit(0.0)}), real.select("corpus", F.lit(0).alias("cell"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("size")), pivots
    near = real.withColumn("_d", _distances(pivots, F.col("u"))).withColumn("d", F.array_min("_d"))
    placed = kept(near.withColumn("cell", (F.array_position("_d", F.col("d")) - 1).cast("int")).drop("_d"), "cells")
    return placed, placed.groupBy("corpus", "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("size")), pivots


def nearest_by_cells(vectors: DataFrame, queries: DataFrame, k: int, n_pivots: int = 16) -> tuple[DataFrame, DataFrame]:
    """(what ``nearest`` gives, (query_id, cells, searched)): exact, without the cells that cannot hold a neighbour.

    A vector in a cell is at least as far from a query as their distances to the pivot differ. First each query
    searches its nearest cells that hold k vectors together; the k-th distance found bounds the rest. Of
    the other cells those that may be nearer are searched, and of these the vectors that may.
    """
    placed, by_cell, pivots = cells(vectors, n_pivots)
    q = queries.where(dot(F.col("q"), F.col("q")) > 0).select("query_id", "corpus", _unit(F.col("q")).alias("q"))
    q = kept(q.withColumn("_to", _distances(pivots, F.col("q")) if pivots else F.array(F.lit(0.0))), "asked")
    pairs = q.join(by_cell, "corpus").withColumn("to", F.get("_to", F.col("cell")))
    bound = pairs.select("query_id", "corpus", "cell", "size", "to", F.greatest(F.lit(0.0), F.col("to") - F.col("hi"), F.col("lo") - F.col("to")).alias("bound"))
    order = Window.partitionBy("query_id", "corpus").orderBy("bound", "to", "cell")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bound = kept(bound.withColumn("first", before < k), "bounds")

    def found(asked: DataFrame) -> DataFrame:
        both = placed.join(asked, ["corpus", "cell"]).where(F.abs(F.col("to") - F.col("d")) <= F.col("most")) if "most" in asked.columns else placed.join(asked, ["corpus", "cell"])
        return both.join(q.select("query_id", "corpus", "q"), ["query_id", "corpus"]).select("query_id", "corpus", "unit", dot(F.col("u"), F.col("q")).alias("similarity"))

    ranked = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("similarity", 9)), "unit")
    top = lambda rows: rows.select("*", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= k)
    one = kept(top(found(bound.where("first").select("query_id", "corpus", "cell"))), "first-neighbours")
    # Similarities are compared to nine places, so what is equal to that is not cut off.
    worst = one.where(F.col("rank") == k).select("query_id", "corpus", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity")) + 1e-8).alias("most"))
    more = bound.where(~F.col("first")).join(worst, ["query_id", "corpus"]).where(F.col("bound") <= F.col("most"))
    two = found(more.select("query_id", "corpus", "cell", "to", "most"))
    searched = bound.join(more.select("query_id", "corpus", "cell", F.lit(True).alias("_m")), ["query_id", "corpus", "cell"], "left")
    cost = searched.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("first") | F.col("_m").isNotNull()).alias("searched"))
    return top(one.drop("rank").unionByName(two)), cost


def lsh_nearest(vectors: DataFrame, queries: DataFrame, k: int, length: float = 2.0, tables: int = 4, distance: float = 1.2) -> DataFrame:
    """An approximate variant by random projections, for corpora beyond brute force."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = lambda df, c: df.withColumn("features", array_to_vector(F.transform(c, lambda x: x.cast("double") / F.sqrt(dot(c, c)))))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length, numHashTables=tables, seed=7).fit(unit(vectors, F.col("v")))
    pairs = model.approxSimilarityJoin(unit(queries, F.col("q")), unit(vectors, F.col("v")), distance, "distance").where("datasetA.corpus = datasetB.corpus")
    near = pairs.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetA.corpus").alias("corpus"), F.col("datasetB.unit").alias("unit"), (1 - F.col("distance") ** 2 / 2).alias("similarity"))
    order = Window.partitionBy("query_id", "corpus").orderBy(F.desc("similarity"), "unit")
    return near.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)

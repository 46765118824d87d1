"""A lexical index that grows: parts by version, counts by addition, compaction, marks of completion.

A version is a folder of postings by bucket of terms, with its counts beside them; it costs its own rows alone. Counts of
a corpus are sums over its versions, so nothing old is read to add something new. A compaction writes one version in
the place of several. A version counts from the moment its mark is written, which is last; what a writer left
without a mark is overwritten by the next attempt and never read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical

#: Buckets of terms, each a folder: a question reads those of its terms.
BUCKETS = 64


def bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _marks(self) -> list[tuple[int, int]]:
        """(version, first version it stands for) of those that are complete; one small row a version comes to the driver."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/marks").collect()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        return sorted((r["version"], r["since"]) for r in rows)

    def versions(self) -> list[int]:
        """The versions to read: the last compaction, and what came after it."""
        marks = self._marks()
        base = max((v for v, since in marks if since < v), default=0)
        return [v for v, _ in marks if v >= base]

    def _write(self, version: int, since: int, postings: DataFrame, counts: tuple[DataFrame, DataFrame]) -> None:
        path = f"{self.root}/versions/{version}"
        placed = postings.withColumn("bucket", F.coalesce(bucket(), F.lit(0)))
        placed.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        for name, table in zip(("units", "terms"), counts, strict=True):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        mark = self.spark.range(1).coalesce(1).select(F.lit(version).cast("long").alias("version"), F.lit(since).cast("long").alias("since"))
        mark.write.mode("overwrite").parquet(f"{self.root}/marks/part={version}")

    def append(self, docs: DataFrame, corpus: str, unit: str, text: str) -> int:
        """A version of units that the index does not have yet; its number."""
        version = max((v for v, _ in self._marks()), default=0) + 1
        made = lexical.postings(docs, corpus, unit, text)
        path = f"{self.root}/versions/{version}/made"
        made.write.mode("overwrite").parquet(path)
        made = self.spark.read.parquet(path)
        self._write(version, version, made, lexical.counts(made))
        return version

    def _read(self, name: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/versions/{v}/{name}") for v in self.versions()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def postings(self) -> DataFrame:
        """All postings (corpus, unit, length, term, tf, bucket)."""
        return self._read("postings")

    def counts(self) -> tuple[DataFrame, DataFrame]:
        """Units and frequencies of terms by corpus, added up over the versions."""
        units = self._read("units").groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return units, self._read("terms").groupBy("corpus", "term").agg(F.sum("df").alias("df"))

    def score(self, queries: DataFrame, k: int) -> DataFrame:
        """As ``lexical.score``; only the buckets of the asked terms are read."""
        asked = lexical.asked_terms(queries).select(bucket().alias("b")).distinct()
        wanted = [r["b"] for r in asked.collect()]  # BUCKETS numbers at most
        held = self.postings().where(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        return lexical.score(held.drop("bucket"), queries, k, self.counts())

    def compact(self) -> int:
        """One version in the place of all that are there; those stay on disk for readers that have begun."""
        version, since = max(v for v, _ in self._marks()) + 1, min(self.versions())
        self._write(version, since, self.postings().drop("bucket"), self.counts())
        return version

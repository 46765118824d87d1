"""Sinks that count a batch once however often it is written, and counters that are drained.

A stream's checkpoint says which offsets a batch has; a restart runs the last batch again under the
same id and with the same rows if it was not committed. So a batch is written to a folder named
by its id, which a repetition overwrites, and a mark is written after it; readers
take marked batches only. That is the contract of a resumable job: pending while unmarked, committed with its
mark, sent again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Ledger:
    """Batches of rows under ``root``/data/batch=<id>, each with a mark under ``root``/marks/batch=<id>."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch, then its mark. Writing the same batch again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        n = self.spark.read.parquet(f"{self.root}/data/batch={batch}").groupBy().agg(F.count(F.lit(1)).alias("n"))
        n.write.mode("overwrite").parquet(f"{self.root}/marks/batch={batch}")

    def sink(self, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch. ``after`` runs when a batch is marked and not yet in the stream's commit log."""

        def put(rows: DataFrame, batch: int) -> None:
            self.write(rows, batch)
            if after:
                after(batch)

        return put

    def marks(self) -> DataFrame:
        """(n, batch) of the committed batches."""
        return self.spark.read.parquet(f"{self.root}/marks")

    def read(self) -> DataFrame:
        """The rows of all committed batches, with their batch. One mark a batch is broadcast."""
        marked = self.marks().select("batch")
        return self.spark.read.option("mergeSchema", "false").parquet(f"{self.root}/data").join(F.broadcast(marked), "batch", "left_semi")

    def batch(self, batch: int, like: DataFrame) -> DataFrame:
        """The rows of one batch alone, with the columns and in the session of ``like``."""
        return like.sparkSession.read.schema(like.schema).parquet(f"{self.root}/data/batch={batch}")

    def forget(self, batch: int) -> None:
        """Deletes a batch that nothing reads any more, its mark first."""
        context = self.spark.sparkContext
        for part in ("marks", "data"):
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/batch={batch}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def latest(self, *keys: str) -> DataFrame:
        """The last row of each key: what an update-mode stream has come to."""
        last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        return self.read().withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def undrained(counters: DataFrame, drained: DataFrame, key: str) -> DataFrame:
    """Counters (key, n_new, first, last) less what was drained (key, n): what a refresh still has to look at."""
    seen = drained.groupBy(key).agg(F.max("n").alias("_n"))
    left = counters.join(seen, key, "left").withColumn("n_new", F.col("n_new") - F.coalesce("_n", F.lit(0)))
    return left.where(F.col("n_new") > 0).drop("_n")


def run_in_slices(df: DataFrame, folder: str, bounds: list, by: str, start: Callable[[int], object], again: bool = False) -> None:
    """Hands df to a stream in several runs, as a scheduled job gets it: the rows of each range of ``by``, in order.

    Each slice is appended to folder, and ``start(k)`` starts the query that reads it and takes up
    at its checkpoint; a query that fails is started once more. With ``again`` each slice also
    brings the rows of the one before, as a source with at-least-once delivery does.
    """
    edges = [None, *bounds, None]
    for k in range(len(edges) - 1):
        low, high = edges[max(k - 1, 0) if again else k], edges[k + 1]
        rows = df if low is None else df.where(F.col(by) >= low)
        rows = rows if high is None else rows.where(F.col(by) < high)
        rows.write.mode("append").parquet(folder)
        try:
            start(k).awaitTermination()
        except StreamingQueryException:
            start(k).awaitTermination()

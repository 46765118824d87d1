"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out where it comes in fewer parts than there are cores (one small file); rows with work do not wait for one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """df with its columns of these names (in any case) under other names, and all its names as they now are, in order."""
    taken, have = {n.lower() for n in names}, {c.lower() for c in df.columns}
    now = []
    for c in df.columns:
        new = c
        while new.lower() in taken or (new != c and new.lower() in have):
            new = "given_" + new
        have.add(new.lower())
        now.append(new)
    return (df if now == df.columns else df.toDF(*now)), now


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset in a local session (a test) is a temporary folder chosen, and
    then it becomes the session's setting; on a cluster its absence is an error, as
    executors would not see the driver's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what came before)
    and lets Spark delete the shuffle files that led to df at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    return kept


def release(*kept: DataFrame) -> None:
    """Delete tables that materialise has written, once nothing reads them any more."""
    for df in kept:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that ``join_by_hot_key`` broadcasts: the most frequent ones, 16 bytes and the values each.
HOT_KEYS = 10_000


def join_by_hot_key(rows: DataFrame, by_key: DataFrame, key: str, count: str, values: list[str]) -> DataFrame:
    """rows with the values of by_key, one row a key with how often rows have it (``count``).

    The HOT_KEYS most frequent keys are broadcast, so none of their rows is shuffled, and of the
    other keys each has at most one row in HOT_KEYS: no task gets many rows of one key. Both inputs are
    read twice; by_key should be a written table and holds every key of rows.
    """
    hot = by_key.orderBy(F.desc(count), key).limit(HOT_KEYS).select(key, *values, F.lit(True).alias("_hot"))
    first = rows.join(F.broadcast(hot), key, "left")
    done = first.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = first.where(F.col("_hot").isNull()).drop("_hot", *values).join(by_key.select(key, *values), key)
    return done.unionByName(rest)

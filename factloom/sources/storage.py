"""Snapshots of tables in a folder, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"


class VersionMismatch(RuntimeError):
    """A store was written under another schema, prompt or embedder."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's spark.checkpoint.dir; that is set only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new shared folder and read back: its lineage is cut, and it is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out where it comes in fewer parts than there are cores (one small file), for work that is heavy by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Store:
    """A folder of Parquet tables, one folder a snapshot; a mutation writes the next snapshot."""

    def __init__(self, spark: SparkSession, root: str, versions: Mapping[str, str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = {"schema": SCHEMA_VERSION, **(versions or {})}

    def provision(self) -> None:
        rows = self.spark.createDataFrame(sorted(self.versions.items()), "key string, value string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/store_meta")

    def check(self) -> None:
        found = {r["key"]: r["value"] for r in self.spark.read.parquet(f"{self.root}/store_meta").collect()}  # a handful of rows
        drift = {k for k in found.keys() | self.versions.keys() if found.get(k) != self.versions.get(k)}
        if drift:
            raise VersionMismatch(f"the store differs in {sorted(drift)}")

    def write(self, table: str, df: DataFrame, snapshot: int, by: str | None = "user_id") -> None:
        """A snapshot, sorted by user within files so that scans of one user skip row groups."""
        rows = df.sortWithinPartitions(by) if by and by in df.columns else df
        rows.write.mode("errorifexists").parquet(f"{self.root}/{table}/snapshot={snapshot}")

    def read(self, table: str, snapshot: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/snapshot={snapshot}")

    def migrate(self, df: DataFrame, renames: Mapping[str, str], added: Mapping[str, str]) -> DataFrame:
        """Old columns under their new names, and missing ones as nulls of a type."""
        out = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})
        return out.withColumns({c: F.lit(None).cast(kind) for c, kind in added.items() if c not in out.columns})

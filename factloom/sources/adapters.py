"""The memory model's tables as views of other tables.

turns: conversations by user and session. facts: events as versions of a slot (their type).
graph: the star schema's keys as typed edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704067200.0  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, session_id, turn_id, idx, role, content, timestamp)."""
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("u"), (F.col("conv_id") % 20).cast("string")).alias("user_id"), session.alias("session_id"),
        F.concat(session, F.lit("_turn_"), F.col("turn").cast("string")).alias("turn_id"), F.col("turn").alias("idx"), "role",
        F.col("text").alias("content"), (F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") / 1000.0).alias("timestamp"),
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(fact_id, user_id, event_type, valid_from, quantity, object, seq) from events."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fact_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"), F.col("value").alias("quantity"),
        F.get_json_object("props", "$.k").cast("string").alias("object"), F.col("event_id").alias("seq"),
    )


def graph(spark: SparkSession, folder: str) -> DataFrame:
    """(src, edge_type, dst): PLACED, CONTAINS, SUPPLIED_BY and IN edges of the star schema."""
    node = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("edge_type"), dst.alias("dst"))
    t = lambda name: table(spark, folder, name)
    lines = t("lineitem")
    parts = [
        edge(t("orders"), node("customer", "o_custkey"), "PLACED", node("order", "o_orderkey")),
        edge(lines, node("order", "l_orderkey"), "CONTAINS", node("part", "l_partkey")).distinct(),
        edge(lines, node("order", "l_orderkey"), "SUPPLIED_BY", node("supplier", "l_suppkey")).distinct(),
        edge(t("supplier"), node("supplier", "s_suppkey"), "IN", node("nation", "s_nationkey")),
        edge(t("customer"), node("customer", "c_custkey"), "IN", node("nation", "c_nationkey")),
        edge(t("nation"), node("nation", "n_nationkey"), "IN", node("region", "n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

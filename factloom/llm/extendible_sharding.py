"""Sharding by extendible hashing under a byte limit.

Each row has a 60-bit hash. A bucket is a prefix of those bits; the directory starts with
one bucket of all rows, and only buckets over the limit split on their next bit. The
shard of a row is therefore its shortest prefix whose rows fit. The sizes of all prefixes
come from one aggregated histogram of fixed fine cells; rows in the rare cells that would
have to split further are looked at bit by bit.

Sizes are added up before they are shuffled, and the rows themselves move only when
``write_shards`` is called. A row that is larger than the limit by itself has a shard of its
own (``oversized``). Equal rows share all their bits; a bucket of such rows only is dealt
into parts of as many rows as fit.

Defined results for edge cases: a null text has 0 bytes; a null key hashes as an empty
string; repeated rows share a prefix and are parted by count; an empty table gives an
empty result; further columns of the input do not matter (``assign`` returns the key).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

BITS = 60


def row_hash(key: str, text: str) -> Column:
    """60 bits that depend on the key and the text of a row."""
    both = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _leaves(cells: DataFrame, cell_bits: int, first: int, limit: int) -> DataFrame:
    """For each cell (cell, bytes, rows) its shortest prefix that fits: (cell, depth, shard_bytes, shard_rows); none if even the cell doesn't.

    cells is a written table. The prefixes of all depths are added up and those that fit under one that does not are written; no
    join sees the others, which Spark takes for as few as the cells.
    """
    levels = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(first), F.lit(cell_bits))).alias("depth"))
    levels = levels.select("*", F.expr(f"shiftright(cell, {cell_bits} - depth)").alias("shard"))
    sizes = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    above = sizes.groupBy("depth", F.expr("shiftright(shard, 1)").alias("_up")).agg(F.sum("shard_bytes").alias("_b"), F.sum("shard_rows").alias("_n"), F.collect_list(F.struct("shard", "shard_bytes", "shard_rows")).alias("_two"))
    # A leaf fits while the prefix one bit shorter does not; each cell has at most one.
    split = above.where((F.col("depth") == first) | ((F.col("_b") > limit) & (F.col("_n") > 1)))
    top = materialise(split.select("depth", F.inline("_two")).where(fits), "sharding-leaves")
    depths = sorted(r["depth"] for r in top.select("depth").distinct().collect())  # BITS at most
    near = cells.select("cell", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("depth"))
    found = near.select("*", F.expr(f"shiftright(cell, {cell_bits} - depth)").alias("shard")).join(top, ["depth", "shard"])
    return found.select("cell", "depth", "shard", "shard_bytes", "shard_rows")


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", spare_bits: int = 6) -> DataFrame:
    """(key, n_bytes, depth, shard, part, shard_bytes, oversized) for each row of docs.

    shard is the number that the first ``depth`` hash bits spell; part is 0 except in a
    bucket of equal rows. shard_bytes is the size of the shard (for parts: of all parts).
    """
    sized = docs.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), row_hash(key, text).alias("_h"))
    sized = materialise(sized, "sharding-sizes")
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + spare_bits))
    placed = sized.select("*", F.expr(f"shiftright(_h, {BITS - bits})").alias("cell"))
    cells = placed.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    cells = materialise(cells, "sharding-cells")
    coarse = _leaves(cells, bits, 0, limit)
    first = placed.join(coarse.hint("merge"), "cell", "left")
    done = first.where(F.col("depth").isNotNull()).select(key, "n_bytes", "_h", "depth", "shard", "shard_bytes", "shard_rows")
    # The rest: rows of cells that hold several rows and too many bytes.
    crowded = cells.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("cell")
    rest = placed.join(crowded, "cell", "left_semi")
    fine = materialise(rest.groupBy(F.col("_h").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "sharding-fine")
    deep = _leaves(fine, BITS, bits, limit).withColumnRenamed("cell", "_h")
    last = rest.select(key, "n_bytes", "_h").join(deep.hint("merge"), "_h", "left")
    deeper = last.where(F.col("depth").isNotNull()).select(key, "n_bytes", "_h", "depth", "shard", "shard_bytes", "shard_rows")
    # Equal rows that fit no more together: as many to a part as the limit holds.
    equal = last.where(F.col("depth").isNull()).select(key, "n_bytes", "_h", F.lit(BITS).alias("depth"), F.col("_h").alias("shard"))
    w = Window.partitionBy("_h").orderBy(F.lit(0))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    parted = equal.select("*", F.floor((F.row_number().over(w) - 1) / each).cast("long").alias("part"), F.sum("n_bytes").over(Window.partitionBy("_h")).alias("shard_bytes"))
    out = [F.col(key), F.col("n_bytes"), F.col("depth").cast("int").alias("depth"), F.col("shard")]
    whole = done.unionByName(deeper).select(*out, F.lit(0).cast("long").alias("part"), "shard_bytes")
    both = whole.unionByName(parted.select(*out, "part", "shard_bytes"))
    return both.select("*", (F.col("n_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write docs as one folder a shard. Keys must be unique here."""
    name = F.concat_ws("-", F.lpad(F.col("depth").cast("string"), 2, "0"), F.col("shard").cast("string"), F.col("part").cast("string"))
    placed = docs.join(assigned.select(key, name.alias("shard_name")), key)
    placed.repartition("shard_name").write.partitionBy("shard_name").parquet(path)


#: The same assignment in DuckDB's SQL, bit by bit from the empty prefix.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (SELECT doc_id, n_bytes, h, d.depth, h >> (60 - d.depth) AS shard FROM sized, (SELECT unnest(range(0, 61)) AS depth) d),
sizes AS (
  SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes FROM levels GROUP BY depth, shard
  HAVING sum(n_bytes) <= __LIMIT__ OR count(*) = 1),
leaf AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM levels JOIN sizes USING (depth, shard) GROUP BY doc_id, n_bytes, h)
SELECT doc_id, n_bytes, leaf.depth::INT AS depth, shard, 0::BIGINT AS part, shard_bytes, n_bytes > __LIMIT__ AS oversized
FROM leaf JOIN sizes ON leaf.depth = sizes.depth AND leaf.h >> (60 - leaf.depth) = sizes.shard
"""

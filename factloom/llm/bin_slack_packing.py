"""Best-fit packing by minimum bin slack.

``plan`` works on the histogram of piece lengths, which has at most ``capacity`` entries
whatever the corpus: per bin, a bitset subset-sum over the available lengths finds the
fullest feasible combination with the longest piece left, and the combination is taken as
often as its lengths last. Which rows take which place then follows from each row's rank
among the rows of its length, so no group of equal lengths meets in one task: ranks are
counted within (length, bucket) and shifted by the buckets before.

Defined results for edge cases: a null text counts as an empty one, whose ids are the end
id alone; only documents longer than the capacity are cut; repeated rows are packed row by
row; an empty table gives an empty result; further columns of the input do not matter (the
key is returned).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vocabulary
from .common import materialise

#: Rows in a (length, bucket) group at most, about.
_GROUP = 50_000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of each document's ids, cut at the capacity."""
    shared = vocabulary.SharedEncoder(docs.sparkSession, path)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.get()
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["_text"], strict=True):
                ids = own.encode(t or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("int64")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names)

    # Keys travel as text: pandas would turn whole numbers with nulls among them into floats.
    schema = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("piece",)), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    names = schema.fieldNames()
    done = docs.select(F.col(key).cast("string").alias(key), F.col(text).alias("_text")).mapInPandas(cut, schema)
    return done.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length (sorted, longest first) to fill room as far as can be."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        left, take = min(counts[n], room // n), 1
        while left > 0:  # counts in powers of two
            take = min(take, left)
            steps.append((reach, n, take))
            reach = (reach | reach << (n * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, n, take in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            taken[n] = taken.get(n, 0) + take
    return taken


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, first offset), by length and rank."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        taken = fullest(lengths, counts, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in taken.items())
        offset = 0
        for n, k in sorted(taken.items(), reverse=True):
            rows.append((n, used[n], k, sequence, offset))
            used[n] += k * times
            counts[n] -= k * times
            offset += n * k
        sequence += times
        if any(counts[n] == 0 for n in taken):
            lengths = [n for n in lengths if counts[n]]
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """cut with _rank, each row's place among the rows of its length, and the lengths' counts."""
    buckets = max(16, -(-cut.count() // _GROUP))
    placed = cut.withColumn("_b", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.lit(buckets)))
    groups = placed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = groups.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    histogram = {r[0]: r[1] for r in placed.groupBy("length").count().collect()}  # as many rows as the capacity at most
    inner = F.row_number().over(Window.partitionBy("length", "_b").orderBy(key, "piece", "start", "ids_crc32")) - 1
    return placed.withColumn("_rank", inner).join(before, ["length", "_b"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_b", "_before"), histogram


def pack(cut: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """cut (rows with key, piece, start, length) with sequence_id and offset."""
    rows, histogram = ranked(cut, key)
    rows = rows.withColumn(key, F.col(key).cast("string"))
    shared = cut.sparkSession.sparkContext.broadcast(plan(histogram, capacity))  # as long as the histogram, about
    schema = T.StructType([*(f for f in rows.schema if f.name != "_rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, each, sequence, offset = shared.value.T
        keys = (length << 44) + first
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            at = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            inner = rank - first[at]
            batch["sequence_id"] = sequence[at] + inner // each[at]
            batch["offset"] = offset[at] + inner % each[at] * n
            yield batch.drop(columns="_rank")[schema.fieldNames()]

    return rows.mapInPandas(place, schema).withColumn(key, F.col(key).cast(cut.schema[key].dataType))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places in as few sequences as the method finds."""
    cut = materialise(pieces(docs, path, capacity, end_id, key, text, with_ids), "pieces")
    return pack(cut, capacity, key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with ids; a sequence is at most the capacity long."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"))

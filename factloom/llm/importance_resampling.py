"""Importance resampling toward a target distribution over hashed n-grams.

Features are runs of one to three consecutive words; a feature's bucket is the CRC-32 of its words
joined by one space, modulo ``BUCKETS``. The features of the corpus and of the target are counted by
bucket, a bucket's gain is the logarithm of the smoothed ratio of its shares, and a document's
weight is the sum of the gains of its features. The highest weights plus Gumbel noise are drawn,
which is sampling without replacement in proportion to the exponential of the weights.

*Suffix arrays.* Both the count and the scoring cut a task's texts into blocks of words, number
the words, and sort the suffixes of the block to the depth of the longest feature. Neighbours in
that order with a common prefix of k words are one run for each n-gram up to k words, so each n-gram that
a block repeats is hashed once, at the head of its run, and its bucket is scattered back to all places.

Counts are exact over all rows, 10,000 whole numbers for each task; the gains, as many, go to the
tasks. Ranks come from one sort by range, with the sizes of the sorted parts before each
part added to places in it, so no task sees all rows.

Defined results for edge cases: a null or empty text, or one without words, has no features and
weight 0, and is not drawn (it has fewer than ``LEAST_WORDS`` words); very long texts are
taken whole; repeated rows count each time and are ranked each, equal rows next to each other; a null key
is hashed as an empty string and comes last among ties; an empty target gives the gains of no
target features; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Words of a block, about. A longer text is one block of its own.
BLOCK_WORDS = 200_000
#: Bytes of a word and the space before it below which CRC-32 values are joined by table.
SHORT = 64
#: Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = np.uint32(0xEDB88320)

#: Bytes to what words are found in: A-Z in lower case, digits, letters and all bytes above 127 kept, the rest spaces.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


class _Numbers(dict):
    """Words to numbers, in order of their first place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def suffix_array(numbers: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Places of a sequence in the order of the depth numbers that begin there.

    Then, in that order: the columns of these numbers (0 beyond the end), and for each k whether the common
    prefix with the place before is k or shorter, so that a run of equal prefixes of k + 1 begins.
    """
    ahead = [np.concatenate((numbers[k:], np.zeros(min(k, len(numbers)), numbers.dtype))) for k in range(depth)]
    bits = int(numbers.max(initial=0)).bit_length()
    if bits * depth <= 63:  # they fit in one number
        packed = np.zeros(len(numbers), np.int64)
        for column in ahead:
            packed = packed << bits | column
        order = np.argsort(packed)
        packed = packed[order]
        columns = [packed >> bits * (depth - 1 - k) & (1 << bits) - 1 for k in range(depth)]
    else:
        order = np.lexsort(ahead[::-1])
        columns = [column[order] for column in ahead]
    begins, new = [], np.zeros(max(0, len(order) - 1), bool)
    for column in columns:
        new = new | (column[1:] != column[:-1])
        begins.append(np.concatenate((np.ones(min(1, len(order)), bool), new)))
    return order, columns, begins


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """What CRC-32 values become when 0 to SHORT - 1 bytes follow: tables by number of bytes, place and value of a byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ _POLYNOMIAL, one >> 1)
    out = np.zeros((SHORT, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT):
        out[n] = out[n - 1] >> 8 ^ one[out[n - 1] & 255]
    return out


class Runs:
    """The n-grams of a block of texts (lists of words): for each length the runs of a suffix array, hashed once each."""

    def __init__(self, texts: list[list[bytes]], longest: int = LONGEST) -> None:
        number = _Numbers({b"": 0})  # no word: stands between texts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        apart = ([b""],) * len(texts)
        flat = chain.from_iterable(chain.from_iterable(zip(texts, apart, strict=True)))
        self.numbers = np.fromiter(map(number.__getitem__, flat), np.int64, int(lengths.sum()) + len(texts))
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths - 1
        self.spaced = [b" " + word for word in number]
        self.size = np.fromiter(map(len, self.spaced), np.int64, len(number))
        self.own = np.fromiter(map(zlib.crc32, number), np.uint32, len(number))
        self.after = np.fromiter(map(zlib.crc32, self.spaced), np.uint32, len(number))
        self.longest = longest

    def _joined(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The CRC-32 of what has crc with a space and a word behind it."""
        shift, size = _shifts(), self.size[word]
        short = np.minimum(size, SHORT - 1)
        out = self.after[word]
        for place in range(4):
            out ^= shift[short, place, crc >> np.uint32(8 * place) & np.uint32(255)]
        for k in np.flatnonzero(size >= SHORT):
            out[k] = zlib.crc32(self.spaced[word[k]], int(crc[k]))
        return out

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: the places of its n-grams, their runs, and each run's CRC-32."""
        order, columns, begins = suffix_array(self.numbers, self.longest)
        run, crc = None, None
        for k in range(self.longest):
            real = columns[k] > 0  # a number 0 ends the text, so longer n-grams end there too
            if not real.all():
                order, run, columns, begins = order[real], None if run is None else run[real], [c[real] for c in columns], [b[real] for b in begins]
            head = begins[k].copy()
            head[:1] = True
            at = np.flatnonzero(head)
            crc = self.own[columns[0][at]] if run is None else self._joined(crc[run[at]], columns[k][at])
            run = np.cumsum(head) - 1
            yield order, run, crc


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches with the words of their texts, each of about BLOCK_WORDS words."""
    for batch in batches:
        first, texts, total = 0, [], 0
        for k, body in enumerate(batch.column(column)):
            words = words_of(body.as_py())
            if texts and total + len(words) > BLOCK_WORDS:
                yield batch.slice(first, len(texts)), texts
                first, texts, total = k, [], 0
            texts.append(words)
            total += len(words)
        if texts:
            yield batch.slice(first, len(texts)), texts


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, buckets without any left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _blocks(batches, 0):
            for _, run, crc in Runs(texts, longest):
                total += np.bincount(crc % np.uint32(buckets), np.bincount(run, minlength=len(crc)), buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return docs.select(F.col(text).cast("binary")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths, rounded down. Two rows a bucket come to the driver."""
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(of, text, longest, buckets).collect()} for of in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: (float(t.get(b, 0) + 1) * float(all_s + buckets)) / (float(s.get(b, 0) + 1) * float(all_t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def noise(key: object, seed: str = "42") -> int:
    """Gumbel noise in thousandths, rounded down, from a key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each row of docs."""
    given = np.array(gain, np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _blocks(batches, 1):
            runs = Runs(texts, longest)
            at_place = np.zeros(len(runs.numbers) + 1, np.int64)
            for places, run, crc in runs:
                at_place[places + 1] += given[crc % np.uint32(len(given))][run]
            sums = np.cumsum(at_place)
            weight = sums[runs.ends] - sums[runs.starts]
            more = np.fromiter(map(noise, part.column(0).to_pylist()), np.int64, len(texts))
            words = np.fromiter(map(len, texts), np.int64, len(texts))
            n = sum(np.maximum(0, words - k) for k in range(longest))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, n, weight, weight + more))], ["key", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary")).mapInArrow(make, f"key {kind}, n_words long, n_features long, weight long, score long")
    return rows.withColumnRenamed("key", key)


def ranked(scored: DataFrame, share: tuple[int, int] = (5, 100), key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with the rank (1, 2, ...) of the drawn rows, else null.

    Of the n rows with least_words words share[0] * n // share[1] are drawn, the highest scores first, ties by key.
    The rows are sorted by range and written; where each part of the sorted table begins is added up on
    the driver, one number a part.
    """
    spark = scored.sparkSession
    eligible = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last(key), "n_features", "weight"]
    placed = scored.where(eligible).orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.call_function("shiftright", F.col("_place"), F.lit(33)).cast("int")), "sorted-scores")
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    begins, total = [], 0
    for part in sorted(sizes):
        begins.append((part, total))
        total += sizes[part]
    starts = spark.createDataFrame(begins, "_part int, _begin long")
    rank = F.col("_begin") + F.col("_place").bitwiseAND(2**33 - 1) + 1
    drawn = placed.join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= share[0] * total // share[1], rank))
    columns = [*scored.columns, "rank"]
    return drawn.select(columns).unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (5, 100)) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each row of docs; rank is null where a row is not drawn."""
    scored = materialise(score(docs, gains(docs, target, text), key, text), "scores")
    return ranked(scored, share, key)


#: The same in DuckDB's SQL: each different feature's CRC-32 by half bytes, counted and joined back.
ORACLE = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
f AS MATERIALIZED (
  SELECT r, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS f FROM w, k WHERE len(w) >= k),
bf AS MATERIALIZED (
  SELECT unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS f FROM bw, k WHERE len(w) >= k),
c AS (SELECT r, f, count(*) AS n FROM f GROUP BY r, f),
bc AS (SELECT f, count(*) AS n FROM bf GROUP BY f),
different AS (SELECT f FROM c UNION SELECT f FROM bc),
table16 AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t),
crc AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(hex(encode(f))) // 2 + 1), lambda i: [(ord(substr(hex(encode(f)), 2 * i, 1)) + 9 * (ord(substr(hex(encode(f)), 2 * i, 1)) // 64)::INTEGER) & 15, (ord(substr(hex(encode(f)), 2 * i - 1, 1)) + 9 * (ord(substr(hex(encode(f)), 2 * i - 1, 1)) // 64)::INTEGER) & 15]))::BIGINT[]),
    lambda a, x: xor(a >> 4, t[(xor(a, x) & 15) + 1])), 4294967295::BIGINT) % 10000 AS b
  FROM different, table16),
s AS (SELECT b, sum(n)::DOUBLE AS n FROM c JOIN crc USING (f) GROUP BY b),
t AS (SELECT b, sum(n)::DOUBLE AS n FROM bc JOIN crc USING (f) GROUP BY b),
gain AS (
  SELECT s.b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)) / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t ON s.b = t.b),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM c JOIN crc USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS p, count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND p <= 5 * n // 100 THEN p END AS rank FROM placed
"""

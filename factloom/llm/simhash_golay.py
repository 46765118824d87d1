"""Near duplicates by SimHash fingerprints, found through Golay codes.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of a text's word
shingles, repeats included. Fingerprints link when at most four bits differ.

*Fuzzy hashing.* The binary Golay code (23, 12) is perfect: each word of 23 bits lies within
three bits of exactly one codeword. A segment of a fingerprint is decoded to the codewords next
to it, one where it lies within two bits of a codeword and six where it lies at three. Words
at most two bits apart share one of these: a word between them decodes to it.

*Pigeonhole.* Four errors fall on three segments of 22, 21 and 21 bits. Either some segment has
none, and then one of the two others has at most two; or two segments have exactly one, and
then an error-free half each, and the third has at most two. So a key is an exact segment and
a codeword of another (the first case, 36 keys at most) or an exact half of each of two segments and a
codeword of the third (the second case, 72). Two unrelated fingerprints share one of them with a
probability of about 5e-8.

*Join and verification.* Each different fingerprint offers its keys once; the keys are sorted, and
what stands under one key is compared exactly. A task hands over a spanning forest of the links
it finds, not the pairs. Under a key with more than ``MOST`` fingerprints they are not compared
in the task: those fingerprints are joined by the words within two bits of them instead. Any two
that share such a word are linked and any two linked share one, so its least fingerprint stands for
all of them and nothing is compared; the rows grow with the fingerprints alone.

Defined results for edge cases: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; a text of fewer words than a shingle has one shingle, the
whole sequence; very long texts are taken whole; repeated rows are linked like copies and each
is returned; rows with a null key are returned with it, and their component is the least key
other than null that they reach, else null; an empty table gives an empty result; further
columns do not matter (the key is returned).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import join_by_hot_key, materialise, release, set_aside
from .components import components

WORDS = 4
SEED = 42
#: Bits in which linked fingerprints differ at most. The keys are made for this distance.
ERRORS = 4
#: Fingerprints under one key that are compared in one task.
MOST = 2**14
#: Hashes of shingles whose bits a task counts at once.
BLOCK = 2**17
#: Rows that a task hands over at once, about.
MOST_ROWS = 300_000

_U = np.uint64
#: Low bit and length of each segment.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_HALF = 11
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0xC75


# ---------------------------------------------------------------- fingerprints


def _hashes(text: bytes | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles. bytes.lower changes A-Z alone; bytes.split cuts at space and U+0009 to U+000D."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, _U)
    whole = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], _U)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), _U, len(starts))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    h = _hashes(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """(key, fp): one row for each row of docs; fp as a signed number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(body.as_py(), words) for body in batch.column(1)), _U, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(make, "key long, fp long")


# ---------------------------------------------------------------- Golay keys


def _remainder(word: int) -> int:
    """The syndrome of a word of 23 bits: its remainder by the generator."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word; for each syndrome the ways to the next codewords; how many these are."""
    by_bit = [_remainder(1 << k) for k in range(23)]
    of_byte = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for bit in range(min(8, 23 - 8 * place)):
                if value >> bit & 1:
                    of_byte[place, value] ^= by_bit[8 * place + bit]
    ways: list[list[int]] = [[] for _ in range(2048)]
    at_three = set()
    for weight in range(5):
        for bits in combinations(range(23), weight):
            way, syndrome = 0, 0
            for k in bits:
                way, syndrome = way | 1 << k, syndrome ^ by_bit[k]
            if weight <= 3:
                ways[syndrome].append(way)
                if weight == 3:
                    at_three.add(syndrome)
            elif syndrome in at_three:
                ways[syndrome].append(way)
    counts = np.array(list(map(len, ways)), np.int64)
    return of_byte, np.array([w + w[:1] * (6 - len(w)) for w in ways], np.int64), counts


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords next to each word of up to 23 bits, six columns, and which of these count."""
    of_byte, ways, counts = _tables()
    word = segment.astype(np.int64)
    syndrome = of_byte[0, word & 255] ^ of_byte[1, word >> 8 & 255] ^ of_byte[2, word >> 16]
    return (word[:, None] ^ ways[syndrome]) >> 11, np.arange(6) < counts[syndrome][:, None]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64) and for each key the row of its fingerprint."""
    segments = [(prints >> _U(low)) & _U((1 << size) - 1) for low, size in _SEGMENTS]
    near = [codewords(s) for s in segments]
    rows = np.repeat(np.arange(len(prints)), 6).reshape(-1, 6)
    out, of = [], []

    def offer(kind: int, exact: np.ndarray, at: int) -> None:
        index, counts = near[at]
        key = (_U(kind) << _U(56)) | (exact[:, None] << _U(12)) | index.astype(_U)
        out.append(key[counts])
        of.append(rows[counts])

    kind = 0
    for whole in range(3):
        for other in range(3):
            if whole != other:
                offer(kind, segments[whole], other)
                kind += 1
    for third in range(3):
        i, j = (k for k in range(3) if k != third)
        for a in (0, _HALF):
            for b in (0, _HALF):
                half = lambda k, low: (segments[k] >> _U(low)) & _U((1 << _HALF) - 1)
                offer(kind, (half(i, a) << _U(_HALF)) | half(j, b), third)
                kind += 1
    return np.concatenate(out), np.concatenate(of)


def _keyed(prints: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), MOST_ROWS // 108):
                some = fp[at : at + MOST_ROWS // 108]
                key, row = keys(some.view(_U))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(some[row])], ["key", "fp"])

    return prints.select("fp").mapInArrow(make, "key long, fp long")


# ---------------------------------------------------------------- verification


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first of its component) that span the components of different fingerprints (uint64)."""
    left, a, b = prints, [], []
    while len(left) > 1:
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= ERRORS
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                a.append(found)
                b.append(np.full(len(found), first, _U))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, _U), np.zeros(0, _U))


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: links (a, b), and (a, null) for each fingerprint under a key with more than most."""
    waiting, of, full = np.zeros(0, _U), None, False  # fingerprints of the last key so far, that key, whether it has too many

    def links(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        body = fp.view(_U)
        inner = (ends - starts == 2)[1:-1]
        pairs = starts[1:-1][inner]  # most keys have two fingerprints at most: all at once
        x, y = body[pairs], body[pairs + 1]
        near = np.bitwise_count(x ^ y) <= ERRORS
        a, b = [y[near]], [x[near]]
        for k in np.flatnonzero((ends - starts > 2) | (np.arange(len(starts)) % max(1, len(starts) - 1) == 0)):
            here = body[starts[k] : ends[k]]
            if key[starts[k]] != of:
                if not full:
                    found = forest(waiting)
                    a.append(found[0])
                    b.append(found[1])
                waiting, of, full = np.zeros(0, _U), key[starts[k]], False
            waiting = np.concatenate((waiting, here))
            if full or len(waiting) > most:
                yield links(waiting, None)
                waiting, full = np.zeros(0, _U), True
        if sum(map(len, a)):
            yield links(np.concatenate(a), np.concatenate(b))
    if not full and len(waiting) > 1:
        yield links(*forest(waiting))


def _ball() -> np.ndarray:
    """What leads from a fingerprint to all words at most half of ERRORS bits away."""
    return np.array([sum(1 << k for k in bits) for weight in range(ERRORS // 2 + 1) for bits in combinations(range(64), weight)], _U)


def _by_words_between(crowded: DataFrame) -> DataFrame:
    """(a, b): links that make the components of the fingerprints (a), by the words between them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), MOST_ROWS // len(ball)):
                some = fp[at : at + MOST_ROWS // len(ball)]
                word = (some.view(_U)[:, None] ^ ball).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.repeat(some, len(ball)))], ["word", "a"])

    words = crowded.select("a").mapInArrow(make, "word long, a long")
    # The least of each word is aggregated before the shuffle, but each row still needs it.
    words = materialise(words, "words-between")
    least = words.groupBy("word").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = materialise(words.join(least, "word").where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links-by-words")
    release(words)
    return links


def links_of(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that make the components of different fingerprints (column fp)."""
    found = _keyed(prints).repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _linked(batches, most), "a long, b long")
    found = materialise(found.distinct(), "fingerprint-links")
    crowded = found.where(F.col("b").isNull()).select("a")
    links = found.where(F.col("b").isNotNull())
    return links.union(_by_words_between(crowded)) if crowded.limit(1).count() else links


# ---------------------------------------------------------------- operator


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """(key, fingerprint, component_id) for each row of docs. The key is a column of whole numbers."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"the key {key} is not of a type of whole numbers")
    rows = materialise(fingerprints(docs, key, text, words), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "different-fingerprints")
    links = links_of(prints, most)
    node = components(links, "a", "b")
    placed = prints.join(node, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialise(placed.join(lowest, "component").select("fp", "n", "component_id"), "components-of-fingerprints")
    release(prints)
    joined = join_by_hot_key(rows, by_print, "fp", "n", ["component_id"])
    return joined.select(F.col("key").cast(docs.schema[key].dataType).alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(docs.schema[key].dataType))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that with the least key other than null, then the least text."""
    given, names = set_aside(docs, ["_row", "fingerprint", "component_id"])
    key, text = names[docs.columns.index(key)], names[docs.columns.index(text)]
    numbered = materialise(given.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    placed = join(numbered, "_row", text).select("_row", "component_id")
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(text).alias("t"), F.col("_row").alias("r"))
    kept = numbered.join(placed, "_row").groupBy("component_id").agg(F.min(order)["r"].alias("_row")).select("_row")
    return numbered.join(kept, "_row", "left_semi").select(*(F.col(new).alias(c) for new, c in zip(names, docs.columns, strict=True)))

"""N-gram Jaccard join by a pigeonhole over a partition of the universe of shingles.

Documents link when the Jaccard similarity of their sets of word shingles is at least 80
percent, that is when their symmetric difference is at most a ninth of their sizes' sum.

*Segments.* For each band of sizes the shingles' hash range is cut into more segments than
two linked sets of the band can differ in. So linked sets agree in several segments, and
equal contents of one segment are found by equality of a key.

*Allocation.* A set offers only as many segments as are needed to meet every partner:
empty segments offer nothing, a fixed order drops those beyond the need, and of the keys
that turn out to be shared the most frequent ``RESERVE`` are dropped, as they would cost most.
A set with so many empty segments that exact segments can miss a partner also offers the
one-deletion neighbourhoods of its segments, and in the extreme a prefix of its shingles.

*Verification.* Equal sets are one (fingerprints of sets). Under each key the members are
verified against a leader, the one that shares most, and these links make components.
Members of one leader in different components can still be linked to each other; few are
compared directly, many through an index of the shingles in which they differ from the
leader, the rarest first. All bounds are exact, so no link between different components
is lost; further links inside one component are not sought. Sets are sets of 64-bit hashes
of shingles.

Defined results for edge cases: a null or empty text, or one without words, has an empty
set, 0 shingles and is its own component; a text of fewer words than a shingle has one
shingle, the whole sequence; very long texts are taken whole; repeated rows are linked like
copies and each is returned; rows with a null key are returned with it and their
component is the least key other than null that they reach, else null; an empty table gives
an empty result; further columns do not matter (the key is returned).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import materialise, release, set_aside
from .components import components

WORDS = 5
RESERVE = 24
#: Members under a leader up to which they are compared directly.
FEW = 8
#: Rows of ids (16 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
NO_KEY = -(2**63)
#: Rows that a task hands over at once, about, where one row in makes many.
MOST_ROWS = 300_000

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_FACTORS = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text, A-Z in lower case.

    bytes.lower changes A-Z alone, and bytes.split cuts at space and U+0009 to U+000D.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, dtype=_U)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 7)], dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=_U, count=len(found))
    n = len(h) - words + 1
    out = np.zeros(n, dtype=_U)
    for k in range(words):
        out = (out ^ (out >> _U(29))) * _FACTORS[k % 5] + h[k : k + n]
    return np.unique(_mix(out))


def fingerprint(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    x = xxhash.xxh3_64_intdigest(found.tobytes())
    return x - 2**64 if x >= 2**63 else x


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) // 9


@lru_cache(maxsize=1)
def bands() -> list[tuple[int, int]]:
    """Ranges of sizes, each half as long again as the one before."""
    out, low = [], 1
    while low < 2**31:
        up = max(low + 1, low * 3 // 2)
        out.append((low, up - 1))
        low = up
    return out


def segments(band: int) -> int:
    apart = most_apart(2 * bands()[band][1], 0)
    return apart + 2 + RESERVE + apart // 8


def bands_of(size: int) -> list[int]:
    """The bands in which the larger of a linked pair with a set of this size can be."""
    return [k for k, (low, up) in enumerate(bands()) if low <= size * 5 // 4 and up >= size and most_apart(2 * up, 0) > 0]


def _of_band(band: int, k: int) -> np.uint64:
    return _U((band + 1) * int(_FACTORS[k]) % 2**64)


def signatures(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and for each key its allocation: 64 * kind of key + what may be dropped."""
    keys, notes = [], []
    mixed = _mix(found + _C1)
    size = len(found)
    for band in _bands_of(size):
        m = segments(band)
        apart = most_apart(size, min(bands()[band][1], size * 5 // 4))
        place = ((found >> _U(32)) * _U(m)) >> _U(32)
        starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        sums = np.add.reduceat(mixed, starts)
        salt = (place[starts] + _U(1)) * _FACTORS[0] ^ _of_band(band, 1)
        own = _mix(sums ^ salt)
        empty = m - len(starts)
        need = m - apart - empty  # a partner agrees in so many of these segments, at least
        spare = max(0, need - 1)
        reserve = min(RESERVE, spare)
        if spare > reserve:
            own = np.partition(own, len(own) - (spare - reserve) - 1)[: len(own) - (spare - reserve)]
        keys.append(own)
        notes.append(np.full(len(own), (3 * band) * 64 + reserve, np.int32))
        if need > 0:
            continue
        counts = np.diff(np.concatenate((starts, [size])))
        group = np.repeat(np.arange(len(starts)), counts)
        without = (sums[group] - mixed)[counts[group] > 1]
        wide = np.concatenate((sums, without)) ^ np.concatenate((salt, salt[group][counts[group] > 1]))
        keys.append(np.unique(_mix(wide ^ _FACTORS[2])))
        notes.append(np.full(len(keys[-1]), (3 * band + 1) * 64, np.int32))
        if empty > m - apart:
            prefix = found[: size - -(-size * 4 // 5) + 1]
            keys.append(_mix(prefix ^ _of_band(band, 3)))
            notes.append(np.full(len(prefix), (3 * band + 2) * 64, np.int32))
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(notes)


@lru_cache(maxsize=100_000)
def _bands_of(size: int) -> list[int]:
    return bands_of(size)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document (key, fp, -1 - size) and one a signature (its key, fp, allocation).

    A task offers the signatures of equal sets once, so that very many copies of a text
    put no more rows on its keys than there are tasks.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_KEY).to_numpy(zero_copy_only=False)
            keys, prints, notes, total = [], [], [], 0
            for k, body in zip(ids, batch.column(1), strict=True):
                found = shingles(body.as_py())
                fp = fingerprint(found)
                own, note = signatures(found[:0] if fp in seen else found)
                seen.add(fp)
                keys += [np.array([k], np.int64), own.view(np.int64)]
                prints.append(np.full(len(own) + 1, fp, np.int64))
                notes += [np.array([-1 - len(found)], np.int32), note]
                total += len(own) + 1
                if total > MOST_ROWS:
                    yield _batch(keys, prints, notes)
                    keys, prints, notes, total = [], [], [], 0
            if keys:
                yield _batch(keys, prints, notes)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(make, "key long, fp long, note int")


def _batch(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "fp", "note"])


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and fp: all documents, and signatures that different sets share, each once."""
    last: tuple | None = None  # the last signature so far, and whether the one before had its key
    for batch in batches:
        key, fp, note = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        is_doc = note < 0
        if is_doc.any():
            yield _batch([key[is_doc]], [fp[is_doc]], [note[is_doc]])
        key, fp, note = key[~is_doc], fp[~is_doc], note[~is_doc]
        before = False
        if last is not None:
            key, fp, note = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], fp)), np.concatenate(([last[2]], note)).astype(np.int32)
            before = last[3]
        if not len(key):
            continue
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
        key, fp, note = key[first], fp[first], note[first]
        same = key[1:] == key[:-1]
        shared = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        last = (key[-1], fp[-1], note[-1], bool(shared[-1]))
        yield _batch([key[:-1][shared[:-1]]], [fp[:-1][shared[:-1]]], [note[:-1][shared[:-1]]])
    if last is not None and last[3]:
        yield _batch([np.array([last[0]])], [np.array([last[1]])], [np.array([last[2]], np.int32)])


def _allocated(shared: DataFrame) -> DataFrame:
    """(key, fp, degree) without the most frequent keys that each set may drop."""
    counts = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = shared.join(counts, "key")
    order = Window.partitionBy("fp", "note").orderBy(F.desc("n"), "key")
    kept = rows.select("*", F.row_number().over(order).alias("_r")).where(F.col("_r") > F.col("note") % 64)
    degree = rows.groupBy("fp").agg(F.sum("n").alias("degree"))
    return kept.select("key", "fp").join(degree, "fp")


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(fp, found array<long>) for the wanted (key, fp)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets = [], []
            for fp, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(body.as_py())
                if fingerprint(found) == fp:  # else another row with the same key
                    prints.append(fp)
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["fp", "found"])

    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_k"), F.col(text).cast("binary").alias("_t"))
    chosen = rows.join(F.broadcast(wanted) if few else wanted, F.col("_k") == F.col("key"))
    return chosen.select("fp", "_t").mapInArrow(make, "fp long, found array<long>").dropDuplicates(["fp"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False).view(_U), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.select(F.col("fp").alias("b"), F.col("found").alias("_sb")), "b")
    return one.join(sets.select(F.col("fp").alias("a"), F.col("found").alias("_sa")), "a")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked, apart, size_a, size_b) of pairs (a, b) of fingerprints."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _lists(batch.column(2)), _lists(batch.column(3))
            common = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y, strict=True)], np.int64)
            n, m = np.array(list(map(len, x)), np.int64), np.array(list(map(len, y)), np.int64)
            union = n + m - common
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(100 * common >= 80 * union), pa.array(union - common), pa.array(n), pa.array(m)], ["a", "b", "linked", "apart", "size_a", "size_b"])

    return _with_sets(pairs, sets).select("a", "b", "_sa", "_sb").mapInArrow(check, "a long, b long, linked boolean, apart long, size_a long, size_b long")


def _kind(n: Column) -> Column:
    """A class of numbers n >= 1: four for each power of two."""
    power = F.length(F.bin(n)) - 1
    return F.when(n < 4, n).otherwise(4 * (power - 1) + F.call_function("shiftright", n, (power - 2).cast("int")) - 4).cast("int")


def _least_of(kind: Column) -> Column:
    """The least number of a class."""
    return F.when(kind < 4, kind).otherwise(F.call_function("shiftleft", 4 + kind % 4, (kind / 4).cast("int") - 1)).cast("long")


def _differing(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members with each shingle in which b differs from its leader a, and how many these are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_leader, of_member = _lists(batch.column(5)), _lists(batch.column(6))
            first = 0
            while first < len(batch):
                last, found, total = first, [], 0
                while last < len(batch) and total <= MOST_ROWS:
                    found.append(np.setxor1d(of_leader[last], of_member[last], assume_unique=True))
                    last, total = last + 1, total + len(found[-1])
                n = np.fromiter(map(len, found), np.int64, len(found))
                size = np.fromiter(map(len, of_member[first:last]), np.int64, len(found))
                at = pa.array(np.repeat(np.arange(first, last), n))
                more = [pa.array(np.repeat(n, n)), pa.array(np.repeat(size, n)), pa.array(np.concatenate(found).view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(5)] + more, [*fields, "n", "size", "token"])
                first = last

    fields = ["a", "b", "cb", "top", "outside"]
    chosen = _with_sets(members.select(fields), sets).select(*fields, "_sa", "_sb")
    return chosen.mapInArrow(make, "a long, b long, cb long, top long, outside boolean, n long, size long, token long")


def _clues(tokens: DataFrame) -> DataFrame:
    """Rows of tokens with ``place`` and ``partner``: what members are found by, for each class of partners.

    Let d(x) be the shingles in which x differs from the leader. Linked x and y differ in
    d(x) ^ d(y), so d(x) and d(y) share at least t = (|d(x)| + |d(y)| - (|x| + |y|) / 9) / 2 of
    them, and t >= 1 unless both are linked to the leader. In any order, then, the first shared
    shingle has t - 1 others behind it in both. The order puts first what costs nothing (held by
    one member, or by none outside the leader's component), then what makes fewest pairs. For
    each class of |d(y)| only the places that can come first are offered.
    """
    priced = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("f"), F.count_if("outside").alias("o")).where("f > 1 and o > 0")
    own = Window.partitionBy("a", "b")
    shared = tokens.join(priced.select("a", "token", (F.col("f") * F.col("o")).alias("price")), ["a", "token"])
    placed = shared.select("*", F.row_number().over(own.orderBy("price", "token")).alias("r"), F.count(F.lit(1)).over(own).alias("shared"))
    placed = placed.withColumn("place", F.col("n") - F.col("shared") + F.col("r") - 1).drop("price", "r", "shared")
    apart = F.expr("(size + size * 5 div 4) div 9")
    # No partner shares less than this, so places beyond it need not be looked at by class.
    placed = placed.where(F.col("place") <= F.col("n") - F.greatest(F.lit(1), F.ceil((F.col("n") + F.greatest(F.lit(1), F.col("n") - apart) - apart) / 2)))
    kinds = F.sequence(_kind(F.greatest(F.lit(1), F.col("n") - apart)), _kind(F.col("n") + apart))
    least = lambda kind: F.greatest(F.lit(1), F.ceil((F.col("n") + _least_of(kind) - apart) / 2))
    chosen = placed.withColumn("_kinds", F.filter(kinds, lambda kind: F.col("place") <= F.col("n") - least(kind)))
    return chosen.select("*", _kind(F.col("n")).alias("kind"), F.explode("_kinds").alias("partner")).drop("_kinds")


def _other_pairs(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of members of one leader, of different components, that may be linked.

    placed: (a, b, ca, cb, top): pairs of leader and member with the components that the links
    to leaders make, and the member's top leader. A pair of members that are both linked to the
    leader is in its component; so at least one of a pair sought is outside.
    """
    groups = placed.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ca") != F.col("cb")).alias("off"), F.min("top").alias("_t"), F.max("top").alias("_u"))
    # Members with the same top leader are compared under that one alone.
    elsewhere = (F.col("_t") == F.col("_u")) & (F.col("_t") != F.col("a"))
    open_groups = groups.where((F.col("off") > 0) & (F.col("n") > 1) & ~elsewhere).select("a", "n")
    members = materialise(placed.join(open_groups, "a").select("a", "b", "cb", "top", (F.col("ca") != F.col("cb")).alias("outside"), "n"), "open-members")
    apart = (F.col("cx") != F.col("cy")) & ((F.col("tx") != F.col("ty")) | (F.col("tx") == F.col("a"))) & (~F.col("oy") | (F.col("x") < F.col("y")))

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.select("a", *[F.col(f).alias(t + name) for f, t in (("b", ""), ("cb", "c"), ("top", "t"), ("outside", "o"))], *more)

    few = members.where(F.col("n") <= FEW)
    direct = side(few.where("outside"), "x").join(side(few, "y"), "a").where(apart).select("x", "y")
    tokens = materialise(_differing(members.where(F.col("n") > FEW), sets), "differing")
    clues = materialise(_clues(tokens), "clues")
    more = lambda name: [F.col(f).alias(f + name) for f in ("n", "size", "place")]
    probes = side(clues.where("outside"), "x", "token", F.col("kind").alias("k"), F.col("partner").alias("l"), *more("x"))
    index = side(clues, "y", "token", F.col("partner").alias("k"), F.col("kind").alias("l"), *more("y"))
    enough = F.expr("2 * least(nx - placex, ny - placey) >= nx + ny - (sizex + sizey) div 9 and 5 * sizex >= 4 * sizey and 5 * sizey >= 4 * sizex")
    found = probes.join(index, ["a", "token", "k", "l"]).where(apart & enough).select("x", "y")
    pairs = materialise(direct.union(found).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "other-pairs")
    release(members, tokens, clues)
    return pairs


def _component_of(pairs: DataFrame, at: str, of: DataFrame, name: str) -> DataFrame:
    """pairs with the component of column ``at`` as ``name``: itself where it has no link."""
    joined = pairs.join(of.select(F.col("node").alias(at), F.col("component").alias("_c")), at, "left")
    return joined.withColumn(name, F.coalesce("_c", at)).drop("_c")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (key, fp, size) and the components (node, component) of their sets' fingerprints."""
    sorted_rows = _rows(docs, key, text).repartition("key").sortWithinPartitions("key", "fp")
    rows = materialise(sorted_rows.mapInArrow(_shared_only, "key long, fp long, note int"), "signatures")
    members = rows.where(F.col("note") < 0).select("key", "fp", (-1 - F.col("note")).cast("long").alias("size"))
    kept = materialise(_allocated(rows.where(F.col("note") >= 0)), "allocated")
    leaders = kept.groupBy("key").agg(F.max(F.struct("degree", "fp")).alias("_l"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", "_l")
    led = kept.join(leaders, "key").where(F.col("fp") != F.col("_l.fp")).select(F.col("_l.fp").alias("a"), F.col("_l.degree").alias("degree"), F.col("fp").alias("b")).distinct()
    led = materialise(led, "leader-pairs")
    tops = led.groupBy("b").agg(F.max_by("a", F.struct("degree", "a")).alias("top"))
    used = led.select(F.col("a").alias("fp")).union(led.select("b")).distinct()
    # One row a set before the join: a set of very many copies is no hot key there.
    wanted = members.groupBy("fp").agg(F.min("key").alias("key")).join(used, "fp").select("fp", "key")
    wanted = materialise(wanted, "representatives")
    sets = materialise(_sets(docs, key, text, wanted), "sets")
    first = materialise(_verified(led.select("a", "b"), sets), "leader-links")
    joined = components(first.where("linked"), "a", "b")
    placed = _component_of(_component_of(first.join(tops, "b").select("a", "b", "top"), "a", joined, "ca"), "b", joined, "cb")
    others = _other_pairs(placed, sets)
    second = _verified(others, sets).where("linked").select("a", "b")
    between = _component_of(_component_of(second, "a", joined, "ca"), "b", joined, "cb").select("ca", "cb")
    merged = components(between, "ca", "cb")
    ends = joined.select("node", "component").union(merged.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
    final = _component_of(ends, "component", merged, "whole").select("node", F.col("whole").alias("component"))
    final = materialise(final, "components-of-sets")
    release(kept, led, wanted, sets, first, others)
    return members, final


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs. The key is a column of whole numbers."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"the key {key} is not of a type of whole numbers")
    members, found = classes(docs, key, text)
    least = members.where(F.col("size") > 0).groupBy("fp").agg(F.min(F.when(F.col("key") != NO_KEY, F.col("key"))).alias("least"))
    placed = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = placed.join(lowest, "component").select("fp", "component_id")
    real = F.when(F.col("key") != NO_KEY, F.col("key"))
    joined = members.join(by_set, "fp", "left")
    return joined.select(real.cast(docs.schema[key].dataType).alias(key), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(real).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, the one with the least key other than null, then the least text.

    Rows without shingles all stay.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType) or docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
        return _keep_first_row(docs, key, text)
    placed = materialise(join(docs, key, text), "components")
    extra = placed.where(F.col(key) != F.col("component_id")).select(key)
    out = docs.join(F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra, key, "left_anti")
    return out.select(docs.columns)


def _keep_first_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    """keep_first where keys are null or repeated: rows are told apart by numbers of their own."""
    given, names = set_aside(docs, ["_row", "n_shingles", "component_id"])
    key, text = names[docs.columns.index(key)], names[docs.columns.index(text)]
    numbered = materialise(given.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    placed = materialise(join(numbered, "_row", text), "components")
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(text).alias("t"), F.col("_row").alias("r"))
    kept = numbered.join(placed, "_row").groupBy("component_id").agg(F.min(order)["r"].alias("_row")).select("_row")
    return numbered.join(kept, "_row", "left_semi").select(*(F.col(new).alias(c) for new, c in zip(names, docs.columns, strict=True)))


#: The same in DuckDB's SQL, by counting common shingles outright.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, chr(10)))]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], chr(10))))) END AS s
  FROM w),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id
  AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(other)::BIGINT AS component_id
FROM sets JOIN reach ON sets.doc_id = reach.doc_id GROUP BY sets.doc_id, s
"""

"""Benchmark decontamination by pigeonhole edit matching.

A text holds a test item if some stretch of it is within the item's error budget (a share
of its length) in edit distance. The item is split into one piece more than the budget: of
any such stretch at least one piece is an exact part. One automaton finds all pieces of a
block of items in a text, and Myers' bit-parallel distance verifies the places found.

Items and texts are compared in lower case with white space runs as one space. The items
are the query set: they are read on the driver in blocks of a bounded number of characters,
and each block is broadcast and held against all texts, where they are read. There is no
shuffle.

Items under ``least`` characters have no error budget: with ``short`` they are found verbatim
between word boundaries (scripts written without spaces have one at every letter), by the
same automaton; without it they are not looked for.

Defined results for edge cases: null and empty texts hold no item; null and empty items are
not looked for; very long texts
are searched whole; repeated rows are searched row by row; empty tables give an empty
result; further columns do not matter (keys are returned).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of items in a block.
BLOCK = 4_000_000
#: Letters of words that spaces separate: not those of Thai, Lao, Burmese, Khmer, Chinese or Japanese.
_IN_WORD = re.compile("(?![\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])\\w")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, percent: int) -> int:
    return length * percent // 100


def split_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces with their places, as even in length as can be."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, window: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the first nearest stretch of window within most edits of item, by bit-parallel columns."""
    m = len(item)
    if masks is None:
        masks = letter_masks(item)
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = whole, 0, m
    found = (m, 0) if m <= most else None
    for end, letter in enumerate(window, 1):
        equal = masks.get(letter, 0)
        keep = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        plus = down | ~(diagonal | up) & whole
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # A match may start anywhere in the window: nothing is carried into the first row.
        plus, minus = plus << 1 & whole, minus << 1 & whole
        up = minus | ~(keep | plus) & whole
        down = plus & keep
        if score <= most and (found is None or score < found[0]):
            found = (score, end)
    return found


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, letter in enumerate(item):
        masks[letter] = masks.get(letter, 0) | 1 << k
    return masks


class Matcher:
    """All pieces of a block of items (id, text) in one automaton."""

    def __init__(self, items: list[tuple], percent: int, least: int = 0):
        import ahocorasick

        self.items, self.masks = items, {}
        self.short = [len(t) < least for _, t in items]
        self.errors = [0 if s else budget(len(t), percent) for s, (_, t) in zip(self.short, items, strict=True)]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for at, piece in split_pieces(item, self.errors[k]):
                places.setdefault(piece, []).append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple]:
        """(item id, distance, end) of each item in the normalised text: the first nearest place."""
        # A hit of a piece says where the item would start; near starts share one window.
        starts: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for k, ahead in where:
                starts.setdefault(k, set()).add(end + 1 - ahead)
        found = []
        for k, at in sorted(starts.items()):
            key, item = self.items[k]
            if self.short[k]:
                whole = (a + len(item) for a in sorted(at) if _stands_alone(text, a, a + len(item)))
                if end := next(whole, 0):
                    found.append((key, 0, end))
                continue
            e, best = self.errors[k], None
            for a, b in _windows(sorted(at), e, len(item), len(text)):
                if text.startswith(item, a + e):
                    got = (0, e + len(item))
                else:
                    masks = self.masks.setdefault(k, letter_masks(item))
                    got = best_match(item, text[a:b], e, masks)
                if got and (best is None or (got[0], a + got[1]) < best):
                    best = (got[0], a + got[1])
            if best:
                found.append((key, *best))
        return found


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on across either end of a stretch."""
    return not any(0 < k < len(text) and _IN_WORD.match(text[k - 1]) and _IN_WORD.match(text[k]) for k in (start, end))


def _windows(starts: list[int], errors: int, length: int, end: int) -> list[tuple[int, int]]:
    """Stretches that hold every place within the budget of a start."""
    out: list[list[int]] = []
    for s in starts:
        a, b = max(0, s - errors), min(end, s + length + errors)
        if out and a <= out[-1][0] + errors:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, least: int) -> Iterator[list[tuple]]:
    """The items (id, normalised text) of least characters or more in sorted blocks of a bounded number of characters."""
    real = benchmark.where(F.col("text").isNotNull())
    blocks = -(-(real.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK)
    for k in range(blocks):
        own = real.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text")
        items = sorted({(r["item_id"], t) for r in own.toLocalIterator() if len(t := normalise(r["text"])) >= least}, key=lambda x: (x[0] is None, x))
        if items:
            yield items


_matchers: dict[int, Matcher] = {}


class SharedMatcher:
    """A block of items broadcast once; ``get`` gives the matcher of an executor's process."""

    def __init__(self, spark, items: list[tuple], percent: int, least: int):
        self.mark = hash((percent, least, *items))
        self.content = spark.sparkContext.broadcast((items, percent, least))

    def get(self) -> Matcher:
        if self.mark not in _matchers:
            _matchers.clear()
            _matchers[self.mark] = Matcher(*self.content.value)
        return _matchers[self.mark]


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 6, least: int = 40, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """(key, item_id, distance, end): each item that a document holds, with its nearest place.

    end is where that place ends in the document's normalised text.
    """
    # Keys travel as text: pandas would turn whole numbers with nulls among them into floats.
    schema = T.StructType([T.StructField(key, T.StringType()), benchmark.schema["item_id"], T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())])
    named = docs.select(F.col(key).cast("string").alias(key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def searched(shared: SharedMatcher) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = shared.get()
            for batch in batches:
                rows = [(k, *hit) for k, t in zip(batch[key], batch["_text"], strict=True) for hit in matcher.search(normalise(t))]
                yield pd.DataFrame(rows, columns=schema.fieldNames())

        return named.mapInPandas(search, schema)

    found = [searched(SharedMatcher(docs.sparkSession, items, percent, least)) for items in item_blocks(benchmark, 1 if short else least)]
    every = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return every.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 6, least: int = 40, text: str = "text", short: bool = False) -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs; judged where they are read."""

    def without(rows: DataFrame, shared: SharedMatcher) -> DataFrame:
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = shared.get()
            for texts in batches:
                yield pd.Series([t is None or not matcher.search(normalise(t)) for t in texts], dtype=bool)

        return rows.where(F.pandas_udf(clean, "boolean")(F.col(text)))

    return reduce(without, (SharedMatcher(docs.sparkSession, items, percent, least) for items in item_blocks(benchmark, 1 if short else least)), docs)

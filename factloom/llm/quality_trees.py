"""Quality classifier: histogram gradient-boosted trees over document statistics.

``train`` grows the trees on the driver from a sample of labelled rows that is bounded by
``most_rows`` (the keys with the smallest hashes, so it is the same at every run; of labels or
texts repeated for one key one counts). ``Forest`` holds them as flat arrays, and ``score`` walks all rows of a batch through
all trees at once in numpy, where the texts are read, with no shuffle.

The inputs are statistics of the text alone (``STATISTICS``).

Defined results for edge cases: a null text counts as an empty one, whose statistics are
zeros; very long texts are measured whole; repeated rows have equal scores; without labels
of both classes every score is the share of label 1 (0.5 without any); labels other than 0
and 1 are left out; an empty table gives an empty result; further columns of the input
pass through, apart from columns named as a result, which are replaced.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import STOP_WORDS

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "commonest_word", "adjacent_equal",
    "distinct_pairs", "distinct_runs", "log_lines", "distinct_lines", "line_words", "upper", "digits", "spaces", "symbols",
    "bars", "exclaims", "stops", "commas", "other_ascii", "non_ascii", "stop_words", "capital_words", "plain_words", "sentence_words",
)
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words)
RESULTS = ("held_out", "score", "predicted")


def statistics(text: str | None) -> list[float]:
    """The figures named in STATISTICS, over the whole text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "replace")
    size, n = len(data), len(words)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda letters: float(by[list(letters)].sum()) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    runs = len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / max(1, n - 3)
    stops = int(by[list(b".!?")].sum())
    return [
        np.log1p(size), np.log1p(n), float(lengths.mean()), float((lengths > 15).mean()), float((lengths <= 2).mean()), len(counts) / n,
        max(counts.values()) / n, sum(map(operator.eq, words, words[1:])) / n, pairs, runs, np.log1p(len(lines)),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), share(range(65, 91)), share(range(48, 58)), share(b" \t\n\r\x0b\x0c"),
        share(b"#*$%&<>@^~_=+\\/{}[]"), share(b"|"), share(b"!"), share(b".?"), share(b","), share(b"\"'();:-"), float(by[128:].sum()) / size,
        sum(map(_STOP.__contains__, words)) / n, sum(map(str.istitle, words)) / n, sum(map(str.isalpha, words)) / n, np.log1p(n / (1 + stops)),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of shape (trees, nodes). A leaf points to itself on both sides."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), dtype=np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[trees, at]] <= self.limit[trees, at]
            at = np.where(below, self.left[trees, at], self.right[trees, at])
        return self.start + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1; in blocks, so that memory stays bounded."""
        return np.concatenate([1 / (1 + np.exp(-self.raw(x[k : k + 4096]))) for k in range(0, len(x), 4096)] or [np.zeros(0)])


@dataclass(frozen=True)
class Settings:
    most_rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least_leaf: int = 10
    shrink: float = 1.0


def grow(x: np.ndarray, y: np.ndarray, how: Settings = Settings()) -> Forest:
    """Boost logistic loss by trees grown level by level over binned features."""
    share = float(y.mean()) if len(y) else 0.5
    start = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    nodes = 2 ** (how.depth + 1) - 1
    both = len(y) > 0 and 0 < share < 1
    trees = how.trees if both else 1
    feature, limit = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf)
    left = np.tile(np.arange(nodes, dtype=np.int32), (trees, 1))
    right, value = left.copy(), np.zeros((trees, nodes))
    if both:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        raw = np.full(len(y), start)
        for t in range(trees):
            chance = 1 / (1 + np.exp(-raw))
            at = _grow_tree(binned, edges, chance - y, chance * (1 - chance), how, feature[t], limit[t], left[t], right[t], value[t])
            raw += value[t][at]
    return Forest(feature, limit, left, right, value, start, how.depth)


def _grow_tree(binned, edges, slope, curve, how: Settings, feature, limit, left, right, value) -> np.ndarray:
    """Fills one tree's arrays; gives each row's leaf."""
    at, width = np.zeros(len(slope), np.int64), how.bins + 1
    open_nodes = [0]
    for level in range(how.depth + 1):
        following = []
        for node in open_nodes:
            rows = np.flatnonzero(at == node)
            g, h = slope[rows].sum(), curve[rows].sum()
            value[node] = -how.rate * g / (h + how.shrink)
            if level == how.depth or len(rows) < 2 * how.least_leaf:
                continue
            best = (1e-6, -1, -1)
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=width))[: len(cuts)]
                gl = np.cumsum(np.bincount(b, slope[rows], width))[: len(cuts)]
                hl = np.cumsum(np.bincount(b, curve[rows], width))[: len(cuts)]
                gain = gl**2 / (hl + how.shrink) + (g - gl) ** 2 / (h - hl + how.shrink) - g**2 / (h + how.shrink)
                gain[(n < how.least_leaf) | (len(rows) - n < how.least_leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            feature[node], limit[node] = f, edges[f][k]
            left[node], right[node] = 2 * node + 1, 2 * node + 2
            at[rows] = np.where(binned[rows, f] <= k, 2 * node + 1, 2 * node + 2)
            following += [2 * node + 1, 2 * node + 2]
        open_nodes = following
    return at


def held_out(key: Column) -> Column:
    """The fold that training never sees: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, how: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Forest:
    """A forest for labels.quality from the labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    once = usable.groupBy(key).agg(F.min(F.col("quality").cast("int")).alias("_y"))
    sample = once.orderBy(F.xxhash64(key), key).limit(how.most_rows)
    # At most most_rows narrow rows: a proven bound for the broadcast.
    known = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(sample), key)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in b["_text"]], "y": b["_y"], "k": b["_k"], "t": b["_t"]})

    # Texts are measured where they are read; of texts with one key the one with the least hash counts, so there are most_rows at most.
    measured = known.select("_text", "_y", F.xxhash64(key).alias("_k"), F.xxhash64(key, F.coalesce("_text", F.lit(""))).alias("_t")).mapInPandas(measure, "x array<double>, y int, k long, t long")
    rows = measured.groupBy("k").agg(F.min(F.struct("t", "y", "x")).alias("r")).select("k", "r.y", "r.x").toPandas()
    rows = rows.sort_values(["k", "y"], kind="stable")  # tasks may end in any order
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(STATISTICS))
    return grow(x, rows["y"].to_numpy(float), how)


def scorer(spark, forest: Forest):
    """A function of a text column that gives its score."""
    shared = spark.sparkContext.broadcast(forest)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            x = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))
            yield pd.Series(own.score(x))

    return F.pandas_udf(scores, "double")


def score(docs: DataFrame, forest: Forest, limit: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score and predicted."""
    keep = [c for c in docs.columns if c not in RESULTS]
    scored = docs.select(*keep, held_out(F.col(key)).alias("held_out"), scorer(docs.sparkSession, forest)(F.col(text)).alias("score"))
    return scored.select("*", (F.col("score") >= limit).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, forest: Forest, limit: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that are predicted good, with the columns of docs."""
    return docs.where(scorer(docs.sparkSession, forest)(F.col(text)) >= limit)

"""Whitening of embeddings by a covariance that is merged from parts.

Vectors are taken as whole numbers, x = floor(256 * c). The model is fitted to the different vectors,
each once, so copies do not pull it. Each task folds its vectors into a count, a mean and a scatter
matrix centred on that mean, and Chan's formula merges these, batch by batch within a task and task
by task in ``treeReduce``; nothing is squared before it is centred. The driver gets one such triple,
whose size depends on the dimension alone, and takes the eigenvectors. A second pass over the
different vectors merges the covariance of the whitened values in the same way, and its
distance from the identity is part of the result.

Defined results for edge cases: rows whose vector is null, or holds a null, a NaN, an infinity or an entry
beyond ``LARGEST`` are left out; the dimension is the most frequent length of the others (of
equally frequent ones the longest), and rows of another length are left out too; vectors of fewer
than ``MOST`` dimensions have as many components as dimensions; a component without variance (all
vectors equal, fewer vectors than dimensions) has whitened null and stays out of the identity, and
without variance at all explained and identity_error are 0; repeated rows and null keys are returned each; an
empty table, or one without usable vectors, gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

STEPS = 256
MOST = 4
#: Entries beyond this, in absolute value, count as not finite: their steps would not be exact.
LARGEST = 2.0**22
#: An eigenvalue below this share of the largest is rounding, not variance.
RANK = 1e-12
#: Parts that one task merges in treeReduce, about; more parts take more levels.
FAN_IN = 16

Part = tuple[int, np.ndarray, np.ndarray]


def part(x: np.ndarray) -> Part:
    """(count, mean, centred scatter) of the rows of a matrix."""
    n = len(x)
    mean = x.sum(axis=0, dtype=np.float64) / max(1, n)
    centred = x - mean
    return n, mean, centred.T @ centred


def merge(a: Part, b: Part) -> Part:
    """Chan's formula for the count, mean and scatter of two parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if not a[0] else a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


@dataclass(frozen=True)
class Model:
    """n vectors with exact sums by dimension; components (columns) by falling eigenvalue and the shares of variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _pack(x: np.ndarray) -> bytes:
    """A vector of whole numbers in two or four bytes each: equal vectors have equal bytes."""
    return x.astype("<i2" if len(x) and np.abs(x).max() < 2**15 else "<i4").tobytes()


def _unpack(column: pa.Array, dimension: int) -> np.ndarray:
    """The matrix of a column of packed vectors of one dimension."""
    out = np.empty((len(column), dimension), np.int64)
    values, at = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    for size, kind in ((2, "<i2"), (4, "<i4")):
        rows = np.flatnonzero(np.diff(at) == size * dimension)
        if len(rows) and dimension:
            out[rows] = values[at[rows][:, None] + np.arange(size * dimension)].view(kind)
    return out


def steps(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x binary, size): the usable vectors as whole numbers, packed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            bad = np.concatenate(([0], np.cumsum(~(np.abs(values) <= LARGEST))))
            usable = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]))
            x = np.floor(STEPS * np.where(np.abs(values) <= LARGEST, values, 0)).astype(np.int64)
            packed = [_pack(x[ends[k] : ends[k + 1]]) for k in usable]
            sizes = (ends[1:] - ends[:-1])[usable].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable)), pa.array(packed, pa.binary()), pa.array(sizes)], ["key", "x", "size"])

    kind = rows.schema[key].dataType.simpleString()
    chosen = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("c"))
    return chosen.mapInArrow(make, f"key {kind}, x binary, size int")


def _reduced(parts: DataFrame, dimension: int) -> Part:
    """One triple from rows (n, mean, scatter) of bytes, merged by pairs on the executors."""
    empty = (0, np.zeros(dimension), np.zeros((dimension, dimension)))
    triples = parts.rdd.map(lambda r: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(dimension, dimension)))
    tasks, depth = triples.getNumPartitions(), 2
    while FAN_IN**depth < tasks:
        depth += 1
    return triples.treeAggregate(empty, merge, merge, depth)


def _scatter(fit: DataFrame, dimension: int, of: int, change=lambda x: x.astype(np.float64)) -> Part:
    """The merged triple of what ``change`` makes of the vectors of fit; it has ``of`` columns."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = reduce(merge, (part(change(_unpack(b.column(0), dimension))) for b in batches if len(b)), (0, np.zeros(of), np.zeros((of, of))))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()], pa.binary()), pa.array([scatter.tobytes()], pa.binary())], ["n", "mean", "scatter"])

    return _reduced(fit.select("x").mapInArrow(make, "n long, mean binary, scatter binary"), of)


def _sums(fit: DataFrame, dimension: int) -> list[int]:
    """Exact sums by dimension."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension, np.int64)
        for batch in batches:
            total += _unpack(batch.column(0), dimension).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(total)], ["d", "s"])

    sums = fit.select("x").mapInArrow(make, "d int, s long").groupBy("d").agg(F.sum("s").alias("s"))
    return [r["s"] for r in sums.orderBy("d").collect()]


def fit_model(fit: DataFrame, dimension: int, most: int = MOST) -> Model:
    """The model of a table of different packed vectors (column x) of one dimension."""
    n, _, scatter = _scatter(fit, dimension, dimension)
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = float(np.trace(scatter / n))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    values = np.where(values > RANK * max(values.max(initial=0.0), 0.0), values, 0.0)
    return Model(n, np.array(_sums(fit, dimension), object), vectors * signs, values, values / trace if trace > 0 else np.zeros(len(values)))


def project(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened values of whole-number vectors: NaN where a component has no variance."""
    centred = x - (model.sums.astype(np.float64) / model.n)
    return np.divide(centred @ model.components, np.sqrt(model.values), out=np.full((len(x), len(model.values)), np.nan), where=model.values > 0)


def identity_error(fit: DataFrame, dimension: int, model: Model) -> float:
    """The largest entry of the whitened values' covariance minus the identity, by a pass over fit."""
    real = model.values > 0
    if not real.any():
        return 0.0
    n, _, scatter = _scatter(fit, dimension, int(real.sum()), lambda x: project(x, model)[:, real])
    return float(np.abs(scatter / n - np.eye(int(real.sum()))).max())


def deviations(x: np.ndarray, model: Model) -> list[Decimal]:
    """Exact sums of (n * x - S) ** 2 over the dimensions."""
    sums = [int(s) for s in model.sums]
    most = max(max((abs(s) for s in sums), default=0) + model.n * int(np.abs(x).max(initial=0)), 1)
    if most * most * max(1, len(sums)) < 2**63:
        d = model.n * x - np.array(sums, np.int64)
        return [Decimal(int(v)) for v in (d * d).sum(axis=1)]
    d = model.n * x.astype(object) - np.array(sums, object)
    return [Decimal(int(v)) for v in (d * d).sum(axis=1)]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(key, component, n, deviation decimal, whitened, explained, identity_error): a row for each usable row and component."""
    usable = materialise(steps(rows, key, vector), "vectors")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = usable.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None or not lengths["size"]:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    dimension = lengths["size"]
    same = usable.where(F.col("size") == dimension)
    fit = materialise(same.select("x").distinct(), "different-vectors")
    model = fit_model(fit, dimension, most)
    error = identity_error(fit, dimension, model)
    release(fit)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch.column(1), dimension)
            y, count = project(x, model), len(model.values)
            at = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n, np.int64)),
                 pa.array(deviations(x, model), pa.decimal128(38, 0)).take(at), pa.array(y.ravel(), mask=np.isnan(y.ravel())),
                 pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(at), error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return same.select("key", "x").mapInArrow(make, schema).withColumnRenamed("key", key)

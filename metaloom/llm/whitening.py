"""Whitening of embeddings by moments that partitions compute and Chan's formula merges."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSET = 1_000_000
SCALE = 64
MOST = float(1 << 62)  # of an integer coordinate
ROWS = 2048  # vectors that a task holds as doubles at a time


@dataclass
class Moments:
    """Of ``n`` vectors: the mean, the scatter about it, and, of integer vectors, the exact sum, smallest and largest of each coordinate."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(0)
        d = x - mean
        # What rounding left in the mean is taken off again.
        left = d.mean(0)
        mean, d = mean + left, d - left
        whole = np.issubdtype(x.dtype, np.integer)
        sums = _sums(x) if whole else []
        return Moments(len(x), mean, d.T @ d, sums, x.min(0) if whole else mean, x.max(0) if whole else mean)


def _sums(x: np.ndarray) -> list[int]:
    """Exact column sums: of the high and the low 32 bits, which can't overflow."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(s) for h, s in zip(high.sum(0), low.sum(0), strict=True)]


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise merge: the scatter about the common mean is both scatters and that of the two means."""
    if not a.n or not b.n:
        return a if a.n else b
    n = a.n + b.n
    gap = b.mean - a.mean
    return Moments(
        n,
        a.mean + gap * (b.n / n),
        a.scatter + b.scatter + np.outer(gap, gap) * (a.n * (b.n / n)),
        [x + y for x, y in zip(a.sums, b.sums, strict=True)],
        np.minimum(a.low, b.low),
        np.maximum(a.high, b.high),
    )


def _kinds(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Moments by the number of coordinates."""
    return {d: merged(a[d], b[d]) if d in a and d in b else a.get(d, b.get(d)) for d in {*a, *b}}


def _vectors(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(places in the batch, the batch's number, vectors as doubles of one length) of batches of lists without nulls in column ``at``."""
    for k, b in enumerate(batches):
        column = b.column(at)
        sizes = np.diff(column.offsets.to_numpy())
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        first = column.offsets.to_numpy()
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            for lo in range(0, len(rows), ROWS):
                some = rows[lo : lo + ROWS]
                yield some, k, values[first[some][:, None] + np.arange(d)] if d else np.zeros((len(some), 0))


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET as longs. Raises where that has no long."""
    x = np.floor(c * SCALE)
    if len(x) and x.size and np.abs(x).max() >= MOST:
        raise OverflowError(f"a coordinate of {np.abs(c).max():g} has no 64-bit integer at {SCALE} steps a unit")
    return x.astype(np.int64) + OFFSET


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows whose vector isn't null and holds finite numbers alone."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", odd))


def _tree(df: DataFrame, of, depth: int) -> dict[int, Moments]:
    """Moments of ``of(vectors)`` over all rows by length: one small row a partition, merged pairwise by treeReduce."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for _, _, c in _vectors(batches, 0):
            total = _kinds(total, {c.shape[1]: Moments.of(of(c))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["m"])

    parts = df.select("v").mapInArrow(run, "m binary").rdd
    return parts.map(lambda r: pickle.loads(bytes(r[0]))).treeReduce(_kinds, depth) if parts.getNumPartitions() else {}


@dataclass
class Whitening:
    """A fit: vectors of ``d`` coordinates, their number and exact sums, ``components`` as columns by falling eigenvalue, each ``scale`` 1/sqrt(eigenvalue) or nan where that is none, and the share of the variance that each explains."""

    d: int
    n: int
    sums: list[int]
    components: np.ndarray
    scale: np.ndarray
    explained: np.ndarray
    deviation_bound: int
    identity_error: float = 0.0

    def white(self, x: np.ndarray) -> np.ndarray:
        # The whole part of the mean goes first, in integers, so that the rest keeps its digits.
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - part) @ self.components * self.scale


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most_components: int = 32, depth: int = 2) -> Whitening | None:
    """The whitening of all usable vectors, or None where there are none.

    Each partition computes count, mean and centred scatter; a tree of pairwise merges joins them on the executors, so the
    driver receives one matrix of d x d. Its eigenvectors are taken on the driver. A second pass whitens every vector and
    merges the moments of the results the same way: the largest deviation of their covariance from the identity is
    ``identity_error``. Components without variance (eigenvalues within rounding of 0) are not whitened and don't count there.

    A task holds matrices of d x d numbers; vectors of more than 4,096 coordinates raise. Vectors of another length than
    most have (of equally frequent lengths the largest counts) take no part. Repeated rows count each.
    """
    rows = usable(vectors, id_col, vector_col)
    kinds = _tree(rows, integers, depth)
    kinds.pop(0, None)
    if not kinds:
        return None
    if max(kinds) > 4096:
        raise ValueError(f"vectors of {max(kinds)} coordinates, 4,096 at most")
    d, m = max(kinds.items(), key=lambda x: (x[1].n, x[0]))
    values, axes = np.linalg.eigh(m.scatter / m.n)
    k = min(most_components, d)
    order = np.argsort(-values, kind="stable")[:k]
    e, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1, 1)  # the largest entry positive, so that reruns agree
    trace = float(np.trace(m.scatter / m.n))
    real = e > max(values.max(), 0.0) * d * np.finfo(float).eps * 16
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1)), np.nan)
    bound = sum(max(m.n * int(h) - s, s - m.n * int(lo)) ** 2 for s, lo, h in zip(m.sums, m.low, m.high, strict=True))
    out = Whitening(d, m.n, m.sums, axes, scale, np.where(real, e, 0.0) / trace if trace > 0 else np.zeros(k), bound)
    if real.any():
        white = _tree(rows.filter(F.size("v") == d), lambda c: out.white(integers(c))[:, real], depth).popitem()[1]
        out.identity_error = float(np.abs(white.scatter / white.n - np.eye(int(real.sum()))).max())
    return out


def _deviations(model: Whitening, x: np.ndarray) -> list[int]:
    """sum over coordinates of (n * x - S)^2, exactly."""
    if model.deviation_bound < 1 << 63:
        shift = np.array([s // model.n for s in model.sums], np.int64)
        rest = np.array([s % model.n for s in model.sums], np.int64)
        return (((x - shift) * model.n - rest) ** 2).sum(1).tolist()
    return [sum((model.n * a - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x.tolist()]


def whiten(vectors: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each usable vector: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    deviation is the exact sum over coordinates of (n * x - S)^2; a value that no long holds raises. whitened is null for a
    component without variance. No shuffle: each task whitens what it reads; the model is d x 32 numbers. Vectors that are
    null, empty, of another length than the model's, or hold null or non-finite numbers give no rows; null ids stay null;
    repeated rows are whitened each; other columns are dropped, whatever their names; no model, no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vector_col)
    if model is None:
        rows, model = rows.limit(0), Whitening(0, 1, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0)
    k = len(model.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, c in _vectors([b], 1):
                x = integers(c)
                white = model.white(x)
                longs = _deviations(model, x)
                if longs and max(longs) >= 1 << 63:
                    raise OverflowError("a deviation has no 64-bit integer")
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                flat = white.ravel()
                cells = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(flat), model.n, np.int64)),
                    pa.array(np.repeat(np.array(longs, np.int64), k)),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(model.explained, len(at))),
                    pa.array(np.full(len(flat), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cells, names)

    return rows.filter(F.size("v") == model.d).mapInArrow(run, schema)

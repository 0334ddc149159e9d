"""Closures of graphs that a task can hold: the packed graph goes to a few tasks, and each walks up from its share of the nodes.

No pair is stored or shuffled on the way: what grows with the closure is its rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.session import kept

FEW = 1000  # edges up to which joins do as well
HELD = 1 << 24  # edges that one task holds
BLOCK = 4096  # nodes from which a task walks at once
PAIRS = 1 << 22  # pairs that a task holds; a block of more is halved, down to a single node
PACKED = 1 << 18  # edges in one packed row
ROWS = 1 << 16  # rows given at once


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, those of one place together."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _opened(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by child as rows (first, last, n, child, parent) of up to PACKED edges or a batch more."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        c, p = (np.concatenate([b.column(k).to_numpy().astype(np.int64) for b in held]) for k in (0, 1))
        cells = [c[0], c[-1], len(c), _squeezed(np.diff(c, prepend=c[:1])), _squeezed(c - p)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["first", "last", "n", "child", "parent"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        if sum(x.num_rows for x in held) >= PACKED:
            yield row(held)
            held = []
    if held:
        yield row(held)


class Graph:
    """Nodes numbered, those with parents first, in order of their ids; the parents of i are up[at[i]:at[i + 1]]."""

    def __init__(self, packed: list[tuple[int, int, int, bytes, bytes]]) -> None:
        packed = sorted(packed, key=lambda r: r[:2])
        ids, sizes = [], []
        for first, _, n, child, _ in packed:
            i, s = np.unique(np.cumsum(_opened(child, n)) + first, return_counts=True)
            if ids and ids[-1][-1] == i[0]:  # a node may stand in several rows
                sizes[-1][-1] += s[0]
                i, s = i[1:], s[1:]
            if len(i):
                ids.append(i)
                sizes.append(s.astype(np.int32))
        below = np.concatenate(ids)
        del ids
        self.at = np.zeros(len(below) + 1, np.int32)
        np.cumsum(np.concatenate(sizes), out=self.at[1:])
        del sizes
        self.up, done, lone = np.empty(self.at[-1], np.int32), 0, []
        for first, _, n, child, parent in packed:
            p = np.cumsum(_opened(child, n)) + first - _opened(parent, n)
            k = np.minimum(np.searchsorted(below, p), len(below) - 1)
            root = np.flatnonzero(below[k] != p)
            lone.append((done + root, p[root]))
            self.up[done : done + n] = k
            done += n
        places, roots = (np.concatenate(x) for x in zip(*lone, strict=True))
        top, number = np.unique(roots, return_inverse=True)
        self.up[places] = len(below) + number
        self.ids = np.concatenate([below, top])
        self.below = self.ids[: len(below)]

    def longest(self, most: int) -> int:
        """The edges of the longest way up; ``most`` where it has as many or more, or goes in a circle."""
        level = np.zeros(len(self.ids), np.int32)
        for k in range(most):
            new = np.maximum.reduceat(level[self.up], self.at[:-1]) + 1
            if (new == level[: len(new)]).all():
                return k
            level[: len(new)] = new
        return most

    def ancestors(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, ancestor, hops) of the nodes of the numbers ``low`` to ``high``, by hops; each pair is met once, at its fewest."""
        total, nodes = len(self.ids), len(self.below)
        i = np.arange(high - low)
        a, seen, found = i + low, i * total + i + low, []
        for hops in range(1, total + 1):
            inner = a < nodes
            i, a = i[inner], a[inner]
            n = self.at[a + 1] - self.at[a]
            place = np.arange(n.sum()) + np.repeat(self.at[a] - np.cumsum(n) + n, n)
            key = np.unique(np.repeat(i, n) * total + self.up[place])
            key = key[seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key]
            if not len(key):
                break
            if high - low > 1 and len(seen) + len(key) > PAIRS:
                middle = (low + high) // 2
                yield from self.ancestors(low, middle)
                yield from self.ancestors(middle, high)
                return
            seen = np.sort(np.concatenate([seen, key]), kind="stable")
            i, a = np.divmod(key, total)
            found.append((key, hops))
        for key, hops in found:
            for j in range(0, len(key), ROWS):
                i, a = np.divmod(key[j : j + ROWS], total)
                yield self.below[i + low], self.ids[a], np.full(len(i), hops, np.int32)


def closure(edges: DataFrame, most: int) -> DataFrame | None:
    """(node, ancestor, hops) of distinct edges (child, parent), none of them from a node to itself, walked in tasks that hold the graph; None where joins are to do it.

    Those are graphs of up to FEW or of over HELD edges, of ids that are no whole numbers, and with ways of ``most`` steps or circles.
    The graph is packed, 16 bytes or fewer an edge, and sent to each task once; a task has about as many bytes of it at work.
    """
    kinds = {edges.schema[c].dataType for c in ("child", "parent")}
    if len(kinds) > 1 or not kinds <= {T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()} or not FEW < (n := edges.count()) <= HELD:
        return None
    cores = edges.sparkSession.sparkContext.defaultParallelism
    kind = kinds.pop().simpleString()
    dealt = edges.repartitionByRange(cores, "child").sortWithinPartitions("child", "parent")
    packed = kept(dealt.select("child", "parent").mapInArrow(_pack, "first long, last long, n long, child binary, parent binary"))

    def held(batches: Iterator[pa.RecordBatch]) -> tuple[Graph | None, list[int]]:
        rows, shards = [], []
        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard not in shards:
                    shards.append(shard)
                if shard == shards[0]:
                    rows.append(tuple(row))
        return Graph(rows) if rows else None, shards

    def depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, _ = held(batches)
        if graph is not None:
            yield pa.RecordBatch.from_arrays([pa.array([graph.longest(most)], pa.int32())], ["depth"])

    tasks = max(1, min(2 * cores, -(-n // BLOCK)))
    whole = packed.select(F.lit(0).alias("shard"), "*")
    if whole.repartition(1).mapInArrow(depth, "depth int").first()[0] >= most:
        return None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, shards = held(batches)
        for shard in shards:
            for low in range(shard * BLOCK, len(graph.below), tasks * BLOCK):
                for node, ancestor, hops in graph.ancestors(low, min(low + BLOCK, len(graph.below))):
                    yield pa.RecordBatch.from_arrays([pa.array(node).cast(own), pa.array(ancestor).cast(own), pa.array(hops)], ["node", "ancestor", "hops"])

    own = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    shards = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("shard"), "*")
    return shards.repartitionById(tasks, F.col("shard")).mapInArrow(walk, f"node {kind}, ancestor {kind}, hops int")

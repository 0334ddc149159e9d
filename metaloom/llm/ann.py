"""Nearest neighbours by a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.llm.common import stored

CHUNK = 4096  # vectors, and queries, of a leaf that one task holds


@dataclass
class Tree:
    """Nodes by number, the root 0: centres, the first child and the number of children (0: a leaf), and the leaf's number."""

    centers: np.ndarray
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to by going to the nearest child, ties to the first."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.count[node]:
                out[rows] = self.leaf[node]
                continue
            lo = self.first[node]
            near = _distances(x[rows], self.centers[lo : lo + self.count[node]]).argmin(axis=1)
            todo += [(lo + k, rows[near == k]) for k in range(self.count[node])]
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: of all branches not yet followed, the one with the nearest centre comes next."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                yield self.leaf[node]
                continue
            lo, n = self.first[node], self.count[node]
            d = ((self.centers[lo : lo + n] - q) ** 2).sum(axis=1)
            for k, v in enumerate(d.tolist()):
                heapq.heappush(queue, (v, lo + k))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(axis=1)[None, :] - 2 * (x @ c.T)


def grow(sample: np.ndarray, branching: int = 8, leaf_rows: int = 32, rounds: int = 8, seed: int = 3) -> Tree:
    """A tree over the rows of ``sample``: nodes of more than ``leaf_rows`` rows are split by k-means, unless all are alike."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float64)
    tree = Tree(np.zeros((1, x.shape[1])), [0], [0], [-1])
    centers = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        own = x[rows]
        start = np.unique(own[rng.permutation(len(own))[: 8 * branching]], axis=0) if len(rows) > leaf_rows else own[:0]
        if len(start) < 2:
            tree.leaf[node] = leaves
            leaves += 1
            continue
        c = start[rng.permutation(len(start))[:branching]]
        for _ in range(rounds):
            near = _distances(own, c).argmin(axis=1)
            c = np.stack([own[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        near = _distances(own, c).argmin(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            tree.leaf[node] = leaves
            leaves += 1
            continue
        tree.first[node], tree.count[node] = len(centers), len(used)
        for k in used:
            todo.append((len(centers), rows[near == k]))
            centers.append(c[k])
            tree.first.append(0)
            tree.count.append(0)
            tree.leaf.append(-1)
    tree.centers = np.stack(centers)
    return tree


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest leaves to visit at which ``queries`` rows of the sample find ``recall`` of their ``k`` true neighbours in it.

    Neighbours among all rows are nearer than those in a sample of them, so more of them are found than calibrated.
    """
    x = sample.astype(np.float64)
    if len(x) < 2:
        return 1
    of = tree.assign(x)
    ranks = []
    step = max(1, len(x) // queries)
    for i in range(0, len(x), step):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        true = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = {leaf: r for r, leaf in enumerate(tree.order(x[i]), 1)}
        ranks += [place[v] for v in of[true].tolist()]
    ranks = np.sort(ranks)
    return int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _packed(df: DataFrame, tree, dims: int, most: int) -> DataFrame:
    """(leaf, vec, ids): a row for each different vector of a batch, as the bytes of its doubles, with its ``most`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)) + 0.0
            ids = b.column(0).to_numpy()
            keys = x.view(np.dtype((np.void, 8 * dims))).ravel()
            _, first, of = np.unique(keys, return_index=True, return_inverse=True)
            order = np.lexsort((ids, of))
            start = np.searchsorted(of[order], np.arange(len(first)))
            small = [ids[order[s:e]][:most].tolist() for s, e in zip(start, [*start[1:], len(order)], strict=True)]
            own = x[first]
            yield pa.RecordBatch.from_arrays([pa.array(t.assign(own)), pa.array([r.tobytes() for r in own], pa.binary()), pa.array(small, pa.list_(pa.int64()))], ["leaf", "vec", "ids"])

    return df.select("id", "v").mapInArrow(run, "leaf long, vec binary, ids array<long>")


def _search(k: int, dims: int):
    """The ``k`` nearest of a part of a leaf to each of its queries, a row each."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, float]] = []
        if q.num_rows and c.num_rows:
            x = _matrix(c.column("vec"), dims)
            ids = c.column("ids").to_pylist()
            flat = np.array([i for s in ids for i in s], np.int64)
            of = np.repeat(np.arange(len(ids)), [len(s) for s in ids])
            for key, raw in zip(q.column("qkey").to_pylist(), q.column("qvec").to_pylist(), strict=True):
                d = np.sqrt(((x - np.frombuffer(raw, np.float64)) ** 2).sum(axis=1))
                # each vector has one id at least, so the k nearest ids are among the k nearest vectors and their ties
                near = d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                rows = np.flatnonzero(near[of])
                best = rows[np.lexsort((flat[rows], d[of[rows]]))][:k]
                out += [(key, int(flat[r]), float(d[of[r]])) for r in best]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"qkey": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector that isn't null, zero or holding null or non-finite components."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95, sample_rows: int = 16_384, leaf_rows: int = 32) -> DataFrame:
    """Each query's ``k`` nearest vectors found, but for the query itself: (query_id, rank, vec_id, score), score the Euclidean distance in doubles.

    The tree is grown on the ``sample_rows`` valid rows of smallest id hash (all, if fewer); every row is indexed in its
    leaf. A query visits leaves best bin first: as many as the calibration on the sample needs for ``recall``, and on
    until those hold more than ``k`` rows. Equal vectors are one entry with their k + 1 smallest ids, which no result can
    go beyond, and equal queries are searched once, so a common vector makes no large leaf. Leaves are compared in parts
    of about CHUNK vectors and CHUNK queries.

    The sample, and with it the number of leaves, doesn't grow with the table: a leaf of n / leaves vectors is read for each
    visit, so the work is rows times queries times the share of leaves visited; for vectors without structure that share is
    about a third, and no tree does much better on them.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than
    most of the sample (the shorter, if as many); ties go to the smaller id; a repeated id is a candidate once for each different vector it has;
    other columns are dropped; without valid rows there are no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    lengths = Counter(len(v) for v in sample.column("v"))
    dims = max(lengths, key=lambda n: (lengths[n], -n))
    x = np.array([v for v in sample.column("v").to_pylist() if len(v) == dims], np.float64)
    tree = grow(x, leaf_rows=leaf_rows)
    visits = calibrate(tree, x, k, recall)
    shared = spark.sparkContext.broadcast(tree)
    alike = F.size("v") == dims
    entry = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    index = stored(_packed(rows.filter(alike), shared, dims, k + 1).groupBy("leaf", "vec").agg(entry), "leaves")
    size = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids"))
    sizes = {r["leaf"]: (r["n"], r["ids"]) for r in size.collect()}  # at most the tree's leaves, which the sample bounds
    held = spark.sparkContext.broadcast(sizes)

    asked = valid(queries, id_col, vector_col).filter(alike)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary())], ["query_id", "qvec"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n = shared.value, held.value
        for b in batches:
            keys, raws, leaves = [], [], []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = got = 0
                for leaf in t.order(np.frombuffer(raw, np.float64)):
                    if seen >= visits and got > k:
                        break
                    seen += 1
                    if leaf in n:
                        got += n[leaf][1]
                        keys.append(key)
                        raws.append(raw)
                        leaves.append(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(raws, pa.binary()), pa.array(leaves, pa.int64())], ["qkey", "qvec", "leaf"])

    # Equal queries go by their smallest id, so that their vector isn't carried beyond the search.
    ids = asked.mapInArrow(keyed, "query_id long, qvec binary")
    alone = ids.groupBy("qvec").agg(F.min("query_id").alias("qkey"))
    paths = stored(alone.select("qkey", "qvec").mapInArrow(visited, "qkey long, qvec binary, leaf long"), "visits")
    many = {r["leaf"]: r["n"] for r in paths.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = spark.createDataFrame([(leaf, -(-n // CHUNK), -(-many.get(leaf, 1) // CHUNK)) for leaf, (n, _) in sizes.items()], "leaf long, c_parts long, q_parts long")
    parts = F.broadcast(parts)  # a row for each leaf
    c_part, q_part = F.pmod(F.xxhash64("vec"), F.col("c_parts")), F.pmod(F.xxhash64("qvec"), F.col("q_parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = paths.join(parts, "leaf").select("leaf", "qkey", "qvec", q_part.alias("q"), every("c_parts").alias("c"))
    right = index.join(parts, "leaf").select("leaf", "vec", "ids", c_part.alias("c"), every("q_parts").alias("q"))
    found = left.groupBy("leaf", "q", "c").cogroup(right.groupBy("leaf", "q", "c")).applyInArrow(_search(k + 1, dims), "qkey long, vec_id long, score double")
    by_vector = W.partitionBy("qkey").orderBy("score", "vec_id")
    best = found.withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1)
    own = W.partitionBy("query_id").orderBy("score", "vec_id")
    asking = ids.distinct().join(alone, "qvec").select("query_id", "qkey")
    out = asking.join(best, "qkey").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(own).cast("int"))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""A stored vector index: coarse cells by k-means, 8-bit codes, probing of few cells, exact re-ranking.

The index is a folder of tables that any later session reads: ``codes`` and ``vectors``, both partitioned by cell, and, written
last, ``meta``. Its name holds a fingerprint of the vectors and of the model that made them, so that a changed table, another
model or other settings get an index of their own, and an unchanged one is read and not built again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.session import kept

MOST_CELLS = 4096
PART_ROWS = 1 << 15  # codes of a cell that one task scores
BUNDLE_ROWS = 1 << 14  # codes of neighbouring cells that one task scores together
QUERY_ROWS = 1 << 14  # queries that meet a bundle of codes together
FIT_ROWS = 256  # vectors a cell from which the cells are made, at most
LEVELS = 255


@dataclass
class Index:
    """``built``: whether this call made it. ``probes``: the cells to look at for the recall that building measured."""

    spark: SparkSession
    path: str
    built: bool
    n: int
    centroids: np.ndarray
    low: np.ndarray
    step: np.ndarray
    parts: list[int]
    probes: int
    recall: float

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _unit(vectors: DataFrame) -> DataFrame:
    """(id, vec) as unit vectors of doubles; null, empty and zero vectors, and such with null or non-finite numbers, are none."""
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    v = v.withColumn("__n", norm).filter((F.col("__n") > 0) & (F.col("__n") < float("inf")) & ~F.isnan("__n"))
    return v.select("id", F.transform("vec", lambda x: x / F.col("__n")).alias("vec"))


def fingerprint(vectors: DataFrame, *settings) -> str:
    """A name for a set of rows (id, vec), whatever their order, and the settings: from their number and two sums of row hashes."""
    row = [F.xxhash64(F.lit(seed), "id", "vec").cast("decimal(38,0)") for seed in (1, 2)]
    facts = vectors.select("id", "vec").agg(F.count(F.lit(1)), *[F.sum(r) for r in row]).first()
    return hashlib.sha256(repr([*map(str, facts), *map(str, settings)]).encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _placed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, vec, cell): each unit vector and its nearest cell."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                near = np.argmax(_matrix(some.column(1)) @ centroids.T, axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(near.astype(np.int32))], ["id", "vec", "cell"])

    return rows.select("id", "vec").mapInArrow(run, f"id {kind}, vec array<double>, cell int")


def _places(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(place): where the cell of each row (vec, cell) stands among all in their order of nearness, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                order = np.argsort(-(_matrix(some.column(0)) @ centroids.T), axis=1, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array((order == some.column(1).to_numpy()[:, None]).argmax(1))], ["place"])

    return rows.select("vec", "cell").mapInArrow(run, "place long")


def _bundles(sizes: dict[int, int], parts: list[int]) -> list[tuple[int, int, int]]:
    """(cell, part, bundle): parts of cells in bundles of about BUNDLE_ROWS codes, in the order of cells."""
    out, bundle, rows = [], 0, 0
    for cell in sorted(sizes):
        for part in range(parts[cell]):
            more = -(-sizes[cell] // parts[cell])
            if rows and rows + more > BUNDLE_ROWS:
                bundle, rows = bundle + 1, 0
            out.append((cell, part, bundle))
            rows += more
    return out


def _asked(queries: DataFrame, centroids: np.ndarray, count: int, units: list[tuple[int, int, int]]) -> DataFrame:
    """(q, vec, bundle, cells): a row for each bundle with cells among the ``count`` nearest to a query (id, vec), and which; no cells stand for all."""
    kind = queries.schema["id"].dataType.simpleString()
    bundles = units[-1][2] + 1
    inside = [np.array(sorted({c for c, _, b in units if b == k})) for k in range(bundles)] if count < len(centroids) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                n = some.num_rows
                if inside:
                    near = np.argsort(-(_matrix(some.column(1)) @ centroids.T), axis=1, kind="stable")[:, :count]
                    probed = np.zeros((n, len(centroids)), bool)
                    np.put_along_axis(probed, near, True, axis=1)
                for k in range(bundles):
                    rows, lists = np.arange(n), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
                    if inside:
                        at, cells = np.nonzero(probed[:, inside[k]])
                        rows, counts = np.unique(at, return_counts=True)
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(inside[k][cells].astype(np.int32)))
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), pa.array(np.full(len(rows), k, np.int32)), lists], ["q", "vec", "bundle", "cells"])

    return queries.select("id", "vec").mapInArrow(run, f"q {kind}, vec array<double>, bundle int, cells array<int>")


def _ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of each component: by task, then by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = rows.select("vec").mapInArrow(run, "d long, low double, high double").groupBy("d").agg(F.min("low"), F.max("high")).sort("d").collect()
    return np.array([r[1] for r in found]), np.array([r[2] for r in found])


def _means(fit: DataFrame, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of ``cells`` cells of unit vectors (id, vec): k-means by cosine from the vectors of smallest id hash.

    A round sums the vectors of each cell by task, then over tasks. A cell that no vector is nearest to stays as it is.
    """
    first = fit.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(cells).select("vec").collect()  # at most MOST_CELLS vectors
    centroids = np.array([r[0] for r in first])

    def summed(cell: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(list(total), pa.list_(pa.float64()))], ["cell", "n", "total"])

    for _ in range(rounds):
        now = centroids.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now)), np.zeros(now.shape)
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    m = _matrix(b.column(0).slice(lo, 1024))
                    cell = (m.astype(np.float32) @ now.T).argmax(1)
                    np.add.at(total, cell, m)
                    n += np.bincount(cell, minlength=len(n))
            yield summed(np.flatnonzero(n), n[n > 0], total[n > 0])

        def over(some: pa.Table) -> pa.Table:
            return pa.Table.from_batches([summed(some.column("cell").to_numpy()[:1], np.array([some.column("n").to_numpy().sum()]), _matrix(some.column("total").combine_chunks()).sum(0, keepdims=True))])

        kind = "cell int, n long, total array<double>"
        found = fit.select("vec").mapInArrow(run, kind).groupBy("cell").applyInArrow(over, kind).collect()  # a row for each cell
        centroids = centroids.copy()
        for r in found:
            centroids[r.cell] = r.total
        centroids /= np.maximum(np.sqrt((centroids**2).sum(1, keepdims=True)), 1e-12)
    return centroids


def build(vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, target: float = 0.95, seed: int = 7) -> None:
    """Writes the index of ``vectors`` (id, vec) to ``path``.

    Cells: k-means by cosine over a sample of at most FIT_ROWS vectors a cell; every vector is then put into its nearest
    cell. There are n / 30 of them, 4 times the root of n and MOST_CELLS at most: each is a file at least. A component's code is its place among 256 steps of its range. For
    up to 200 of the vectors the ``k`` nearest of all are found, and where the cells of these stand in the order in
    which cells are probed: the probes are as many as hold the share ``target`` of them.
    """
    spark = vectors.sparkSession
    unit = kept(_unit(vectors))
    n = unit.count()
    cells = max(1, cells or min(MOST_CELLS, n // 30, 4 * math.isqrt(n)))
    mix = lambda s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(1 << 30))
    if cells > 1:
        share = min(1.0, FIT_ROWS * cells / n)
        fit = unit.filter(mix(seed) < int(share * (1 << 30))) if share < 1 else unit
        centroids = _means(kept(fit.repartition(spark.sparkContext.defaultParallelism)), cells, seed)
    else:
        centroids = np.ones((1, len(unit.first()["vec"]) if n else 1))
    low, high = _ranges(unit)
    step = np.where(high > low, (high - low) / LEVELS, 1.0)
    placed = _placed(unit, centroids)
    sizes = dict(placed.groupBy("cell").count().collect())
    parts = [max(1, -(-sizes.get(c, 0) // PART_ROWS)) for c in range(len(centroids))]
    of = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("cell") + 1) if max(parts) > 1 else F.lit(1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.clip(np.rint((_matrix(b.column(1)) - low) / step), 0, LEVELS).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in code], pa.binary()), b.column(2), b.column(3)], ["id", "code", "part", "cell"])

    kind = vectors.schema["id"].dataType.simpleString()
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), of.cast("long")).cast("int"))
    codes = placed.select("id", "vec", "part", "cell").mapInArrow(coded, f"id {kind}, code binary, part int, cell int")
    codes.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    placed.select("id", "vec", "part", "cell").repartition("cell", "part").drop("part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    probes, recall = len(centroids), 1.0
    if n:
        draft = Index(spark, path, True, n, centroids, low, step, parts, probes, 1.0)
        few = unit.filter(mix(seed + 1) < max(1, int(min(1.0, 200 / n) * (1 << 30)))).limit(400)
        near = search(draft, few, k, probes=len(centroids)).select("q", "cell")
        places = np.array([r[0] for r in _places(near.join(few.withColumnRenamed("id", "q"), "q"), centroids).collect()])  # at most 400 k
        if len(places):
            probes = int(np.sort(places)[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1
            recall = float((places < probes).mean())
    meta = (n, centroids.tolist(), low.tolist(), step.tolist(), parts, probes, recall)
    spark.createDataFrame([meta], "n long, centroids array<array<double>>, low array<double>, step array<double>, parts array<int>, probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def opened(vectors: DataFrame, folder: str, model: str = "", **settings) -> Index:
    """The index of ``vectors`` (id, vec), read from ``folder`` if it stands there, else built; see ``build``. ``model`` names what made the vectors."""
    path = f"{folder.rstrip('/')}/{fingerprint(vectors, model, sorted(settings.items()))}"
    spark = vectors.sparkSession
    stale = not _exists(spark, f"{path}/meta/_SUCCESS")
    if stale:
        build(vectors, path, **settings)
    m = spark.read.parquet(f"{path}/meta").first()
    return Index(spark, path, stale, m.n, np.array(m.centroids), np.array(m.low), np.array(m.step), list(m.parts), m.probes, m.recall)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(q, rank, id, cosine, cell): the ``k`` nearest by cosine to each of ``queries`` (id, vec) in the ``probes`` cells nearest to it, itself aside; ties to the smaller id.

    Only partitions of probed cells are read. Codes give each cosine up to a bound (half a step of each component times
    the query's); in each part of a cell those go on that may be among the best, then those that may over all parts,
    and only for these are whole vectors read and exact cosines taken. So within the probed cells the result is exact.
    Codes of neighbouring cells meet the queries in bundles of about BUNDLE_ROWS, and a cell in parts of PART_ROWS rows, so a
    query goes to each bundle once, and what it brings back is ``k`` rows a bundle and those within the bound. Queries
    without a direction give no rows.
    """
    spark = index.spark
    kind = queries.schema["id"].dataType.simpleString()
    if not index.n:
        return spark.createDataFrame([], f"q {kind}, rank int, id {kind}, cosine double, cell int")
    low, step, count = index.low, index.step, min(probes or index.probes, len(index.centroids))
    given = kept(_unit(queries))
    units = _bundles(dict(index.table("codes").groupBy("cell").count().collect()), index.parts)  # at most MOST_CELLS numbers
    asked = _asked(given, index.centroids, count, units)
    every = count == len(index.centroids)
    cells = sorted({c for c, _, _ in units}) if every else [r[0] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]
    bundled = F.broadcast(spark.createDataFrame(units, "cell int, part int, bundle int"))
    # Many queries come in blocks, each of which meets the codes on its own.
    blocks = -(-max(1, given.count()) // QUERY_ROWS)
    met = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    codes = index.table("codes").filter(F.col("cell").isin(cells)).join(bundled, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        types = [a.schema.field("q").type, b.schema.field("id").type, pa.int32(), pa.float64(), pa.float64()]
        if a.num_rows and b.num_rows:
            d, best = len(low), k + 1  # itself may be among them
            b = b.sort_by("cell")
            m = (low + np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, d) * step).astype(np.float32)
            cell, ids, a = b.column("cell").to_numpy(), b.column("id").combine_chunks(), a.combine_chunks()
            names, first = np.unique(cell, return_index=True)
            ends = np.append(first[1:], len(cell))
            # what single precision may be wrong by, besides half a step
            blur = (d + 4) * 2.0**-23 * max(1.0, float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max()))
            for lo in range(0, a.num_rows, 256):
                some = a.slice(lo, 256)
                v = _matrix(some.column("vec").combine_chunks())
                v32, off = v.astype(np.float32), np.abs(v) @ (step / 2) + blur
                if every:
                    near = v32 @ m.T
                else:
                    near, lists = np.full((len(v), len(m)), -np.inf, np.float32), some.column("cells").combine_chunks()
                    at, flat = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
                    here = np.searchsorted(names, flat)
                    ok = (here < len(names)) & (names[np.minimum(here, len(names) - 1)] == flat)
                    probed = np.zeros((len(v), len(names)), bool)
                    probed[at[ok], here[ok]] = True
                    for c in range(len(names)):
                        rows = np.flatnonzero(probed[:, c])
                        if len(rows):
                            near[rows, first[c] : ends[c]] = v32[rows] @ m[first[c] : ends[c]].T
                # The greatest of each of some groups of codes: of these the last of the best is no better than that of all codes.
                groups = min(len(m), max(512, 8 * best))
                top = near[:, : len(m) // groups * groups].reshape(len(v), -1, groups).max(axis=1)
                least = np.partition(top, groups - best, axis=1)[:, groups - best] if groups >= best else np.full(len(v), -np.inf)
                rows, cols = np.nonzero((near >= (least - 2 * off)[:, None]) & (near > -np.inf))
                x = near[rows, cols].astype(np.float64)
                out.append([some.column("q").combine_chunks().take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(cell[cols], pa.int32()), pa.array(x - off[rows]), pa.array(x + off[rows])])
        columns = [pa.chunked_array([o[i] for o in out], t) for i, t in enumerate(types)]
        return pa.table(dict(zip(("q", "id", "cell", "least", "most"), columns, strict=True)))

    ids = codes.schema["id"].dataType.simpleString()
    scored = met.groupBy("bundle", "block").cogroup(codes.groupBy("bundle", "block")).applyInArrow(run, f"q {kind}, id {ids}, cell int, least double, most double").filter("q <> id")
    ranked = scored.withColumn("__r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("least"))))
    ranked = ranked.withColumn("__k", F.max(F.when(F.col("__r") == k, F.col("least"))).over(W.partitionBy("q")))
    hopeful = ranked.filter(F.col("__k").isNull() | (F.col("most") >= F.col("__k"))).select("q", "id", "cell")
    whole = index.table("vectors").filter(F.col("cell").isin(cells))
    exact = hopeful.join(whole, ["cell", "id"]).join(given.select(F.col("id").alias("q"), F.col("vec").alias("__q")), "q")
    cosine = F.aggregate(F.zip_with("__q", "vec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = exact.select("q", "id", "cell", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)).alias("cosine"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "id")))
    return best.filter(F.col("rank") <= k).select("q", "rank", "id", "cosine", "cell")

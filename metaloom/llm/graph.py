"""Connected components of large edge lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import discard, stored

SMALL = 1 << 18  # edges that one task may join


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each node linked to the smallest of its component there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = np.fromiter(up, np.int64, len(up))
    roots = np.array([root(int(x)) for x in nodes], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def components(edges: DataFrame, small: int = SMALL, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b longs); a component is named by its smallest node.

    Each partition first turns its edges into stars, of which there are no more than its nodes; partitions are as large as
    the input makes them. If that leaves ``small`` edges at most, one task joins them. Otherwise rounds of large-star and
    small-star follow: each links every node's neighbours to the smallest node near it, until each component is a star. A
    round groups edges by node with partial aggregation and joins the minima back, so a node with very many edges is
    spread over tasks; rounds are stored in the shared folder, and grow in number with the logarithm of the longest
    chain. Self-links and repeated edges are allowed; an empty list gives no rows.
    """
    shape = "a long, b long"
    e = stored(edges.filter("a is not null and b is not null").select("a", "b").mapInArrow(_stars, shape), "stars")
    n = e.count()
    if n <= small:
        return e.coalesce(1).mapInArrow(_stars, shape).toDF("node", "component")
    nodes = e.select("a").distinct()
    e = stored(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        # Large star: a node's larger neighbours go to the smallest of its neighbours and itself.
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours and itself go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        before, e = e, stored(star.filter("a <> b").distinct(), "edges")
        discard(e.sparkSession, before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point in {most_rounds} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.withColumnRenamed("a", "node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

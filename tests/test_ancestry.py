"""Closures walked in tasks that hold the packed graph, against plain searches."""

import random

import pyarrow as pa
import pytest

from metaloom.operators import ancestry as A
from metaloom.operators import ontology as O


def searched(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = {}
    for node in up:
        level, hops = {node}, 0
        seen = {node}
        while level:
            level, hops = {p for x in level for p in up.get(x, ())} - seen, hops + 1
            seen |= level
            out |= {(node, a): hops for a in level}
    return out


def graph(n, seed=5):
    """A graph of odd numbers, large and below 0, with diamonds and several roots; (child, parent)."""
    r = random.Random(seed)
    ids = sorted({r.randrange(-50, 50) for _ in range(n // 2)} | {r.randrange(1 << 40) for _ in range(n)})
    return sorted({(ids[k], ids[r.randrange(k // 3, k)]) for k in range(len(ids) // 10, len(ids)) for _ in range(r.choice((1, 2, 3)))})


@pytest.mark.parametrize("kind", ["long", "int"])
def test_walked_closures_equal_a_search_and_keep_no_pairs(spark, monkeypatch, kind):
    kept = []
    for module in (A, O):
        monkeypatch.setattr(module, "kept", lambda df, real=module.kept: kept.append(df.columns) or real(df))
    monkeypatch.setattr(A, "FEW", 100)
    monkeypatch.setattr(A, "BLOCK", 16)
    edges = graph(400) if kind == "long" else sorted({(k, k // d) for k in range(1, 500) for d in (2, 3)})
    c = O.closure(spark.createDataFrame([*edges, edges[0], (7, 7), (None, 1), (1, None)], f"child {kind}, parent {kind}").repartition(5))
    ids = {"long": "bigint", "int": "int"}[kind]
    assert c.dtypes == [("node", ids), ("ancestor", ids), ("hops", "int")]
    rows = c.collect()
    assert len(rows) == len({(r.node, r.ancestor) for r in rows}) and {(r.node, r.ancestor): r.hops for r in rows} == searched(edges)
    assert kept == [["child", "parent"], ["first", "last", "n", "child", "parent"]]


def test_circles_and_long_ways_are_left_to_joins(spark, monkeypatch):
    monkeypatch.setattr(A, "FEW", 0)
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, parent long")
    assert A.closure(ring, 64) is None and {(r.node, r.ancestor): r.hops for r in O.closure(ring).collect()} == searched([(1, 2), (2, 3), (3, 1), (4, 1)])
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "child long, parent long")
    assert A.closure(chain, 7).count() == 21 and A.closure(chain, 6) is None
    with pytest.raises(RuntimeError):
        O.closure(chain, most=3)
    assert A.closure(ring.limit(0), 64) is None


def test_graphs_are_packed_in_parts_and_blocks_are_halved(monkeypatch):
    monkeypatch.setattr(A, "PACKED", 3)
    edges = graph(60) + [(1 << 41, p) for p in range(-10, 10)]  # a node of several packed rows
    batches = [pa.RecordBatch.from_pylist([{"child": c, "parent": p} for c, p in edges[i : i + 2]]) for i in range(0, len(edges), 2)]
    rows = [tuple(r.values()) for b in A._pack(iter(batches)) for r in b.to_pylist()]
    assert len(rows) > 20
    g = A.Graph(rows[::-1])
    for pairs in (1 << 22, 40, 1):
        monkeypatch.setattr(A, "PAIRS", pairs)
        found = [(int(n), int(a), int(h)) for cols in g.ancestors(0, len(g.below)) for n, a, h in zip(*cols, strict=True)]
        assert len(found) == len(set(found)) and {(n, a): h for n, a, h in found} == searched(edges)
    assert max(searched(edges).values()) <= g.longest(64) < 64

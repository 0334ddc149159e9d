import heapq
import math
import random

import pytest

from metaloom.operators import negation as N
from metaloom.operators import paths as P


@pytest.mark.parametrize(
    ("value", "evidence", "trigger"),
    [
        ("TMT", "No TMT labeling was used in this study.", "no"),
        ("TMT", "Samples were not only labelled with TMT but also fractionated.", None),
        ("fractionated", "Samples were not only labelled with TMT but not fractionated.", "not"),
        ("TMT", "No iTRAQ was used, but TMT labelling was.", None),
        ("TMT", "TMT was not used.", "was not used"),
        ("TMT", "iTRAQ was used although TMT was not used.", "was not used"),
        ("iTRAQ", "iTRAQ was used although TMT was not used.", None),
        ("trypsin", "The digestion wasn't done with trypsin.", "n't"),
        ("trypsin", "The digestion wasn’t done with Trypsin.", "n’t"),
        ("liver", "We excluded kidney. Liver was used.", None),
        ("liver", "We excluded kidney and liver.", "excluded"),
        ("liver", "Without kidney; liver was taken", None),
        ("liver", "No kidney\nliver", None),
        ("no label", "There was no label control", None),
        ("heart", "Neither kidney nor heart was used.", "neither"),
        ("Lys-C", "Trypsin was used instead of Lys-C.", "instead of"),
        ("TMT", "There is no doubt that TMT was used", None),
        ("5 ppm", "A tolerance of 5 ppm was not applied", "was not applied"),
        ("x", "", None),
        (None, "no x", None),
        ("", "no x", None),
        ("absent", "no mention", None),
        ("no", "no", None),
        ("zebra", "not zebra, and the zebra was there", "not"),
    ],
)
def test_triggers(value, evidence, trigger):
    assert N.trigger(value, evidence) == trigger


def test_flags_skip_what_says_absence(spark):
    rows = [
        (1, "labeling", "TMT", "No TMT was used"), (2, "_raw", "TMT", "No TMT was used"), (3, "labeling", " Label-free ", "no label-free"), (4, "labeling", "TMT", "inferred: no TMT"),
        (5, "labeling", None, "no"), (6, "labeling", "TMT", None), (7, "labeling", "tmt", "TMT wasn’t used"), (8, "tissue", "unknown", "not unknown"), (9, "a.b", "(x|y", "without (X|Y"), (10, "labeling", "TMT", "TMT was used"),
    ]
    got = {r.id: r.trigger for r in N.flags(spark.createDataFrame(rows, "id long, field string, value string, evidence string")).collect()}
    assert got == {1: "no", 9: "without"}
    assert {r.id for r in N.flags(spark.createDataFrame([(7, "labeling", "tmt", "it wasn’t TMT")], "id long, field string, value string, evidence string")).collect()} == {7}


def graph(seed, n=60, m=110):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.choice([0.0, 0.25, 1.0, 3.0, 20.0])) for _ in range(m)]


def dijkstra(edges, a):
    near = {}
    for x, y, w in edges:
        near.setdefault(x, []).append((y, w))
        near.setdefault(y, []).append((x, w))
    best, heap = {}, [(0.0, a)]
    while heap:
        c, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = c
        for y, w in near.get(x, ()):
            if y not in best:
                heapq.heappush(heap, (c + w, y))
    return best


@pytest.mark.parametrize("delta", [0.3, None])
def test_cheapest_ways(spark, delta):
    e = graph(1)
    pairs = [(a, b) for a in (0, 1, 7) for b in range(60)] + [(999, 1), (5, 999), (999, 999)]
    got = {(r.a, r.b): r.cost for r in P.cheapest(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(e, "child long, parent long, weight double"), delta).collect()}
    assert got == {(a, b): pytest.approx(dijkstra(e, a).get(b)) for a, b in pairs}


def test_ways_of_many_nodes_with_one_neighbour_fold_into_it(spark, monkeypatch):
    r = random.Random(4)
    # hubs with hundreds of leaves, leaves below leaves, a loop, an edge apart, parallel edges, a cycle of hubs
    e = [(100 + i, i % 4, 1.0 + i % 3) for i in range(400)] + [(1000 + i, 100 + i, 0.5) for i in range(40)] + [(0, 1, 2.0), (1, 2, 0.25), (2, 0, 1.0), (7, 7, 0.0), (50, 51, 3.0), (100, 0, 9.0)]
    nodes = [*range(5), 7, 50, 51, *range(100, 140), *range(1000, 1040), 9999]
    pairs = [(r.choice(nodes), r.choice(nodes)) for _ in range(300)] + [(50, 51), (51, 50), (1000, 100), (100, 1000), (9999, 9999), (1001, 1001), (3, 103), (None, 1), (1, None), (None, None)]
    searched = []
    for name in ("_stepped", "_levelled"):
        monkeypatch.setattr(P, name, lambda p, e, *o, real=getattr(P, name): (searched.append(e.count()), real(p, e, *o))[1])
    p, df = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(e, "child long, parent long, weight double")
    want = {(a, b): None if a is None or b is None else 0.0 if a == b else dijkstra(e, a).get(b) for a, b in pairs}
    got = {(x.a, x.b): x.cost for x in P.cheapest(p, df).collect()}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    hops = {(x.a, x.b): (x.hops, x.distance) for x in P.fewest(p, df).collect()}
    steps = {(a, b): None if a is None or b is None else 0 if a == b else dijkstra([(x, y, 1) for x, y, _ in e], a).get(b) for a, b in pairs}
    assert hops == {k: (v, v if v is None else v / (1 + v)) for k, v in steps.items()}
    assert len(searched) == 2 and max(searched) <= 12  # the hubs' cycle at most, instead of 446 edges both ways


def test_cheapest_raises(spark):
    p = spark.createDataFrame([(0, 3)], "a long, b long")
    with pytest.raises(ValueError, match="negative"):
        P.cheapest(p, spark.createDataFrame([(0, 1, -1.0)], "child long, parent long, weight double"))
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "child long, parent long, weight double")
    with pytest.raises(RuntimeError, match="fixed point"):
        P.cheapest(p, chain, most=3)
    with pytest.raises(RuntimeError, match="levels"):
        P.fewest(p, chain, most=3)


def test_orders_of_a_deep_graph(spark):
    r = random.Random(2)
    e = [(i, p) for i in range(1, 40) for p in {i - 1, r.randrange(i)}]
    df = spark.createDataFrame(e, "child long, parent long")
    parents, children = {}, {}
    for c, p in e:
        parents.setdefault(c, set()).add(p)
        children.setdefault(p, set()).add(c)
    level, ti = {0: 0}, {0: 0.0}
    for i in range(1, 40):
        level[i] = 1 + max(level[p] for p in parents[i])
        ti[i] = sum(ti[p] + math.log(len(children[p])) for p in parents[i])
    assert max(level.values()) == 39
    assert {x.node: x.level for x in P.topological_order(df).collect()} == level
    assert {x.node: x.ti for x in P.topological_information(df).collect()} == pytest.approx(ti)
    with pytest.raises(ValueError, match="cycle"):
        P.topological_order(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 0)], "child long, parent long"))


def test_paths_to_roots(spark):
    e = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(5, 9), (30, 31), (None, 3)], "child long, parent long")
    nodes = spark.createDataFrame([(i,) for i in (*range(20), 30, 31, 77)], "node long")
    got = {r.node: r.path for r in P.path_to_root(nodes, e).collect()}
    assert got == {i: ">".join(map(str, range(i, -1, -1))) for i in range(20)} | {30: "30>31", 31: "31", 77: "77"}
    with pytest.raises(RuntimeError, match="cycle"):
        P.path_to_root(nodes, spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), most=50)


def test_negated_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("TMT", "No TMT"), ("TMT", "TMT"), (None, "No"), ("TMT", None)], "v string, e string")
    assert [r.n for r in df.select(N.negated(F.col("v"), F.col("e")).alias("n")).collect()] == [True, False, False, False]

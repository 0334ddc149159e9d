import random
from collections import Counter

import pytest

from metaloom.operators import evaluation as E


def pairs(seed, groups=4):
    r = random.Random(seed)
    return [(f"g{g}", i, j, r.choice([0.1, 0.5, 0.5, 0.9, 1.0]), r.choice([1, 2])) for g in range(groups) for i in range(12) for j in range(10) if r.random() < 0.4]


def by_hand(rows):
    out = set()
    for g in {r[0] for r in rows}:
        out |= {(g, i, j, s) for i, j, s in E.greedy_pairs([(s, i, j) for h, i, j, s, _ in rows if h == g])}
    return out


@pytest.mark.parametrize("large", [1 << 16, 5])
def test_greedy_pairs_of_any_size(spark, large):
    rows = pairs(1)
    df = spark.createDataFrame(rows, "g string, i int, j int, s double, rank int")
    got = {tuple(r) for r in E.one_to_one(df, ["g"], "greedy", large=large).select("g", "i", "j", "s").collect()}
    assert got == by_hand(rows)


def test_optimal_pairs_of_a_group_in_parts(spark):
    # three parts that share no node, in one group
    rows = [("g", 100 * k + i, 100 * k + j, s, rank) for k in range(3) for _, i, j, s, rank in pairs(5 + k, 1)]
    df = spark.createDataFrame(rows, "g string, i int, j int, s double, rank int")
    value = lambda found: (len(found), round(sum(next(x[4] for x in rows if x[1:3] == f[1:3]) + f[3] / 10 for f in found), 6))
    whole = [tuple(r) for r in E.one_to_one(df, ["g"], "optimal").select("g", "i", "j", "s").collect()]
    apart = [tuple(r) for r in E.one_to_one(df, ["g"], "optimal", large=80).select("g", "i", "j", "s").collect()]
    assert value(apart) == value(whole) and len({f[1] for f in apart}) == len(apart) == len({f[2] for f in apart})
    with pytest.raises(ValueError, match="connected"):
        E.one_to_one(df, ["g"], "optimal", large=4).collect()


def test_field_scores(spark):
    v = {"heart": [1.0, 0.0], "cardiac": [0.9, 0.2], "liver": [0.0, 1.0], "Heart ": [1.0, 0.0], "hepatic": [0.5, 0.6], "x": [-1.0, 0.0]}
    predicted = [("a", 0, "Heart "), ("a", 1, "hepatic"), ("a", 2, "x"), ("b", 0, "liver"), ("c", 0, None), ("e", 0, "cardiac"), ("e", 1, "heart")]
    golden = [("a", 0, "cardiac"), ("a", 1, "heart"), ("a", 2, "liver"), ("d", 0, "liver"), ("e", 0, "heart")]
    frame = lambda rows: spark.createDataFrame(rows, "f string, seq int, value string")
    vectors = spark.createDataFrame(list(v.items()), "term string, vec array<double>")
    scores, matched = E.field_scores(frame(predicted), frame(golden), vectors, ["f"])
    got = {r.f: (r.n_predicted, r.n_golden, r.tp, r.p, r.r) for r in scores.collect()}
    assert got == {"a": (3, 3, 2, pytest.approx(2 / 3), pytest.approx(2 / 3)), "b": (1, 0, 0, 0.0, 0.0), "d": (0, 1, 0, 0.0, 0.0), "e": (2, 1, 1, 0.5, 1.0)}
    found = {(r.f, r.predicted, r.golden): r.method for r in matched.collect()}
    assert found == {("a", "Heart ", "heart"): "exact", ("a", "hepatic", "cardiac"): "semantic", ("e", "heart", "heart"): "exact"}


def fields(seed, n=14):
    """Rows of three fields whose values meet at few different scores."""
    r = random.Random(seed)
    words = ["a", "A ", "b", "c", "d", "e"]
    side = lambda: [(f"f{k}", i, r.choice(words)) for k in range(3) for i in r.sample(range(99), n)]
    return side(), side(), {w: [1.0, r.choice([0.0, 0.5, 1.0]), r.choice([0.0, 0.5])] for w in words}


@pytest.mark.parametrize(("seed", "large"), [(1, 1 << 16), (2, 1 << 16), (3, 45), (4, 1)])
def test_values_are_matched_as_rows_are(spark, seed, large):
    predicted, golden, v = fields(seed)
    frame = lambda rows: spark.createDataFrame(rows, "f string, seq int, value string")
    vectors = spark.createDataFrame(list(v.items()), "term string, vec array<double>")
    cosine = {(r.a, r.b): r.c for r in spark.createDataFrame([(a, b, v[a], v[b]) for a in v for b in v], "a string, b string, x array<double>, y array<double>").select("a", "b", E.M.cosine(E.F.col("x"), E.F.col("y")).alias("c")).collect()}
    scores, matched = E.field_scores(frame(predicted), frame(golden), vectors, ["f"], least=0.9, large=large)
    want = Counter()
    for f in {x[0] for x in predicted}:
        left, right = ({i: w for g, i, w in side if g == f} for side in (predicted, golden))
        score = lambda a, b: 1.0 if a.strip().lower() == b.strip().lower() else cosine[a, b]
        pairs = [(score(a, b), i, j) for i, a in left.items() for j, b in right.items() if score(a, b) >= 0.9]
        want.update((f, left[i], right[j]) for i, j, _ in E.greedy_pairs(pairs))
    assert Counter((r.f, r.predicted, r.golden) for r in matched.collect()) == want
    assert {r.f: r.tp for r in scores.collect()} == Counter(f for f, _, _ in want.elements())


def test_repeated_rows_match_once_each(spark):
    rows = spark.createDataFrame([("f", 1, "x"), ("f", 1, "x")], "f string, seq int, value string")
    vectors = spark.createDataFrame([("x", [1.0])], "term string, vec array<double>")
    scores, matched = E.field_scores(rows, rows, vectors, ["f"])
    assert [(r.tp, r.p, r.r, r.f1) for r in scores.collect()] == [(2, 1.0, 1.0, 1.0)] and matched.count() == 2


@pytest.mark.parametrize("large", [1 << 16, 9])
def test_fields_of_many_rows_and_few_values(spark, large):
    rows = spark.range(20_000).selectExpr("'f' AS f", "id AS seq", "concat('v', id % 3) AS value")
    vectors = spark.createDataFrame([("v0", [1.0, 0.0]), ("v1", [0.0, 1.0]), ("v2", [1.0, 0.1]), ("w", [0.9, 0.0])], "term string, vec array<double>")
    golden = rows.withColumn("value", E.F.when(E.F.col("value") == "v0", "w").otherwise(E.F.col("value")))
    scores, matched = E.field_scores(rows, golden, vectors, ["f"], large=large)
    assert [(r.n_predicted, r.tp) for r in scores.collect()] == [(20_000, 20_000)]
    assert {(r.predicted, r.golden): r["count"] for r in matched.groupBy("predicted", "golden").count().collect()} == {("v0", "w"): 6667, ("v1", "v1"): 6667, ("v2", "v2"): 6666}

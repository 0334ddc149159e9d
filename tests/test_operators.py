import itertools
import random

import pytest
from pyspark.sql import functions as F

from metaloom.operators import evaluation as E
from metaloom.operators import guards as Q
from metaloom.operators import matching as V
from metaloom.operators import merge as G
from metaloom.operators import ontology as O
from metaloom.operators import paths as P


@pytest.fixture(scope="module")
def graph(spark):
    #      r      s
    #     / \    |
    #    a   b   x
    #     \ / \
    #      c   d
    rows = [("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("d", "b"), ("x", "s")]
    return spark.createDataFrame(rows, "child string, parent string")


def test_closure_is_transitive_and_ends_on_cycles(spark, graph):
    got = {(r.node, r.ancestor): r.hops for r in O.closure(graph).collect()}
    assert got == {("a", "r"): 1, ("b", "r"): 1, ("c", "a"): 1, ("c", "b"): 1, ("d", "b"): 1, ("x", "s"): 1, ("c", "r"): 2, ("d", "r"): 2}
    ring = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1")], "child string, parent string")
    assert O.closure(ring).count() == 6
    assert O.closure(graph.limit(0)).count() == 0


def test_similarities(spark, graph):
    c, n = O.closure(graph), O.nodes_of(graph)
    w = O.own(n, c)
    pairs = spark.createDataFrame([(p, q) for p in "abcdrxs" for q in "abcdrxs"], "a string, b string")
    m = {(r.a, r.b): r for r in O.pair_metrics(pairs, w, O.information_content(n, c), O.depths(n, graph, c)).collect()}
    for (p, q), r in m.items():
        assert 0 <= r.lin <= 1 and r.lin == pytest.approx(m[(q, p)].lin) and r.jaccard == pytest.approx(m[(q, p)].jaccard)
        if p == q:
            assert r.lin == r.jaccard == 1 and r.hops == 0
    assert m[("c", "d")].mica == "b" and m[("c", "d")].hops == 2 and m[("c", "x")].lin == 0 and m[("c", "x")].jc is None
    assert m[("c", "d")].jaccard == pytest.approx(2 / 5)
    lca = {(r.a, r.b): r.lca for r in O.lowest_common(pairs, w).collect()}
    assert lca[("c", "d")] == "b" and lca[("c", "b")] == "b" and ("c", "x") not in lca
    ti = {r.node: r.ti for r in P.topological_information(graph).collect()}
    import math

    assert ti["r"] == 0 and ti["a"] == pytest.approx(math.log(2)) and ti["c"] == pytest.approx(math.log(2) * 2 + math.log(2) + math.log(1))
    d = {(r.a, r.b): r.hops for r in P.fewest(pairs, graph).collect()}
    assert d[("c", "d")] == 2 and d[("c", "x")] is None and d[("a", "a")] == 0


def test_greedy_and_optimal(spark):
    assert E.greedy_pairs([(0.9, 0, 0), (0.8, 0, 1), (0.8, 1, 0)]) == [(0, 0, 0.9)]
    assert E.greedy_pairs([(0.5, 0, 0), (0.5, 1, 1), (0.5, 1, 0)])[0] == (1, 1, 0.5)
    df = spark.createDataFrame([("g", 0, 0, 0.9), ("g", 0, 1, 0.8), ("g", 1, 0, 0.8)], "k string, i long, j long, s double")
    assert {(r.i, r.j) for r in E.one_to_one(df, ["k"], "optimal").collect()} == {(0, 1), (1, 0)}
    assert E.one_to_one(df, ["k"], "greedy").count() == 1


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_best(seed):
    r = random.Random(seed)
    n, m = r.randint(1, 5), r.randint(1, 5)
    w = [[r.choice([0, r.random()]) for _ in range(m)] for _ in range(n)]
    best = max(sum(w[i][p[i]] if n <= m else w[p[i]][i] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
    assert sum(w[i][j] for i, j in E.assignment(w)) == pytest.approx(best)


def test_scores_on_identity(spark):
    d = spark.createDataFrame([(1, 1.0, True), (2, 1.0, True)], "i int, s double, y boolean").withColumn("k", F.lit("k"))
    r = E.prf(d, ["k"], F.col("s"), F.col("y"), F.col("y")).first()
    assert (r.p, r.r, r.f1) == (1, 1, 1)
    wrong = E.prf(d.withColumn("s", F.lit(0.2)), ["k"], F.col("s"), F.col("y"), F.col("y")).first()
    assert (wrong.tp, wrong.fp, wrong.fn) == (0, 2, 2)
    k = E.multi_kappa(d.withColumn("a", F.col("i")).withColumn("b", F.col("i")), "a", "b").first()
    assert k.kappa == 1


def test_compare_levels(spark):
    rows = [("Liver", "Liver", None, None), ("Liver", " liver ", None, None), ("3", "three", None, None), ("3", "4", None, 0.99), ("a", "n/a", None, None), ("T cell", "leukocyte", 1, 0.1), ("big", "large", None, 0.8), ("big", "red", None, 0.6)]
    df = spark.createDataFrame(rows, "g string, p string, h int, c double")
    kind, score = V.compare(F.col("g"), F.col("p"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("h"), F.col("c"))
    got = [(r.k, r.s) for r in df.select(kind.alias("k"), score.alias("s")).collect()]
    assert got == [("EXACT", 1.0), ("NORMALIZED", 0.95), ("NORMALIZED", 0.95), ("NO_MATCH", 0.0), ("MISSING", 0.0), ("HIERARCHICAL", 0.9), ("SEMANTIC", 0.8), ("NO_MATCH", 0.6)]


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_clusters(spark, small, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (3, 3)], "a long, b long")
    got = {r.id: r.cluster for r in V.clusters(spark.range(9), links, small=small).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}


def test_knn_blocks_agree_with_brute_force(spark):
    r = random.Random(0)
    v = {i: [r.gauss(0, 1) for _ in range(5)] for i in range(80)}
    df = spark.createDataFrame(list(v.items()), "id long, vec array<double>")
    got = {(x.q, x.rank): x.id for x in V.knn(df.filter("id < 9"), df, 3, block=17, query_block=4).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in range(9):
        best = sorted((i for i in v if i != q), key=lambda i: (-cos(v[q], v[i]), i))[:3]
        assert [got[(q, k)] for k in (1, 2, 3)] == best


def test_evidence_both_ways(spark):
    words = [f"w{i}" for i in range(40)]
    q = spark.createDataFrame([(1, " ".join(words[3:15])), (2, "W3  w4 W5 w6 w7 w8 w9 w10 w11"), (3, "w1 w2"), (4, "never there at all in any of these texts"), (5, "")], "item_id long, quote string")
    d = spark.createDataFrame([(10, " ".join(words)), (11, "w1 w2x"), (12, None), (13, "")], "doc_id long, text string")
    want = {(1, 10, "verbatim"), (2, 10, "normalized"), (3, 10, "verbatim"), (3, 11, "verbatim"), (4, None, "absent"), (5, None, "absent")}
    for sizes in ({}, {"shard": 10, "block": 40}):
        assert {tuple(r) for r in V.evidence_status(q, d, **sizes).collect()} == want


def test_threshold_pairs_in_blocks(spark):
    r = random.Random(1)
    rows = [(i, i % 2, [r.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(99, 0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, g int, vec array<double>")
    one = {(x.g, x.a, x.b): round(x.cosine, 9) for x in V.threshold_pairs(df, ["g"], 0.5).collect()}
    many = {(x.g, x.a, x.b): round(x.cosine, 9) for x in V.threshold_pairs(df, ["g"], 0.5, block=7).collect()}
    assert one == many and one and all(a < b for _, a, b in one) and 99 not in {a for _, a, _ in one}


def test_embedding_and_tiers(spark):
    t = spark.createDataFrame([("liver",), ("Liver tissue",), ("kidney",)], "term string")
    vecs = {r.term: r.vec for r in V.hashed_ngrams(t).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in vecs.values())
    model = V.embed(t, lambda xs: [[float(len(x))] for x in xs])
    assert {r.term: r.vec for r in model.collect()}["liver"] == [5.0]
    lex = spark.createDataFrame([("liver", "U:1", "exact"), ("Liver tissue", None, "ambiguous"), ("kidney", None, "unresolved")], "term string, node string, status string")
    near = spark.createDataFrame([("Liver tissue", "U:1", 0.9), ("kidney", "U:2", 0.71), ("kidney", "U:3", 0.2)], "term string, node string, similarity double")
    uni = spark.createDataFrame([], "term string, node string")
    got = {r.term: (r.node, r.method) for r in V.normalise(t, lex, near, uni).collect()}
    assert got == {"liver": ("U:1", "exact"), "Liver tissue": (None, "ambiguous"), "kidney": ("U:2", "semantic")}


def test_fill_in_order_of_priority(spark):
    t = spark.createDataFrame([("a", None, None), ("b", "x; y", "sdrf"), ("c", "x", "sdrf")], "run string, v string, v_evidence string")
    s = spark.createDataFrame([("a", "n1"), ("b", "Y"), ("c", "z")], "run string, v string")
    got = {r.run: (r.v, r.v_evidence) for r in G.fill(t, s, ["run"], ["v"], "name").collect()}
    assert got == {"a": ("n1", "name"), "b": ("x; y", "sdrf; name"), "c": ("x", "sdrf; -name")}


def test_conflicts_and_agents(spark):
    d = spark.createDataFrame([("Homo sapiens", "homo", 0.9), ("x", "y", None), (None, "y", None), ("x", None, 0.3), (None, " ", None)], "c string, e string, s double")
    got = [(r.resolved, r.status, r.confidence) for r in G.resolve_conflict(d, "c", "e", "s").collect()]
    assert [g[1] for g in got] == ["AGREE", "DISAGREE", "LLM_ONLY", "RUNASSESSOR_ONLY", "UNKNOWN"] and got[1][0] == "x" and got[1][2] == 0.5


def test_split_and_shards(spark):
    d = spark.range(3000).withColumn("g", (F.col("id") % 300).cast("string"))
    s = G.split_groups(d, "g", {"a": 0.8, "b": 0.2})
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert 0.7 < s.filter("split = 'a'").count() / 3000 < 0.9
    n = G.shards(spark.range(0, 2000, 2).repartition(5), "id", 3)
    assert [r.shard for r in n.orderBy("id").collect()] == [i % 3 for i in range(1000)]


def test_columns_with_equal_headers(spark):
    cells = spark.createDataFrame([("f", 0, c, h, str(c)) for c, h in enumerate(["x", "y", "x"])], "file string, row int, col int, header string, cell string")
    assert {(r.col, r.occ) for r in G.align_columns(cells, "file", "row", "col", "header").collect()} == {(0, 0), (1, 0), (2, 1)}


def test_guards(spark):
    L = F.lit
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(Q.format_error(F.array(L("v")))) == "no_evidence" and one(Q.format_error(F.array(L("v"), L("e")))) is None
    assert one(Q.evidence_score(L("liver"), L("human liver"), L("We took human  liver tissue."))) == 1.0
    assert one(Q.evidence_score(L("unknown"), L(""), L("x"))) == 1.0 and one(Q.evidence_score(L("a"), L("zz"), L("x"))) == 0.2
    assert one(Q.numeric_mismatch(L("10 mg"), L("we used 10.0 mg"))) is False and one(Q.numeric_mismatch(L("11"), L("10"))) is True
    assert one(Q.negated(L("trypsin"), L("Digested without any added trypsin."))) is True and one(Q.negated(L("trypsin"), L("Digested with trypsin, not LysC"))) is False
    assert one(Q.degenerate(L("ab " * 20))) is False and one(Q.degenerate(L("ab " * 200))) is True and one(Q.degenerate(L("A fair answer."))) is False
    assert one(Q.degenerate(F.lit(None).cast("string"))) is False
    assert one(Q.next_temperature(L(0.45))) == 0.5
    d = spark.createDataFrame([(1, "x" * 30 + "\nshort\n" + "X" * 30 + "\nshort"), (2, None)], "id int, t string")
    got = {r.id: (r.text, r.dropped) for r in Q.without_repeated_lines(d, "id", "t", 20).collect()}
    assert got == {1: ("x" * 30 + "\nshort\nshort", 1), 2: ("", 0)}


def test_verdicts_keep_accessions(spark):
    cells = spark.createDataFrame([("P", "f", 0, 0, "NT=Ox;AC=A:1"), ("P", "f", 1, 0, "bad"), ("P", "f", 2, 0, "ok")], "pxd string, field string, row_idx int, col_idx int, cell string")
    v = spark.createDataFrame([("P", "f", "nt=ox", "replace", "ox"), ("P", "f", "bad", "remove", None)], "pxd string, field string, unit string, verdict string, corrected string")
    assert {r.row_idx: r.fixed for r in Q.apply_verdicts(cells, v).collect()} == {0: "NT=ox;AC=A:1", 1: "not available", 2: "ok"}


def test_assignment_equals_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (5, 5), (4, 1)):
        for _ in range(8):
            w = np.where(r.random((n, m)) < 0.3, 0, r.integers(1, 60, (n, m))).astype(float)
            got = E.assignment(w.tolist())
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(w[i, j] > 0 for i, j in got)
            k = min(n, m)
            best = max(sum(w[i, j] for i, j in zip(a, b, strict=True)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
            assert sum(w[i, j] for i, j in got) == pytest.approx(best)


def test_tiers_come_before_scores(spark):
    rows = [("k", 0, 0, 0.9, 1), ("k", 0, 1, 0.1, 3), ("k", 1, 0, 0.1, 3), ("k", 1, 1, 0.9, 1)]
    df = spark.createDataFrame(rows, "k string, i int, j int, s double, rank int")
    assert {(r.i, r.j) for r in E.one_to_one(df, ["k"], "optimal").collect()} == {(0, 1), (1, 0)}


def test_tails(spark):
    d = spark.createDataFrame([(3.841459, 1.0, 1.959964), (5.991465, 2.0, 0.0), (0.5, 4.0, -2.575829), (30.0, 10.0, None)], "x double, k double, z double")
    got = d.select(E.chi_square_tail("x", "k").alias("p"), E.two_sided("z").alias("q")).collect()
    assert [r.p for r in got] == pytest.approx([0.05, 0.05, 0.973501, 0.000857], abs=1e-5)
    assert [r.q for r in got[:3]] == pytest.approx([0.05, 1.0, 0.01], abs=1e-6) and got[3].q is None


def test_closure_raises_beyond_its_levels(spark):
    from metaloom.operators import ontology as O

    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "child long, parent long")
    assert O.closure(chain, most=8).count() == 21
    with pytest.raises(RuntimeError):
        O.closure(chain, most=3)


def test_clusters_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(120)], "a long, b long").repartition(16)
    got = {r.id: r.cluster for r in V.clusters(spark.range(122), links, small=0).collect()}
    assert all(got[i] == 0 for i in range(121)) and got[121] == 121


def test_short_quotes_without_an_automaton(spark):
    q = spark.createDataFrame([(1, "cat"), (2, "og bar"), (3, "zebra"), (4, "red car"), (5, "x")], "item_id long, quote string")
    d = spark.createDataFrame([(1, "A concatenated dog barks"), (2, "The red  CAR"), (3, "")], "doc_id long, text string")
    want = {tuple(r) for r in V.evidence_status(q, d).collect()}
    assert {tuple(r) for r in V.evidence_status(q, d, shard=8, block=16).collect()} == want and (1, 1, "verbatim") in want and (4, 2, "normalized") in want

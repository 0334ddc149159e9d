import numpy as np
import pytest

from metaloom.operators import vector_index as X


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 24)) * 3
    m = centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, m[5].tolist())]
    return spark.createDataFrame(rows, "id long, vec array<double>"), np.vstack([m, m[5]]), [*range(3000), 9004]


def brute(m, ids, queries, k):
    u = m / np.sqrt((m**2).sum(1, keepdims=True))
    s = u @ u.T
    out = {}
    for q in queries:
        i = ids.index(q)
        rows = sorted(((-round(float(s[i, j]), 12), ids[j]) for j in range(len(ids)) if j != i))[:k]
        out[q] = [x for _, x in rows]
    return out


def test_exact_when_all_cells_are_probed_and_recall_when_few_are(spark, clustered, tmp_path, monkeypatch):
    df, m, ids = clustered
    monkeypatch.setattr(X, "PART_ROWS", 40)
    monkeypatch.setattr(X, "QUERY_ROWS", 70)
    index = X.opened(df, str(tmp_path), "made", cells=30)
    assert index.built and index.n == 3001 and 1 <= index.probes < len(index.centroids) and index.recall >= 0.95 and max(index.parts) > 1
    want = brute(m, ids, range(0, 3000, 20), 10)
    queries = df.filter("id % 20 = 0")

    def found(**kw):
        out = {}
        for r in X.search(index, queries, 10, **kw).collect():
            out.setdefault(r.q, []).append((r["rank"], r.id))
        return {q: [i for _, i in sorted(v)] for q, v in out.items()}

    assert found(probes=len(index.centroids)) == want
    few = found()
    assert np.mean([len(set(few.get(q, [])) & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_a_query_meets_a_bundle_of_cells_once(spark, clustered, tmp_path, monkeypatch):
    df, m, ids = clustered
    index = X.opened(df, str(tmp_path), "bundles", cells=60)
    queries = df.filter("id % 20 = 0")
    for rows, most in ((1 << 14, 1), (700, 6)):
        monkeypatch.setattr(X, "BUNDLE_ROWS", rows)
        units = X._bundles(dict(index.table("codes").groupBy("cell").count().collect()), index.parts)
        assert units[-1][2] < most
        for probes in (60, 20):
            asked = X._asked(X._unit(queries), index.centroids, probes, units)
            assert asked.count() <= 150 * most  # as many rows as queries and cells probed before: 9,000 and 3,000
    found = {}
    for r in X.search(index, queries, 10, probes=60).collect():
        found.setdefault(r.q, []).append((r["rank"], r.id))
    assert {q: [i for _, i in sorted(v)] for q, v in found.items()} == brute(m, ids, range(0, 3000, 20), 10)


def test_an_unchanged_table_is_not_built_again(spark, clustered, tmp_path, monkeypatch):
    df, _, _ = clustered
    first = X.opened(df, str(tmp_path), "a", cells=5)
    monkeypatch.setattr(X, "build", None)
    again = X.opened(df.repartition(7), str(tmp_path), "a", cells=5)
    assert first.built and not again.built and again.path == first.path and (again.centroids == first.centroids).all()
    for changed, model in ((df.filter("id <> 3"), "a"), (df, "b")):
        with pytest.raises(TypeError):  # it would be built
            X.opened(changed, str(tmp_path), model, cells=5)


def test_probing_reads_only_the_probed_cells(spark, clustered, tmp_path):
    df, _, _ = clustered
    index = X.opened(df, str(tmp_path), "c", cells=8)
    plan = X.search(index, df.filter("id = 20"), 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vec array<double>")
    index = X.opened(none, str(tmp_path))
    assert index.n == 0 and X.search(index, none, 3).collect() == []

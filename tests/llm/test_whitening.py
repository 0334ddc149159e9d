import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(vectors):
    """Whitening by a direct eigendecomposition of the integer vectors."""
    x = np.floor(np.array(vectors) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    d = x - s / n
    e, axes = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-e)
    deviation = [int(sum((n * int(a) - int(t)) ** 2 for a, t in zip(r, s, strict=True))) for r in x]
    return n, deviation, d @ axes[:, order], e[order]


def test_equals_a_direct_solution_whatever_the_partitions(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(700, 40)) @ r.normal(size=(40, 40)) + 1000.0
    n, deviation, projected, e = plain(v)
    found = {}
    for parts in (1, 7):
        df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]).repartition(parts)
        model = whitening.fit(df)
        rows = whitening.whiten(df, model).collect()
        assert len(rows) == 700 * 32
        w = np.zeros((700, 32))
        for q in rows:
            w[q.vec_id, q.component - 1] = q.whitened
            assert q.n == n and q.deviation == deviation[q.vec_id] and q.identity_error < 1e-9
            assert q.explained == pytest.approx(e[q.component - 1] / e.sum(), rel=1e-9)
        want = projected[:, :32] / np.sqrt(e[:32])
        sign = np.sign((w * want).sum(0))
        assert np.abs(w * sign - want).max() < 1e-7
        assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9
        found[parts] = w
    assert np.abs(found[1] - found[7]).max() < 1e-7


def test_merging_is_the_same_in_any_grouping():
    r = np.random.default_rng(1)
    x = r.integers(10**6, 10**6 + 900, (90, 6))
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(x[i : i + k]) for i, k in ((0, 1), (1, 40), (41, 2), (43, 47))]
    left = parts[0]
    for p in parts[1:]:
        left = whitening.merged(left, p)
    right = whitening.merged(whitening.merged(parts[0], parts[1]), whitening.merged(parts[2], parts[3]))
    for m in (left, right):
        assert m.n == 90 and m.sums == whole.sums == x.sum(0).tolist()
        assert np.allclose(m.mean, whole.mean, rtol=1e-14) and np.allclose(m.scatter, whole.scatter, rtol=1e-10)


def test_odd_vectors(spark):
    r = np.random.default_rng(2)
    good = [(i, r.normal(size=3).tolist()) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, []), (105, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (7, good[7][1])]
    df = frame(spark, good + odd).withColumns({c: F.lit("clash") for c in ("id", "v", "n", "whitened", "component", "m")})
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).collect()
    assert model.n == 52 and len(rows) == 52 * 3 and {q.vec_id for q in rows} == {None, *range(50)}
    assert sum(q.vec_id == 7 for q in rows) == 6
    want = plain([v for _, v in good] + [[1.0, 2.0, 3.0], good[7][1]])
    assert sorted(q.deviation for q in rows if q.component == 1) == sorted(want[1])


def test_components_without_variance_are_null(spark):
    df = frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).collect()
    assert {q.component for q in rows if q.whitened is None} == {2, 3} and model.identity_error < 1e-9
    assert all(q.explained == pytest.approx(1.0) for q in rows if q.component == 1)
    one = frame(spark, [(1, [1.0, 2.0])])
    assert all(q.whitened is None and q.deviation == 0 and q.explained == 0 for q in whitening.whiten(one, whitening.fit(one)).collect())


def test_deviations_beyond_a_long_raise_and_large_ones_are_exact(spark):
    v = [[2.0**20 * i] for i in range(8)]
    df = frame(spark, list(enumerate(v)))
    assert sorted(q.deviation for q in whitening.whiten(df, whitening.fit(df)).collect()) == sorted(plain(v)[1])
    far = frame(spark, [(0, [0.0]), (1, [2.0**40])])
    with pytest.raises(Exception, match="64-bit"):
        whitening.whiten(far, whitening.fit(far)).collect()


def test_empty(spark):
    df = frame(spark, [])
    assert whitening.fit(df) is None and whitening.whiten(df, None).collect() == []

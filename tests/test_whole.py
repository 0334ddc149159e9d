"""Queries against independent computations over whole tables."""

import math
import os

import duckdb
import numpy as np
import pytest
from test_oracle import TABLES, canonical

from metaloom.plans import registry


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """360 vectors of four components, in the shape of the embeddings table."""
    rows = [(i, [float(np.float32(math.sin((i + 1) * (k + 1) * 1.7))) for k in range(4)], i % 3) for i in range(360)]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, {i: v for i, v, _ in rows}


def cosine(a, b):
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))))


def test_max_sim_sets_reads_every_vector(spark, vectors):
    path, v = vectors
    want = {k: max(cosine(v[a], v[b]) for a in range(k, 360, 3) for b in range(k, 360, 3) if a % 2 == 0 and b % 2) for k in range(3)}
    got = {r.label: r.best for r in registry.QUERIES["max_sim_sets"](spark, path).collect()}
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("name", ["greedy_match", "optimal_match"])
def test_matches_reach_every_group(spark, vectors, name):
    path, v = vectors
    got = registry.QUERIES[name](spark, path).collect()
    assert {r.g for r in got} == set(range(30))
    for r in got:
        assert r.i // 12 == r.j // 12 == r.g and r.s == pytest.approx(cosine(v[r.i], v[r.j]), abs=2e-6)
    if name == "greedy_match":
        want = set()
        for g in range(30):
            ids = range(12 * g, 12 * g + 12)
            left = sorted((-round(cosine(v[i], v[j]), 6), i, j) for i in ids for j in ids if i % 2 == 0 and j % 2)
            while left and left[0][0] < 0:
                _, i, j = left[0]
                want.add((i, j))
                left = [x for x in left if x[1] != i and x[2] != j]
        assert {(r.i, r.j) for r in got if r.s > 0} == want


WHOLE = ("fraction_groups", "sample_counts", "run_keys", "rank_spearman", "provenance_first_wins", "unanimity", "max_sim_sets", "group_split")


@pytest.mark.parametrize("name", WHOLE)
def test_equals_sql_over_whole_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert canonical(registry.QUERIES[name](spark, sf).toPandas()) == canonical(con.execute(registry.ORACLES[name]).df())

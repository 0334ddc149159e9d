import os

import duckdb
import pytest

from metaloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df):
    def cell(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return "∅" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", registry.ORACLES)
def test_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, duck, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())

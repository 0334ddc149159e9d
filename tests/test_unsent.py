import pytest

from metaloom.operators import ontology as O
from metaloom.operators import paths as P


@pytest.mark.parametrize("run", [lambda e, p: O.closure(e), lambda e, p: P.cheapest(p, e), lambda e, p: P.fewest(p, e), lambda e, p: P.topological_order(e)], ids=["closure", "cheapest", "fewest", "order"])
def test_graphs_are_not_gathered_by_the_driver(spark, monkeypatch, tmp_path, run):
    """Tables of a graph grow with it, and their estimated sizes don't: none is sent to all tasks."""
    path = str(tmp_path / "edges")
    spark.range(1, 60).selectExpr("id AS child", "id div 2 AS parent", "1.0D AS weight").write.parquet(path)
    e, plans = spark.read.parquet(path), []
    for module in (O, P):
        real = module.kept
        monkeypatch.setattr(module, "kept", lambda df, real=real: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    found = run(e, e.selectExpr("child AS a", "child + 1 AS b"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)

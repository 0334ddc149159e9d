from metaloom.operators import judge_run as J

CELLS = [
    ("p1", "tissue", 0, 0, "Liver"), ("p1", "tissue", 1, 0, "liver"), ("p1", "tissue", 2, 0, "Mars"), ("p1", "sex", 0, 1, "male"), ("p1", "sex", 1, 1, "not available"), ("p1", "sex", 2, 1, "f"),
    ("p2", "tissue", 0, 0, "heart"), ("p2", "sex", 0, 1, "x"), ("p3", "tissue", 0, 0, "lung"), ("p4", "tissue", 0, 0, "not available"),
]
PAPERS = [("p1", "text"), ("p2", "text"), ("p3", " "), ("p4", "text"), ("p5", "text")]
ANSWERS = [
    ("p1", "tissue", "liver", "high", False, False, True, True, None), ("p1", "tissue", "mars", "low", True, False, False, False, None), ("p1", "sex", "male", "medium", False, False, True, False, None),
    ("p1", "sex", "f", "medium", False, False, False, True, "female"), ("p2", "tissue", "heart", "low", False, True, False, False, None),
]
ANSWER = "pxd string, field string, unit string, verdict string, hallucinated boolean, mismatch boolean, value_correct boolean, value_complete boolean, corrected string"


def test_one_run_gives_all_tables(spark, tmp_path):
    cells = spark.createDataFrame(CELLS, "pxd string, field string, row_idx int, col_idx int, cell string")
    papers, answers = spark.createDataFrame(PAPERS, "pxd string, text string"), spark.createDataFrame(ANSWERS, ANSWER)
    tables, counters = J.run(cells, papers, answers, ["tissue", "sex", "age"])
    J.written(tables, str(tmp_path))
    read = {n: spark.read.parquet(f"{tmp_path}/{n}").collect() for n in J.TABLES}
    assert {(r.pxd, r.reason) for r in read["skipped"]} == {("p3", "no manuscript"), ("p4", "empty sdrf"), ("p5", "empty sdrf")}
    assert {(r.pxd, r.unit): r.match_type for r in read["review"]} == {("p1", "liver"): "CORRECT", ("p1", "mars"): "HALLUCINATED", ("p1", "male"): "PARTIAL", ("p1", "f"): "PARTIAL", ("p2", "heart"): "TYPE_MISMATCH", ("p2", "x"): "ERROR"}
    per = {r.pxd: r for r in read["per_paper"]}
    assert (per["p1"].total, per["p1"].correct, per["p1"].hallucinated, per["p1"].wrong, per["p1"].incomplete, per["p1"].corrected, per["p1"].runs, per["p1"].columns) == (4, 1, 1, 1, 1, 1, 3, 2)
    assert per["p1"].accuracy == 0.25 and per["p2"].accuracy == 0.0 and per["p2"].error == 1
    assert [(r.field, r.total) for r in sorted(read["per_field"], key=lambda r: r.place)] == [("tissue", 3), ("sex", 3), ("age", 0)]
    fixed = {(r.pxd, r.field, r.row_idx): r.fixed for r in read["filtered"]}
    assert fixed[("p1", "tissue", 2)] == "not available" and fixed[("p1", "sex", 2)] == "female" and fixed[("p1", "sex", 0)] == "male" and fixed[("p2", "sex", 0)] == "x" and fixed[("p2", "tissue", 0)] == "not available"
    assert {r.pxd: (r.kept, r.replaced, r.removed) for r in read["filter_summary"]} == {"p1": (3, 1, 1), "p2": (1, 0, 1)}
    assert {(r.pxd, r.field): (r.known, r.cells) for r in read["coverage"]}[("p1", "sex")] == (2, 3)
    assert counters == {k: sum(r[k] for r in read["per_paper"]) for k in J.COUNTS} | {"cells": 7}


def test_empty(spark):
    tables, counters = J.run(spark.createDataFrame([], "pxd string, field string, row_idx int, col_idx int, cell string"), spark.createDataFrame([], "pxd string, text string"), spark.createDataFrame([], ANSWER), ["a"])
    assert tables["review"].count() == 0 and [tuple(r) for r in tables["per_field"].collect()] == [(0, "a", *[0] * len(J.COUNTS), None)] and set(counters.values()) <= {0}

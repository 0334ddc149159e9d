import pytest
from pyspark.sql import functions as F

from metaloom.operators import records as P


@pytest.fixture(scope="module")
def shapes(spark):
    rows = {
        '{"name":"a","value":"b"}': ["a"], '[{"value":"x"},{"ontology_name":"y","name":"z"},{"value":null}]': ["x", "y"], '["p","q","p","unknown"]': ["p", "q"], "a; b ;;a": ["a", "b"],
        '[["v","e"],"w"]': ["v", "e", "w"], "{not json": ["{not json"], "[1, 2.5, true, null]": ["1", "2.5", "true"], "": [], '"quoted"': ['"quoted"'], "12": ["12"], '{"n":{"name":"deep"}}': [], "[]": [],
    }
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "cell string")
    return rows | {None: None}, {r.cell: r.t for r in df.select("cell", P.terms_of(F.col("cell")).alias("t")).collect()}


def test_terms_of_any_shape(shapes):
    want, got = shapes
    assert got == want


def test_hashed_ngrams_are_counted_in_place(spark):
    """No row for each gram, no shuffle but that of the distinct texts, and the counts of a text's grams over their norm."""
    from metaloom.operators import matching as V

    texts = spark.createDataFrame([("Abc  abc",), ("",), ("x",), (None,), ("ünï 7",), ("Abc  abc",)], "term string").repartition(3)
    vectors = V.hashed_ngrams(texts, 16)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") <= 1
    want = {}
    for term, grams in {"Abc  abc": [" ab", "abc", "bc ", "c a", " ab", "abc", "bc "], "": ["  "], "x": [" x "], "ünï 7": [" ün", "ünï", "nï ", "ï 7", " 7 "]}.items():
        slots = [r.s for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.expr("pmod(xxhash64(g), 16)").alias("s")).collect()]
        norm = sum(slots.count(s) ** 2 for s in set(slots)) ** 0.5
        want[term] = [slots.count(s) / norm for s in range(16)]
    assert {r.term: r.vec for r in vectors.collect()} == want


def test_vectors_of_terms_are_not_stored(spark, monkeypatch):
    """Many terms and few names: only the names' vectors are kept, each text is embedded once, and the likest name is found."""
    from metaloom.operators import matching as V
    from metaloom.operators import terms as T

    kept, embedded, real = [], [], T.kept
    monkeypatch.setattr(T, "kept", lambda df: kept.append(out := real(df)) or out)
    monkeypatch.setattr(T, "EMBEDDED", 7)
    names = spark.createDataFrame([("A:1", "alpha bravo"), ("A:2", "charlie delta")], "node string, name string")
    terms = spark.createDataFrame([(f"{w} {i}",) for w in ("alpha bravo", "charlie delta") for i in range(40)] + [("alpha bravo",), (None,)], "term string")
    found = T.neighbours(terms, names, lambda df: embedded.append(df) or V.hashed_ngrams(df)).collect()
    assert {r.term: r.node for r in found} == {f"{w} {i}": n for w, n in (("alpha bravo", "A:1"), ("charlie delta", "A:2")) for i in range(40)} | {"alpha bravo": "A:1"}
    assert [df.count() for df in kept if "vec" in df.columns] == [2]
    texts = [r.term for df in embedded for r in df.collect()]
    assert len(texts) == len(set(texts)) == 82

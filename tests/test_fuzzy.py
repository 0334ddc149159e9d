import itertools
import random

import pytest

from metaloom.functions.text import similarity
from metaloom.operators import fuzzy


def names(seed, n):
    r = random.Random(seed)
    fixed = random.Random(99)
    stems = ["".join(fixed.choices("abcdeinorst", k=fixed.randrange(1, 9))) for _ in range(60)]
    out = set()
    while len(out) < n:
        s = " ".join(r.choices(stems, k=r.randrange(1, 4)))
        for _ in range(r.randrange(3)):
            i = r.randrange(len(s) + 1)
            s = s[:i] + r.choice(["", "x", "e"]) + s[i + r.randrange(2) :]
        if s.strip():
            out.add(s.strip())
    return sorted(out)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_all_pairs_that_reach_the_ratio(spark, least):
    a, b = names(1, 300), names(2, 300) + ["n" * 250 + "abc", "n" * 240 + "abd"]
    a += ["n" * 250 + "abd"]
    got = {(r.a, r.b): r.ratio for r in fuzzy.matches(frame(spark, a), frame(spark, b), "name", least).collect()}
    want = {(x, y): s for x, y in itertools.product(a, b) if (s := similarity(x, y)) >= least}
    assert got == want and len(want) > 10


def test_five_thousand_names(spark):
    a = names(3, 5000)
    df = frame(spark, a)
    pairs = fuzzy.matches(df, df, "name", 0.9)
    assert "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b) for r in pairs.collect()}
    r = random.Random(1)
    for x in r.sample(a, 40):
        assert {y for q, y in got if q == x} == {y for y in a if similarity(x, y) >= 0.9}


def test_abbreviations_blanks_and_case(spark):
    left = ["H. sapiens", " Homo sapiens ", "p. falciparum 3d7", None, "", "x", "Danio rerio"]
    right = ["HOMO  sapiens", "homo sapiens", "Plasmodium falciparum 3D7", "Pan paniscus", "", None, "d. rerio", "X"]
    got = {(r.a, r.b): r.ratio for r in fuzzy.matches(frame(spark, left), frame(spark, right), "name", 0.85).collect()}
    assert got[("h. sapiens", "homo sapiens")] == 0.95 and got[("p. falciparum 3d7", "plasmodium falciparum 3d7")] == 0.95 and got[("danio rerio", "d. rerio")] == 0.95 and got[("x", "x")] == 1.0
    assert set(got) == {(x, y) for x, y in itertools.product({s.strip().lower() for s in left if s}, {s.strip().lower() for s in right if s}) if similarity(x, y) >= 0.85}
    assert {(r.a, r.b) for r in fuzzy.best(frame(spark, ["homo sapien"]), frame(spark, right), "name", 0.85).collect()} == {("homo sapien", "homo sapiens")}
    assert fuzzy.matches(frame(spark, []), frame(spark, right), "name", 0.85).collect() == []

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from metaloom.llm import mixing, sharding


def brute_targets(sizes: dict, weights, share, cap):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]}
        if not over:
            target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 900, None: 10}, {"x": 5}, {"a": 1, "b": 1, "c": 1000, "d": 3, "Z": 77}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2).collect()}
    assert got == pytest.approx(brute_targets(sizes, (3, 1, 2), 1.5, 2))


def test_mix(spark, odd, prose):
    more = spark.createDataFrame([(100 + i, prose(i, 10 + i % 7), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").unionAll(more)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sum(r["size"] for r in rs)}
        assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rs)
        assert all(0 <= r.taken <= 2 * r["size"] for r in rs)
        # the smallest document bounds the miss, or, in a source that is mostly one document, that document
        sizes = sorted(r["size"] for r in rs if r["size"]) or [1]
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= (sizes[0] if sizes[-1] < sum(sizes[:-1]) else sizes[-1])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).collect() == []


def brute_dual(masses, targets, cap, ridge):
    """Multipliers by source and the tilt by plain coordinate descent on the dual; masses: {source: [(mass, x)]}."""

    def solve(f, lo, hi):
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return (lo + hi) / 2

    def rate(m, t, x):
        return cap / (1 + math.exp(-max(-700, min(700, m + t * x))))

    def at(t):
        return {s: solve(lambda m: sum(w * rate(m, t, x) for w, x in c) - targets[s], -40, 40) for s, c in masses.items()}

    def slope(t):
        ms = at(t)
        return sum(w * x * rate(ms[s], t, x) for s, c in masses.items() for w, x in c) + ridge * t

    t = solve(slope, -20, 20)
    return at(t), t


def test_balance_equals_a_plain_solver(spark):
    r = random.Random(5)
    masses = {s: [(r.randrange(50, 900), r.gauss(s - 2, 1)) for _ in range(30)] for s in range(1, 5)}
    shares = {1: 1.7, 2: 0.3, 3: 1.1, 4: 2.0}
    targets = {s: shares[s] * sum(w for w, _ in c) for s, c in masses.items()}
    classes = spark.createDataFrame([(s, float(w), x) for s, c in masses.items() for w, x in c], "sid long, mass double, x double")
    sums = spark.createDataFrame([(s, float(sum(w for w, _ in c)), targets[s]) for s, c in masses.items()], "sid long, mass double, target double")
    ridge = 0.25 * sum(w for c in masses.values() for w, _ in c)
    m, tilt = mixing.balance(classes, sums, 2, ridge)
    want, t = brute_dual(masses, targets, 2, ridge)
    assert tilt == pytest.approx(t, abs=1e-4) and abs(tilt) > 0.05
    got = {x.sid: x.m for x in m.collect()}
    for s, c in masses.items():
        assert sum(w * 2 / (1 + math.exp(-(got[s] + tilt * x))) for w, x in c) == pytest.approx(targets[s], rel=1e-4)
        assert s == 4 or got[s] == pytest.approx(want[s], abs=1e-3)


def test_a_balance_that_is_not_met_raises(spark):
    classes = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, -1.0)], "sid long, mass double, x double")
    sums = spark.createDataFrame([(1, 30.0, 21.0)], "sid long, mass double, target double")
    with pytest.raises(RuntimeError, match="balance"):
        mixing.balance(classes, sums, 2, 5.0, most_steps=1)
    mixing.balance(classes, sums, 2, 5.0)


def test_steep_balances_are_met(spark):
    """Sources nearly full or nearly empty, and sizes far apart."""
    c = [(s, float(10.0 ** (k % 7)), (k - 10) / 2) for s in range(1, 7) for k in range(20)]
    share = {1: 1.9999999, 2: 1e-6, 3: 2.0, 4: 1.0, 5: 0.001, 6: 1.5}
    mass = {s: sum(w for t, w, _ in c if t == s) for s in share}
    sums = spark.createDataFrame([(s, mass[s], share[s] * mass[s]) for s in share], "sid long, mass double, target double")
    m, tilt = mixing.balance(spark.createDataFrame(c, "sid long, mass double, x double"), sums, 2, 0.25 * sum(mass.values()))
    got = {x.sid: x.m for x in m.collect()}
    for s in share:
        assert sum(w * 2 / (1 + math.exp(-max(-700, min(700, got[s] + tilt * x)))) for t, w, x in c if t == s) == pytest.approx(share[s] * mass[s], abs=1e-4 * sum(mass.values()))


def test_rates_differ_within_a_source_and_keep_lengths(spark, prose):
    rows = [(i, prose(i, 8 + i % 5 if i % 3 else 150 + i % 40), "abc"[i % 3]) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(set)
    for r in got:
        by[r.source].add(round(r.rate, 6))
    assert max(map(len, by.values())) > 3

    def mean(of):
        return sum(of(r) * math.log(r["size"]) for r in got) / sum(map(of, got))

    def plain(r):
        return r["size"] * r.target / r.source_size

    assert abs(mean(lambda r: r["size"] * r.rate) - mean(lambda r: r["size"])) < abs(mean(plain) - mean(lambda r: r["size"]))


def test_repeated_gives_rows_as_often_as_taken(spark, odd):
    same = spark.createDataFrame([(None, "a b c d", "z", "q")] * 3 + [(7, f"w{i} x", "z", "q") for i in range(6)], "doc_id long, text string, source string, copies string")
    n = Counter((r.doc_id, r["size"]) for r in mixing.mix(same).collect() for _ in range(r.copies))
    out = mixing.repeated(same)
    assert out.columns == same.columns and out.schema.simpleString() == same.schema.simpleString()
    assert Counter((r.doc_id, len(r.text.split())) for r in out.collect()) == n
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(odd.limit(0)).collect() == []


def test_one_long_text_among_short_ones(spark):
    rows = [(0, "w " * 15_000, "s")] + [(i, "w " * (3 + i % 9), "s") for i in range(1, 4000)] + [(5000, "v " * 3000, "t")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    s = [r for r in got if r.source == "s"]
    assert abs(sum(r.taken for r in s) - s[0].target) <= 3


def test_shards(spark, odd):
    rows = sharding.shard(odd.drop("source"), [1.0] * 24).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(odd.limit(0), [1.0] * 3).collect() == []


def test_weights_share_and_growth_moves_little(spark):
    df = spark.range(30_000).withColumnRenamed("id", "k")
    n = df.select(sharding.rendezvous(F.col("k"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] for r in n}
    assert set(n) == {0, 1} and abs(n[0] / 30_000 - 0.25) < 0.02
    moved = df.select((sharding.rendezvous(F.col("k"), [1.0] * 9) != sharding.rendezvous(F.col("k"), [1.0] * 10)).cast("int").alias("m")).agg(F.avg("m")).first()[0]
    assert abs(moved - 0.1) < 0.02


def brute_shard(key, weights):
    """By the law alone: the greatest -weight / ln(u), u from the hash of the key's text and the shard."""
    if key is None:
        first = 42
    else:
        first = xxhash.xxh64(str(key).encode(), seed=42).intdigest()
    best = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64(struct.pack("<i", s), seed=first).intdigest()
        best.append((-w / math.log(((h >> 12) + 0.5) / 2**52), s))
    return max(best)[1]


def test_shards_equal_brute_force_for_any_type_of_key(spark):
    weights = [1.0, 2.5, 0.5, 1.0]
    keys = [*range(-5, 200), None]
    for kind in ("int", "long", "string"):
        df = spark.createDataFrame([(None if k is None else str(k) if kind == "string" else k, "t") for k in keys], f"doc_id {kind}, text string")
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(df, weights).collect()}
        assert {None if k is None else int(k): v for k, v in got.items()} == {k: (brute_shard(k, weights), brute_shard(k, [*weights, 1.25])) for k in keys}


def test_bad_weights():
    with pytest.raises(ValueError):
        sharding.rendezvous(None, [])

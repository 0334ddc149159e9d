import random

from metaloom.operators import phrases


def test_shards_and_blocks_find_what_one_automaton_finds(spark):
    r = random.Random(6)
    text = lambda n: "".join(r.choices("abc ", k=n))
    texts = [(i, t := text(r.randrange(0, 80)), t.upper() if i % 3 == 0 else t) for i in range(120)] + [(500, None, None), (None, "abc abc", "abc abc")]
    keys = [text(r.randrange(1, 5)) for _ in range(150)] + ["abc abc", ""]
    wanted = [(i, k, k) for i, k in enumerate(keys)] + [(900, None, None), (901, keys[0], keys[0].upper())]
    want = sorted(((i, d, w in t) for i, k, w in wanted if k for d, tk, t in texts if tk and k in tk), key=str)
    p = spark.createDataFrame(wanted, "id long, key string, written string")
    t = spark.createDataFrame(texts, "doc long, key string, text string")
    for sizes in ({}, {"shard": 40, "block": 300}, {"shard": 1 << 20, "block": 100}):
        assert sorted((tuple(x) for x in phrases.found(p, t, **sizes).collect()), key=str) == want
    assert phrases.found(p.limit(0), t).collect() == [] and phrases.found(p, t.limit(0)).collect() == []

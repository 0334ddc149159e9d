import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from metaloom.llm import suffix_dedup


def brute(texts, length):
    """(bytes, kept, starts, lengths) of each text, every string counted."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
        kept = bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g)
        out.append((len(r), kept, edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))
    return out


def texts_with_repeats(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé☃ .", k=r.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(k) for k in (12, 15, 20, 40, 90)]
    out = []
    for i in range(n):
        parts = [prose(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(shared)
            a = r.randrange(0, 30)
            parts += [p[a:] if r.random() < 0.5 else p, prose(r.randrange(0, 6))]
        out.append("".join(parts))
    out += [out[3], out[3], out[5] + "x", "y" + out[5], "", None, "ab" * 200, "a" * 300, ("line of this kind\n" * 20) + prose(3), "short"]
    return out


def got(spark, texts, parts=3, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = sorted(suffix_dedup.dedup(df, **kw).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return [(r.n_bytes, bytes(r.kept), r.cut_starts, r.cut_lengths) for r in rows]


@pytest.mark.parametrize(("seed", "length"), [(1, 64), (2, 101), (3, 400)])
def test_equals_counting_every_string(spark, seed, length):
    texts = texts_with_repeats(seed)
    assert got(spark, texts, length=length) == brute(texts, length)


@pytest.mark.parametrize(("hot", "widths"), [(1, (16, 4, 1)), (3, (48, 6, 1)), (2, (5,))])
def test_hot_anchors_are_split_without_loss(spark, hot, widths):
    texts = texts_with_repeats(7)
    assert got(spark, texts, length=80, hot=hot, widths=widths) == brute(texts, 80)


def test_a_passage_in_every_text_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 5)
    r = random.Random(3)
    passage = "".join(r.choices("abcdefgh ", k=700))
    texts = ["".join(r.choices("ijklmnop ", k=r.randrange(0, 300))) + passage + "".join(r.choices("qrstuv ", k=200)) for _ in range(80)]
    assert got(spark, texts, length=100, hot=20) == brute(texts, 100)


def test_long_texts_in_chunks_and_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 300)
    r = random.Random(8)
    p = "".join(r.choices("abcdef", k=2500))
    texts = [p, "zz" + p[300:1700] + "yy", p[1000:1200] * 3, "".join(r.choices("abcdef", k=900))]
    assert got(spark, texts, parts=1, length=64) == brute(texts, 64)


def test_suffixes_are_sorted_as_bytes_are():
    r = random.Random(5)
    for length in (64, 77, 200):
        base = bytes(r.choices(b"ab\x00\xff", k=300))
        data = base + base[20:] + bytes(r.choices(b"ab", k=200)) + base[:250] + b"a" * 400
        n = len(data) - length + 1
        groups = np.sort(np.array([r.randrange(3) for _ in range(n)]))
        starts = np.array(r.sample(range(n), n))
        order, same = suffix_dedup.sorted_suffixes(np.frombuffer(data, np.uint8), starts, groups, length)
        key = [(int(groups[i]), data[starts[i] : starts[i] + length]) for i in order]
        assert key == sorted(key) and sorted(order.tolist()) == list(range(n))
        assert same.tolist() == [i > 0 and key[i] == key[i - 1] for i in range(n)]


def test_rows_without_ids_of_their_own(spark, odd):
    rows = odd.collect()
    want = Counter((r.doc_id, *map(str, b)) for r, b in zip(rows, brute([r.text for r in rows], 100), strict=True))
    found = suffix_dedup.dedup(odd, length=100)
    assert found.columns == ["doc_id", "n_bytes", "kept", "cut_starts", "cut_lengths"]
    assert Counter((r.doc_id, str(r.n_bytes), str(bytes(r.kept)), str(r.cut_starts), str(r.cut_lengths)) for r in found.collect()) == want


def test_empty(spark, odd):
    assert suffix_dedup.dedup(odd.limit(0)).collect() == []


def test_query(spark, tmp_path):
    from metaloom.llm.queries import QUERIES

    texts = [t * 4 if t else t for t in texts_with_repeats(4, 20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).collect()}
    want = {i: (n, sum(c), len(c), hashlib.sha256(kept).hexdigest()) for i, (n, kept, _, c) in enumerate(brute(texts, 400))}
    assert found == want and sum(w[1] for w in want.values()) > 0

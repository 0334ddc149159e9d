import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import ngram_join, quality, spotsigs, substring_dedup, toxicity
from metaloom.llm.graph import components


def shingle_set(t):
    import re

    w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_links(rows, threshold=0.8):
    sets = {i: shingle_set(t) for i, t in rows}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-9:
                links[a].add(b)
                links[b].add(a)
    group = {}
    for i in sorted(sets):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    return group, {i: len(v) for i, v in links.items()}


@pytest.mark.parametrize("block", [768, 7])
def test_ngram_join_equals_brute_force(spark, prose, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_HASHES", 1 << 19 if block > 7 else 300)
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(100 + g, 120).split()
        for k in range(8):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = f"new{r.randrange(999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, x) for i, x in enumerate([None, "", "a b", "A  b!", "..", prose(100, 120), prose(7, 5000), prose(7, 5000)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("rep", F.lit(2))
    got = {x.doc_id: x for x in ngram_join.near_duplicates(df).collect()}
    group, n = brute_links(rows)
    assert {i: x.class_id for i, x in got.items()} == group
    assert {i: x.n_links for i, x in got.items()} == n
    kept = {x.doc_id for x in ngram_join.one_of_each(df).collect()}
    assert kept == set(group.values())


def test_ngram_join_odd_rows(spark, odd):
    rows = ngram_join.near_duplicates(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8}
    by = {r.doc_id: r for r in rows}
    assert by[6].class_id == by[1].class_id == 1 and by[2].n_links == by[3].n_links == 0
    assert {r.doc_id for r in ngram_join.one_of_each(odd).collect()} == {1, 2, 3, 4, 5, 7, 8, None}
    assert ngram_join.near_duplicates(odd.limit(0)).collect() == []


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_components(spark, small):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, r.randrange(2000, 2300)) for _ in range(400)] + [(5, 5), (9999, 9999), (70, 69), (69, 70)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in components(df, small=small).collect()}
    assert set(got) == {x for e in edges for x in e}
    assert all(got[i] == 0 for i in range(61)) and got[9999] == 9999 and got[70] == 69
    assert all(got[b] == 1000 for a, b in edges if a == 1000)
    assert components(df.limit(0), small=small).collect() == []


def test_prefixes_are_shortened_until_planted_pairs_meet():
    r = np.random.default_rng(3)
    sets = [np.sort(r.integers(1, 1 << 63, 200).astype(np.uint64)) for _ in range(60)]
    prefixes = ngram_join.planted_prefixes(sets, 40, 8, 0.8)
    assert prefixes.shape == (240, 40)
    for k in (1, 3, 6):
        assert abs((prefixes >= k).mean() - 0.8**k) < 0.03
    k = ngram_join.forest_depth(prefixes, 40, 0.8, 0.99995, 8)
    assert ((prefixes >= k).any(axis=1)).mean() >= 0.95 and k >= 5
    assert ngram_join.forest_depth(prefixes[:0], 40, 0.8, 0.99999, 8) == 6
    with pytest.raises(ValueError):
        ngram_join.forest_depth(prefixes, 1, 0.8, 0.99995, 8)


def test_large_subtrees_of_unlike_texts_end_and_lose_no_link(spark, prose, monkeypatch):
    """Subtrees of far more than CHUNK members, half alike, with pairs at the threshold among them; blocks smaller than the groups."""
    monkeypatch.setattr(ngram_join, "CHUNK", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    r = random.Random(8)
    base, rows = prose(1, 200).split(), []
    for k in range(90):
        w = list(base)
        for i in r.sample(range(200), 1 + k % 5):
            w[i] = f"u{k}x{i}"
        rows.append((k, " ".join(w)))
    for k in range(30):
        w = prose(500 + k // 3, 90).split()
        for i in r.sample(range(90), k % 3):
            w[i] = f"v{k}"
        rows.append((100 + k, " ".join(w)))
    got = {x.doc_id: x for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group, n = brute_links(rows)
    assert max(n.values()) > 20 and 0 < sum(v == 0 for v in n.values())
    assert {i: x.n_links for i, x in got.items()} == n and {i: x.class_id for i, x in got.items()} == group


def test_classes_of_many_copies(spark, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    rows = [(i, prose(1, 60)) for i in range(12)] + [(i, prose(i, 60)) for i in range(20, 26)] + [(30, prose(20, 60)), (31, None)]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(got[i] == (0, 0, 11) for i in range(12)) and got[30] == (20, 20, 1) and got[25] == (25, 25, 0) and got[31] == (31, 31, 0)


def test_ngram_join_of_repeated_ids(spark, prose):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(3, 50)), (2, prose(3, 50)), (3, prose(3, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__first", F.lit(1))
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == 5 and {r.class_id for r in got if r.doc_id in (2, 3)} == {2}
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == [1, 2]


def test_chunks_resist_insertions(prose):
    text = prose(9, 800).encode()
    other = b"some inserted words " + text[:2000] + b" and more " + text[2000:]

    def chunks(t):
        ends = substring_dedup.boundaries(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3, 8, 256)
        return [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    a, b = chunks(text), chunks(other)
    assert b"".join(a) == text and b"".join(b) == other
    assert len(set(a) - set(b)) <= 4


def test_substring_dedup_cuts_repeats_and_nothing_else(spark, prose):
    passage = prose(50, 60)
    rows = [(i, prose(200 + i, 80) + " " + (passage + " " if i in (2, 5, 7) else "") + prose(300 + i, 80)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(3)).withColumn("cut_starts", F.lit("x"))
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    for i, t in rows:
        r = got[i]
        if i in (5, 7):
            assert len(r.cut_starts) == 1 and r.cut_firsts == [2]
            lo, n = r.cut_starts[0], r.cut_lengths[0]
            assert t[lo : lo + n] in passage + " " and n >= 0.6 * len(passage) and r.text == t[:lo] + t[lo + n :]
        else:
            assert r.text == t and r.cut_starts == []


def test_substring_dedup_keeps_text_of_scattered_phrases(spark, prose):
    # Each chunk of the last text stands in the first or second somewhere, but no 16 words of it stand together.
    long = prose(11, 3000)
    data = np.frombuffer(long.encode(), np.uint8)
    ends = substring_dedup.boundaries(data, np.array([0, len(data)]), 3, 8, 256)
    pieces = [long[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    mixed = "".join(pieces[i] for i in range(len(pieces) - 2, 0, -2))
    df = spark.createDataFrame([(1, long), (2, mixed)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.dedup(df).collect()} == {1: long, 2: mixed}


def test_substring_dedup_measures_text_without_white_space(spark):
    r = np.random.default_rng(5)
    passage = "".join(chr(0x4E00 + int(c)) for c in r.integers(0, 3000, 2000))
    df = spark.createDataFrame([(1, passage), (2, "".join(chr(0x5C00 + int(c)) for c in r.integers(0, 3000, 900)) + passage)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    assert got[1].text == passage and sum(got[2].cut_lengths) > 1500


def test_substring_dedup_of_repeated_ids_cuts_each_row_at_its_own_places(spark, prose):
    p, q = prose(71, 60), prose(72, 60)
    rows = [(1, p + " " + prose(73, 30)), (2, prose(74, 40) + " é☃ " + p), (2, prose(75, 300)), (3, q), (3, "ñ " + prose(76, 20) + " " + q), (4, "☃ " + q), (4, "☃ " + q), (None, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("__key", "__spans", "__row", "__hash", "first", "k")})
    got = substring_dedup.dedup(df).collect()
    assert len(got) == len(rows) and {"__key", "__spans"} <= set(got[0].asDict())
    left = {(r.doc_id, r.text) for r in got}
    assert (1, rows[0][1]) in left and (2, rows[2][1]) in left and (None, p) in left
    (two,) = [r.text for r in got if r.doc_id == 2 and "☃" in r.text]
    assert two.startswith(prose(74, 40) + " é☃ ") and len(two) < len(rows[1][1]) - 0.6 * len(p)
    three = [r for r in got if r.doc_id == 3]
    assert sum(len(r.cut_starts) for r in three) == 1 and all(len(r.cut_starts) == 1 and r.cut_firsts == [3] for r in got if r.doc_id == 4)


def test_substring_dedup_with_heavy_digests(spark, prose, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 5)
    p = prose(81, 60)
    rows = [(i, prose(400 + i, 40) + " " + p + " " + prose(500 + i, 40)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    heavy = {r.doc_id: (r.text, r.cut_starts) for r in substring_dedup.dedup(df).collect()}
    monkeypatch.setattr(substring_dedup, "HEAVY", 10**9)
    assert heavy == {r.doc_id: (r.text, r.cut_starts) for r in substring_dedup.dedup(df).collect()}
    assert heavy[0][1] == [] and all(len(heavy[i][1]) == 1 for i in range(1, 30))


def brute_cuts(rows, least_words=16):
    """Spans to cut by comparing the windows' own bytes, by the boundaries alone: no hashing, no tables."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = np.frombuffer(t.encode(), np.uint8)
        ends = [int(e) for e in substring_dedup.boundaries(data, np.array([0, len(data)]), 3, 8, 256) if e > 0]
        starts, spans = [0, *ends[:-1]], []
        chunks = [t.encode()[a:b] for a, b in zip(starts, ends, strict=True)]
        raw = t.encode()
        begins = [k for k in range(len(raw)) if not raw[k : k + 1].isspace() and (k == 0 or raw[k - 1 : k].isspace())]
        sizes = [max(sum(a <= k < b for k in begins), (b - a) // 8) for a, b in zip(starts, ends, strict=True)]
        for k in range(len(chunks)):
            total, j = 0, k
            while j < len(chunks) and total < least_words:
                total += sizes[j]
                j += 1
            if total >= least_words:
                w = tuple(chunks[k:j])
                if w in seen:
                    spans.append((starts[k], ends[j - 1]))
                else:
                    seen[w] = i
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        raw, at, left = t.encode(), 0, b""
        for a, b in merged:
            left, at = left + raw[at:a], b
        out[i] = (left + raw[at:]).decode()
    return out


def test_substring_dedup_equals_brute_force(spark, prose):
    r = random.Random(12)
    pool = [prose(600 + k, 30 + 5 * k) for k in range(6)]
    rows = [(i, " ".join(x for k in range(3) for x in (prose(700 + 9 * i + k, r.randrange(5, 40)), r.choice(pool)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in substring_dedup.dedup(df).collect()} == brute_cuts(rows)


def test_substring_dedup_within_a_text_and_odd_rows(spark, odd, prose):
    p = prose(51, 60)
    df = spark.createDataFrame([(1, p + " é☃ " + prose(52, 30) + " " + p)], "doc_id long, text string")
    (r,) = substring_dedup.dedup(df).collect()
    assert len(r.cut_starts) == 1 and r.cut_starts[0] > len(p) and r.cut_firsts == [1]
    out = substring_dedup.dedup(odd)
    assert out.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "cut_starts"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[3].text == "" and by[None].text == "no id here" and len(by[6].text) < len(by[1].text)
    assert substring_dedup.dedup(odd.limit(0)).collect() == []


def brute_sigs(text, chain=2):
    import re

    tokens = [t for t in re.split(r"[^\w]+|_", text.lower()) if t]
    common = set(spotsigs.COMMON)
    out = set()
    for i, t in enumerate(tokens):
        if t in common:
            rest = [w for w in tokens[i + 1 :] if w not in common][:chain]
            if rest:
                out.add((t, *rest))
    return out


def test_spotsigs_counts_and_likeness(spark):
    texts = {1: "The quick fox is on the lazy dog and the cat", 2: "the quick fox is on a lazy dog", 3: "plain words only here", 4: "", 5: None, 6: "the"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("bucket", F.lit(0))
    got = {r.doc_id: r for r in spotsigs.fingerprints(df).collect()}
    for i in (1, 2):
        assert len(got[i].fingerprint) == 8 * len(brute_sigs(texts[i]))
    assert len(got[3].fingerprint) == 8 * 4 and got[4].fingerprint == got[5].fingerprint == ""
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        a, b = brute_sigs(t), brute_sigs(nxt)
        if a and b:
            assert got[d].near_next == pytest.approx(len(a & b) / len(a | b))
        a, b = brute_sigs(t), brute_sigs(edited)
        if a and b:
            assert len(got[d].edited_fingerprint) == 8 * len(b) and got[d].near_edited == pytest.approx(len(a & b) / len(a | b))


def test_ngram_join_bounds_tasks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_HASHES", 20_000)
    seen = spark.sparkContext.accumulator(0)
    real, r = ngram_join._verify, random.Random(3)

    def watched(threshold):
        own = real(threshold)

        def run(t):
            seen.add(int(len(t.column("hashes").combine_chunks().values) > 2 * (20_000 + 6000)))
            return own(t)

        return run

    monkeypatch.setattr(ngram_join, "_verify", watched)
    base = [f"w{r.randrange(10**6)}" for _ in range(5000)]
    rows = [(i, " ".join(base[: 5000 - i])) for i in range(60)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.class_id, x.n_links) for x in got} == {(0, 59)} and seen.value == 0


def test_spotsigs_likeness_is_exact_however_small(spark, prose):
    common = " ".join(f"the word{i} other{i}" for i in range(3))
    texts = {1: common + " " + " ".join(f"the a{i} b{i}" for i in range(200)), 2: common + " " + " ".join(f"the c{i} d{i}" for i in range(900))}
    rows = spotsigs.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    a, b = (brute_sigs(t) for t in texts.values())
    assert 0 < len(a & b) / len(a | b) < 0.01
    assert [r.near_next for r in rows] == [pytest.approx(len(a & b) / len(a | b))] * 2


def test_spotsigs_bands_hold_what_is_alike(spark):
    for least in (0.05, 0.8):
        n = spark.range(1, 400).select(F.col("id").alias("n"), spotsigs.band(F.col("id"), least).alias("b"))
        m = n.select(F.col("n").alias("m"), F.col("b").alias("c"))
        assert n.join(m, F.col("m") >= F.col("n") * F.lit(least)).filter("m <= n and abs(b - c) > 1").isEmpty()


def test_spotsigs_odd_pairs(spark, odd):
    text = "the harbor is on the river and the town of the north was in the valley"
    rows = [(1, text), (1, text), (2, text + " too"), (None, text), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sigs", F.lit(0))
    assert {(r.a, r.b) for r in spotsigs.near_pairs(df, 0.5).collect()} == {(1, 2)}
    assert spotsigs.near_pairs(odd.limit(0)).collect() == [] and len(spotsigs.near_pairs(odd).collect()) >= 0


def test_spotsigs_many_buckets_and_odd_rows(spark, odd, prose, monkeypatch):
    real = spotsigs.buckets_of
    monkeypatch.setattr(spotsigs, "buckets_of", lambda d, k: real(d, k, rows_a_bucket=1, most=3))
    ids = [3, 9, 10, 11, 50, 51, 52, 90, 91, 1000, 1001, 5000]
    rows = {i: prose(i, 30) for i in ids}
    got = {r.doc_id: r for r in spotsigs.fingerprints(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    for k, d in enumerate(sorted(ids, reverse=True)):
        t, nxt = rows[d], rows[sorted(ids, reverse=True)[(k + 1) % len(ids)]]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert len(spotsigs.fingerprints(odd).collect()) == odd.count()
    assert spotsigs.fingerprints(odd.limit(0)).collect() == []


def test_spotsigs_pairs(spark, prose):
    base = ("the " + " the ".join(prose(5, 60).split())).split()
    other = list(base)
    other[11] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base)), (4, "the " + " the ".join(prose(6, 60).split()))]
    got = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and 0.8 <= got[0].likeness < 1


def toxic_rows(prose):
    r = random.Random(1)
    rows = []
    for i in range(900):
        w = prose(i, 30).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[r.randrange(30)] = r.choice(["scum", "moron", "trashy", "idiot"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_held_out(spark, prose, odd):
    rows = toxic_rows(prose)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    y = {i: t for i, _, t in rows}
    got = toxicity.score(docs, model).select("*", toxicity.held_out().alias("held_out")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}
    assert len(toxicity.score(odd, model).collect()) == odd.count() and toxicity.score(odd.limit(0), model).collect() == []
    assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.drop_toxic(odd.limit(0), model).collect() == []


def test_fit_samples_are_bounded_by_rows_and_characters(spark, prose, monkeypatch):
    """A repeated id brings one text, and long texts stay out of the sample, though they are scored."""
    rows = [(0, prose(i, 20)) for i in range(50)] + [(i, prose(i, 20)) for i in range(1, 12)] + [(20, prose(20, 4000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(21)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **o: seen.setdefault("toxicity", texts))
    toxicity.train(docs, labels, chars=5000)
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts, p: (seen.setdefault("quality", texts), real(texts, p))[1])
    models = quality.train(docs, chars=5000)
    assert len(seen["quality"]) == 12 and len(seen["toxicity"]) <= 12 and max(map(len, seen["quality"])) <= 5000
    assert len(quality.score(docs, *models).collect()) == len(rows)


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd.select("doc_id", "text"), none)
    assert all(r.predicted == 0 for r in toxicity.score(odd, model).collect())
    assert np.array_equal(toxicity.fit(["a b", "c d"] * 20, [0, 1] * 20).table, toxicity.fit(["a b", "c d"] * 20, [0, 1] * 20).table)


def test_toxicity_slices_agree(prose):
    texts = [prose(i, 20 + i) for i in range(30)] + ["", None, "one"]
    m = toxicity.fit(texts, [i % 2 for i in range(len(texts))])
    whole = m.scores(toxicity._words_of(texts))
    assert np.allclose(whole, [m.scores(toxicity._words_of([t]))[0] for t in texts])


def test_quality(spark, prose, odd):
    good = [("The harbor is on the north side of the town and it was built for trade with " + prose(i, 40)).replace(".", " and the.") for i in range(300)]
    bad = [" | ".join(prose(i, 40).split()) if i % 2 else "!! ".join(prose(i, 12).upper().split() * 5) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, *quality.train(docs)).collect()}
    assert sum(got[i].keep for i in range(300)) >= 297 and sum(got[i].keep for i in range(300, 380)) <= 4
    models = quality.train(odd.select("doc_id", "text"))
    assert len(quality.score(odd, *models).collect()) == odd.count()
    empty = odd.limit(0)
    assert quality.score(empty, *quality.train(empty)).collect() == []


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.7
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.9, 0.65, 0.75]
    v = np.stack([np.where(r.random(4000) < 0.2, -1, np.where(r.random(4000) < p, truth, ~truth)) for p in right], axis=1).astype(np.int8)
    pat, n = np.unique(v, axis=0, return_counts=True)
    m = quality.estimate(pat, n)
    found = [m.tables[k, 1, 2] / (m.tables[k, 1, 1] + m.tables[k, 1, 2]) for k in range(8)]
    assert abs(m.prior - 0.7) < 0.05 and np.abs(np.array(found) - right).max() < 0.05

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metaloom.llm import lexical

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [t.translate(LOWER) for t in re.findall(lexical.TERM, text or "")]


def brute(docs, items, k=10):
    """Rows (item, rank, doc, score), item by item, scoring every document."""
    bags = [(d, Counter(tokens(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(tokens(text)) if b[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item, r.rank, r.doc, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(900)]
    docs += [(1000 + i, "Same copies OF this text, w1 w2") for i in range(40)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(60)] + [(99, "copies OF"), (98, "w1 w1 W1 w2")]
    return docs, items


@pytest.mark.parametrize(("parts", "block", "terms"), [(1, 16, 1 << 16), (5, 7, 1 << 16), (3, 256, 60)])
def test_equals_scoring_every_document(spark, corpus, parts, block, terms):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    index = lexical.index(df, block_docs=block)
    rows = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), most_terms=terms)
    assert got(rows) == brute(docs, items)


def test_blocks_below_the_bound_are_not_scored(spark):
    r = random.Random(1)
    topics = [[f"t{t}x{i}" for i in range(30)] for t in range(40)]
    docs = [(i, " ".join(r.choices(topics[i // 50], k=40))) for i in range(2000)]
    items = [(t, " ".join(topics[t][:5])) for t in range(40)]
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_docs=25)
    rows = lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert index.blocks.count() == 80 and max(x.scored for x in rows) <= 4


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "naïve CAFÉ x"), (2, None), (3, ""), (None, "id no"), (5, rows[4][1]), (5, "zzz"), (7, "x"), (7, "x"), (8, "ÉTÉ_été")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("q", "item", "terms", "rank", "doc", "score")})
    assert got(lexical.search(lexical.index(odd), df)) == brute(rows, items)


def test_keys_of_text_and_a_very_long_document(spark, prose):
    docs = [("a", prose(1, 60_000)), ("b", "x" * 70_000), (None, "harbor1 silver2"), ("c", "harbor1")]
    items = [("i", "harbor1 silver2"), ("j", "x" * 70_000)]
    rows = lexical.search(lexical.index(spark.createDataFrame(docs, "doc_id string, text string"), block_postings=500), spark.createDataFrame(items, "item_id string, text string"))
    assert [r[:2] + r[3:] for r in got(rows)] == [r[:2] + r[3:] for r in brute([(d or "~", t) for d, t in docs], items)]


def test_empty(spark, odd):
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical.search(lexical.index(odd.limit(0)), items).collect() == []
    assert lexical.search(lexical.index(odd), items.limit(0)).collect() == []


def test_files_and_slices_of_the_index_are_bounded(spark, corpus):
    docs, items = corpus
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_docs=4)
    files = index.blocks.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r[1] for r in files) <= lexical.FILE_BLOCKS
    assert got(lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)

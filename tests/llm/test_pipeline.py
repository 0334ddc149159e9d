import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, prose, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(400):
        w = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["scum", "moron", "idiot"])
        rows.append((i, " ".join(w), "en", f"s{i % 4}", toxic))
    passage = prose(9999, 60)
    rows[1] = (1, rows[1][1] + " " + passage, "en", "s1", False)
    rows[2] = (2, rows[2][1] + " " + passage, "en", "s2", False)
    rows += [(1000, rows[3][1], "en", "s3", False), (1001, None, "en", None, False)]
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(x)) for i, _, _, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(d + "/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    ids = {x.doc_id for x in kept.collect()}
    toxic = {i for i, *_, x in rows if x}
    assert len(ids & toxic) <= 3 and len(ids) >= len(rows) - len(toxic) - 6
    one = corpus_pipeline.drop_near_copies(spark, kept, d)
    assert one.columns == docs.columns and {x.doc_id for x in one.collect()} == ids - {1000}
    cut = corpus_pipeline.cut_repeats(spark, one, d).cache()
    assert cut.columns == docs.columns and cut.count() == one.count()
    by = {x.doc_id: x for x in cut.collect()}
    assert passage in by[1].text and passage not in by[2].text and by[2].n_chars == len(by[2].text)
    mixed = corpus_pipeline.mix(spark, cut, d)
    n = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed.columns == docs.columns and n == 2
    assert len(corpus_pipeline.STAGES) == 5
    # The whole run packs what the stages leave one after another: as many copies of each text, each token once.
    want = Counter(x.doc_id for x in mixed.collect())
    pieces = corpus_pipeline.run(spark, d).collect()
    tokens, sizes = Counter(), {}
    for x in pieces:
        tokens[x.doc_id] += x.length
        assert sizes.setdefault(x.doc_id, x.doc_tokens) == x.doc_tokens
    assert {i: n / sizes[i] for i, n in tokens.items()} == dict(want)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).collect() == []


def test_rows_without_an_id_are_mixed_as_often_as_they_are_taken(spark, tmp_path):
    rows = [(None, f"a b c {i}", "en", "s", 7) for i in range(3)] + [(5, "x y", "en", "s", 3)] * 2 + [(6, None, None, None, None), (7, "", "fr", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("clash"))
    out = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() <= 2 * len(rows)
    assert max(Counter(r.text for r in out.filter("doc_id is null").collect()).values()) <= 2

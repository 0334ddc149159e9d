import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import quality

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_scores_rank_labelled_texts(spark):
    """The labels are in no training; without the statistics' bins the scorer has the text's trigrams alone."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null")
    found = {}
    for bins_too in (True, False):
        rows = quality.score(docs, *quality.train(docs, bins_too=bins_too)).join(labels, "doc_id").select("score", "posterior", F.col("quality").cast("int")).collect()
        s, p, y = (np.array(x, float) for x in zip(*rows, strict=True))
        found[bins_too] = auc(s, y), auc(p, y)
    print(found)
    assert found[True][0] > 0.95 and found[True][1] > 0.95 and found[False][0] > 0.8


def test_long_texts_leave_the_sample_to_others(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 60) if i % 10 == 0 else prose(i, 60) * 40) for i in range(200)], "doc_id long, text string")
    _, few = quality.train(docs, rows=20, chars=2000)
    _, same = quality.train(docs.filter("doc_id % 10 = 0"), rows=20, chars=2000)
    assert few.trigrams.any() and np.count_nonzero(few.trigrams) == np.count_nonzero(same.trigrams)

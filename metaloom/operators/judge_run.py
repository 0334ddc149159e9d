"""A whole judge run: units of sample tables with the answers about them, and the tables that come of it, from one stored result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X
from metaloom.operators import guards as Q
from metaloom.session import kept

COUNTS = ("total", "correct", "hallucinated", "mismatch", "wrong", "incomplete", "corrected", "error")
TABLES = ("review", "per_paper", "per_field", "coverage", "filtered", "filter_summary", "skipped")


def _flags() -> dict[str, Column]:
    """What of COUNTS a unit counts as. A unit without a verdict is an error and nothing else; a made-up or misplaced one is neither wrong nor incomplete."""
    c = F.col
    judged = c("verdict").isNotNull()
    placed = judged & ~c("hallucinated") & ~c("mismatch")
    flags = {
        "total": F.lit(True), "correct": placed & c("value_correct") & c("value_complete"), "hallucinated": judged & c("hallucinated"), "mismatch": judged & c("mismatch"),
        "wrong": placed & ~c("value_correct"), "incomplete": placed & c("value_correct") & ~c("value_complete"), "corrected": judged & c("corrected").isNotNull(), "error": ~judged,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def _counted(review: DataFrame, by: str) -> DataFrame:
    """(by, COUNTS..., accuracy): accuracy is the share of correct units among those judged, null where there are none."""
    g = review.groupBy(by).agg(*[F.count_if(v).alias(k) for k, v in _flags().items()])
    return g.withColumn("accuracy", M.ratio_or(F.col("correct"), F.col("total") - F.col("error"), None))


def run(cells: DataFrame, papers: DataFrame, answers: DataFrame, fields: Sequence[str]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables of TABLES, and the counters of the run.

    cells: (pxd, field, row_idx, col_idx, cell); papers: (pxd, text); answers: (pxd, field, unit, verdict, hallucinated, mismatch,
    value_correct, value_complete, corrected), one for each unit that was judged. A paper without a text, or with a text and no
    known cell, is ``skipped``, with the reason, and in no other table.

    review: a row for each unit (guards.units) with its answer and ``match_type``. per_paper and per_field: COUNTS and accuracy; the
    former with runs and columns, the latter for all ``fields``, in their order (``place``). coverage: of each paper and field the
    known cells of all. filtered: each cell as the verdicts leave it (``fixed``): made-up, misplaced and wrong values
    go, corrected ones are replaced. filter_summary: cells kept, replaced and removed by paper.

    The join of units, texts and answers is made and stored once, with its counters observed on the way; all tables are read of
    it and of the cells, and may be written to as many sinks without judging again.
    """
    cells = kept(cells.select("pxd", "field", "row_idx", "col_idx", "cell"))
    known = cells.filter(~X.is_nullish("cell", "sample"))
    have = known.select("pxd").distinct()
    texts = papers.filter("text is not null and trim(text) <> ''").select("pxd").distinct()
    asked = cells.select("pxd").distinct().unionAll(papers.select("pxd")).distinct().filter("pxd is not null")
    reasons = asked.join(texts.withColumn("__t", F.lit(True)), "pxd", "left").join(have.withColumn("__c", F.lit(True)), "pxd", "left")
    reason = F.when(F.col("__t").isNull(), "no manuscript").when(F.col("__c").isNull(), "empty sdrf")
    reasons = kept(reasons.select("pxd", reason.alias("reason")))
    good = reasons.filter("reason is null").select("pxd")
    own = cells.join(good, "pxd", "left_semi")
    units = Q.units(own).select("pxd", "field", "unit", "n", F.col("variants")[0].alias("value"))
    judged = units.join(answers.select("pxd", "field", "unit", "verdict", "hallucinated", "mismatch", "value_correct", "value_complete", "corrected"), ["pxd", "field", "unit"], "left")
    v = F.col("verdict")
    match = F.when(v.isNull(), "ERROR").when(F.col("hallucinated"), "HALLUCINATED").when(F.col("mismatch"), "TYPE_MISMATCH").when(v == "high", "CORRECT").when(v == "medium", "PARTIAL").otherwise("NO_MATCH")
    seen = Observation()
    counters = [F.count_if(f).alias(k) for k, f in _flags().items()] + [F.coalesce(F.sum("n"), F.lit(0)).alias("cells")]
    review = kept(judged.withColumn("match_type", match).observe(seen, *counters))
    flags = _flags()
    shape = own.groupBy("pxd").agg(F.countDistinct("row_idx").alias("runs"), F.countDistinct("field", "col_idx").alias("columns"))
    order = cells.sparkSession.createDataFrame(list(enumerate(fields)), "place int, field string")
    per_field = order.join(_counted(review, "field"), "field", "left").na.fill(0, list(COUNTS)).select("place", "field", *COUNTS, "accuracy")
    coverage = own.groupBy("pxd", "field").agg(F.count(F.lit(1)).alias("cells"), F.count_if(~X.is_nullish("cell", "sample")).alias("known"))
    # What is right, or not judged, stays; a correction takes the place of what is not; the rest goes.
    action = F.when(flags["error"] | flags["correct"], "keep").when(flags["corrected"] & ~flags["hallucinated"], "replace").when(flags["incomplete"], "keep").otherwise("remove")
    verdicts = review.select("pxd", "field", "unit", action.alias("verdict"), F.when(action == "replace", F.col("corrected")).alias("corrected"))
    filtered = kept(Q.apply_verdicts(own, verdicts))
    was = ~X.is_nullish("cell", "sample")
    gone, same = X.is_nullish("fixed", "sample"), F.col("cell").eqNullSafe(F.col("fixed"))
    summary = filtered.filter(was).groupBy("pxd").agg(F.count_if(same).alias("kept"), F.count_if(~same & ~gone).alias("replaced"), F.count_if(~same & gone).alias("removed"))
    tables = {
        "review": review, "per_paper": _counted(review, "pxd").join(shape, "pxd"), "per_field": per_field, "coverage": coverage.withColumn("share", M.ratio_or(F.col("known"), F.col("cells"))),
        "filtered": filtered, "filter_summary": summary, "skipped": reasons.filter("reason is not null"),
    }
    return tables, dict(seen.get)


def written(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in a folder of its name; a run that is repeated overwrites them."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")

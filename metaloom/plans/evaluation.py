"""Scores of predicted against golden labels, agreement of rule raters, and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.operators import evaluation as E
from metaloom.session import table


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with three rule raters of quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("n_chars") >= 300).cast("int").alias("r_long"), (~F.contains("text", F.lit("|"))).cast("int").alias("r_plain"), F.contains("text", F.lit(". ")).cast("int").alias("r_prose"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


RATED = """rated AS (SELECT doc_id, lang, source, n_chars, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END r_long, CASE WHEN contains(text, '|') THEN 0 ELSE 1 END r_plain,
  CASE WHEN contains(text, '. ') THEN 1 ELSE 0 END r_prose, quality, toxic FROM documents JOIN labels USING (doc_id))"""


def _prf(spark, sf_dir, by):
    # the gold value counts as given where the document is good, the rule's where it says so
    return E.prf(rated(spark, sf_dir), by, F.col("quality").cast("double"), F.col("r_plain") == 1, F.col("quality") == 1)


def prf_micro(spark, sf_dir):
    """Micro scores of the length rule by source; a wrong value is a false positive and a false negative."""
    r = rated(spark, sf_dir).withColumn("score", F.when(F.col("quality") == F.col("r_plain"), 1.0).otherwise(0.0))
    return E.prf(r, ["source"], F.col("score"), F.col("r_long") == 1, F.col("toxic").isNotNull())


def prf_by_lang(spark, sf_dir):
    return _prf(spark, sf_dir, ["lang"])


def prf_micro_macro(spark, sf_dir):
    """Micro scores over all beside the macro means over languages."""
    one = E.prf(rated(spark, sf_dir).withColumn("all", F.lit("all")), ["all"], F.col("quality").cast("double"), F.col("r_plain") == 1, F.col("quality") == 1)
    return one.select("tp", "fp", "fn", "p", "r", "f1").crossJoin(E.macro(_prf(spark, sf_dir, ["lang"])))


def outcome_shares(spark, sf_dir):
    r = rated(spark, sf_dir).withColumn("kind", M.outcome(F.col("quality").cast("double"), F.col("r_prose") == 1))
    return E.counts_by_kind(r, "lang", "kind", ["missing", "accepted", "wrong"], share=True)


def acceptance_pivot(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg(F.col("quality").cast("double")), 6))


def kappa_presence(spark, sf_dir):
    """Kappa and its parts of two raters by language."""
    g = rated(spark, sf_dir).groupBy("lang").agg(*[c.alias(n) for n, c in M.kappa_parts(F.col("r_plain") == 1, F.col("quality") == 1).items()])
    cols = [F.col(c) for c in ("n", "both", "neither", "a_only", "b_only")]
    return g.select("lang", *cols, M.kappa(*cols).alias("kappa"), M.positive_agreement(cols[1], cols[3], cols[4]).alias("positive"))


def kappa_decompose(spark, sf_dir):
    """Raw and chance agreement, prevalence and shared absence of two raters over all."""
    g = rated(spark, sf_dir).agg(*[c.alias(n) for n, c in M.kappa_parts(F.col("r_prose") == 1, F.col("quality") == 1).items()])
    n, both, neither, a, b = (F.col(c) for c in ("n", "both", "neither", "a_only", "b_only"))
    pa, pb = (both + a) / n, (both + b) / n
    return g.select("n", ((both + neither) / n).alias("raw"), (pa * pb + (1 - pa) * (1 - pb)).alias("chance"), M.positive_agreement(both, a, b).alias("positive"), (neither / n).alias("both_absent"), ((pa + pb) / 2).alias("prevalence"))


def kappa_multicat(spark, sf_dir):
    """Kappa of two raters with several categories: size classes by characters and by words."""
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("n_chars") < 500, "s").when(F.col("n_chars") < 2000, "m").otherwise("l").alias("a"), F.when(F.size(F.split("text", " ")) < 90, "s").when(F.size(F.split("text", " ")) < 380, "m").otherwise("l").alias("b"))
    return E.multi_kappa(d, "a", "b", ["lang"])


def rater_agreement(spark, sf_dir):
    """Share of equal ratings of each two raters."""
    long = rated(spark, sf_dir).select("doc_id", F.expr("stack(4, 'long', r_long, 'plain', r_plain, 'prose', r_prose, 'gold', quality) as (rater, value)"))
    return E.rater_pairs(long, "doc_id", "rater", "value").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v1") == F.col("v2")).cast("double")).alias("same"))


def rater_permutation(spark, sf_dir):
    """Exact test of whether the gold rater agrees less than the rules do."""
    return E.permutation_test(rater_agreement(spark, sf_dir).select("r1", "r2", F.col("same").alias("value")), ["gold"])


def unanimity(spark, sf_dir):
    """Users whose first event types agree over three buckets that cover all days: the days of a month up to 10, up to 20 and after."""
    bucket = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).alias("bucket")
    e = table(spark, sf_dir, "events").groupBy("user_id", bucket).agg(F.min("event_type").alias("first"))
    return E.unanimity(e, ["user_id"], "first", 3)


def replicate_spread(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("replicate", F.col("event_id") % 3)
    out = E.replicate_spread(e, ["event_type"], "replicate", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


def rank_auc(spark, sf_dir):
    """Length against quality, in hundreds of characters, with variances corrected for ties."""
    r = rated(spark, sf_dir).withColumn("hundreds", F.floor(F.col("n_chars") / 100))
    out = E.auc(r, "hundreds", F.col("quality") == 1, ["lang"], ties=True)
    return out.withColumns({c: F.round(c, 6) for c in ("auc", "z")})


def rank_spearman(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    return E.spearman(o, "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


def rank_kruskal(spark, sf_dir):
    """H corrected for ties, over balances in thousands; with p, which SQL lacks, in four places."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("b"))
    return E.kruskal(c, "b", "c_mktsegment").withColumn("h", F.round("h", 4)).drop("p")


def rank_wilcoxon(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(F.when(F.col("event_id") % 2 == 0, F.floor("value")).otherwise(0)) - F.sum(F.when(F.col("event_id") % 2 == 1, F.floor("value")).otherwise(0))).alias("d"), F.min("event_type").alias("kind"))
    return E.wilcoxon(e, "d", ["kind"]).withColumn("z", F.round("z", 6)).drop("p")


def calibration_bins(spark, sf_dir):
    """Confidence bins of the length rule, empty ones kept."""
    r = rated(spark, sf_dir).withColumn("c", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))
    out = E.calibration(r, "c", F.col("quality") == 1, [0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 0.9999, 1.0], keep_empty=True)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "accuracy")})


def tier_counts_cumulative(spark, sf_dir):
    t = rated(spark, sf_dir).withColumn("tier", F.when(F.col("n_chars") < 200, "exact").when(F.col("n_chars") < 1000, "near").when(F.col("n_chars") < 3000, "distant").otherwise("wrong"))
    out = E.cumulative_shares(t, "tier", ["exact", "near", "distant", "wrong"])
    return out.withColumns({c: F.round(c, 6) for c in ("pct", "cum_pct")})


def confidence_score(spark, sf_dir):
    """The weighted confidence of documents by source from validity, prose and completeness."""
    g = rated(spark, sf_dir).groupBy("source").agg(F.avg(F.col("r_plain").cast("double")).alias("v"), F.avg(F.col("r_prose").cast("double")).alias("e"), F.avg(F.col("r_long").cast("double")).alias("c"))
    return g.select("source", F.round(0.3 * F.col("v") + 0.5 * F.col("e") + 0.2 * F.col("c"), 6).alias("confidence"))


def top_confusions(spark, sf_dir):
    """The five most frequent pairs of size class and language, a report by definition."""
    d = table(spark, sf_dir, "documents").select(F.left("source", F.lit(4)).alias("golden"), F.lower("lang").alias("predicted"))
    return d.groupBy("golden", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "golden", "predicted").limit(5)


def coverage_shares(spark, sf_dir):
    """By source, the share of documents with either rule, both, or one alone."""
    a, b = F.col("r_plain") == 1, F.col("r_prose") == 1
    sh = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rated(spark, sf_dir).groupBy("source").agg(sh(a & b).alias("both"), sh(a & ~b).alias("a_only"), sh(~a & b).alias("b_only"), sh(a | b).alias("either"))


def judge_stats(spark, sf_dir):
    """Counts and accuracy variants of verdicts by language: right needs all flags."""
    r = rated(spark, sf_dir)
    ok = (F.col("r_plain") == 1) & (F.col("r_prose") == 1) & (F.col("quality") == 1) & (F.col("toxic") == 0)
    g = r.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), F.count_if(F.col("toxic") == 1).alias("flagged"))
    return g.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6)).withColumn("accuracy_unflagged", F.round(M.ratio_or(F.col("correct"), F.col("n") - F.col("flagged")), 6))


def cosine_of_metrics(spark, sf_dir):
    """Cosine between each two numeric columns of line items."""
    li = table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sums = li.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in names for b in names])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}|{b}") / F.sqrt(F.col(f"{a}|{a}") * F.col(f"{b}|{b}")), 6).alias("cosine")) for a in names for b in names if a < b]
    return sums.select(F.inline(F.array(*rows)))


QUERIES = {f.__name__: f for f in (prf_micro, prf_by_lang, prf_micro_macro, outcome_shares, acceptance_pivot, kappa_presence, kappa_decompose, kappa_multicat, rater_agreement, rater_permutation, unanimity, replicate_spread, rank_auc, rank_spearman, rank_kruskal, rank_wilcoxon, calibration_bins, tier_counts_cumulative, confidence_score, top_confusions, coverage_shares, judge_stats, cosine_of_metrics)}

DIV = "coalesce(({0}) / nullif(({1}), 0)::DOUBLE, 0.0)"
P, R, F1 = DIV.format("tp", "tp + fp"), DIV.format("tp", "tp + fn"), DIV.format("2 * tp", "2 * tp + fp + fn")
BY_LANG = """count(*) FILTER (quality = 1 AND r_plain = 1) tp, 0::BIGINT fp, count(*) FILTER (quality = 1 AND r_plain = 0) fn"""
SAME = """long AS (SELECT doc_id, 'long' rater, r_long AS value FROM rated UNION ALL SELECT doc_id, 'plain', r_plain FROM rated UNION ALL SELECT doc_id, 'prose', r_prose FROM rated UNION ALL SELECT doc_id, 'gold', quality FROM rated),
  same AS (SELECT x.rater r1, y.rater r2, count(*) n, avg((x.value = y.value)::INT::DOUBLE) same FROM long x JOIN long y ON x.doc_id = y.doc_id AND x.rater < y.rater GROUP BY 1, 2)"""
RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"
ORACLES = {
    "prf_micro": f"""WITH {RATED}, c AS (SELECT source, count(*) FILTER (r_long = 1 AND quality = r_plain) tp, count(*) FILTER (r_long = 1 AND quality <> r_plain) fp, count(*) FILTER (NOT (r_long = 1 AND quality = r_plain)) fn FROM rated GROUP BY source)
      SELECT source, tp, fp, fn, {P} p, {R} r, {F1} f1 FROM c""",
    "prf_by_lang": f"WITH {RATED}, c AS (SELECT lang, {BY_LANG} FROM rated GROUP BY lang) SELECT lang, tp, fp, fn, {P} p, {R} r, {F1} f1 FROM c",
    "prf_micro_macro": f"""WITH {RATED}, c AS (SELECT lang, {BY_LANG} FROM rated GROUP BY lang), a AS (SELECT sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn FROM c)
      SELECT tp, fp, fn, {P} p, {R} r, {F1} f1, (SELECT avg({P}) FROM c) macro_p, (SELECT avg({R}) FROM c) macro_r, (SELECT avg({F1}) FROM c) macro_f1 FROM a""",
    "outcome_shares": f"WITH {RATED} SELECT lang, avg((r_prose = 0)::INT::DOUBLE) AS missing, avg((r_prose = 1 AND quality = 1)::INT::DOUBLE) AS accepted, avg((r_prose = 1 AND quality = 0)::INT::DOUBLE) AS wrong FROM rated GROUP BY lang",
    "acceptance_pivot": f"WITH {RATED} SELECT source, " + ", ".join(f"round(avg(quality::DOUBLE) FILTER (lang = '{x}'), 6) {x}" for x in ("de", "en", "es", "fr")) + " FROM rated GROUP BY source",
    "kappa_presence": f"""WITH {RATED}, c AS (SELECT lang, count(*) n, count(*) FILTER (r_plain = 1 AND quality = 1) AS "both", count(*) FILTER (r_plain = 0 AND quality = 0) AS neither, count(*) FILTER (r_plain = 1 AND quality = 0) a_only, count(*) FILTER (r_plain = 0 AND quality = 1) b_only FROM rated GROUP BY lang),
      p AS (SELECT *, ("both" + neither) / n::DOUBLE po, ("both" + a_only) / n::DOUBLE pa, ("both" + b_only) / n::DOUBLE pb FROM c)
      SELECT lang, n, "both", neither, a_only, b_only, (po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0) kappa, 2.0 * "both" / nullif(2 * "both" + a_only + b_only, 0)::DOUBLE AS positive FROM p""",
    "kappa_decompose": f"""WITH {RATED}, c AS (SELECT count(*) n, count(*) FILTER (r_prose = 1 AND quality = 1) AS "both", count(*) FILTER (r_prose = 0 AND quality = 0) AS neither, count(*) FILTER (r_prose = 1 AND quality = 0) a_only, count(*) FILTER (r_prose = 0 AND quality = 1) b_only FROM rated),
      p AS (SELECT *, ("both" + a_only) / n::DOUBLE pa, ("both" + b_only) / n::DOUBLE pb FROM c)
      SELECT n, ("both" + neither) / n::DOUBLE AS raw, pa * pb + (1 - pa) * (1 - pb) chance, 2.0 * "both" / (2 * "both" + a_only + b_only)::DOUBLE AS positive, neither / n::DOUBLE both_absent, (pa + pb) / 2 prevalence FROM p""",
    "kappa_multicat": """WITH d AS (SELECT lang, CASE WHEN n_chars < 500 THEN 's' WHEN n_chars < 2000 THEN 'm' ELSE 'l' END a, CASE WHEN len(string_split(text, ' ')) < 90 THEN 's' WHEN len(string_split(text, ' ')) < 380 THEN 'm' ELSE 'l' END b FROM documents),
      t AS (SELECT lang, count(*) n, avg((a = b)::INT::DOUBLE) po FROM d GROUP BY lang),
      x AS (SELECT p.lang, sum(na * nb) x FROM (SELECT lang, a c, count(*) na FROM d GROUP BY 1, 2) p JOIN (SELECT lang, b c, count(*) nb FROM d GROUP BY 1, 2) q USING (lang, c) GROUP BY p.lang)
      SELECT lang, n, po, coalesce(x, 0)::DOUBLE / (n * n) pe, (po - coalesce(x, 0)::DOUBLE / (n * n)) / nullif(1 - coalesce(x, 0)::DOUBLE / (n * n), 0) kappa FROM t LEFT JOIN x USING (lang)""",
    "rater_agreement": f"WITH {RATED}, {SAME} SELECT r1, r2, n, same FROM same",
    "rater_permutation": f"""WITH {RATED}, {SAME}, k AS (SELECT unnest(['gold', 'long', 'plain', 'prose']) c),
      d AS (SELECT c, avg(same) FILTER ((r1 = c) <> (r2 = c)) - avg(same) FILTER ((r1 = c) = (r2 = c)) d FROM k, same GROUP BY c)
      SELECT (SELECT d FROM d WHERE c = 'gold') observed, count(*) assignments, avg((abs(d) >= abs((SELECT d FROM d WHERE c = 'gold')) - 1e-12)::INT::DOUBLE) p FROM d""",
    "unanimity": """WITH e AS (SELECT user_id, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END b, min(event_type) f FROM events GROUP BY 1, 2), g AS (SELECT user_id, count(DISTINCT f) d, count(*) n FROM e GROUP BY user_id)
      SELECT count(*) slots, count(*) FILTER (d = 1 AND n = 3) AS unanimous, count(*) informative, count(*) FILTER (d = 1 AND n = 3) informative_unanimous FROM g""",
    "replicate_spread": "SELECT event_type, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) sd, count(*) n FROM (SELECT event_type, event_id % 3 r, avg(value) m FROM events GROUP BY 1, 2) t GROUP BY 1",
    "rank_auc": f"""WITH {RATED}, v AS (SELECT lang, quality, n_chars // 100 h FROM rated), r AS (SELECT lang, quality, {RANK.format(by='lang', v='h')} rk FROM v), t AS (SELECT lang, sum(c * c * c - c) ties FROM (SELECT lang, h, count(*)::DOUBLE c FROM v GROUP BY 1, 2) GROUP BY 1),
      g AS (SELECT r.lang, ties, count(*) FILTER (quality = 1) n_pos, count(*) FILTER (quality <> 1) n_neg, sum(rk) FILTER (quality = 1) s FROM r JOIN t ON t.lang = r.lang GROUP BY 1, 2)
      SELECT lang, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0)::DOUBLE, 6) auc, round((s - n_pos * (n_pos + 1) / 2.0 - n_pos * n_neg / 2.0) / nullif(sqrt(n_pos * n_neg * (n_pos + n_neg + 1) / 12.0 - n_pos * n_neg * ties / (12.0 * (n_pos + n_neg) * (n_pos + n_neg - 1))), 0), 6) z FROM g""",
    "rank_spearman": f"SELECT l_returnflag, round(corr(a, b), 6) rho FROM (SELECT l_returnflag, {RANK.format(by='l_returnflag', v='l_quantity')} a, {RANK.format(by='l_returnflag', v='l_extendedprice')} b FROM lineitem) t GROUP BY 1",
    "rank_kruskal": """WITH c AS (SELECT c_mktsegment, floor(c_acctbal / 1000) b FROM customer), r AS (SELECT c_mktsegment, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 rk FROM c), g AS (SELECT c_mktsegment, count(*)::DOUBLE k, sum(rk)::DOUBLE s FROM r GROUP BY 1),
      t AS (SELECT sum(c * c * c - c) ties FROM (SELECT count(*)::DOUBLE c FROM c GROUP BY b))
      SELECT count(*) AS groups, sum(k)::BIGINT n, round((12 * sum(s * s / k) / (sum(k) * (sum(k) + 1)) - 3 * (sum(k) + 1)) / (1 - (SELECT ties FROM t) / (sum(k) ** 3 - sum(k))), 4)::DOUBLE h FROM g""",
    "rank_wilcoxon": """WITH e AS (SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE 0 END) - sum(CASE WHEN event_id % 2 = 1 THEN floor(value) ELSE 0 END) d, min(event_type) kind FROM events GROUP BY user_id),
      r AS (SELECT kind, d, rank() OVER (PARTITION BY kind ORDER BY abs(d)) + (count(*) OVER (PARTITION BY kind, abs(d)) - 1) / 2.0 rk FROM e WHERE d <> 0), t AS (SELECT kind, sum(c * c * c - c) ties FROM (SELECT kind, abs(d), count(*)::DOUBLE c FROM r GROUP BY 1, 2) GROUP BY 1)
      SELECT r.kind, count(*) n, coalesce(sum(rk) FILTER (d > 0), 0.0)::DOUBLE w_plus, coalesce(sum(rk) FILTER (d < 0), 0.0)::DOUBLE w_minus,
        round((coalesce(sum(rk) FILTER (d > 0), 0.0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - any_value(ties) / 48), 6)::DOUBLE z FROM r JOIN t ON t.kind = r.kind GROUP BY r.kind""",
    "calibration_bins": f"""WITH {RATED}, b AS (SELECT * FROM (VALUES (0, 0.0, 0.05), (1, 0.05, 0.1), (2, 0.1, 0.2), (3, 0.2, 0.4), (4, 0.4, 0.8), (5, 0.8, 0.9999), (6, 0.9999, 1.0)) t(bin, lo, hi)),
      r AS (SELECT least(1.0, n_chars / 5000.0)::DOUBLE c, quality FROM rated)
      SELECT bin, lo::DOUBLE lo, hi::DOUBLE hi, count(c) n, round(avg(c), 6) mean_confidence, round(avg(CASE WHEN c IS NOT NULL THEN quality::DOUBLE END), 6) accuracy FROM b LEFT JOIN r ON c > lo::DOUBLE AND c <= hi::DOUBLE GROUP BY 1, 2, 3""",
    "tier_counts_cumulative": f"""WITH {RATED}, t AS (SELECT CASE WHEN n_chars < 200 THEN 1 WHEN n_chars < 1000 THEN 2 WHEN n_chars < 3000 THEN 3 ELSE 4 END k FROM rated), g AS (SELECT k, count(*) n FROM t GROUP BY k)
      SELECT ['exact', 'near', 'distant', 'wrong'][k] tier, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE pct, round(100.0 * sum(n) OVER (ORDER BY k) / sum(n) OVER (), 6)::DOUBLE cum_pct FROM g""",
    "confidence_score": f"WITH {RATED} SELECT source, round(0.3::DOUBLE * avg(r_plain::DOUBLE) + 0.5::DOUBLE * avg(r_prose::DOUBLE) + 0.2::DOUBLE * avg(r_long::DOUBLE), 6) confidence FROM rated GROUP BY source",
    "top_confusions": "SELECT left(source, 4) golden, lower(lang) predicted, count(*) n FROM documents GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5",
    "coverage_shares": f"WITH {RATED} SELECT source, round(avg((r_plain = 1 AND r_prose = 1)::INT::DOUBLE), 6) AS both, round(avg((r_plain = 1 AND r_prose = 0)::INT::DOUBLE), 6) a_only, round(avg((r_plain = 0 AND r_prose = 1)::INT::DOUBLE), 6) b_only, round(avg((r_plain = 1 OR r_prose = 1)::INT::DOUBLE), 6) AS either FROM rated GROUP BY source",
    "judge_stats": f"""WITH {RATED}, g AS (SELECT lang, count(*) n, count(*) FILTER (r_plain = 1 AND r_prose = 1 AND quality = 1 AND toxic = 0) correct, count(*) FILTER (toxic = 1) flagged FROM rated GROUP BY lang)
      SELECT *, round(correct / n::DOUBLE, 6) accuracy, round(coalesce(correct / nullif(n - flagged, 0)::DOUBLE, 0.0), 6) accuracy_unflagged FROM g""",
    "cosine_of_metrics": " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) cosine FROM lineitem" for a in ("l_discount", "l_extendedprice", "l_quantity", "l_tax") for b in ("l_discount", "l_extendedprice", "l_quantity", "l_tax") if a < b),
}

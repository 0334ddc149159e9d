"""Reports over the driver's tables: sources, projects, tiers, metrics and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X
from metaloom.operators import ontology as O
from metaloom.operators import reports as R
from metaloom.plans import ontology as G
from metaloom.session import table


def frequent_labels(spark, sf_dir):
    """Users seen in three events and in two types of them at least."""
    return R.frequent_labels(table(spark, sf_dir, "events"), "user_id", "event_type")


def group_summary(spark, sf_dir):
    s = R.summary(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return s.withColumn("mean", F.round("mean", 6))


def source_choice(spark, sf_dir):
    """Per status of orders how often each priority was chosen, where fifty have one."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 7 != 0, F.substring("o_orderpriority", 1, 1)).alias("choice"))
    return R.source_choice(o, ["year", "o_orderstatus"], "choice", ["1", "2", "3", "4", "5"], 50)


def _cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 4 == 0, "n/a").when(F.col("p_partkey") % 4 == 1, F.upper("p_type")).otherwise(F.col("p_type"))
    norm = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    return p.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("seq"), raw.alias("raw"), norm.alias("norm"), "p_brand", "p_name", "p_size")


CELLS = """cells AS (SELECT p_brand project, p_partkey seq, CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN upper(p_type) ELSE p_type END raw,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE p_type END norm, p_brand, p_name, p_size FROM part)"""
KNOWN = "CASE WHEN lower(trim({0})) NOT IN ('', 'unknown', 'n/a', 'na', 'none', 'null', 'not available', 'not applicable', 'not specified', 'not provided') THEN trim({0}) END"
RAW, NORM = KNOWN.format("raw"), KNOWN.format("norm")


def populated_fields(spark, sf_dir):
    """Known and distinct values of each project in three sources."""
    c = _cells(spark, sf_dir)
    long = c.select("project", F.lit("raw").alias("source"), F.col("raw").alias("value")).unionAll(c.select("project", F.lit("norm"), "norm")).unionAll(c.select("project", F.lit("name"), "p_name"))
    return R.populated(long, ["project", "source"], "value")


def _statuses(spark, sf_dir):
    c = _cells(spark, sf_dir)
    status = F.when(X.known("raw").isNull(), "empty").when(F.col("norm").isNull(), "unmapped").when(X.key("raw") == X.key("norm"), "exact").otherwise("semantic")
    return c.select(F.substring("project", 1, 7).alias("field"), F.substring_index("raw", " ", 1).alias("raw"), F.substring_index("norm", " ", 1).alias("norm"), status.alias("status"), (F.col("p_size") / 64.0).alias("similarity"), "seq")


def normalisation_report(spark, sf_dir):
    return R.normalisation_report(_statuses(spark, sf_dir), ["exact", "semantic", "unmapped"]).withColumn("place", F.col("place").cast("long"))


def table_summary(spark, sf_dir):
    return R.table_summary(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def joined_values(spark, sf_dir):
    return R.joined_values(_cells(spark, sf_dir), ["project"], "raw").withColumn("raw", F.md5("raw"))


def setup_kinds(spark, sf_dir):
    """Projects of the parts by how many size classes they have, and the sizes summed over runs of those with one."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("project"), (F.col("p_size") % 2 + F.when(F.col("p_partkey") % 97 < 30, F.col("p_size") % 2).otherwise(0)).alias("setup"), "p_partkey")
    p = p.withColumn("setup", F.when(F.col("project") < 50, F.lit(1)).otherwise(F.col("setup")))
    runs = p.select("project", "p_partkey")
    one = R.single_setup_runs(runs, p, "project", "setup", ["setup"]).groupBy("project").agg(F.count(F.lit(1)).alias("runs"), F.max("setup").alias("setup"))
    return R.setups(p, "project", "setup").join(one, "project", "left")


def _tiers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", ((F.col("p_partkey") % 101) / 100.0).alias("lin"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size") % 6).alias("hops"))
    tier = M.tier(F.col("p_partkey") % 10 == 0, F.col("lin"), F.coalesce("hops", F.lit(99)))
    return p.withColumn("tier", tier)


TIERS = """tiers AS (SELECT p_brand, p_partkey, p_size, (p_partkey % 101) / 100.0::DOUBLE lin, CASE WHEN p_partkey % 13 <> 0 THEN p_size % 6 END hops,
  CASE WHEN p_partkey % 10 = 0 THEN 'exact' WHEN (p_partkey % 101) / 100.0::DOUBLE >= 0.7::DOUBLE OR (p_partkey % 13 <> 0 AND p_size % 6 <= 2) THEN 'near'
       WHEN (p_partkey % 101) / 100.0::DOUBLE >= 0.35::DOUBLE OR (p_partkey % 13 <> 0 AND p_size % 6 <= 4) THEN 'distant' ELSE 'wrong' END tier FROM part)"""


def vocabulary_agreement(spark, sf_dir):
    a = R.agreement(_tiers(spark, sf_dir), ["p_brand"], "tier", "lin")
    return a.withColumns({c: F.round(c, 6) for c in ("exact_rate", "mean_lin", "near_or_exact")})


def depth_by_tier(spark, sf_dir):
    d = R.depth_by_tier(_tiers(spark, sf_dir), "tier", "hops")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


def class_matrix(spark, sf_dir):
    """The mean mass of each place of the vectors by label, over their five largest."""
    return R.top_mass(table(spark, sf_dir, "embeddings"), "label", "embedding", 5).withColumn("mean", F.round("mean", 6))


def argmax_class(spark, sf_dir):
    a = R.argmax(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 0.3)
    return a.select("vec_id", "place", F.round("top", 6).alias("top"))


def heterogeneity(spark, sf_dir):
    return R.heterogeneity(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag")


def rates_by_column(spark, sf_dir):
    r = R.rates_by_column(_cells(spark, sf_dir), [("raw", "norm"), ("norm", "raw"), ("p_brand", "norm")])
    return r.withColumns({c: F.round(c, 6) for c in ("raw_rate", "norm_rate", "equal_rate")})


def by_cardinality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 3 == 0, F.concat_ws(";", "o_orderstatus", "o_orderpriority")).otherwise(F.concat_ws(" ; ", "o_orderstatus", "o_orderstatus")).alias("v"), F.col("o_totalprice").cast("double").alias("s"))
    return R.by_cardinality(o, "v", "s").withColumn("mean", F.round("mean", 3))


def last_casing(spark, sf_dir):
    """Statuses of conversations' turns by conversation, as last written."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")).alias("v"))
    return R.last_casing(c, ["conv_id"], "v", "turn")


def _lines(spark, sf_dir):
    """Order lines with one of seven modes."""
    return table(spark, sf_dir, "lineitem").withColumn("l_shipmode", F.concat(F.lit("M"), ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("string")))


def set_coverage(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return R.set_coverage(li.select("l_suppkey", F.col("l_shipmode").alias("v")), li.filter("l_quantity > 45").select("l_suppkey", F.col("l_shipmode").alias("v")), "l_suppkey", "v").withColumn("coverage", F.round("coverage", 6))


def metric_differences(spark, sf_dir):
    """Where Lin, Wu and Palmer's and Jaccard's measures of supplier pairs differ most."""
    e, closed, nodes, whole = G.parts(spark, sf_dir)
    m = O.pair_metrics(G.pairs(spark, sf_dir), whole, O.information_content(nodes, closed), O.depths(nodes, e, closed), ("lin", "wu_palmer", "jaccard"))
    m = m.select("a", "b", *[F.round(c, 6).alias(c) for c in ("lin", "wu_palmer", "jaccard")])
    # in millionths, so that ties are ties
    m = m.withColumns({c: F.round(F.col(c) * 1e6).cast("long") for c in ("lin", "wu_palmer", "jaccard")})
    d = R.metric_differences(m, ["a", "b"], ["lin", "wu_palmer", "jaccard"])
    return d.withColumn("difference", F.col("difference") / 1e6).withColumn("rank", F.col("rank").cast("long"))


def separability(spark, sf_dir):
    """How measures set suppliers of one region apart from others."""
    e, closed, nodes, whole = G.parts(spark, sf_dir)
    m = O.pair_metrics(G.pairs(spark, sf_dir), whole, O.information_content(nodes, closed), O.depths(nodes, e, closed), ("lin", "wu_palmer", "jaccard"))
    m = m.withColumns({c: F.round(c, 6) for c in ("lin", "wu_palmer", "jaccard")})
    s = R.separability(m.withColumn("kind", F.when(F.col("b").startswith("N:"), "near").when(F.col("b").startswith("R:"), "conflict").otherwise("other")), "kind", "near", "conflict", ["lin", "wu_palmer", "jaccard"])
    return s.withColumns({c: F.round(c, 6) for c in ("near_mean", "conflict_mean", "gap", "ratio")}).withColumn("rank", F.col("rank").cast("long"))


def similarity_histogram(spark, sf_dir):
    h = R.histogram(_tiers(spark, sf_dir), "lin", 10)
    return h.withColumns({c: F.round(c, 6) for c in ("share", "cum_share")})


def cohort_funnel(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return R.funnel(d, [("all", F.lit(True)), ("english", F.col("lang") == "en"), ("long", F.col("n_chars") > 500), ("even", F.col("doc_id") % 2 == 0)]).withColumn("place", F.col("place").cast("long"))


def cohort_crosstab(spark, sf_dir):
    return R.crosstab(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"])


def value_categories(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return R.value_categories(e, ["user_id", "day"], "event_type").withColumn("day", F.col("day").cast("string"))


def first_with_all_sources(spark, sf_dir):
    """The twenty first parts that are shipped by three given modes: a limit that is the report's own."""
    li = _lines(spark, sf_dir)
    return R.first_n(R.with_all_sources(li, "l_partkey", "l_shipmode", ["M0", "M3", "M5"]), "l_partkey", 20)


def flagged_projects(spark, sf_dir):
    """Lines of the orders that have a returned line, by ship mode."""
    li = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipmode")
    return R.flagged_projects(li, "l_orderkey", F.col("l_returnflag") == "R").groupBy("l_shipmode").agg(F.count(F.lit(1)).alias("n"))


def acquisition_resolved(spark, sf_dir):
    """Suppliers with ship modes as their acquisitions: that of the expected name, where one is."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.when(F.col("s_suppkey") % 2 == 0, "M1").otherwise("NONE").alias("expected"))
    a = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("run"), F.col("l_shipmode").alias("acquisition"))
    return R.resolved_acquisition(s, a, ["run"], "expected")


def merged_metrics(spark, sf_dir):
    """Per brand the mean size, the mean price and the number of lines, for brands that all three know."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    a = p.groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size"))
    b = p.filter("p_size > 10").groupBy("p_brand").agg(F.count(F.lit(1)).alias("large"))
    c = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("lines"))
    return R.merged_metrics([a, b, c], ["p_brand"])


def list_lengths(spark, sf_dir):
    c = _cells(spark, sf_dir)
    k = (F.col("seq") % 301).alias("k")
    return R.list_lengths(c.select("project", k, F.col("raw").alias("value")).filter("k % 7 <> 0"), c.select("project", k, F.col("norm").alias("value")), ["project", "k"])


def anonymous_pairs(spark, sf_dir):
    """Priorities under other names, with the kind of pair that each makes with its order's status."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    a = R.anonymous(o, "o_orderpriority")
    return a.select("anonymous", R.pair_kind(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.substring("o_orderpriority", 1, 1)).alias("kind"), "n")


def first_known(spark, sf_dir):
    c = _cells(spark, sf_dir)
    f = R.first_known([(F.col("norm"), F.lit("norm")), (F.col("raw"), F.lit("raw")), (F.col("p_name"), F.lit("name"))])
    return c.select("seq", f["value"].alias("value"), f["node"].alias("node"))


def value_scores(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return c.select("seq", R.value_score(F.col("raw"), F.coalesce("norm", F.lit("")), F.col("p_size") / 50.0).alias("score"))


def subset_summary(spark, sf_dir):
    t = _tiers(spark, sf_dir)
    s = R.subsets(t, [("all", F.lit(True)), ("known", F.col("hops").isNotNull()), ("small", F.col("p_size") < 10)], [("exact", F.col("tier") == "exact"), ("wrong", F.col("tier") == "wrong")])
    return s.withColumns({c: F.round(c, 6) for c in ("exact", "wrong")})


QUERIES = {f.__name__: f for f in (frequent_labels, group_summary, source_choice, populated_fields, normalisation_report, table_summary, joined_values, setup_kinds, vocabulary_agreement, depth_by_tier, class_matrix, argmax_class, heterogeneity, rates_by_column, by_cardinality, last_casing, set_coverage, metric_differences, separability, similarity_histogram, cohort_funnel, cohort_crosstab, value_categories, first_with_all_sources, flagged_projects, acquisition_resolved, merged_metrics, list_lengths, anonymous_pairs, first_known, value_scores, subset_summary)}

LINES = "li AS (SELECT *, 'M' || (l_partkey + l_linenumber) % 7 l_shipmode FROM lineitem)"
METRICS = f"{G.HEAD}{G.BEST}, m AS (SELECT a, b, " + ", ".join(f"{G.METRICS[m]} AS {m}" for m in ("lin", "wu_palmer", "jaccard")) + " FROM j)"
ORACLES = {
    "frequent_labels": "SELECT user_id, count(*) mentions, count(DISTINCT event_type) annotators FROM events GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT event_type) >= 2",
    "group_summary": "SELECT c_mktsegment, count(c_acctbal) n, round(avg(c_acctbal), 6) mean, min(c_acctbal) low, max(c_acctbal) high FROM customer GROUP BY 1",
    "source_choice": "SELECT year(o_orderdate)::INT AS year, o_orderstatus, count(*) FILTER (o_orderkey % 7 <> 0) populated, " + ", ".join(f"count(*) FILTER (o_orderkey % 7 <> 0 AND left(o_orderpriority, 1) = '{k}') n_{k}" for k in range(1, 6)) + " FROM orders GROUP BY 1, 2 HAVING populated >= 50",
    "populated_fields": f"WITH {CELLS}, l AS (SELECT project, 'raw' AS source, {RAW} v FROM cells UNION ALL SELECT project, 'norm', {NORM} FROM cells UNION ALL SELECT project, 'name', {KNOWN.format('p_name')} FROM cells) SELECT project, source, count(v) populated, count(DISTINCT v) distinct_values FROM l GROUP BY 1, 2",
    "normalisation_report": f"""WITH {CELLS}, s AS (SELECT left(project, 7) field, string_split(raw, ' ')[1] raw, string_split(norm, ' ')[1] norm, CASE WHEN {RAW} IS NULL THEN 'empty' WHEN norm IS NULL THEN 'unmapped' WHEN lower(raw) = lower(norm) THEN 'exact' ELSE 'semantic' END status, p_size / 64.0::DOUBLE similarity, seq FROM cells),
      g AS (SELECT field, raw, norm, status, count(*) n, arg_max(similarity, seq) similarity FROM s GROUP BY 1, 2, 3, 4)
      SELECT *, row_number() OVER (PARTITION BY field ORDER BY CASE status WHEN 'exact' THEN 1 WHEN 'semantic' THEN 2 WHEN 'unmapped' THEN 3 ELSE 4 END, n DESC, raw NULLS FIRST, norm NULLS FIRST) place FROM g""",
    "table_summary": "WITH l AS (SELECT 'o_orderstatus' AS col, o_orderstatus v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) SELECT col AS column, count(*) n, count(DISTINCT v) n_values, string_agg(DISTINCT v, '; ' ORDER BY v) shown FROM l GROUP BY 1",
    "joined_values": f"WITH {CELLS} SELECT project, md5(string_agg(DISTINCT {RAW}, '; ' ORDER BY {RAW})) raw FROM cells GROUP BY 1",
    "setup_kinds": """WITH p AS (SELECT p_partkey % 97 project, CASE WHEN p_partkey % 97 < 50 THEN 1 ELSE p_size % 2 + CASE WHEN p_partkey % 97 < 30 THEN p_size % 2 ELSE 0 END END setup FROM part)
      SELECT project, count(DISTINCT setup) n_setups, CASE WHEN count(DISTINCT setup) = 1 THEN 'single' ELSE 'multi' END kind, CASE WHEN count(DISTINCT setup) = 1 THEN count(*) END runs, CASE WHEN count(DISTINCT setup) = 1 THEN max(setup) END setup FROM p GROUP BY 1""",
    "vocabulary_agreement": f"WITH {TIERS} SELECT p_brand, count(*) n, round(avg((tier = 'exact')::INT), 6) exact_rate, round(avg(lin), 6) mean_lin, round(avg((tier IN ('exact', 'near'))::INT), 6) near_or_exact FROM tiers GROUP BY 1",
    "depth_by_tier": f"WITH {TIERS} SELECT tier, count(*) n, round(avg(hops), 6) mean, round(median(hops), 6)::DOUBLE median FROM tiers GROUP BY 1",
    "class_matrix": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE v, unnest(range(len(embedding))) place FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, place) k FROM x), n AS (SELECT label, count(*) n FROM embeddings GROUP BY 1)
      SELECT r.label, place::INT place, round(sum(v) / n.n, 6) mean FROM r JOIN n ON n.label = r.label WHERE k <= 5 GROUP BY r.label, place, n.n""",
    "argmax_class": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE v, unnest(range(len(embedding))) place FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, place) k FROM x) SELECT vec_id, place::INT place, round(v, 6) top FROM r WHERE k = 1 AND v >= 0.3""",
    "heterogeneity": "SELECT l_suppkey, count(*) runs, count(DISTINCT l_returnflag) n_predicted, count(DISTINCT l_returnflag) > 1 heterogeneous FROM lineitem GROUP BY 1",
    "rates_by_column": f"""WITH {CELLS}, l AS (SELECT 'raw' AS col, {RAW} a, {NORM} b FROM cells UNION ALL SELECT 'norm', {NORM}, {RAW} FROM cells UNION ALL SELECT 'p_brand', p_brand, {NORM} FROM cells)
      SELECT col AS column, count(*) n, round(avg((a IS NOT NULL)::INT), 6) raw_rate, round(avg((b IS NOT NULL)::INT), 6) norm_rate, round(avg((lower(a) = lower(b))::INT), 6) equal_rate FROM l GROUP BY 1""",
    "by_cardinality": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'multi' ELSE 'single' END cardinality, count(*) n, round(avg(o_totalprice::DOUBLE), 3) mean FROM orders GROUP BY 1",
    "last_casing": "SELECT conv_id, arg_max(CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END, turn) v FROM conversations GROUP BY conv_id, lower(role)",
    "set_coverage": f"WITH {LINES}, p AS (SELECT l_suppkey, count(DISTINCT l_shipmode) n FROM li GROUP BY 1), a AS (SELECT l_suppkey, count(DISTINCT l_shipmode) m FROM li WHERE l_quantity > 45 GROUP BY 1 HAVING m >= 2) SELECT l_suppkey, n::INT n_predicted, m::INT n_annotated, round(m / n::DOUBLE, 6) coverage FROM p JOIN a USING (l_suppkey)",
    "similarity_histogram": f"WITH {TIERS}, g AS (SELECT greatest(0, least(9, floor(lin * 10)))::INT bin, count(*) n FROM tiers GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 6)::DOUBLE share, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6)::DOUBLE cum_share FROM g",
    "cohort_funnel": "SELECT 'all' step, 0 place, count(*) n FROM documents UNION ALL SELECT 'english', 1, count(*) FILTER (lang = 'en') FROM documents UNION ALL SELECT 'long', 2, count(*) FILTER (lang = 'en' AND n_chars > 500) FROM documents UNION ALL SELECT 'even', 3, count(*) FILTER (lang = 'en' AND n_chars > 500 AND doc_id % 2 = 0) FROM documents",
    "cohort_crosstab": "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{k}') {k}" for k in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1",
    "value_categories": "SELECT user_id, ts::DATE::VARCHAR AS day, string_agg(DISTINCT lower(event_type), '; ' ORDER BY lower(event_type)) category FROM events GROUP BY 1, 2",
    "first_with_all_sources": f"WITH {LINES} SELECT l_partkey FROM li WHERE l_shipmode IN ('M0', 'M3', 'M5') GROUP BY 1 HAVING count(DISTINCT l_shipmode) = 3 ORDER BY 1 LIMIT 20",
    "flagged_projects": f"WITH {LINES} SELECT l_shipmode, count(*) n FROM li WHERE l_orderkey IN (SELECT l_orderkey FROM li WHERE l_returnflag = 'R') GROUP BY 1",
    "acquisition_resolved": f"""WITH {LINES}, j AS (SELECT DISTINCT s_suppkey run, CASE WHEN s_suppkey % 2 = 0 THEN 'M1' ELSE 'NONE' END expected, l_shipmode acquisition FROM supplier LEFT JOIN li ON l_suppkey = s_suppkey), w AS (SELECT *, max((acquisition IS NOT DISTINCT FROM expected)::INT) OVER (PARTITION BY run) x FROM j)
      SELECT run, expected, acquisition FROM w WHERE x = 0 OR acquisition = expected""",
    "merged_metrics": "SELECT p_brand, round(avg(p_size), 6) size, count(*) FILTER (p_size > 10) large, (SELECT count(*) FROM lineitem JOIN part q ON l_partkey = q.p_partkey WHERE q.p_brand = p.p_brand) AS lines FROM part p GROUP BY 1 HAVING large > 0 AND lines > 0",
    "list_lengths": f"""WITH {CELLS}, a AS (SELECT project, seq % 301 k, count({RAW}) n FROM cells WHERE seq % 301 % 7 <> 0 GROUP BY 1, 2), b AS (SELECT project, seq % 301 k, count({NORM}) m FROM cells GROUP BY 1, 2), j AS (SELECT project, k, coalesce(n, 0) n_raw, coalesce(m, 0) n_norm FROM a FULL JOIN b USING (project, k))
      SELECT *, CASE WHEN n_raw > 0 AND n_norm = 0 THEN 'missing' WHEN n_raw = 0 AND n_norm > 0 THEN 'extra' WHEN n_raw = n_norm THEN 'same' WHEN n_norm < n_raw THEN 'fewer' ELSE 'more' END status FROM j""",
    "anonymous_pairs": "SELECT 'R' || dense_rank() OVER (ORDER BY o_orderpriority) anonymous, left(o_orderpriority, 1) || '-' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'unknown' END kind, count(*) n FROM orders GROUP BY o_orderpriority, o_orderstatus",
    "first_known": f"WITH {CELLS} SELECT seq, coalesce({NORM}, {RAW}, {KNOWN.format('p_name')}) AS value, CASE WHEN {NORM} IS NOT NULL THEN 'norm' WHEN {RAW} IS NOT NULL THEN 'raw' WHEN {KNOWN.format('p_name')} IS NOT NULL THEN 'name' END node FROM cells",
    "value_scores": f"WITH {CELLS} SELECT seq, CASE WHEN lower(raw) = lower(coalesce(norm, '')) OR p_size / 50.0 >= 0.75 THEN 1.0 ELSE 0.0 END::DOUBLE score FROM cells",
    "subset_summary": f"WITH {TIERS}, l AS (SELECT 'all' subset, * FROM tiers UNION ALL SELECT 'known', * FROM tiers WHERE hops IS NOT NULL UNION ALL SELECT 'small', * FROM tiers WHERE p_size < 10) SELECT subset, count(*) n, round(avg((tier = 'exact')::INT), 6) AS exact, round(avg((tier = 'wrong')::INT), 6) AS wrong FROM l GROUP BY 1",
    "metric_differences": METRICS + """, d AS (SELECT 'lin' AS first, 'wu_palmer' AS second, a, b, round(abs(lin - wu_palmer), 6) difference FROM m UNION ALL SELECT 'lin', 'jaccard', a, b, round(abs(lin - jaccard), 6) FROM m UNION ALL SELECT 'wu_palmer', 'jaccard', a, b, round(abs(wu_palmer - jaccard), 6) FROM m),
      r AS (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY difference DESC, a, b) AS rank FROM d) SELECT * FROM r WHERE rank <= 5""",
    "separability": METRICS + """, l AS (SELECT 'lin' metric, b, lin v FROM m UNION ALL SELECT 'wu_palmer', b, wu_palmer FROM m UNION ALL SELECT 'jaccard', b, jaccard FROM m),
      g AS (SELECT metric, avg(v) FILTER (b LIKE 'N:%') x, avg(v) FILTER (b LIKE 'R:%') y FROM l GROUP BY 1)
      SELECT metric, round(x, 6) near_mean, round(y, 6) conflict_mean, round(x - y, 6) gap, round(x / nullif(y, 0), 6) ratio, row_number() OVER (ORDER BY x - y DESC, metric) AS rank FROM g""",
}

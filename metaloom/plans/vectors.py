"""Vector and value matching over embeddings and derived strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.operators import evaluation as E
from metaloom.operators import matching as V
from metaloom.session import table


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def knn_topk(spark, sf_dir):
    """The five nearest by cosine of every twentieth vector among all."""
    v = vecs(spark, sf_dir)
    return V.knn(v.filter("id % 20 = 0"), v, 5).withColumn("cosine", F.round("cosine", 6))


def knn_label_votes(spark, sf_dir):
    """Of each query the label most of its ten nearest have, and whether it is its own."""
    v = vecs(spark, sf_dir)
    n = V.knn(v.filter("id % 20 = 0"), v, 10).join(v.select("id", "label"), "id")
    top = n.groupBy("q", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("q").agg(F.min(F.struct((-F.col("c")).alias("m"), "label")).alias("b"))
    own = v.select(F.col("id").alias("q"), F.col("label").alias("golden"))
    return top.join(own, "q").select("q", F.col("b.label").alias("predicted"), "golden")


def confusion_pivot(spark, sf_dir):
    """Golden against voted label."""
    c = knn_label_votes(spark, sf_dir)
    return c.groupBy("golden").pivot("predicted", list(range(10))).count().na.fill(0).select("golden", *[F.col(str(k)).alias(f"p{k}") for k in range(10)])


def cosine_threshold_pairs(spark, sf_dir):
    return V.threshold_pairs(vecs(spark, sf_dir), ["label"], 0.35).withColumn("cosine", F.round("cosine", 6))


def value_clusters(spark, sf_dir):
    """Clusters within labels of vectors linked by a cosine of .3."""
    v = vecs(spark, sf_dir)
    return V.clusters(v.select("id"), V.threshold_pairs(v, ["label"], 0.3).select("a", "b"))


def max_sim_sets(spark, sf_dir):
    """The greatest cosine between each label's even and odd rows."""
    p = V.best_between(vecs(spark, sf_dir), ["label"], F.col("id") % 2).select(F.col("label").alias("id"), "cosine")
    return V.max_similarity(p).select(F.col("id").alias("label"), F.round("best", 6).alias("best"))


def coverage_vector(spark, sf_dir):
    """Per label the mean share of components above zero, and the sum vector's first four components."""
    v = vecs(spark, sf_dir)
    x = v.select("label", (F.size(F.filter("vec", lambda c: c > 0)) / F.size("vec")).alias("share"), *[F.col("vec")[k].cast("double").alias(f"c{k}") for k in range(4)])
    return x.groupBy("label").agg(F.round(F.avg("share"), 6).alias("coverage"), *[F.round(F.sum(f"c{k}"), 5).alias(f"s{k}") for k in range(4)])


def topk_restricted_choice(spark, sf_dir):
    """The first of a vector's five largest places that is even."""
    v = vecs(spark, sf_dir)
    order = F.transform(F.slice(F.array_sort(F.transform("vec", lambda x, i: F.struct((-x.cast("double")).alias("m"), i.alias("i")))), 1, 5), lambda s: s["i"])
    return v.select("id", V.restricted_choice(order, F.sequence(F.lit(0), F.lit(62), F.lit(2))).alias("choice"))


def _scored(spark, sf_dir):
    v = vecs(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 12))
    x = v.filter("id % 2 = 0").select("g", F.col("id").alias("i"), F.col("vec").alias("va"))
    y = v.filter("id % 2 = 1").select("g", F.col("id").alias("j"), F.col("vec").alias("vb"))
    return x.join(y, "g").select("g", "i", "j", F.round(M.cosine(F.col("va"), F.col("vb")), 6).alias("s"))


def greedy_match(spark, sf_dir):
    return E.one_to_one(_scored(spark, sf_dir), ["g"], "greedy")


def optimal_match(spark, sf_dir):
    return E.one_to_one(_scored(spark, sf_dir), ["g"], "optimal").withColumn("s", F.round("s", 6))


def five_level_match(spark, sf_dir):
    """Part names against altered ones, by kind and score."""
    p = table(spark, sf_dir, "part")
    altered = F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("  "), F.upper("p_name"))).when(F.col("p_partkey") % 6 == 2, F.lit("n/a")).when(F.col("p_partkey") % 6 == 3, F.concat(F.col("p_size").cast("string"), F.lit(" units"))).otherwise(F.col("p_type"))
    golden = F.when(F.col("p_partkey") % 6 == 3, F.concat((F.col("p_size") + F.col("p_partkey") % 2).cast("string"), F.lit(".0"))).otherwise(F.col("p_name"))
    hops = F.when(F.col("p_partkey") % 6 == 4, F.col("p_size") % 7)
    cosine = F.when(F.col("p_partkey") % 6 == 5, F.col("p_size") / 50.0)
    kind, score = V.compare(golden, altered, F.lit(None).cast("string"), F.lit(None).cast("string"), hops, cosine)
    return p.select("p_partkey", kind.alias("kind"), F.round(score, 6).alias("score"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_label_votes, confusion_pivot, cosine_threshold_pairs, value_clusters, max_sim_sets, coverage_vector, topk_restricted_choice, greedy_match, optimal_match, five_level_match)}

COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
CLIP = "greatest(0.0, least(1.0, " + COS + "))"
NEAR = f"""n AS (SELECT q.vec_id q, v.vec_id id, {CLIP.format('q.embedding', 'v.embedding')} c, v.label, q.label golden, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format('q.embedding', 'v.embedding')} DESC, v.vec_id) rank
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""
VOTES = f"""{NEAR}, votes AS (SELECT q, golden, label, count(*) c FROM n WHERE rank <= 10 GROUP BY 1, 2, 3), best AS (SELECT q, golden, first(label ORDER BY c DESC, label) predicted FROM votes GROUP BY 1, 2)"""
PAIRS = f"p AS (SELECT x.label, x.vec_id a, y.vec_id b, {CLIP.format('x.embedding', 'y.embedding')} c FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)"
ORACLES = {
    "knn_topk": f"WITH {NEAR} SELECT q, rank::INT rank, id, round(c, 6) cosine FROM n WHERE rank <= 5",
    "knn_label_votes": f"WITH {VOTES} SELECT q, predicted, golden FROM best",
    "confusion_pivot": f"WITH {VOTES} SELECT golden, " + ", ".join(f"count(*) FILTER (predicted = {k}) p{k}" for k in range(10)) + " FROM best GROUP BY golden",
    "cosine_threshold_pairs": f"WITH {PAIRS} SELECT label, a, b, round(c, 6) cosine FROM p WHERE c >= 0.35",
    "value_clusters": f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p WHERE c >= 0.3 UNION SELECT b, a FROM p WHERE c >= 0.3),
      r AS (SELECT vec_id id, vec_id c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id""",
    "max_sim_sets": f"WITH {PAIRS} SELECT label, round(max(c), 6) best FROM p WHERE a % 2 <> b % 2 GROUP BY label",
    "coverage_vector": "SELECT label, round(avg(len(list_filter(embedding, lambda x: x > 0)) / len(embedding)::DOUBLE), 6) coverage, " + ", ".join(f"round(sum(embedding[{k + 1}]::DOUBLE), 5) s{k}" for k in range(4)) + " FROM embeddings GROUP BY label",
    "topk_restricted_choice": """WITH x AS (SELECT vec_id id, unnest(embedding) v, unnest(range(64)) i FROM embeddings), r AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) k FROM x)
      SELECT id, first(CASE WHEN i % 2 = 0 AND k <= 5 THEN i END ORDER BY CASE WHEN i % 2 = 0 AND k <= 5 THEN k ELSE 99 END)::INT choice FROM r GROUP BY id""",
    "five_level_match": """WITH t AS (SELECT p_partkey, p_partkey % 6 m, p_size, p_name, p_type FROM part)
      SELECT p_partkey, CASE m WHEN 0 THEN 'EXACT' WHEN 1 THEN 'NORMALIZED' WHEN 2 THEN 'MISSING' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'NORMALIZED' ELSE 'NO_MATCH' END
          WHEN 4 THEN CASE WHEN p_size % 7 BETWEEN 1 AND 4 THEN 'HIERARCHICAL' ELSE 'NO_MATCH' END ELSE CASE WHEN p_size / 50.0 >= 0.75 THEN 'SEMANTIC' ELSE 'NO_MATCH' END END kind,
        round(CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.0 WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.95 ELSE 0.0 END
          WHEN 4 THEN CASE p_size % 7 WHEN 1 THEN 0.90 WHEN 2 THEN 0.87 WHEN 3 THEN 0.83 WHEN 4 THEN 0.80 ELSE 0.0 END ELSE p_size / 50.0 END, 6)::DOUBLE score FROM t""",
}

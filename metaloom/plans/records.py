"""Records of mixed shapes over derived values."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import records as P
from metaloom.session import table

L = F.lit


def _s(c):
    return F.col(c).cast("string")


def rendered_prompts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = P.rendered("Field {{ name }} of {{brand}}: {{ none }}{{ other }}.", {"name": F.col("p_name"), "brand": F.col("p_brand"), "none": L(None)})
    return p.select("p_partkey", t.alias("prompt"))


def mixed_terms(spark, sf_dir):
    """Terms of cells of four shapes."""
    p = table(spark, sf_dir, "part")
    m, n, b = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    cell = (
        F.when(m == 0, F.to_json(F.struct(L("n/a").alias("ontology_name"), n.alias("name")))).when(m == 1, F.to_json(F.array(F.struct(b.alias("value")), F.struct(n.alias("value")), F.struct(b.alias("value")))))
        .when(m == 2, F.to_json(F.array(n, L("unknown"), b))).otherwise(F.concat(n, L("; n/a ;"), b, L("; "), n))
    )
    return p.select("p_partkey", F.array_join(P.terms_of(cell), "|").alias("terms"))


def value_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    i = F.array(F.struct(F.col("p_name").alias("value"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("ontology_name")), F.struct(L("n/a").alias("value"), L("x").alias("ontology_name")))
    return p.select("p_partkey", F.explode(P.raw_and_normalised(i)).alias("x")).select("p_partkey", "x.*")


def backfilled(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = lambda k, v: p.filter(f"p_partkey % {k} = 0").select(F.col("p_partkey").alias("id"), L("f").alias("field"), v.alias("value"))
    return P.backfilled(t(2, F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_name"))), t(3, F.col("p_brand")), t(1, F.col("p_type")))


PRINTED = {  # lines of properties by the customer's key
    "kinds": ("Experiment types: Shotgun proteomics; SWATH MS", "EXPERIMENT TYPES : ;", "experiment types:Top-down"),
    "tools": ("Instruments: LTQ Orbitrap; Q Exactive ;", "Instruments: timsTOF Pro", "Instruments: Q Exactive", "No line of it"),
    "labels": ("Quantification: TMT", "Quantification: first\nquantification: Label free; second"),
}


def technical_records(spark, sf_dir):
    """Technical records of customers by property lines printed for them."""
    k = F.col("c_custkey")
    pick = lambda name: F.element_at(F.array(*[L(x) for x in PRINTED[name]]), (k % len(PRINTED[name]) + 1).cast("int"))
    name = F.concat(L("Modifications: "), F.col("c_mktsegment"), L("; Oxidation"))
    text = F.concat_ws("\n", L("Instruments: Astral"), L(" === PRIDE PROJECT PROPERTIES === "), pick("kinds"), pick("tools"), name, pick("labels"), L("=== METHODS ==="), L("Instruments: Orbitrap Astral"))
    return P.technical_record(table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text")))


def distinct_raters(spark, sf_dir):
    """Raters of customers: the third repeats the first's work, the second differs in one label."""
    c = table(spark, sf_dir, "customer")
    value = lambda r: F.when((F.col("c_custkey") == 3) & L(r == "b"), "other").otherwise(F.col("c_mktsegment"))
    a = None
    for r in ("a", "b", "c"):
        rows = c.select(L(r).alias("rater"), F.col("c_custkey").alias("doc"), L("seg").alias("label"), value(r).alias("value"))
        a = rows if a is None else a.unionAll(rows)
    return P.distinct_raters(a).groupBy("rater").agg(F.count(L(1)).alias("n"))


def species_stanzas(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("taxon"), F.concat(L("Genus "), F.translate(F.lower("n_name"), "0123456789_ ", "abcdefghijkl")).alias("name"), F.array(F.lower("n_name")).alias("common"))
    return P.obo_text(n, "NCBI")


def rescored_pairs(spark, sf_dir):
    """Neighbouring vectors as pairs of terms, scored again by them."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("vec"), "vec_id")
    pairs = v.select(F.col("term").alias("a"), (F.col("vec_id") + 1).cast("string").alias("b"), F.when(F.col("vec_id") % 3 == 0, "EXACT").otherwise("SEMANTIC").alias("kind"), F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.8).alias("score"))
    return P.rescored(pairs, v, 0.2).withColumn("score", F.round("score", 6))


def staged_files(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(_s("conv_id").alias("id"), F.col("role").alias("agent"), F.when(F.col("turn") % 2 == 0, "normalised").otherwise("raw").alias("stage")).distinct()
    return P.staged(c, {"user": "UserAgent"})


def preflight_problems(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return P.preflight(n.select(_s("n_nationkey").alias("name"), L(100).alias("least_bytes")), s.filter("s_nationkey % 3 <> 0").select(_s("s_nationkey").alias("name"), F.col("s_suppkey").alias("bytes")))


def checked_shards(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("shard"))
    return P.checked_counts(d, d.withColumn("norm", F.col("doc_id") + 1), "shard")


def text_supports(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    m, w = F.col("n_nationkey") % 3, F.translate(F.lower("n_name"), " _", "xx")
    needle = F.concat(L("Homo "), w)
    text = F.when(m == 0, F.concat(L("we took HOMO  "), F.upper(w), L(" cells"))).when(m == 1, F.concat(L("the h. "), w, L(" line"))).otherwise(L("none of it"))
    return n.select("n_nationkey", P.text_support(needle, text).alias("support"))


QUERIES = {f.__name__: f for f in (rendered_prompts, mixed_terms, value_pairs, backfilled, technical_records, distinct_raters, species_stanzas, rescored_pairs, staged_files, preflight_problems, checked_shards, text_supports)}
ORACLES = {
    "rendered_prompts": "SELECT p_partkey, 'Field ' || p_name || ' of ' || p_brand || ': {{ other }}.' prompt FROM part",
    "mixed_terms": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '|' || p_name ELSE p_name || '|' || p_brand END terms FROM part",
    "value_pairs": "SELECT p_partkey, p_name raw, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END norm FROM part",
    "backfilled": "SELECT p_partkey id, 'f' field, CASE WHEN p_partkey % 2 = 0 AND p_size % 5 <> 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS value, CASE WHEN p_partkey % 2 = 0 AND p_size % 5 <> 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END place FROM part",
    "technical_records": """
WITH c AS (SELECT c_custkey id, c_custkey % 3 k, c_custkey % 4 t, c_custkey % 2 q, 'Modifications: ' || c_mktsegment || '; Oxidation' m, c_mktsegment s FROM customer),
told AS (
  SELECT id, 'acquisition_method' field, 0 seq, CASE k WHEN 0 THEN 'Shotgun proteomics' ELSE 'Top-down' END AS value, CASE k WHEN 0 THEN 'Experiment types: Shotgun proteomics; SWATH MS' ELSE 'experiment types:Top-down' END evidence FROM c WHERE k <> 1
  UNION ALL SELECT id, 'acquisition_method', 1, 'SWATH MS', 'Experiment types: Shotgun proteomics; SWATH MS' FROM c WHERE k = 0
  UNION ALL SELECT id, 'instrument', 0, CASE t WHEN 0 THEN 'LTQ Orbitrap' WHEN 1 THEN 'timsTOF Pro' ELSE 'Q Exactive' END, 'Instruments: ' || CASE t WHEN 0 THEN 'LTQ Orbitrap; Q Exactive ;' WHEN 1 THEN 'timsTOF Pro' ELSE 'Q Exactive' END FROM c WHERE t <> 3
  UNION ALL SELECT id, 'instrument', 1, 'Q Exactive', 'Instruments: LTQ Orbitrap; Q Exactive ;' FROM c WHERE t = 0
  UNION ALL SELECT id, 'mass_analyzer', 0, 'Orbitrap', 'inferred: Instruments: LTQ Orbitrap; Q Exactive ;' FROM c WHERE t = 0
  UNION ALL SELECT id, 'ptm', 0, s, m FROM c UNION ALL SELECT id, 'ptm', 1, 'Oxidation', m FROM c
  UNION ALL SELECT id, 'labeling', 0, CASE q WHEN 0 THEN 'TMT' ELSE 'Label free' END, CASE q WHEN 0 THEN 'Quantification: TMT' ELSE 'quantification: Label free; second' END FROM c
  UNION ALL SELECT id, 'labeling', 1, 'second', 'quantification: Label free; second' FROM c WHERE q = 1),
f AS (SELECT unnest(['acquisition_method', 'alkylation_concentration', 'alkylation_reagent', 'cleavage_agent', 'collision_energy', 'enrichment_method', 'fractionation_method', 'fragmentation_method',
  'instrument', 'ionization_type', 'labeling', 'mass_analyzer', 'ptm', 'reduction_concentration', 'reduction_reagent']) field)
SELECT * FROM told UNION ALL SELECT id, field, 0, 'unknown', '' FROM c, f WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.id = c.id AND t.field = f.field)""",
    "distinct_raters": "SELECT r rater, count(*) n FROM customer, (VALUES ('a'), ('b')) t(r) GROUP BY 1",
    "species_stanzas": "WITH n AS (SELECT n_nationkey k, lower(n_name) c, translate(lower(n_name), '0123456789_ ', 'abcdefghijkl') s FROM nation) SELECT 'NCBI:' || k id, concat_ws(chr(10), '[Term]', 'id: NCBI:' || k, 'name: Genus ' || s, 'synonym: \"' || c || '\" EXACT []', 'synonym: \"g.' || s || '\" RELATED []', 'synonym: \"g. ' || s || '\" RELATED []', 'synonym: \"genus.' || s || '\" RELATED []') stanza FROM n",
    "rescored_pairs": """WITH p AS (SELECT x.vec_id a, x.vec_id + 1 b, greatest(0.0, least(1.0, coalesce(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 0.0))) c FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 1)
      SELECT a::VARCHAR a, b::VARCHAR b, CASE WHEN a % 3 = 0 THEN 'EXACT' WHEN c >= 0.2 THEN 'SEMANTIC' ELSE 'NO_MATCH' END kind, round(CASE WHEN a % 3 = 0 THEN 1.0 ELSE c END, 6) score FROM p""",
    "staged_files": "SELECT DISTINCT conv_id::VARCHAR id, role agent, CASE WHEN turn % 2 = 0 THEN 'normalised' ELSE 'raw' END stage, CASE WHEN turn % 2 = 0 THEN 'NormalizedAgent/' ELSE '' END || CASE role WHEN 'user' THEN 'UserAgent' ELSE role END || '/' || conv_id || '_' || role || '.json' target FROM conversations",
    "preflight_problems": "WITH p AS (SELECT s_nationkey k, max(s_suppkey) b FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) SELECT n_nationkey::VARCHAR AS name, CASE WHEN b IS NULL THEN 'missing' ELSE 'too_small' END problem FROM nation LEFT JOIN p ON k = n_nationkey WHERE b IS NULL OR b < 100",
    "checked_shards": "SELECT doc_id, doc_id % 8 shard, doc_id + 1 norm FROM documents",
    "text_supports": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.0 END::DOUBLE support FROM nation",
}

"""Normalisation, consistency, concordance and grounding over derived items."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import grounding as D
from metaloom.operators import normalisation as N
from metaloom.operators import ontology as O
from metaloom.operators import paths as P
from metaloom.plans import ontology as G
from metaloom.session import table


def _items(spark, sf_dir):
    """Parts' names, types, lines and odd values as items of four fields."""
    p = table(spark, sf_dir, "part")
    fields = [("name", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))), ("type", F.col("p_type")), ("line", F.concat(F.lit("He-La "), (F.col("p_size") % 4).cast("string"))), ("other", F.col("p_brand"))]
    return p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields])).alias("x")).select(F.col("p_partkey").alias("id"), "x.field", F.lit(0).alias("seq"), "x.value")


def _normalised(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    router = spark.createDataFrame([("name", "tissue"), ("type", "disease"), ("line", "cell_line")], "field string, entity string")
    names = p.filter("p_size % 2 = 0").select(F.lit("tissue").alias("entity"), F.concat(F.lit("T:"), F.length("p_name").cast("string"), F.lit("-"), F.left("p_name", F.lit(1))).alias("node"), F.col("p_name").alias("name")).distinct()
    synonyms = p.filter("p_size % 3 = 0").select(F.lit("tissue").alias("entity"), F.concat(F.lit("S:"), F.left("p_name", F.lit(2))).alias("node"), F.col("p_name").alias("synonym"), F.lit("EXACT").alias("scope")).distinct()
    t = p.select(F.col("p_type").alias("term")).distinct()
    n = (F.length("term") % 10).cast("double") / 10
    near = t.select(F.lit("disease").alias("entity"), "term", F.lit(False).alias("expanded"), F.lit("D:1").alias("node"), F.lower("term").alias("name"), n.alias("similarity"))
    near = near.unionAll(t.select(F.lit("disease"), "term", F.lit(True), F.lit("D:2"), F.lit("expanded"), F.when(F.length("term") % 2 == 0, 0.8).otherwise(0.1)))
    overrides = spark.createDataFrame([("disease", "EXPANDED", "forced")], "entity string, source string, target string")
    lines = spark.createDataFrame([(1, "HeLa 1", "hela(1)"), (2, "Other", "HELA-1"), (3, "HeLa 2", "HeLa_2")], "place int, canonical string, alias string")
    return N.normalised(_items(spark, sf_dir), router, names, synonyms, near, overrides, lines)


def normalise_terms(spark, sf_dir):
    return _normalised(spark, sf_dir).select("id", "field", "node", "name", "similarity", "status")


def normalise_cells(spark, sf_dir):
    """Cells of two values with their normalised names, unmapped ones dropped."""
    p = table(spark, sf_dir, "part")
    cells = p.select(F.col("p_partkey").alias("id"), F.lit("f").alias("field"), F.concat_ws("; ", "p_type", F.lit("zzz"), "p_brand").alias("cell"))
    resolved = p.filter("p_size > 25").select(F.lit("f").alias("field"), F.col("p_type").alias("value"), F.lower("p_type").alias("name")).distinct().unionAll(p.filter("p_size % 50 = 7").select(F.lit("f"), "p_brand", F.upper("p_brand")).distinct())
    return N.normalised_cells(cells, resolved).select("id", "norm")


def disambiguated(spark, sf_dir):
    """Of the parts of a size class as candidates, the one named like the brand's first part, else the first."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 211).alias("term"), F.col("p_partkey").alias("place"), F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("name"), F.lit(0.9).alias("similarity"), F.concat(F.lit(" brand#"), (F.col("p_partkey") % 5 + 1).cast("string"), F.lit("3")).alias("context"))
    return N.disambiguated(p, ["term"])


def inconsistent_fields(spark, sf_dir):
    """Customers as records whose line, species, tissue and disease come from their keys."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    r = c.select(
        k.alias("id"), F.when(k % 7 == 0, "n/a").otherwise(text("Line", 5)).alias("line"), F.when(k % 2 == 0, text("CLO_", 5)).alias("line_id"), F.when(k % 11 == 0, "unknown").otherwise(text("species", 3)).alias("species"), F.lit(None).cast("string").alias("species_id"),
        text("tissue", 4).alias("tissue"), F.when(k % 5 != 0, text("uberon_", 4)).alias("tissue_id"), text("disease", 6).alias("disease"), text("DOID:", 6).alias("disease_id"), text("cell", 3).alias("cell_type"), text("CL:", 3).alias("cell_type_id"),
    )
    facts = spark.createDataFrame([(f"CLO:{i}", f"Line{i}", [f"species{i % 3}"], [f"UBERON_{i % 4}"] if i else []) for i in range(4)], "line_id string, name string, species array<string>, tissue array<string>")
    disease = spark.createDataFrame([("DOID:1", "UBERON:1"), ("DOID:1", "UBERON:2"), ("DOID:3", "UBERON:0")], "node string, tissue_id string")
    cell = spark.createDataFrame([("CL_2", "UBERON_3")], "node string, tissue_id string")
    return N.inconsistencies(r, facts, disease, cell)


def run_concordance(spark, sf_dir):
    """Suppliers' nation and region against the next supplier's nation, by Lin and hops over the graph."""
    e, closed, nodes, whole = G.parts(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier")
    runs = s.select(F.col("s_suppkey").alias("id"), F.concat_ws("; ", F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("N:"), F.col("s_nationkey").cast("string"))), F.when(F.col("s_suppkey") % 3 == 0, F.lit("zzz"))).alias("given"), F.concat(F.lit("N:"), (F.col("s_suppkey") % 25).cast("string")).alias("predicted"))
    name = F.concat(F.lit("N:"), F.col("n_nationkey").cast("string"))
    pairs = n.select(name.alias("a"), F.col("n_regionkey").alias("r")).join(n.select(name.alias("b"), F.col("n_regionkey").alias("r")), "r").select("a", "b")
    m = O.pair_metrics(pairs, whole, O.information_content(nodes, closed), O.depths(nodes, e, closed), ("lin", "hops"))
    scores = m.select(F.lower("a").alias("given"), F.lower("b").alias("predicted"), "lin", "hops")
    c = N.concordance(runs, scores, n.filter("n_nationkey < 10").select(name.alias("name")))
    return c.withColumn("lin", F.round("lin", 6))


def graded_agreement(spark, sf_dir):
    """Per region how well a shifted list of its nations agrees with it, by Lin."""
    e, closed, nodes, whole = G.parts(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    name = lambda c: F.concat(F.lit("N:"), c.cast("string"))
    golden = n.select(F.col("n_regionkey").alias("id"), name(F.col("n_nationkey")).alias("value"))
    predicted = n.filter("n_nationkey % 3 <> 0").select(F.col("n_regionkey").alias("id"), name((F.col("n_nationkey") + 1) % 25).alias("value"))
    pairs = golden.select("id", F.col("value").alias("a")).join(predicted.select("id", F.col("value").alias("b")), "id").select("a", "b").distinct()
    lin = O.pair_metrics(pairs, whole, O.information_content(nodes, closed), O.depths(nodes, e, closed), ("lin",)).select("a", "b", F.col("lin").alias("score"))
    g = N.graded(golden, predicted, lin, golden.filter("value <> 'N:3'").select("value"))
    both = golden.select("id", F.lit("a").alias("side"), F.col("value").alias("node")).unionAll(predicted.select("id", F.lit("b"), "value"))
    sets = O.best_over_sets(both, lin).withColumnRenamed("score", "over_sets")
    return g.join(sets, "id").select("id", F.round("score", 6).alias("score"), F.round("over_sets", 6).alias("over_sets"))


def graph_information(spark, sf_dir):
    """Two further measures of supplier pairs: by topological information, and by the information of shared ancestors."""
    e, closed, nodes, whole = G.parts(spark, sf_dir)
    pairs = G.pairs(spark, sf_dir)
    g = N.graph_ic(pairs, whole, P.topological_information(e)).select("a", "b", F.round("graph_ic", 6).alias("graph_ic"))
    i = N.information_jaccard(pairs, whole, O.information_content(nodes, closed)).select("a", "b", F.round("jaccard_ic", 6).alias("jaccard_ic"))
    return g.join(i, ["a", "b"])


LOWER = "abcdefghijklmnopqrstuvwxyz"


def _entries(spark, sf_dir):
    """Documents' own words as evidence, with their place: as written, in upper case, as inferred, made up, or of an unknown value."""
    d = table(spark, sf_dir, "documents")
    m, words = F.col("doc_id") % 6, F.substring("text", 10, 60)
    evidence = F.when(m == 0, words).when(m == 1, F.translate(words, LOWER, LOWER.upper())).when(m == 2, F.concat(F.lit("inferred: "), words)).when(m == 3, F.concat(F.lit("made up "), F.col("doc_id").cast("string"))).when(m == 4, F.lit("")).otherwise(words)
    value = F.when(m == 5, "unknown").when(m == 3, "drug vs placebo").otherwise(F.substring_index(words, " ", 2))
    e = d.select(F.col("doc_id").alias("id"), F.when(m == 3, "factor_value").otherwise("tissue").alias("field"), F.lit(0).alias("seq"), value.alias("value"), evidence.alias("evidence"), (F.lit(9) + F.length(words) - F.length(F.ltrim(words))).alias("place"))
    return e, d.select(F.col("doc_id").alias("id"), "text")


def evidence_snapped(spark, sf_dir):
    s = D.snapped(*_entries(spark, sf_dir))
    return s.select("id", "status", F.md5("evidence").alias("evidence"))


def evidence_grounded(spark, sf_dir):
    g = D.grounded(*_entries(spark, sf_dir))
    return g.select("id", F.array_join("flags", ";").alias("flags"))


def contract_problems(spark, sf_dir):
    e, t = _entries(spark, sf_dir)
    return D.contract_problems(e, t, e.filter("id % 12 = 3").select("id", "field", "value", "evidence"))


def schema_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return D.schema_summary(d.select("source", F.when(F.col("n_chars") < 200, "short").alias("error")), ["source"]).withColumn("valid_share", F.round("valid_share", 6))


def truncations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("model"), F.col("n_chars").alias("n_tokens"))
    return D.truncations(d, 1000)


def validated_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    original = e.select(F.col("event_id").alias("id"), F.lit('{"k":-1}').alias("record"))
    answers = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: "), "props", F.lit(" done"))).when(F.col("event_id") % 3 == 1, "no JSON").otherwise("{broken").alias("answer"))
    v = D.validated(original, answers, "k long")
    return v.select("id", F.get_json_object("record", "$.k").cast("long").alias("k"), "changed")


QUERIES = {f.__name__: f for f in (normalise_terms, normalise_cells, disambiguated, inconsistent_fields, run_concordance, graded_agreement, graph_information, evidence_snapped, evidence_grounded, contract_problems, schema_summary, truncations, validated_records)}

E = """e AS (SELECT doc_id id, doc_id % 6 m, text, trim(substr(text, 10, 60)) words, substr(text, 10, 60) raw FROM documents)"""
UP = f"translate(raw, '{LOWER}', '{LOWER.upper()}')"
ORACLES = {
    "normalise_terms": """WITH it AS (SELECT p_partkey id, 'name' field, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'line', 'He-La ' || (p_size % 4) FROM part UNION ALL SELECT p_partkey, 'other', p_brand FROM part),
      nm AS (SELECT DISTINCT 'T:' || length(p_name) || '-' || left(p_name, 1) node, p_name AS name FROM part WHERE p_size % 2 = 0), k1 AS (SELECT lower(name) k, count(DISTINCT node) n, min(node) node FROM nm GROUP BY 1), own AS (SELECT node, min(name) own FROM nm GROUP BY 1),
      k2 AS (SELECT lower(p_name) k, count(DISTINCT 'S:' || left(p_name, 2)) n, min('S:' || left(p_name, 2)) node FROM part WHERE p_size % 3 = 0 GROUP BY 1),
      j AS (SELECT id, field, v, CASE WHEN k1.k IS NOT NULL THEN k1.node ELSE k2.node END node, CASE WHEN k1.k IS NOT NULL THEN own END own, length(v) % 10 / 10.0::DOUBLE s, CASE WHEN length(v) % 2 = 0 THEN 0.8 ELSE 0.1 END::DOUBLE x
        FROM it LEFT JOIN k1 ON field = 'name' AND k1.k = lower(v) LEFT JOIN own ON own.node = k1.node LEFT JOIN k2 ON field = 'name' AND k2.k = lower(v))
      SELECT id, field, CASE field WHEN 'name' THEN node WHEN 'type' THEN CASE WHEN x > s AND x >= 0.7::DOUBLE THEN 'D:2' WHEN s >= 0.7::DOUBLE AND s >= x THEN 'D:1' END END node,
        CASE field WHEN 'name' THEN own WHEN 'type' THEN CASE WHEN x > s AND x >= 0.7::DOUBLE THEN 'forced' WHEN s >= 0.7::DOUBLE AND s >= x THEN lower(v) END WHEN 'line' THEN CASE v WHEN 'He-La 1' THEN 'HeLa 1' WHEN 'He-La 2' THEN 'HeLa 2' END END AS name,
        CASE field WHEN 'name' THEN CASE WHEN node IS NOT NULL THEN 1.0 END WHEN 'type' THEN CASE WHEN greatest(x, s) >= 0.7::DOUBLE THEN greatest(x, s) END WHEN 'line' THEN CASE WHEN v IN ('He-La 1', 'He-La 2') THEN 1.0 END END::DOUBLE similarity,
        CASE field WHEN 'name' THEN CASE WHEN node IS NOT NULL THEN 'mapped' ELSE 'unmapped' END WHEN 'type' THEN CASE WHEN x > s AND x >= 0.7::DOUBLE THEN 'post_mapped' WHEN s >= 0.7::DOUBLE THEN 'mapped' ELSE 'unmapped' END WHEN 'line' THEN CASE WHEN v IN ('He-La 1', 'He-La 2') THEN 'exact_match' ELSE 'unmapped' END ELSE 'unrouted' END status FROM j""",
    "normalise_cells": "SELECT p_partkey id, nullif(concat_ws('; ', CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size > 25) THEN lower(p_type) END, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size % 50 = 7) THEN upper(p_brand) END), '') norm FROM part",
    "disambiguated": "WITH c AS (SELECT p_partkey % 211 term, p_partkey, p_brand, lower(p_brand) <> 'brand#' || (p_partkey % 5 + 1) || '3' other FROM part) SELECT term, 'P:' || first(p_partkey ORDER BY other, p_partkey) node, first(p_brand ORDER BY other, p_partkey) AS name, 0.9::DOUBLE similarity FROM c GROUP BY 1",
    "inconsistent_fields": """WITH c AS (SELECT c_custkey k FROM customer), f AS (
      SELECT k, 'line_species_mismatch' AS type, 'Line' || k % 5 a, 'species' || k % 3 b, 'species' || (k % 5 % 3) expected FROM c WHERE k % 7 <> 0 AND k % 5 < 4 AND k % 11 <> 0 AND k % 3 <> k % 5 % 3
      UNION ALL SELECT k, 'line_tissue_mismatch', 'Line' || k % 5, 'tissue' || k % 4, 'UBERON_' || (k % 5 % 4) FROM c WHERE k % 7 <> 0 AND k % 5 BETWEEN 1 AND 3 AND k % 4 <> k % 5
      UNION ALL SELECT k, 'disease_tissue_mismatch', 'disease' || k % 6, 'tissue' || k % 4, CASE k % 6 WHEN 1 THEN 'UBERON:1, UBERON:2' ELSE 'UBERON:0' END FROM c WHERE k % 5 <> 0 AND ((k % 6 = 1 AND k % 4 NOT IN (1, 2)) OR (k % 6 = 3 AND k % 4 <> 0))
      UNION ALL SELECT k, 'cell_type_tissue_mismatch', 'cell' || k % 3, 'tissue' || k % 4, 'UBERON:3' FROM c WHERE k % 5 <> 0 AND k % 3 = 2 AND k % 4 <> 3)
      SELECT k id, type, a, b, expected FROM f""",
    "run_concordance": G.HEAD.replace(G.PAIRS, """,
pairs AS (SELECT 'N:' || x.n_nationkey a, 'N:' || y.n_nationkey b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)""") + G.BEST + f""", sc AS (SELECT a, b, {G.METRICS['lin'].replace('round(', '(').replace(', 6)', ')')} lin, hops FROM j),
      r AS (SELECT s_suppkey id, CASE WHEN s_suppkey % 4 <> 0 THEN 'N:' || s_nationkey END g, concat_ws('; ', CASE WHEN s_suppkey % 4 <> 0 THEN 'N:' || s_nationkey END, CASE WHEN s_suppkey % 3 = 0 THEN 'zzz' END) given, 'N:' || (s_suppkey % 25) predicted, s_nationkey nk FROM supplier),
      x AS (SELECT r.*, coalesce(g = predicted, false) exact, coalesce(g IS NOT NULL AND nk < 10, false) in_vocabulary, sc.lin l, sc.hops h FROM r LEFT JOIN sc ON sc.a = g AND sc.b = predicted)
      SELECT id, given, predicted, exact, in_vocabulary, round(CASE WHEN exact THEN 1.0 ELSE coalesce(l, 0.0) END, 6) lin, CASE WHEN exact THEN 0 ELSE h END::INT hops,
        CASE WHEN exact THEN 'exact' WHEN coalesce(l, 0) >= 0.7 OR h <= 2 THEN 'near' WHEN coalesce(l, 0) >= 0.35 OR h <= 4 THEN 'distant' WHEN coalesce(l, 0) > 0 OR h IS NOT NULL THEN 'conflict' ELSE 'unconnected' END tier FROM x""",
    "graded_agreement": G.HEAD.replace(G.PAIRS, """,
pairs AS (SELECT DISTINCT 'N:' || x.n_nationkey a, 'N:' || ((y.n_nationkey + 1) % 25) b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey % 3 <> 0)""") + G.BEST + f""", sc AS (SELECT a, b, {G.METRICS['lin'].replace('round(', '(').replace(', 6)', ')')} lin FROM j),
      m AS (SELECT x.n_regionkey id, 'N:' || x.n_nationkey a, max(CASE WHEN x.n_nationkey = (y.n_nationkey + 1) % 25 THEN 1.0 ELSE coalesce(sc.lin, 0.0) END) best, max(sc.lin) plain FROM nation x LEFT JOIN nation y ON y.n_regionkey = x.n_regionkey AND y.n_nationkey % 3 <> 0
        LEFT JOIN sc ON sc.a = 'N:' || x.n_nationkey AND sc.b = 'N:' || ((y.n_nationkey + 1) % 25) GROUP BY 1, 2)
      SELECT id, round(avg(best) FILTER (a <> 'N:3'), 6) score, round(avg(plain), 6) over_sets FROM m GROUP BY 1""",
    "graph_information": G.HEAD + G.TI + """, t AS (SELECT a, b, max(ti) top FROM common JOIN ti ON ti.node = ancestor GROUP BY a, b), s AS (SELECT w.node, sum(ic) s FROM whole w JOIN ic ON ic.node = w.ancestor GROUP BY 1), x AS (SELECT a, b, sum(ic) x FROM common JOIN ic ON ic.node = ancestor GROUP BY a, b)
      SELECT p.a, p.b, round(CASE WHEN p.a = p.b THEN 1.0 ELSE coalesce(least(1.0, greatest(0.0, coalesce(2 * top / nullif(ta.ti + tb.ti, 0), 0.0))), 0.0) END, 6) graph_ic, round(coalesce(coalesce(x.x, 0.0) / nullif(sa.s + sb.s - coalesce(x.x, 0.0), 0), 0.0), 6) jaccard_ic
      FROM pairs p JOIN ti ta ON ta.node = p.a JOIN ti tb ON tb.node = p.b JOIN s sa ON sa.node = p.a JOIN s sb ON sb.node = p.b LEFT JOIN t ON t.a = p.a AND t.b = p.b LEFT JOIN x ON x.a = p.a AND x.b = p.b""",
    "evidence_snapped": f"""WITH {E} SELECT id, CASE WHEN words = '' OR m IN (3, 4) THEN 'absent' WHEN m = 1 AND NOT contains(text, trim({UP})) THEN 'normalized' ELSE 'verbatim' END status,
      md5(CASE m WHEN 0 THEN CASE WHEN words = '' THEN raw ELSE words END WHEN 1 THEN CASE WHEN words = '' THEN {UP} ELSE words END WHEN 2 THEN CASE WHEN words = '' THEN 'inferred: ' || raw ELSE 'inferred: ' || words END WHEN 3 THEN 'made up ' || id WHEN 4 THEN '' ELSE CASE WHEN words = '' THEN raw ELSE words END END) evidence FROM e""",
    "evidence_grounded": f"WITH {E} SELECT id, CASE WHEN m = 5 THEN CASE WHEN raw <> '' THEN 'cleared' ELSE '' END WHEN m = 3 THEN 'not_grounded;no_comparison' WHEN m = 4 THEN 'no_evidence' WHEN words <> '' THEN '' WHEN m = 2 THEN 'not_grounded' WHEN raw = '' THEN 'no_evidence' ELSE 'not_grounded' END flags FROM e",
    "contract_problems": f"""WITH {E}, p AS (SELECT id, CASE m WHEN 3 THEN 'factor_value' ELSE 'tissue' END field, 0 seq, CASE WHEN m = 5 THEN CASE WHEN raw <> '' THEN 'unknown_with_evidence' END WHEN m = 4 OR (m <> 2 AND m <> 3 AND raw = '') THEN 'no_evidence' WHEN m = 3 AND id % 12 <> 3 THEN 'evidence_absent' END problem FROM e)
      SELECT * FROM p WHERE problem IS NOT NULL""",
    "schema_summary": "SELECT source, count(*) n_fields, count(*) FILTER (n_chars < 200) n_errors, round(1 - count(*) FILTER (n_chars < 200) / count(*)::DOUBLE, 6) valid_share, count(*) FILTER (n_chars < 200) = 0 ok FROM documents GROUP BY 1",
    "truncations": "SELECT doc_id id, lang model, n_chars n_tokens, n_chars - 1000 removed FROM documents WHERE n_chars > 1000",
    "validated_records": "SELECT event_id id, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::BIGINT ELSE -1 END k, event_id % 3 = 0 changed FROM events",
}

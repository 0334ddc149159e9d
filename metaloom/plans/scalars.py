"""Column expressions and small record operators, each over values derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import runs as R
from metaloom.functions import text as X
from metaloom.operators import evaluation as E
from metaloom.operators import guards as Q
from metaloom.operators import matching as V
from metaloom.operators import merge as G
from metaloom.operators import ontology as O
from metaloom.session import table

L = F.lit


def _s(c):
    return F.col(c).cast("string")


def splits(spark, sf_dir):
    """Splitting, separators and joining of lists in one string."""
    p = table(spark, sf_dir, "part")
    a = F.concat("p_name", L(" (a; b); "), "p_brand", L(" ;"), _s("p_size"))
    b = F.concat("p_name", L(", "), "p_brand", L(" / "), _s("p_size"), L("; ab/cd"))
    c = F.concat(F.upper("p_brand"), L("; n/a; "), "p_brand", L(" ;"), "p_type", L(";  x   y"))
    arr = F.array(F.col("p_name"), F.upper("p_name"), F.lower("p_brand"), F.col("p_brand"))
    return p.select(
        "p_partkey", F.array_join(X.split_outside_parens(a), "|").alias("outside"), F.array_join(X.split_outside_parens(F.replace(a, L(";"), L(",")), ",;"), "|").alias("outside_two"), X.unify_separators(b).alias("unified"),
        X.comparable(c).alias("comparable"), F.array_join(X.split_set(c), "|").alias("parts"), X.joined_distinct(F.array(F.col("p_name"), L(" "), F.col("p_brand"), F.col("p_name"))).alias("distinct"), F.array_join(X.folded_sorted(arr), "|").alias("folded"),
    )


def headers(spark, sf_dir):
    """Headers of sample tables: kind and key."""
    p = table(spark, sf_dir, "part")
    m, w = F.col("p_partkey") % 5, F.substring_index("p_type", " ", 1)
    h = F.when(m == 0, F.concat(L("characteristics["), w, L(" 1]"))).when(m == 1, F.concat(L("Comment [ "), w, L("]"))).when(m == 2, F.concat(L("factor value["), w, L("]"))).when(m == 3, L("Source Name")).otherwise(w)
    return p.select("p_partkey", X.header_kind(h).alias("kind"), X.header_key(h).alias("key"))


def identifiers(spark, sf_dir):
    """Identifiers, names of runs, lines, species and instruments."""
    p = table(spark, sf_dir, "part")
    n = _s("p_partkey")
    w = F.initcap(F.substring_index("p_name", " ", 1))
    return p.select(
        "p_partkey", X.curie(F.concat(L(" bto_"), n)).alias("curie"), X.line_key(F.concat(L("He-La_("), n, L(") x"))).alias("line"), X.run_stem(F.concat(L("/data/x/run_"), n, F.when(F.col("p_partkey") % 2 == 0, ".raw").otherwise(".mzML.gz"))).alias("stem"),
        X.without_taxon(F.concat(n, L(" (Homo "), F.lower(w), L(")"))).alias("species"), X.expand_binomial(F.concat(L("Homo."), L("sapiens"))).alias("expanded"), F.array_join(X.binomial_short(L("Homo sapiens")), "|").alias("short"),
        X.clean_instrument(F.concat(L("Thermo Fisher Scientific Model "), n, L(" (x) mass spectrometer instrument"))).alias("instrument"),
    )


def answers(spark, sf_dir):
    """What is read from models' answers: the last verdict, salvage of broken JSON, marks, measurements and buckets."""
    p = table(spark, sf_dir, "part")
    n, b = _s("p_size"), F.col("p_brand")
    text = F.concat(L("VERDICT: low\n# Head\n- **x** "), n, L("\nVerdict :  "), b, L(" \nend"))
    broken = F.concat(L('Sure: {"tissue": ["'), b, L('", "e"], "age": "'), n, L('", "x": ['))
    return p.select(
        "p_partkey", X.last_answer(text, "VERDICT").alias("verdict"), X.last_answer(text, "NOTHING").alias("none"), F.try_element_at(X.salvage(broken), L("tissue")).alias("tissue"), F.try_element_at(X.salvage(broken), L("age")).alias("age"),
        X.without_markdown(F.concat(L("## "), b, L(" is **"), n, L("** `x`"))).alias("bare"), X.is_measurement(F.concat(n, F.when(F.col("p_partkey") % 2 == 0, " mM").otherwise(" of them"))).alias("measured"), X.confidence_bucket(F.col("p_size") / 50).alias("bucket"),
        X.inferred(F.concat(F.when(F.col("p_partkey") % 3 == 0, "Inferred: ").otherwise("from "), b)).alias("inferred"), X.without_inferred(F.concat(L(" inferred: "), b)).alias("plain"),
        X.repaired_pair(F.slice(F.array(b, n), 1, (F.col("p_partkey") % 3).cast("int")))["value"].alias("value"), X.repaired_pair(F.slice(F.array(b, n), 1, (F.col("p_partkey") % 3).cast("int")))["evidence"].alias("evidence"),
    )


def values_chosen(spark, sf_dir):
    """Values by precedence and shortening, printed ranges, sections and canonical field names."""
    p = table(spark, sf_dir, "part")
    m, n = F.col("p_partkey") % 4, _s("p_size")
    items = F.array(L("n/a"), F.col("p_name"), F.col("p_brand"))
    block = F.concat(L("=== METHODS ===\n"), F.col("p_name"), L("\n=== RESULTS ===\nn = "), n, L("\n=== METHODS ===\nlate"))
    r = X.ranges(F.concat(L("aged "), n, L("-"), (F.col("p_size") + 5).cast("string"), L(" and 2 to 3.5")))
    return p.select(
        "p_partkey", X.resolved_value(F.when(m == 0, F.col("p_type")), F.when(m == 1, F.col("p_brand")).otherwise(L("unknown")), items).alias("resolved"), X.all_nullish(F.array(L(""), F.when(m == 2, L("na")).otherwise(F.col("p_name")))).alias("nothing"),
        X.first_short(items).alias("first"), F.try_element_at(X.sections(block), L("METHODS")).alias("methods"), F.try_element_at(X.sections(block), L("RESULTS")).alias("results"), F.element_at(r, 1)["hi"].alias("hi"), F.element_at(r, 2)["hi"].alias("second"),
        X.aliased(F.when(m == 0, L("Organ")).when(m == 1, L("organ")).otherwise(F.col("p_brand")), {"Organ": "tissue"}).alias("field"),
    )


def run_names(spark, sf_dir):
    """What run names say that are made of known words and a key."""
    p = table(spark, sf_dir, "part")
    m, n = F.col("p_partkey") % 4, _s("p_partkey")
    name = F.when(m == 0, F.concat(L("QEHFX_HeLa_DIA_HCD_CID_"), n)).when(m == 1, F.concat(L("Mouse_liver_plasma_TMT"), n)).when(m == 2, F.concat(L("timsTOF-SCP_phospho_Nuc_WT_"), n)).otherwise(F.concat(L("deliveries_radial_"), n))
    # Reading a name takes far longer than moving it, and few files hold all names.
    p = p.select("p_partkey", name.alias("name")).repartition(spark.sparkContext.defaultParallelism)
    p = p.withColumn("found", R.run_hits(F.col("name"), ["HeLa", "MCF-7"]))
    f = R.fields_of(F.col("found"), lines=True)
    return p.select("p_partkey", *[f[c].alias(c) for c in ("instrument", "acquisition", "fragmentation", "organism", "tissue", "labeling", "cell_line", "enrichment", "cell_part", "disease")])


def cohort_flags(spark, sf_dir):
    """Cohort predicates and classes of derived values."""
    p = table(spark, sf_dir, "part")
    m = F.col("p_partkey") % 4
    species = F.when(m == 0, L("Homo sapiens")).when(m == 1, L("human")).otherwise(F.col("p_name"))
    disease = F.when(m == 0, L("healthy")).when(m == 1, L("Breast carcinoma")).when(m == 2, L("n/a")).otherwise(L("asthma"))
    tissue = F.when(m == 0, L("Blood plasma")).when(m == 1, L("blood vessel")).when(m == 2, L("prefrontal cortex")).otherwise(F.col("p_brand"))
    licence = F.when(m == 0, L("CC BY 4.0")).when(m == 1, L("CC BY-ND 4.0")).when(m == 2, L("CC0"))
    flags = R.licence_flags(licence, F.when(m == 2, L("no text mining")))
    return p.select(
        "p_partkey", R.is_human(F.array(species)).alias("human"), R.is_culture(F.array(F.when(m == 3, L("Cell line X")).otherwise(F.col("p_brand")))).alias("culture"), R.is_healthy(F.array(disease)).alias("healthy"), R.is_cancer(F.array(disease)).alias("cancer"),
        R.is_fluid(tissue).alias("fluid"), R.tissue_class(tissue).alias("organ"), flags["open"].alias("open"), flags["minable"].alias("minable"), R.relationship(F.col("p_size") / 50, F.when(m == 0, L("a subtype of")).when(m == 1, L("identical"))).alias("relationship"),
    )


def set_measures(spark, sf_dir):
    """Sets of neighbouring parts: Jaccard, kind of match, containment, hops and evidence notes."""
    p = table(spark, sf_dir, "part")
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 2 == 0, L("zzz"))), " ")
    return p.select("p_partkey", F.round(M.set_jaccard(a, b), 6).alias("jaccard"), M.match_kind(a, b).alias("kind"), M.partly_contained(F.array(L("aa")), F.array(F.when(F.col("p_partkey") % 2 == 0, L("xaay")).otherwise(L("bb")))).alias("contained"), M.hop_score(F.col("p_size") % 6).alias("hops"), M.evidence_note(F.when(F.col("p_partkey") % 3 != 0, L("x")), F.when(F.col("p_partkey") % 5 != 0, L("y")), "src", F.col("p_size") > 25).alias("note"))


def record_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") > 10).alias("valid"), (F.col("p_size") % 5 / 4.0).alias("score"), F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_name")).alias("value"))
    return Q.record_confidence(d, ["p_brand"], 100).withColumns({c: F.round(c, 6) for c in ("schema", "evidence", "completeness")})


def evidence_scores(spark, sf_dir):
    """Scores, format errors and negations of derived fields."""
    p = table(spark, sf_dir, "part")
    m, n = F.col("p_partkey") % 6, F.col("p_name")
    value = F.when(m == 5, "unknown").otherwise(n)
    evidence = F.when(m == 0, F.concat(L("has "), F.upper(n))).when(m == 1, L("the source")).when(m == 2, F.concat(n, L(" elsewhere"))).when(m == 3, L("other")).otherwise(L(""))
    items = F.slice(F.array(n, L("e"), L("x")), 1, (F.col("p_partkey") % 4).cast("int"))
    return p.select("p_partkey", Q.evidence_score(value, evidence, F.concat(L("The Source has "), n)).alias("score"), Q.format_error(F.when(m == 5, None).otherwise(items)).alias("error"), Q.negated(n, F.concat(F.when(m == 0, L("without any ")).otherwise(L("with ")), n, L(" in it"))).alias("negated"))


def best_of_lists(spark, sf_dir):
    """Best matches between the parts of a brand and sizes, by level and score."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "EXACT").when(F.col("p_partkey") % 4 == 1, "SEMANTIC").otherwise("NO_MATCH")
    pairs = p.select("p_brand", (F.col("p_size") % 3).alias("g"), F.col("p_partkey").alias("v"), kind.alias("kind"), (F.col("p_partkey") % 50 / 50.0).alias("score"))
    return V.score_lists(pairs, ["p_brand"]).withColumn("recall", F.round("recall", 6))


def best_matches(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    g = p.filter("p_size = 1").select("p_brand", F.col("p_partkey").alias("g"))
    v = p.filter("p_size = 2").select("p_brand", F.col("p_partkey").alias("v"))
    return E.best_matches(g, v, ["p_brand"], (F.col("g") * 7 + F.col("v") * 13) % 101 / 100.0)


def audit_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("raw"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise(F.upper("p_name")).alias("name"), F.when(F.col("p_size") % 7 != 0, F.concat(F.when(F.col("p_size") % 5 == 0, L("X:")).otherwise(L("A:")), _s("p_size"))).alias("node"), F.slice(F.array(L(1), L(2)), 1, (F.col("p_size") % 3).cast("int")).alias("candidates"), F.array(L("A:"), L("B:")).alias("prefixes"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") > 20).alias("taxon_ok"))
    return Q.audit(d).groupBy("problem").agg(F.count(L(1)).alias("n"))


def appended(spark, sf_dir):
    """Customers' orders with those added that weren't there, and flags of repeated keys; two first by price of each customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = Q.append_new(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 2 = 0"), ["o_orderkey"])
    flagged = Q.duplicate_flags(out, ["o_custkey"])
    first = Q.first_of_ranked(flagged, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)
    return first.select("o_custkey", "o_orderkey", "duplicate", F.col("rank").cast("long").alias("rank"))


def graph_extras(spark, sf_dir):
    """Suppliers under their nation only, by prefix; synonyms added once; terms routed by type."""
    from metaloom.plans.ontology import LEVELS, edges

    closed = O.closure(edges(spark, sf_dir), LEVELS)
    up = O.prefixed(closed, "R:").filter("node like 'S:%'").groupBy(F.col("ancestor").alias("k")).agg(F.count(L(1)).alias("n")).select(L("prefixed").alias("what"), "k", "n")
    p = table(spark, sf_dir, "part")
    syn = p.filter("p_size <= 20").select(F.col("p_brand").alias("node"), F.col("p_type").alias("synonym"), L("EXACT").alias("scope")).distinct()
    more = p.filter("p_size <= 40").select(F.col("p_brand").alias("node"), F.upper("p_type").alias("synonym"), L("RELATED").alias("scope")).distinct()
    added = O.add_synonyms(syn, more).groupBy(F.col("scope").alias("k")).agg(F.count(L(1)).alias("n")).select(L("synonyms").alias("what"), "k", "n")
    terms = p.select(F.col("p_type").alias("term"), F.when(F.col("p_size") % 2 == 0, "t").otherwise("none").alias("entity")).distinct()
    names = p.select(L("onto").alias("onto"), F.concat(L("P:"), F.col("p_type")).alias("node"), F.col("p_type").alias("name")).filter("length(name) % 2 = 0").distinct()
    routed = O.route(terms, spark.createDataFrame([("t", "onto")], "entity string, onto string"), names).groupBy(F.when(F.col("node").isNull(), "no").otherwise("yes").alias("k")).agg(F.count(L(1)).alias("n")).select(L("routed").alias("what"), "k", "n")
    top = O.rank_by(p.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey")]).select(L("ranked").alias("what"), F.col("p_brand").alias("k"), F.col("p_partkey").cast("long").alias("n"))
    return up.unionAll(added).unionAll(routed).unionAll(top)


def species_similarity(spark, sf_dir):
    """The ratio of a name and its altered form: one, an abbreviated genus, or none in common."""
    n = table(spark, sf_dir, "nation")
    m = F.col("n_nationkey") % 3
    w = F.initcap(F.lower(F.substring_index("n_name", " ", 1)))
    a = F.concat(w, L(" sapiens"))
    b = F.when(m == 0, F.upper(a)).when(m == 1, F.concat(F.left(w, L(1)), L(". sapiens"))).otherwise(L("####"))
    return n.select("n_nationkey", F.round(X.ratio(a, b), 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (splits, headers, identifiers, answers, values_chosen, run_names, cohort_flags, set_measures, record_confidence, evidence_scores, best_of_lists, best_matches, audit_problems, appended, graph_extras, species_similarity)}

ORACLES = {
    "splits": """WITH p AS (SELECT p_partkey, p_name n, p_brand b, p_type t, p_size::VARCHAR s FROM part) SELECT p_partkey, n || ' (a; b)|' || b || '|' || s outside, n || ' (a, b)|' || b || '|' || s outside_two, n || '; ' || b || '; ' || s || '; ab; cd' unified,
      array_to_string(list_sort([lower(b), lower(t), 'x y']), '; ') comparable, lower(b) || '|' || lower(t) || '|x y' parts, n || '; ' || b AS distinct, CASE WHEN lower(n) < lower(b) THEN n || '|' || lower(b) ELSE lower(b) || '|' || n END folded FROM p""",
    "headers": """WITH p AS (SELECT p_partkey, p_partkey % 5 m, string_split(p_type, ' ')[1] w FROM part) SELECT p_partkey, ['characteristics', 'comment', 'factor', 'identifier', 'other'][m + 1] kind, CASE WHEN m = 3 THEN 'sourcename' ELSE regexp_replace(lower(w), '[^a-z]', '', 'g') END AS key FROM p""",
    "identifiers": """SELECT p_partkey, 'BTO:' || p_partkey curie, 'hela' || p_partkey || 'x' AS line, 'run_' || p_partkey stem, 'Homo ' || lower(string_split(p_name, ' ')[1]) species, 'Homo sapiens' expanded, 'h.sapiens|h. sapiens|homo.sapiens' short, 'Model ' || p_partkey instrument FROM part""",
    "answers": """SELECT p_partkey, p_brand verdict, NULL::VARCHAR none, p_brand tissue, p_size::VARCHAR age, p_brand || ' is ' || p_size || ' x' bare, p_partkey % 2 = 0 measured, CASE WHEN p_size / 50.0 >= 0.9 THEN 'high' WHEN p_size / 50.0 >= 0.7 THEN 'medium' ELSE 'low' END bucket,
      p_partkey % 3 = 0 inferred, p_brand plain, CASE p_partkey % 3 WHEN 0 THEN 'unknown' ELSE p_brand END AS value, CASE p_partkey % 3 WHEN 2 THEN p_size::VARCHAR ELSE '' END evidence FROM part""",
    "values_chosen": """WITH p AS (SELECT *, p_partkey % 4 m FROM part) SELECT p_partkey, CASE m WHEN 0 THEN p_type WHEN 1 THEN p_brand END resolved, m = 2 nothing, p_name AS first, p_name methods, 'n = ' || p_size results, (p_size + 5)::DOUBLE hi, 3.5::DOUBLE AS second, CASE WHEN m < 2 THEN 'tissue' ELSE p_brand END field FROM p""",
    "run_names": """WITH f(m, instrument, acquisition, fragmentation, organism, tissue, labeling, cell_line, enrichment, cell_part, disease) AS (VALUES (0, 'Q Exactive HF-X', 'DIA', 'HCD; CID', 'Homo sapiens', NULL, NULL, 'HeLa', NULL, NULL, NULL), (1, NULL, NULL, NULL, 'Mus musculus', 'blood plasma', 'TMT', NULL, NULL, NULL, NULL),
      (2, 'timsTOF SCP', NULL, NULL, NULL, NULL, NULL, NULL, 'phospho-enrichment', 'nucleus', 'healthy'), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) SELECT p_partkey, f.* EXCLUDE m FROM part JOIN f ON m = p_partkey % 4""",
    "cohort_flags": """WITH p AS (SELECT p_partkey, p_partkey % 4 m, p_size FROM part) SELECT p_partkey, m < 2 human, m = 3 culture, m = 0 healthy, m = 1 cancer, m = 0 fluid, CASE WHEN m = 2 THEN 'Brain' END organ, m IN (0, 2) AS open, m = 0 minable,
      CASE WHEN m = 0 THEN 'kind' WHEN m = 1 THEN 'same' WHEN p_size / 50.0 >= 0.7 THEN 'near' WHEN p_size / 50.0 >= 0.35 THEN 'distant' ELSE 'unrelated' END relationship FROM p""",
    "set_measures": """WITH p AS (SELECT *, list_distinct(string_split(p_name, ' ')) a FROM part) SELECT p_partkey, round(1.0 / (len(a) + (p_partkey % 2 = 0)::INT), 6)::DOUBLE jaccard, CASE WHEN len(string_split(p_name, ' ')) = 1 AND p_partkey % 2 = 1 THEN 'MATCH' ELSE 'PARTIAL' END kind, p_partkey % 2 = 0 contained,
      CASE p_size % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.87 WHEN 3 THEN 0.83 WHEN 4 THEN 0.8 END::DOUBLE hops, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 OR p_size > 25 THEN 'src' ELSE '-src' END note FROM p""",
    "record_confidence": """WITH g AS (SELECT p_brand, avg((p_size > 10)::INT) s, avg(p_size % 5 / 4.0::DOUBLE) e, count(*) FILTER (p_size % 3 <> 0) / 100.0::DOUBLE c FROM part GROUP BY 1), o AS (SELECT *, 0.3 * s + 0.5 * e + 0.2 * least(c, 1.0) x FROM g)
      SELECT p_brand, round(s, 6) AS schema, round(e, 6) evidence, round(c, 6) completeness, round_even(x, 3) overall, round_even(x, 3) >= 0.7 gate FROM o""",
    "evidence_scores": """WITH p AS (SELECT p_partkey, p_partkey % 6 m, p_partkey % 4 k FROM part) SELECT p_partkey, CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 WHEN 3 THEN 0.2 WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE score, CASE WHEN m = 5 THEN 'missing' WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'no_evidence' WHEN k = 3 THEN 'too_long' END error, m = 0 negated FROM p""",
    "best_of_lists": """WITH q AS (SELECT p_brand, p_size % 3 g, CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 1 END r, p_partkey % 50 / 50.0::DOUBLE s FROM part), b AS (SELECT p_brand, g, max(r) r, arg_max(s, r * 1000 + s) s FROM q GROUP BY 1, 2),
      o AS (SELECT p_brand, round_even(avg(s), 4) mean_score, avg((r >= 3)::INT) recall, min(r) low FROM b GROUP BY 1) SELECT p_brand, mean_score, round(recall, 6) recall, CASE WHEN recall = 1 THEN CASE low WHEN 6 THEN 'EXACT' WHEN 2 THEN 'SEMANTIC' ELSE 'NO_MATCH' END WHEN recall > 0 THEN 'SEMANTIC' ELSE 'NO_MATCH' END kind FROM o""",
    "best_matches": """WITH g AS (SELECT p_brand, p_partkey g FROM part WHERE p_size = 1), v AS (SELECT p_brand, p_partkey v FROM part WHERE p_size = 2), r AS (SELECT g.p_brand, g, v, (g * 7 + v * 13) % 101 / 100.0::DOUBLE s FROM g LEFT JOIN v ON v.p_brand = g.p_brand)
      SELECT p_brand, g, first(v ORDER BY s DESC, v) v, coalesce(max(s), 0.0) score FROM r GROUP BY 1, 2""",
    "audit_problems": """WITH l AS (SELECT 'correction' problem FROM part WHERE p_size % 7 <> 0 AND p_size % 4 = 0 AND lower(p_type) <> lower(p_name) UNION ALL SELECT 'ambiguous' FROM part WHERE p_size % 3 = 2 UNION ALL SELECT 'cross_namespace' FROM part WHERE p_size % 7 <> 0 AND p_size % 5 = 0 UNION ALL SELECT 'taxon' FROM part WHERE p_size % 2 = 0 AND p_size <= 20)
      SELECT problem, count(*) n FROM l GROUP BY 1""",
    "appended": """WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) > 1 duplicate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) SELECT o_custkey, o_orderkey, duplicate, rank FROM o WHERE rank <= 2""",
    "graph_extras": """WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 20), m AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 40), t AS (SELECT DISTINCT p_type, p_size % 2 = 0 e FROM part)
      SELECT 'prefixed' what, 'R:' || n_regionkey k, count(*) n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'synonyms', 'EXACT', count(*) FROM a HAVING count(*) > 0 UNION ALL SELECT 'synonyms', 'RELATED', count(*) FROM (FROM m EXCEPT FROM a) HAVING count(*) > 0
      UNION ALL SELECT 'routed', CASE WHEN e AND length(p_type) % 2 = 0 THEN 'yes' ELSE 'no' END, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'ranked', p_brand, first(p_partkey ORDER BY p_size DESC, p_partkey) FROM part GROUP BY 2""",
    "species_similarity": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.0 END::DOUBLE ratio FROM nation",
}

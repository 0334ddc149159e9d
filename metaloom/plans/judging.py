"""Judging units: hints, guarded answers, per-sample rules, recovered values and modification cells, over derived units."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import judge as J
from metaloom.operators import judge_run as J2
from metaloom.operators import sheets as T
from metaloom.session import table


def _case(k, *options):
    """The option of the number that k is."""
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(k == i, options[i]).otherwise(out)
    return out


def judge_hints(spark, sf_dir):
    """What can be told of parts as units of eight kinds."""
    p = table(spark, sf_dir, "part")
    m, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    tolerance = F.lit("precursor_mass_tolerance")
    ppm = F.concat(size, F.lit(" ppm"))
    u = p.select(
        "p_partkey",
        _case(m, F.lit("tissue"), F.lit("tissue"), tolerance, tolerance, tolerance, F.lit("disease_state"), F.lit("modification"), F.lit("technical_replicate")).alias("field"),
        _case(m, *[F.lit(x) for x in ("value", "value", "value", "value", "value", "value", "modification", "runs")]).alias("kind"),
        _case(m, F.col("p_name"), F.col("p_name"), ppm, size, ppm, F.lit("healthy"), F.concat(F.lit("NT=Oxidation;AC=UNIMOD:"), size, F.lit(";TA=M")), F.concat(F.lit("a = "), size, F.lit(" | b = x"))).alias("cell"),
        _case(m, F.concat(F.lit("we used "), F.upper("p_name"), F.lit(" here")), F.lit("nothing of it"), F.concat(F.lit("a tolerance of "), ppm), F.lit("x"), F.lit("none given"), F.lit("Healthy donors"), F.lit("oxidation of residues"), F.lit("")).alias("paper"),
    )
    return J.hints(u).select("p_partkey", F.array_join("hints", ";").alias("hints"))


def judge_guards(spark, sf_dir):
    """Answers of sixteen kinds after the safety rules."""
    p = table(spark, sf_dir, "part")
    m, size, name = F.col("p_partkey") % 16, F.col("p_size").cast("string"), F.col("p_name")
    t, f, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    no = F.lit(None).cast("string")
    cat = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    lits = lambda *x: [F.lit(v) for v in x]
    a = p.select(
        "p_partkey",
        _case(m, *lits("tissue", "age", "tissue", "tissue", "tissue", "fragmentation_method", "factor_value", "factor_value", "factor_value", "collision_energy", "collision_energy", "cleavage_agent", "modification", "modification", "precursor_mass_tolerance", "precursor_mass_tolerance")).alias("field"),
        _case(m, *lits("value", "value", "value", "value", "value", "value", "runs", "runs", "runs", "value", "value", "value", "modification", "modification", "value", "value")).alias("kind"),
        _case(m, name, name, name, name, name, F.lit("HCD"), F.lit("r1 = a | r2 = a"), F.lit("r1 = 1 mM | r2 = b"), F.lit("r1 = a | r2 = a"), F.lit("0.1 uM"), cat(size, " mM"), F.lit("MS:1001251"), F.lit("NT=Acetyl;AC=UNIMOD:1;TA=K;MT=Variable"), F.lit("NT=Acetyl;TA=K"), F.lit("20 ppm"), F.lit("20 ppm")).alias("value"),
        _case(m, *lits("high", "medium", "high", "medium", None, "medium", "medium", "medium", "medium", "low", "medium", "medium", "low", "low", "medium", "medium")).alias("verdict"),
        _case(m, f, f, t, f, f, f, f, f, f, t, f, f, t, t, f, f).alias("hallucinated"),
        _case(m, t, f, t, f, none, t, t, t, t, t, t, t, t, t, t, t).alias("type_correct"),
        _case(m, no, F.lit("developmental_stage"), no, F.lit("cell_type"), *[no] * 12).alias("correct_type"),
        none.alias("value_correct"), none.alias("value_complete"),
        _case(m, no, F.lit("other"), no, F.lit("other"), no, F.lit("CID and HCD"), F.lit("r1 = b"), F.lit("r1 = 1000 uM | r2 = b"), F.lit("r1 = a | r2 = c"), no, cat(size, "000 uM"), F.lit("Trypsin"), no, no, F.lit("15 mmu"), F.lit("30 ppm")).alias("corrected"),
        F.array(F.lit("r1"), F.lit("r2")).alias("run_keys"),
        _case(m, *lits("", "", "", "", "", "", "", "", "runs were pooled", "we added 100 nM of it", "", "", "we searched Acetyl (Protein N-term) and others", "searched acetyl (K)", "within 0.015 Da", "within 5 ppm")).alias("paper"),
    )
    g = J.guarded(a)
    return g.select("p_partkey", "verdict", "match_type", "mismatch", "hallucinated", "value_correct", "value_complete", "corrected", F.array_join("guards", ";").alias("guards"))


def sample_sheet_guard(spark, sf_dir):
    """Customers as samples of their nation: ages that a text gives as a range for every other nation, and sexes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pxd"), F.col("c_custkey").alias("row"), (F.col("c_custkey") % 90).alias("age"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"), F.when((F.col("c_custkey") % 4 == 1) & (F.col("c_nationkey") % 3 == 0), "HeLa").otherwise("n/a").alias("line"))
    long = c.select("pxd", F.col("row").alias("row_idx"), F.explode(F.array(F.struct(F.lit("age").alias("field"), F.col("age").cast("string").alias("cell")), F.struct(F.lit("sex").alias("field"), F.col("sex").alias("cell")), F.struct(F.lit("cell_line").alias("field"), F.col("line").alias("cell")))).alias("x")).select("pxd", "row_idx", "x.*")
    results = long.filter("field <> 'cell_line'").select("pxd", "field", F.lit("value").alias("kind"), F.col("cell").alias("value"), F.when(F.col("row_idx") % 3 == 0, "high").otherwise("low").alias("verdict"), (F.col("row_idx") % 3 == 1).alias("hallucinated"), F.lit(False).alias("mismatch"), F.array("row_idx").alias("rows"))
    ranges = c.filter("pxd % 2 = 0").select("pxd").distinct().select("pxd", F.lit("age").alias("field"), F.lit(20.0).alias("lo"), F.lit(40.0).alias("hi"))
    g = J.sample_sheet_guard(results, long, ranges)
    return g.select("pxd", F.col("rows")[0].alias("row_idx"), "field", "verdict", "hallucinated", "guard")


def recovered_values(spark, sf_dir):
    """Parts as candidates for fields of their brand, with reasons for those that aren't taken."""
    p = table(spark, sf_dir, "part")
    k = F.floor(F.col("p_partkey") / 3)
    field = _case(F.col("p_partkey") % 7, F.lit("Modification"), F.lit(" modification"), F.lit("TISSUE"), F.lit("Age "), F.lit("MODIFICATION"), F.lit("nonsense"), F.lit("sex"))
    value = F.when(F.col("p_size") % 11 == 0, "n/a").when(F.col("p_size") % 5 == 0, "fixed").otherwise(F.substring_index("p_name", " ", 1))
    evidence = F.when(F.col("p_partkey") % 13 == 0, "short").when(F.col("p_partkey") % 17 == 0, "made up evidence").otherwise(F.concat(F.lit('"printed: '), F.col("p_name"), F.lit('"')))
    c = p.select(k.alias("pxd"), F.col("p_partkey").alias("seq"), field.alias("field"), value.alias("value"), evidence.alias("evidence"), F.concat(F.lit("The text. PRINTED:  "), F.col("p_name"), F.lit(".")).alias("paper"))
    accepted = p.filter("p_partkey % 4 = 0").select(k.alias("pxd"), F.lit("tissue").alias("field"), F.lit("x").alias("value")).unionAll(p.filter("p_partkey % 6 = 0").select(k, F.lit("modification"), F.lit("NT=Fixed")))
    rejected = p.filter("p_partkey % 5 = 0").select(k.alias("pxd"), F.lit("age").alias("field"), F.upper(F.substring_index("p_name", " ", 1)).alias("value"))
    r = J.recovered(c, accepted, rejected, ["tissue", "age", "sex", "modification"])
    return r.select("pxd", "seq", "field", "reason", "evidence_check")


def modification_cells(spark, sf_dir):
    """Lists of modifications in words as cells, their readable form, and the cell that printed sites make."""
    p = table(spark, sf_dir, "part")
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    words = _case(m, F.lit("Oxidation (M) variable, Carbamidomethyl (C) fixed"), F.concat(F.lit("Phospho (ST), M"), size, F.lit(" (Protein N-term); all variable")), F.concat(F.lit("NT=X"), size, F.lit(";TA=K")), F.concat(F.lit("Label "), size))
    cells = J.modifications(words)
    site = J.modification_of_sites(F.concat(F.lit("NT=M"), size, F.lit(";AC=A:1;MT=Fixed")), J.printed_sites(F.concat(F.lit("M"), size), F.concat(F.lit("with m"), size, F.lit(" (S, T) and M"), size, F.lit(" (Protein N-term)"))))
    return p.select("p_partkey", F.array_join(cells, " + ").alias("cells"), F.array_join(F.transform(cells, J.readable), " + ").alias("readable"), J.modification_key(F.concat(F.lit("NT=A;TA=T, S;MT=Fixed;AC="), size)).alias("meaning"), site.alias("site"))


def unit_context(spark, sf_dir):
    """Sizes and types of parts' brands beside each other."""
    p = table(spark, sf_dir, "part")
    u = p.select(F.col("p_brand").alias("pxd"), F.lit("size").alias("field"), (F.col("p_size") % 3).cast("string").alias("cell")).unionAll(p.select("p_brand", F.lit("type"), F.concat(F.lit("NT="), F.substring_index("p_type", " ", 1), F.lit(";AC=T:1")))).distinct()
    related = spark.createDataFrame([("size", "type"), ("type", "size"), ("type", "none")], "field string, other string")
    return J.with_context(u, related)


def degenerate_answers(spark, sf_dir):
    """Which answers have run wild, of those that documents make by being repeated, cut or spoilt."""
    from metaloom.operators import guards as Q

    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 5
    a = _case(m, F.col("text"), F.lit("- a " * 60), F.repeat(F.lit("ab"), 400), F.repeat(F.lit("Some words of an answer, with enough variety to pass; "), 90), F.concat(F.repeat(F.lit("Some words of an answer, with enough variety to pass; "), 90), F.lit("VERDICT: high")))
    return d.select("doc_id", Q.degenerate(F.when(m == 0, F.left("text", F.lit(99))).otherwise(a)).alias("degenerate"))


def _run(spark, sf_dir):
    """A run over parts as samples of their brands: a type for each, of which some are judged made up, misplaced, wrong, or in part, and a size, not judged where it is large."""
    p = table(spark, sf_dir, "part")
    brand, k = F.col("p_brand").alias("pxd"), F.col("p_partkey")
    cells = p.select(brand, F.lit("type").alias("field"), k.alias("row_idx"), F.lit(0).alias("col_idx"), F.when(k % 7 == 0, "not available").otherwise(F.col("p_type")).alias("cell"))
    cells = cells.unionAll(p.select(brand, F.lit("size"), k, F.lit(1), F.col("p_size").cast("string")))
    papers = p.groupBy(brand).agg(F.when(F.col("pxd").endswith("7"), "").otherwise("The text.").alias("text"))
    t = p.filter(k % 7 != 0).select("p_brand", F.lower("p_type").alias("unit")).distinct()
    m = F.length("unit") % 5
    answers = t.select(F.col("p_brand").alias("pxd"), F.lit("type").alias("field"), "unit", F.when(m < 2, "high").when(m == 2, "medium").otherwise("low").alias("verdict"), (m == 3).alias("hallucinated"), (m == 4).alias("mismatch"), (m < 2).alias("value_correct"), F.lit(True).alias("value_complete"), F.when(m == 2, F.lit("Fixed")).alias("corrected"))
    s = p.filter("p_size <= 25").select("p_brand", F.col("p_size").cast("string").alias("unit")).distinct()
    no = F.lit(False)
    answers = answers.unionAll(s.select("p_brand", F.lit("size"), "unit", F.lit("medium"), no, no, F.lit(True), no, F.lit(None).cast("string")))
    return J2.run(cells, papers, answers, ["type", "size", "age"])


def judge_run_papers(spark, sf_dir):
    """Of each paper of the run its counts."""
    return _run(spark, sf_dir)[0]["per_paper"].withColumn("accuracy", F.round("accuracy", 6))


def judge_run_fields(spark, sf_dir):
    """Of each field of the run its counts, in the order of fields, and whether all of them add up to the observed counters."""
    tables, counters = _run(spark, sf_dir)
    f = tables["per_field"].withColumn("accuracy", F.round("accuracy", 6))
    totals = f.agg(*[(F.sum(c) == counters[c]).alias(c) for c in J2.COUNTS])
    agree = totals.select(F.forall(F.array(*J2.COUNTS), lambda x: x).alias("agree"))
    return f.crossJoin(F.broadcast(agree))  # one row


def judge_run_cells(spark, sf_dir):
    """The run's cells as its verdicts leave them."""
    return _run(spark, sf_dir)[0]["filtered"].select("pxd", "field", "row_idx", "fixed")


REASONS = (  # answers about a value of the field tissue, and the field that they name
    ("VERDICT: low\n**CORRECT_TYPE_NAME:** Cell_Line\n", "cell_line"),
    ("CORRECT_TYPE_NAME: tissue\nIt belongs in the Disease_State column.", "disease_state"),
    ("- CORRECT_TYPE_NAME: NONE", None),
    ("It says CORRECT_TYPE_NAME: age.\n> CORRECT_TYPE_NAME: `(sex)`.", "sex"),
    ("I think CORRECT_TYPE_NAME: age, no more", "age"),
    ("The correct field is age here", None),
    ("The correct type is nothing; the correct field is cell_line. It belongs to Sex", "cell_line"),
    ("It belongs to Tissue or belongs in Age", "age"),
    ("CORRECT_TYPE_NAME: unheard_of", None),
    ("CORRECT_TYPE_NAME:\nage", None),
    (None, None),
)


def corrected_fields(spark, sf_dir):
    """The field that answers about parts say their value belongs to."""
    p = table(spark, sf_dir, "part")
    k = (F.col("p_partkey") % len(REASONS)).cast("int")
    reason = F.get(F.array(*[F.lit(r) for r, _ in REASONS]), k)
    return p.select("p_partkey", J.corrected_field(reason, F.lit("tissue"), ["tissue", "cell_line", "disease_state", "age", "sex"]).alias("field"))


def sheet_columns(spark, sf_dir):
    """Tables of brands' parts after values were recovered: one column is filled where it was empty, one is inserted."""
    p = table(spark, sf_dir, "part")
    even = F.substring_index("p_brand", "#", -1).cast("int") % 2 == 0
    cell = lambda c, header, field, value: F.struct(F.lit(c).alias("col_idx"), F.lit(header).alias("header"), F.lit(field).alias("field"), value.alias("cell"))
    own = F.array(cell(0, "source name", "other", F.col("p_name")), cell(1, "characteristics[organism part]", "tissue", F.when(even, "not available").otherwise(F.col("p_type"))), cell(2, "factor value[size]", "factor", F.col("p_size").cast("string")))
    cells = p.select(F.col("p_brand").alias("pxd"), F.col("p_partkey").alias("row_idx"), F.explode(own).alias("c")).select("pxd", "row_idx", "c.*")
    brands = p.select(F.col("p_brand").alias("pxd")).distinct()
    found = brands.select("pxd", F.lit(0).alias("seq"), F.lit("tissue").alias("field"), F.concat(F.lit("of "), "pxd").alias("value")).unionAll(brands.select("pxd", F.lit(1), F.lit("age"), F.lit("9")))
    return T.filled(cells, found, {"tissue": "characteristics[organism part]", "age": "characteristics[age]"})


QUERIES = {f.__name__: f for f in (sheet_columns, corrected_fields, judge_run_papers, judge_run_fields, judge_run_cells, judge_hints, judge_guards, sample_sheet_guard, recovered_values, modification_cells, unit_context, degenerate_answers)}
GUARDS = (
    # verdict, match type, mismatch, hallucinated, value correct, value complete, corrected, guards
    "'high', 'CORRECT', false, false, true, true, NULL, ''",
    "'medium', 'PARTIAL', false, false, true, false, 'other', 'mismatch_veto'",
    "'low', 'HALLUCINATED', false, true, false, false, NULL, 'reconcile'",
    "'low', 'TYPE_MISMATCH', true, false, false, false, NULL, 'reconcile'",
    "NULL, 'ERROR', false, false, false, false, NULL, ''",
    "'high', 'CORRECT', false, false, true, true, NULL, 'one_value'",
    "'medium', 'PARTIAL', false, false, true, false, NULL, 'runs'",
    "'high', 'CORRECT', false, false, true, true, NULL, 'unit'",
    "'medium', 'PARTIAL', false, false, true, false, NULL, 'regroup'",
    "'high', 'CORRECT', false, false, true, true, NULL, 'unit'",
    "'high', 'CORRECT', false, false, true, true, NULL, 'unit'",
    "'medium', 'PARTIAL', false, false, true, false, 'NT=Trypsin;AC=MS:1001251', 'accession'",
    "'medium', 'PARTIAL', false, false, false, true, 'NT=Acetyl;AC=UNIMOD:1;PP=Protein N-term;MT=Variable', 'modification'",
    "'high', 'CORRECT', false, false, true, true, NULL, 'modification'",
    "'medium', 'PARTIAL', false, false, true, false, '0.015 Da', ''",
    "'low', 'NO_MATCH', false, false, true, false, NULL, 'number'",
)
HINTS = ("in_text", "not_verbatim", "in_text", "not_verbatim;tolerance_without_unit", "not_verbatim;tolerance_not_printed", "in_text;write_normal", "in_text;no_kind", "not_a_number")
RUN = """
WITH good AS (SELECT * FROM part WHERE p_brand NOT LIKE '%7'),
u AS (SELECT DISTINCT p_brand pxd, 'type' field, lower(p_type) unit, length(p_type) % 5 m FROM good WHERE p_partkey % 7 <> 0
  UNION ALL SELECT DISTINCT p_brand, 'size', p_size::VARCHAR, CASE WHEN p_size <= 25 THEN 5 ELSE 6 END FROM good)"""
COUNTED = """count(*) total, count(*) FILTER (m < 2) correct, count(*) FILTER (m = 3) hallucinated, count(*) FILTER (m = 4) mismatch, count(*) FILTER (m = 2) wrong,
  count(*) FILTER (m = 5) incomplete, count(*) FILTER (m = 2) corrected, count(*) FILTER (m = 6) error, round(count(*) FILTER (m < 2) / nullif(count(*) FILTER (m <> 6), 0)::DOUBLE, 6) accuracy"""
ORACLES = {
    "sheet_columns": """
WITH p AS (SELECT p_brand pxd, p_partkey row_idx, p_name, p_type, p_size, replace(p_brand, 'Brand#', '')::INT % 2 = 0 even FROM part)
SELECT pxd, row_idx, 0 col_idx, 'source name' header, 'other' field, p_name cell FROM p
UNION ALL SELECT pxd, row_idx, 1, 'characteristics[organism part]', 'tissue', CASE WHEN even THEN 'of ' || pxd ELSE p_type END FROM p
UNION ALL SELECT pxd, row_idx, 2, 'characteristics[age]', 'age', '9' FROM p UNION ALL SELECT pxd, row_idx, 3, 'factor value[size]', 'factor', p_size::VARCHAR FROM p""",
    "corrected_fields": "SELECT p_partkey, [" + ", ".join("NULL" if f is None else f"'{f}'" for _, f in REASONS) + f"][p_partkey % {len(REASONS)} + 1] AS field FROM part",
    "judge_run_papers": f"{RUN}, c AS (SELECT pxd, {COUNTED} FROM u GROUP BY 1) SELECT c.*, r.runs, 2 AS columns FROM c JOIN (SELECT p_brand pxd, count(DISTINCT p_partkey) runs FROM good GROUP BY 1) r USING (pxd)",
    "judge_run_fields": f"""{RUN}, f(place, field) AS (VALUES (0, 'type'), (1, 'size'), (2, 'age')), c AS (SELECT field, {COUNTED} FROM u GROUP BY 1)
SELECT place, f.field, coalesce(total, 0) total, coalesce(correct, 0) correct, coalesce(hallucinated, 0) hallucinated, coalesce(mismatch, 0) mismatch, coalesce(wrong, 0) wrong,
  coalesce(incomplete, 0) incomplete, coalesce(corrected, 0) corrected, coalesce(error, 0) error, accuracy, true AS agree FROM f LEFT JOIN c USING (field)""",
    "judge_run_cells": f"""{RUN} SELECT p_brand pxd, 'type' field, p_partkey row_idx, CASE WHEN p_partkey % 7 = 0 THEN 'not available' WHEN length(p_type) % 5 = 2 THEN 'Fixed' WHEN length(p_type) % 5 > 2 THEN 'not available' ELSE p_type END fixed FROM good
UNION ALL SELECT p_brand, 'size', p_partkey, p_size::VARCHAR FROM good""",
    "judge_hints": "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HINTS)) + " END hints FROM part",
    "judge_guards": "WITH g(m, verdict, match_type, mismatch, hallucinated, value_correct, value_complete, corrected, guards) AS (VALUES " + ", ".join(f"({k}, {g})" for k, g in enumerate(GUARDS)) + ") SELECT p_partkey, g.* EXCLUDE m FROM part JOIN g ON m = p_partkey % 16",
    "sample_sheet_guard": """WITH c AS (SELECT c_nationkey pxd, c_custkey AS row, c_custkey % 90 age, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END sex, c_custkey % 4 = 1 AND c_nationkey % 3 = 0 line FROM customer),
      n AS (SELECT pxd, count(DISTINCT age) ages, count(DISTINCT sex) sexes FROM c GROUP BY 1), l AS (SELECT c.*, 'age' field, ages >= 5 many FROM c JOIN n USING (pxd) UNION ALL SELECT c.*, 'sex', sexes >= 2 FROM c JOIN n USING (pxd)),
      g AS (SELECT pxd, row row_idx, field, CASE WHEN row % 3 = 0 THEN 'high' ELSE 'low' END v, row % 3 = 1 h, CASE WHEN field = 'age' AND many AND pxd % 2 = 0 THEN CASE WHEN age BETWEEN 20 AND 40 THEN 'range_inside' ELSE 'range_outside' END
        WHEN row % 3 = 1 AND line THEN 'cell_line' WHEN row % 3 = 1 AND many THEN 'sample_sheet' END guard FROM l)
      SELECT pxd, row_idx, field, CASE WHEN guard = 'range_outside' THEN 'low' WHEN guard IS NOT NULL THEN 'unverifiable' ELSE v END verdict, guard IS NULL AND h hallucinated, guard FROM g""",
    "recovered_values": """WITH c AS (SELECT p_partkey // 3 pxd, p_partkey seq, CASE p_partkey % 7 WHEN 2 THEN 'tissue' WHEN 3 THEN 'age' WHEN 5 THEN 'nonsense' WHEN 6 THEN 'sex' ELSE 'modification' END field,
        CASE WHEN p_size % 11 = 0 THEN 'n/a' WHEN p_size % 5 = 0 THEN 'fixed' ELSE string_split(p_name, ' ')[1] END v, CASE WHEN p_partkey % 13 = 0 THEN 'short' WHEN p_partkey % 17 = 0 THEN 'made up evidence' ELSE 'x' END e FROM part),
      acc AS (SELECT DISTINCT p_partkey // 3 pxd FROM part WHERE p_partkey % 4 = 0), mods AS (SELECT DISTINCT p_partkey // 3 pxd FROM part WHERE p_partkey % 6 = 0),
      rej AS (SELECT DISTINCT p_partkey // 3 pxd, lower(string_split(p_name, ' ')[1]) v FROM part WHERE p_partkey % 5 = 0),
      d AS (SELECT *, count(*) OVER (PARTITION BY pxd, field) per, field = 'age' AND (pxd, lower(v)) IN (SELECT pxd, v FROM rej) rejected, e = 'x' AND v <> 'n/a' AND NOT (field = 'age' AND (pxd, lower(v)) IN (SELECT pxd, v FROM rej)) sound FROM c)
      SELECT *, CASE WHEN reason IS NULL THEN 'normalized' WHEN reason = 'evidence_absent' THEN 'absent' END evidence_check FROM (SELECT pxd, seq, field, CASE WHEN field = 'nonsense' THEN 'unknown_field' WHEN field = 'tissue' AND pxd IN (SELECT pxd FROM acc) THEN 'not_open' WHEN field <> 'modification' AND per > 1 THEN 'several' WHEN v = 'n/a' THEN 'empty' WHEN rejected THEN 'rejected'
        WHEN field = 'modification' AND v = 'fixed' AND pxd IN (SELECT pxd FROM mods) THEN 'present' WHEN coalesce(sum(sound::INT) OVER (PARTITION BY pxd, field, lower(v) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'duplicate'
        WHEN e = 'short' THEN 'evidence_length' WHEN e <> 'x' THEN 'evidence_absent' END reason FROM d)""",
    "modification_cells": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NT=Oxidation;TA=M;MT=Variable + NT=Carbamidomethyl;TA=C;MT=Fixed' WHEN 1 THEN 'NT=Phospho;TA=S,T;MT=Variable + NT=M' || p_size || ';PP=Protein N-term;MT=Variable' WHEN 2 THEN 'NT=X' || p_size || ';TA=K' ELSE 'NT=Label ' || p_size END cells,
      CASE p_partkey % 4 WHEN 0 THEN 'Oxidation (M, Variable) + Carbamidomethyl (C, Fixed)' WHEN 1 THEN 'Phospho (S,T, Variable) + M' || p_size || ' (Protein N-term, Variable)' WHEN 2 THEN 'X' || p_size || ' (K)' ELSE 'Label ' || p_size END readable,
      'a|s,t||fixed' meaning, 'NT=M' || p_size || ';AC=A:1;TA=S,T;PP=Protein N-term;MT=Fixed' site FROM part""",
    "unit_context": """WITH u AS (SELECT DISTINCT p_brand pxd, 'size' field, (p_size % 3)::VARCHAR cell, (p_size % 3)::VARCHAR r FROM part UNION SELECT DISTINCT p_brand, 'type', 'NT=' || string_split(p_type, ' ')[1] || ';AC=T:1', string_split(p_type, ' ')[1] FROM part),
      v AS (SELECT pxd, field, string_agg(DISTINCT r, ', ' ORDER BY r) vs FROM u GROUP BY 1, 2) SELECT u.pxd, u.field, cell, v.field || ': ' || vs context FROM u JOIN v ON v.pxd = u.pxd AND v.field <> u.field""",
    "degenerate_answers": "SELECT doc_id, doc_id % 5 IN (1, 2, 3) degenerate FROM documents",
}

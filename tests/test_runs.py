import pytest
from pyspark.sql import functions as F

from metaloom import refdata
from metaloom.functions import runs as R
from metaloom.functions import text as X


@pytest.mark.parametrize(
    "name, want",
    [
        ("QEHFX2_HeLa_DIA_HCD_CID_F3", {"instrument": "Q Exactive HF-X", "acquisition": "DIA", "fragmentation": "HCD; CID", "organism": "Homo sapiens", "cell_line": "HeLa", "fractionation": "True"}),
        ("Mouse_liver_plasma_TMT10", {"organism": "Mus musculus", "tissue": "blood plasma", "labeling": "TMT", "cell_line": None}),
        ("mouseBrain_10HeLa", {"organism": "Mus musculus; Homo sapiens", "cell_line": "HeLa"}),
        ("timsTOF-SCP_phospho_Nuc_WT", {"instrument": "timsTOF SCP", "enrichment": "phospho-enrichment", "cell_part": "nucleus", "disease": "healthy"}),
        ("deliveries_radial", {"tissue": None, "acquisition": None, "organism": None}),
        ("", {"tissue": None, "fragmentation": None}),
    ],
)
def test_run_names(spark, name, want):
    row = spark.createDataFrame([(name,)], "n string").select(*[c.alias(k) for k, c in R.run_fields(F.col("n"), ["HeLa", "MCF-7"]).items()]).first()
    assert {k: row[k] for k in want} == want


def test_cohorts(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(R.is_human(a("Homo sapiens"))) and not one(R.is_human(a("Mus musculus")))
    assert one(R.is_healthy(a("normal", "n/a"))) and not one(R.is_healthy(a("n/a"))) and one(R.is_cancer(a("Breast carcinoma")))
    assert one(R.is_fluid(F.lit("Blood plasma"))) and not one(R.is_fluid(F.lit("blood vessel"))) and one(R.tissue_class(F.lit("prefrontal cortex"))) == "Brain"
    assert one(R.licence_flags(F.lit("CC BY 4.0"), F.lit(None).cast("string"))["minable"]) and not one(R.licence_flags(F.lit("CC BY-ND"), F.lit(""))["open"])
    assert one(X.aliased(F.lit("Cell Type"), refdata.FIELD_OF)) == "cell_type"


def test_tables(spark):
    assert refdata.FIELD_OF["bmi"] == "BMI" and refdata.CELL_TYPE_OF_LINE["jurkat"] == "T cell" and len(refdata.LINEAGE) == 19
    assert refdata.frame(spark, refdata.ALTERNATIVES, "field string, other string").filter("field = 'strain'").count() == 2


def test_a_kept_record_gives_the_same_fields(spark):
    names = ["QEHFX2_HeLa_DIA_HCD_CID_F3", "mouseBrain_10HeLa", "timsTOF-SCP_phospho_Nuc_WT", "", None, "h_e_l_a", "h_e_l_a_x", "M_C_F_-7", "abcde_f", "a_b_c_d_e_f", "a_b_c_d_e_f abcde_f", "xHELA HeLax", "ΣHeLa_ς"]
    lines = ["HeLa", "MCF-7", "abcdef"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("f", R.run_hits(F.col("n"), lines))
    plain = [c.alias(f"p_{k}") for k, c in R.run_fields(F.col("n"), lines).items()]
    kept = R.fields_of(F.col("f"), lines=True)
    plan = rows.select(*[c.alias(k) for k, c in kept.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4  # of one record, whatever the number of columns
    found = rows.select("n", *[c.alias(k) for k, c in kept.items()], *plain).collect()
    assert all(r[k] == r[f"p_{k}"] for r in found for k in kept)
    # runs of up to five words, here and elsewhere in the name
    assert [r["cell_line"] for r in found][5:] == ["HeLa", "HeLa", "MCF-7", "abcdef", None, "abcdef", "HeLa", "HeLa"]

import pytest
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


L = F.lit


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: X.key(L("  A \n b ")), "a b"),
        (lambda: X.plain(L(" Orbitrap™ ")), "orbitrap"),
        (lambda: X.is_nullish(L(" N/A ")), True),
        (lambda: X.is_nullish(L("na"), "checker"), False),
        (lambda: X.is_nullish(L(None).cast("string")), True),
        (lambda: X.first_short(F.array(L("unknown"), L("x" * 120), L("liver"))), "liver"),
        (lambda: X.aliased(L("Tissue"), {"tissue": "organism part"}), "organism part"),
        (lambda: X.split_set(L("A; b;n/a; a")), ["a", "b"]),
        (lambda: X.split_outside_parens(L("a (b; c); d;; e")), ["a (b; c)", "d", "e"]),
        (lambda: X.unify_separators(L("liver, kidney / lung and Blood/Plasma")), "liver; kidney; lung and Blood; Plasma"),
        (lambda: X.comparable(L("b;A; b")), "a; b"),
        (lambda: X.folded_sorted(F.array(L("b"), L("A"), L("a"))), ["A", "b"]),
        (lambda: X.header_key(L("characteristics[Organism part]")), "organismpart"),
        (lambda: X.header_kind(L("Comment[label]")), "comment"),
        (lambda: X.cell_value(L("AC=A:1;NT=Trypsin ")), "Trypsin"),
        (lambda: X.cell_value(L(" bare ")), "bare"),
        (lambda: X.cell_value(L("AC=A:1")), None),
        (lambda: X.cell_identity(L("AC=A:1;NT=Ox;TA=M")), "nt=ox;ta=m"),
        (lambda: X.number_of(L("Three replicates")), 3.0),
        (lambda: X.number_of(L("12.5 mg")), 12.5),
        (lambda: X.number_of(L("two or three")), None),
        (lambda: X.quantity(L("5 mg"))["value"], 0.005),
        (lambda: X.quantity(L("12 things")), None),
        (lambda: F.size(X.ranges(L("from 400-1600 and 2 to 5"))), 2),
        (lambda: X.run_stem(L("a\\b/run_1.mzML.gz")), "run_1"),
        (lambda: X.run_stem(L("run.d")), "run"),
        (lambda: X.fraction_of(L("s1_F03"))["fraction_id"], 3),
        (lambda: X.fraction_of(L("plain")), None),
        (lambda: X.without_taxon(L("9606 (Homo sapiens)")), "Homo sapiens"),
        (lambda: X.binomial_short(L("Homo sapiens")), ["h.sapiens", "h. sapiens", "homo.sapiens"]),
        (lambda: X.expand_binomial(L("Homo.sapiens")), "Homo sapiens"),
        (lambda: X.curie(L("cl_0000084")), "CL:0000084"),
        (lambda: X.line_key(L("He-La (S3)")), "helas3"),
        (lambda: X.clean_instrument(L("Thermo Scientific Q Exactive (HF) mass spectrometer")), "Q Exactive"),
        (lambda: X.inferred(L(" Inferred from title")), True),
        (lambda: X.without_inferred(L("inferred from: title")), "title"),
        (lambda: X.is_measurement(L("10 ppm")), True),
        (lambda: X.without_markdown(L("## **Bold** `x`")), "Bold x"),
        (lambda: X.last_answer(L("Verdict: a\nx\nverdict:  b "), "verdict"), "b"),
        (lambda: X.last_answer(L("none"), "verdict"), None),
        (lambda: X.sections(L("=== A ===\none\n=== B ===\ntwo"))["B"], "two"),
        (lambda: X.properties(L("k: a; b\nnothing\nm: c"))["k"], ["a", "b"]),
        (lambda: X.plex(F.array(L("TMT126"), L("TMT127N"))), "TMT2plex"),
        (lambda: X.balanced_json(L('x {"a": "}", "b": {"c": 1}} y {')), '{"a": "}", "b": {"c": 1}}'),
        (lambda: X.answer_json(L('THOUGHT {"no": 1} FINAL JSON: ```json\n{"a": {"b": 2}}\n```')), '{"a": {"b": 2}}'),
        (lambda: X.salvage(L('{"organism": ["human", "ev"], "tissue": "liver", "x": [')), {"organism": "human", "tissue": "liver"}),
        (lambda: X.repaired_pair(F.array(L("v")))["evidence"], ""),
        (lambda: X.canonical(L("Ａ–b  C")), "a-b c"),
        (lambda: X.ratio(L("H. sapiens"), L("Homo sapiens")), 0.95),
        (lambda: X.ratio(L("abc"), L("ABC")), 1.0),
        (lambda: X.confidence_bucket(L(0.7)), "medium"),
        (lambda: M.hop_score(L(3)), 0.83),
        (lambda: M.tier(L(False), L(0.2), L(2)), "near"),
        (lambda: M.outcome(L(0.5), L(True)), "accepted"),
        (lambda: M.set_status(F.array(L(1)), F.array(L(1), L(2))), "additional"),
        (lambda: M.match_kind(F.array(L(1)), F.array(L(2))), "MISMATCH"),
        (lambda: M.partly_contained(F.array(L("ab")), F.array(L("xaby"))), True),
        (lambda: M.kappa(L(10), L(5), L(5), L(0), L(0)), 1.0),
        (lambda: M.kappa(L(10), L(10), L(0), L(0), L(0)), None),
        (lambda: M.cosine(F.array(L(1.0), L(0.0)), F.array(L(-1.0), L(0.0))), 0.0),
        (lambda: M.cosine(F.array(L(0.0)), F.array(L(1.0))), None),
    ],
)
def test_expression(spark, make, want):
    got = one(spark, make())
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_cell_text_round_trip(spark):
    assert one(spark, X.cell_text(X.cell_map(L("AC=A:1;PP=Anywhere;NT=Ox")))) == "NT=Ox;AC=A:1;PP=Anywhere"


def test_snapping():
    src = "We used Homo  sapiens cells. The samples were digested with trypsin overnight at 37 degrees. End."
    assert X.snapped("Homo  sapiens", src) == ("Homo  sapiens", "verbatim")
    assert X.snapped("homo sapiens CELLS", src) == ("Homo  sapiens cells", "normalized")
    q, how = X.snapped("The sample was digested with trypsin overnight at 37 degrees", src)
    assert how == "sentence" and q.startswith("The samples were digested")
    assert X.snapped("nothing of this kind is anywhere in there at all", src) == (None, "absent")
    assert X.snapped(None, src) == (None, "absent")
    assert X.snapped("STRASSE 12 in Berlin", "Die Straße 12 in Berlin ist lang") == ("Straße 12 in Berlin", "normalized")
    assert X.snapped("inferred: mice were fed ad libitum", "All mice were fed ad libitum.") == ("mice were fed ad libitum", "verbatim")
    assert X.snapped("ﬁbre–rich diet", "A Fibre-rich  Diet, they said") == ("Fibre-rich  Diet", "normalized")
    assert X.snapped("ample was\nheated", "The sample  was heated.") == ("ample  was heated", "normalized")


def test_snapped_quotes_keep_line_ends_and_whole_letters():
    src = "Das eneinßpf einsch.\nUnd der enäachß. Ende"
    assert X.snapped("ßPF EINSCH", src) == ("ßpf einsch", "normalized")
    assert X.snapped("UND DER ENÄ", src) == ("Und der enä", "normalized")
    assert X.snapped("INßPF EINSCH.\n", src) == ("inßpf einsch.\n", "normalized")
    assert X.snapped("\nUND DER", src) == ("\nUnd der", "normalized")
    assert X.snapped("\n EINSCH", src) == ("einsch", "normalized")
    assert X.snapped("inferred: \nUnd der", src) == ("\nUnd der", "verbatim")
    assert X.snapped("inferred:\neinsch", src) == ("einsch", "verbatim")


def test_snapped_quotes_of_several_places_have_the_words_of_their_own(spark):
    from metaloom.operators import grounding

    src = "La La La la la, LA LA\n La la"
    assert X.snapped("LA LA LA", src) == ("La La La", "normalized")
    assert X.snapped("LA LA LA", src, place=3) == ("La La la", "normalized")
    assert X.snapped("LA LA LA", src, place=4) == ("La La La", "normalized")  # not there
    assert X.snapped("LA LA", src, place=6) == ("La la", "verbatim")  # as written elsewhere
    assert X.snapped("\nLA LA", src, place=21) == ("La la", "normalized")
    assert X.snapped("NONE", src, place=99) == (None, "absent")
    e = spark.createDataFrame([(1, 0, "LA LA LA", 3), (1, 1, "inferred: LA LA LA", 3), (1, 2, "LA LA LA", None), (1, 3, "LA LA", 6), (1, 4, "LA LA", None), (1, 5, "la LA", 12)], "id long, seq int, evidence string, place int")
    got = grounding.snapped(e, spark.createDataFrame([(1, src)], "id long, text string")).sort("seq").collect()
    assert [r.evidence for r in got] == ["La La la", "inferred: La La la", "La La La", "La la", "LA LA", "La La"]
    assert [r.status for r in got] == ["normalized"] * 3 + ["verbatim"] * 2 + ["normalized"]


def test_evidence_snapped_of_repeated_words_equals_sql(spark, tmp_path):
    import duckdb

    from metaloom.plans import registry

    texts = ["La " * 25 + "la " * 30, "x" * 9 + "Word one, two. " * 8 + "WORD ONE, TWO. " * 8]
    spark.createDataFrame([(6 * i + m, t) for m in range(6) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["evidence_snapped"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["evidence_snapped"](spark, str(tmp_path)).collect())) == sorted(want)


def test_snapped_entries_keep_line_ends(spark):
    from metaloom.operators import grounding

    e = spark.createDataFrame([(1, "tissue", 0, "v", "inferred: \nUnd der "), (1, "tissue", 1, "v", "\nUND DER")], "id long, field string, seq int, value string, evidence string")
    got = grounding.snapped(e, spark.createDataFrame([(1, "Einsch.\nUnd der Ende")], "id long, text string")).sort("seq")
    assert [(r.evidence, r.status) for r in got.collect()] == [("inferred: \nUnd der", "verbatim"), ("\nUnd der", "normalized")]

import json
import pickle

from pyspark.sql import functions as F

from metaloom.operators import ontology as O
from metaloom.sources import readers as R
from metaloom.sources import writers as Wr

OBO = """format-version: 1.2

[Term]
id: T:1
name: cell
def: "A unit of \\"life\\"." [x:1]

[Term]
id: T:2
name: leukocyte ! no
synonym: "white cell" EXACT []
synonym: "wbc" RELATED [y:2]
synonym: "plain" []
is_a: T:1 ! cell
relationship: part_of U:9 ! blood
relationship: in_taxon NCBI:9606
xref: M:5
xref: K:1

[Term]
id: T:3
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""
OWL = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">
<owl:Class rdf:about="http://x/L_1"><rdfs:label>HeLa</rdfs:label><oboInOwl:hasExactSynonym>hela line</oboInOwl:hasExactSynonym><rdfs:subClassOf rdf:resource="http://x/L_0"/>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/derives_from"/><owl:someValuesFrom rdf:resource="http://x/NCBITaxon_9606"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="http://x/L_2"><owl:deprecated>true</owl:deprecated></owl:Class></rdf:RDF>"""


def found(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "a" / "P1").mkdir(parents=True)
    (tmp_path / "a" / "P1" / "manuscript.txt").write_text("one")
    (tmp_path / "a" / "two.txt").write_text("line\nline")
    got = {(r.doc_id, r.text) for r in R.documents(R.files(spark, str(tmp_path), "*.txt")).collect()}
    assert got == {("P1", "one"), ("two", "line\nline")}
    assert R.inventory(spark, str(tmp_path)).filter("small").count() == 2


def test_json(spark):
    f = found(spark, [("x/a.json", '{"v": 1}'), ("x/b.json", "{broken")])
    got = {r.doc_id: (r.record.v if r.record else None, r.broken) for r in R.json_records(f, "v int").collect()}
    assert got == {"a": (1, None), "b": (None, "{broken")}
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert {(r.k, r.v, r.place) for r in R.preferred([one, two], ["k"]).collect()} == {("a", 1, 0), ("b", 3, 1)}


def test_obo(spark):
    t = R.obo_tables(R.obo_terms(found(spark, [("x.obo", OBO)])))
    assert {(r.id, r.name) for r in t["node"].collect()} == {("T:1", "cell"), ("T:2", "leukocyte ! no")}
    assert {(r.synonym, r.scope) for r in t["synonym"].collect()} == {("white cell", "EXACT"), ("wbc", "RELATED"), ("plain", "UNSPECIFIED")}
    assert {(r.child, r.parent, r.relation) for r in t["edge"].collect()} == {("T:2", "T:1", "is_a"), ("T:2", "U:9", "part_of")}
    assert [(r.id, r.taxon_id) for r in t["taxon"].collect()] == [("T:2", "NCBI:9606")]
    assert R.xrefs(t, "M:").first().xrefs == ["M:5"]
    assert R.obo_tables(R.obo_terms(found(spark, [("x.obo", "")])))["node"].count() == 0


def test_owl(spark):
    got = {r.id: r for r in R.owl_classes(found(spark, [("x.owl", OWL), ("bad.owl", "<a>")])).collect()}
    assert got["L:1"].name == "HeLa" and got["L:1"].parents == ["L:0"] and got["L:1"].synonyms == ["hela line"]
    assert [tuple(x) for x in got["L:1"].links] == [("derives:from", "NCBITaxon:9606")] and got["L:2"].deprecated


def test_vocabulary_and_accessions(spark):
    f = found(spark, [("v.txt", "# c\nalpha\n\n beta \n")])
    assert [(r.id, r.name) for r in R.vocabulary(f, "mat").orderBy("id").collect()] == [("mat:0001", "alpha"), ("mat:0002", "beta")]
    f = found(spark, [("t", "PXD2 then PXD1 then PXD2")])
    assert [r.pxd for r in R.accessions(f).orderBy("pos").collect()] == ["PXD2", "PXD1"]


def test_sample_tables_round_trip(spark):
    text = "source name\tcomment[x]\tcomment[x]\r\ns1\ta\tb\r\n\r\ns2\tc\n"
    cells = R.sample_cells(found(spark, [("d/PXD1.sdrf.tsv", text)]))
    got = {(r.row_idx, r.col_idx): (r.header, r.occ, r.cell) for r in cells.collect()}
    assert got[(0, 2)] == ("comment[x]", 1, "b") and got[(1, 2)] == ("comment[x]", 1, "") and len(got) == 6
    lines = [r.line for r in Wr.sample_lines(cells).orderBy("line_no").collect()]
    assert lines == ["source name\tcomment[x]\tcomment[x]", "s1\ta\tb", "s2\tc\t"]


def test_annotations(spark):
    tab = R.annotations(found(spark, [("a/d1.ann", "T1\tOrganism 3 9\tHomo\nR1\tx\ty\n")]), "tab")
    flat = R.annotations(found(spark, [("a/d1.txt", "Organism : Homo: s\nnothing\n")]), "flat")
    pipe = R.annotations(found(spark, [("a/d1.txt", "T1|||Organism 3 9|||Homo")]), "pipe")
    assert [tuple(r) for r in tab.collect()] == [("d1", "Organism", "Homo")] == [tuple(r) for r in pipe.collect()]
    assert [tuple(r) for r in flat.collect()] == [("d1", "Organism", "Homo: s")]


def test_articles_and_passages(spark):
    xml = "<article><article-title>A <i>b</i></article-title><abstract abstract-type='graphical'><p>no</p></abstract><abstract><p>yes<xref>1</xref> tail</p></abstract><body><sec><title>Methods</title><p>text<table-wrap>x</table-wrap> more</p></sec></body></article>"
    a, b = R.articles(found(spark, [("p.xml", xml), ("q.xml", "<oops")])).orderBy("path").collect()
    assert (a.title, a.abstract, a.sections) == ("A b", "yes tail", {"methods": "Methods text more"}) and b.title is None
    bioc = json.dumps([{"documents": [{"passages": [{"infons": {"section_type": "METHODS"}, "text": "one"}, {"infons": {"section_type": "REF"}, "text": "no"}, {"infons": {"section_type": "methods"}, "text": "two"}]}]}])
    (r,) = R.passages(found(spark, [("p.json", bioc)]), ["METHODS"]).collect()
    assert (r.section, r.texts) == ("METHODS", ["one", "two"])


def test_repositories(spark):
    cv = lambda n: {"name": n, "accession": "A:1", "cvLabel": "X", "value": ""}
    repo = {"pxd_id": "PXD1", "pride_metadata": {"organisms": [cv("Homo sapiens "), cv(None)], "keywords": ["k1", "k2"], "references": [{"pubmedID": 7}]}, "runAssessor": {"files": {"b": {"spectra_stats": {"fragmentation_tag": "HCD"}}, "a": {"spectra_stats": {"fragmentation_tag": "unknown"}}}}}
    repos = R.repositories(found(spark, [("r1.json", json.dumps(repo)), ("r2.json", json.dumps(repo))]))
    assert R.flat_project(repos).first().organisms == "Homo sapiens"
    assert R.first_file_fact(repos, "spectra_stats.fragmentation_tag").first().value == "HCD"
    assert {(r.key, r.path) for r in R.project_index(repos).collect()} == {("PXD1", "r2.json"), ("7", "r2.json")}


def test_pickles_and_caches(spark):
    rows = [(bytearray(pickle.dumps({"x": '{"a": 1}', "y": "text"})),), (bytearray(pickle.dumps(['{"a": 1}', '{"b": 2}'])),), (bytearray(b"junk"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(R.pickled_json("c")).collect()]
    assert got == ['{"a": 1}', None, None, None]
    e = spark.createDataFrame([("k", "1"), ("k", "2"), ("l", "1"), ("l", "1")], "key string, value string")
    assert [r.key for r in R.cache_conflicts(e).collect()] == ["k"]
    env = found(spark, [("m.json", '{"response": "hi", "eval_count": 10, "eval_duration": 2000000000}')])
    r = R.responses(env).first()
    assert (r.response, r.tokens_per_second) == ("hi", 5.0)


def test_writers(spark, tmp_path):
    f = spark.createDataFrame([("d", "b", "organism", "mouse", "e1"), ("d", "a", "organism", "human", "e2"), ("d", "b", "tissue", "liver", "e3")], "doc_id string, agent string, field string, value string, evidence string")
    rec = json.loads(Wr.merged_records(f, ["a", "b"]).first().record)
    assert rec["fields"]["organism"]["value"] == "human" and rec["_provenance"] == {"organism": "a", "tissue": "b"}
    Wr.json_by(f, str(tmp_path / "j"), ["agent"])
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    for _ in range(2):
        Wr.csv_quoted(f, str(tmp_path / "c"), ["doc_id", "value"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 6
    Wr.report(f, str(tmp_path / "r"), "field")
    assert {r.field: r.n for r in spark.read.json(str(tmp_path / "r" / "summary")).collect()} == {"organism": 2, "tissue": 1}
    assert spark.range(1).select(Wr.clipped(F.lit("abcdef"), 4)).first()[0] == "abc…"
    g = spark.sql("select 'P' pxd, array(named_struct('name', 'g1', 'organism', array(named_struct('value', 'x', 'evidence', 'e')), 'tissue', array()), named_struct('name', 'g2', 'organism', cast(array() as array<struct<value:string,evidence:string>>), 'tissue', array())) sample_groups")
    g = g.select("pxd", F.transform("sample_groups", lambda s: F.struct(s["name"].alias("name"), s["organism"].alias("organism"))).alias("sample_groups"))
    assert [r.name for r in Wr.flat_groups(g, ["organism"], ["organism"]).collect()] == ["g1"]


def test_resolution_of_read_terms(spark):
    t = R.obo_tables(R.obo_terms(found(spark, [("x.obo", OBO)])))
    names, syn = t["node"].select(F.col("id").alias("node"), "name"), t["synonym"].select(F.col("id").alias("node"), "synonym", "scope")
    terms = spark.createDataFrame([("CELL",), ("White  Cell",), ("wbc",), ("none",)], "term string")
    got = {r.term: (r.node, r.status) for r in O.resolve(terms, names, syn).collect()}
    assert got == {"CELL": ("T:1", "exact"), "White  Cell": ("T:2", "exact_synonym"), "wbc": ("T:2", "related_synonym"), "none": (None, "unresolved")}
    more = spark.createDataFrame([("T:1", "unit", "CUSTOM"), ("T:2", "WBC", "CUSTOM")], "node string, synonym string, scope string")
    twice = O.add_synonyms(O.add_synonyms(syn, more), more)
    assert twice.count() == 4

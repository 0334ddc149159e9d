from metaloom.sources import pieces
from metaloom.sources import readers as R

HEAD = '<?xml version="1.0"?>\n<!DOCTYPE rdf:RDF [ <!ENTITY obo "http://purl.obolibrary.org/obo/" > ]>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:obo="http://purl.obolibrary.org/obo/" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">\n<owl:Ontology rdf:about="x"/>\n'


def owl_class(i):
    inner = ""
    if i % 3 == 0:
        inner = f'<owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection"><owl:Class rdf:about="http://x/X_{i}"/><owl:Class><owl:unionOf/></owl:Class></owl:intersectionOf></owl:Class></owl:equivalentClass>'
    link = '<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/R_1"/><owl:someValuesFrom rdf:resource="http://x/S_9"/></owl:Restriction></rdfs:subClassOf>' if i % 2 else ""
    return f'  <!-- http://x/P_{i} </owl:x> -->\n  <owl:Class rdf:about="http://x/P_{i}">{inner}<rdfs:label>name {i} &amp; é</rdfs:label>{link}<rdfs:subClassOf rdf:resource="http://x/P_{i // 2}"/><oboInOwl:hasExactSynonym>syn {i}</oboInOwl:hasExactSynonym></owl:Class>\n<owl:Axiom><owl:x/></owl:Axiom>\n'


def rows(df):
    return sorted((r.id, r.name, r.synonyms, r.parents, [tuple(x) for x in r.links], r.deprecated) for r in df.collect())


def test_a_file_is_read_by_several_tasks_and_nothing_is_lost_at_their_edges(spark, tmp_path):
    text = HEAD + "".join(owl_class(i) for i in range(400)) + "</rdf:RDF>\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big.owl").write_text(text)
    whole = R.owl_classes(R.files(spark, str(tmp_path / "a")).select("path", F_text(text)))
    want = [r for r in rows(whole) if r[1] is not None]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (997, 4001, 60_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            tasks = spark.read.text(str(tmp_path / "a"), lineSep=pieces.END).rdd.getNumPartitions()
            got = pieces.owl_classes(spark, str(tmp_path / "a"))
            assert tasks > 1 and rows(got) == want and {r.status for r in got.collect()} == {None}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(want) == 400


def F_text(text):
    from pyspark.sql import functions as F

    return F.lit(text.replace("&obo;", "http://purl.obolibrary.org/obo/")).alias("text")


def test_broken_classes_and_files_have_a_status(spark, tmp_path):
    good = owl_class(1) + owl_class(2)
    bad = '<owl:Class rdf:about="&obo;CLO_7"><rdfs:label a=b>x</rdfs:label></owl:Class>\n'
    open_ = '<owl:Class rdf:about="http://x/P_8"><rdfs:label>x</owl:Class>\n'
    (tmp_path / "one.owl").write_text(HEAD + good + bad + open_ + owl_class(4) + "</rdf:RDF>")
    (tmp_path / "two.owl").write_text(HEAD + good + '<owl:Class rdf:about="http://x/P_9"><rdfs:label>cut')
    (tmp_path / "none.owl").write_text("")
    got = pieces.owl_classes(spark, str(tmp_path)).collect()
    told = {(r.path.rsplit("/", 1)[-1], r.id): r.status for r in got}
    assert told.pop(("one.owl", "CLO:7")).startswith("not parsed")
    assert told.pop(("one.owl", "P:8")).startswith("not parsed")
    broken = {k: v for k, v in told.items() if v}
    assert set(broken) == {("two.owl", "P:9")}
    assert {k for k, v in told.items() if not v} == {("one.owl", f"P:{i}") for i in (1, 2, 4)} | {("two.owl", "P:1"), ("two.owl", "P:2")}


def test_obo_stanzas(spark, tmp_path):
    stanzas = [f"[Term]\nid: A:{i}\nname: n{i}\nsynonym: \"s [x] {i}\" EXACT []\nis_a: A:{i // 2} ! up\n" for i in range(1, 200)]
    text = "format-version: 1.2\n\n" + "\n".join(stanzas) + "\n[Typedef]\nid: part_of\n"
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.obo").write_text(text)
    (tmp_path / "o" / "b.obo").write_text(stanzas[0].replace("A:", "B:").replace("\n", "\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = {(r.id, tuple(x for x in r.lines if x)) for r in pieces.obo_terms(spark, str(tmp_path / "o")).collect()}
        want = {(r.id, ("Term]", *[x for x in r.lines if x][1:])) for r in R.obo_terms(R.files(spark, str(tmp_path / "o"))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(got) == 200

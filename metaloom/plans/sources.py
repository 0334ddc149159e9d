"""Readers and writers: tables written out in a format, and what is read back of it. The texts are DataFrames, as files are to readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.operators import derived as D
from metaloom.sources import pieces as P
from metaloom.sources import readers as S
from metaloom.sources import writers as Wr
from metaloom.session import shared_folder, table
from metaloom.streaming import incremental as I

L = F.lit


def _cat(*xs):
    return F.concat(*[L(x) if isinstance(x, str) else x for x in xs])


def _s(c):
    return F.col(c).cast("string")


def _lines(df, path, order, line, head="", tail=""):
    """Files (path, text) of lines in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return df.groupBy(path.alias("path")).agg(_cat(head, body, tail).alias("text"))


def _obo(spark, sf_dir):
    """A file of terms for each region: its nations and their suppliers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    nations = n.select("n_regionkey", F.col("n_nationkey").alias("o"), _cat("[Term]\nid: N:", _s("n_nationkey"), "\nname: ", F.col("n_name"), '\nsynonym: "', F.lower("n_name"), '" EXACT []\nxref: R:', _s("n_regionkey"), "\n").alias("l"))
    sup = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", (F.col("s_suppkey") + 100).alias("o"), _cat("[Term]\nid: S:", _s("s_suppkey"), "\nname: Supplier ", _s("s_suppkey"), "\nis_a: N:", _s("s_nationkey"), " ! ", F.col("n_name"), F.when(F.col("s_suppkey") % 3 == 0, "\nrelationship: part_of N:0").otherwise(""), F.when(F.col("s_suppkey") % 7 == 0, "\nis_obsolete: true").otherwise(""), "\n").alias("l"))
    return _lines(nations.unionAll(sup), _cat("x/r", _s("n_regionkey"), ".obo"), F.col("o"), F.col("l"), "format-version: 1.2\n\n")


def obo_edges(spark, sf_dir):
    return S.obo_tables(S.obo_terms(_obo(spark, sf_dir)))["edge"]


def obo_names(spark, sf_dir):
    t = S.obo_tables(S.obo_terms(_obo(spark, sf_dir)))
    return t["node"].select("id", "name").join(t["synonym"].select("id", "synonym", "scope"), "id", "left").join(S.xrefs(t, "R:").select("id", F.array_join("xrefs", ";").alias("xrefs")), "id", "left")


def ontology_by_ending(spark, sf_dir):
    """Terms of OBO and OWL files together."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">'
    c = _cat('<owl:Class rdf:about="http://x/P_', _s("s_suppkey"), '"><rdfs:label>', F.col("s_suppkey").cast("string"), '</rdfs:label><rdfs:subClassOf rdf:resource="http://x/N_', _s("s_nationkey"), '"/>', F.when(F.col("s_suppkey") % 5 == 0, "<owl:deprecated>true</owl:deprecated>").otherwise(""), "</owl:Class>")
    owl = _lines(s, _cat("y/n", _s("s_nationkey"), ".owl"), F.col("s_suppkey"), c, head, "</rdf:RDF>")
    t = S.ontology_terms(_obo(spark, sf_dir).unionAll(owl))
    return t.select("path", "id", "name", F.array_join("parents", ";").alias("parents"))


def owl_in_pieces(spark, sf_dir):
    """Customers as the classes of one OWL file, written by Spark and read in pieces; those of one segment have a class within, one in fifty is broken."""
    c = table(spark, sf_dir, "customer")
    key = _s("c_custkey")
    inner = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit('<owl:equivalentClass><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="http://x/C_0"/></owl:unionOf></owl:Class></owl:equivalentClass>')).otherwise(F.lit(""))
    label = F.when(F.col("c_custkey") % 50 == 7, F.lit("<rdfs:label>")).otherwise(_cat("<rdfs:label>", F.col("c_name"), "</rdfs:label>"))
    text = _cat('<owl:Class rdf:about="http://x/C_', key, '">', inner, label, '<rdfs:subClassOf rdf:resource="http://x/N_', _s("c_nationkey"), '"/></owl:Class>')
    folder = f"{shared_folder(spark)}/owl-{uuid.uuid4().hex}"
    rows = c.select(F.col("c_custkey").alias("k"), text.alias("value")).unionAll(spark.createDataFrame([(-1, "<rdf:RDF>"), (1 << 60, "</rdf:RDF>")], "k long, value string"))
    rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(folder)
    found = P.owl_classes(spark, folder)
    return found.select("id", "name", F.array_join("parents", ";").alias("parents"), F.substring_index("status", ":", 1).alias("status"))


def cell_line_origins(spark, sf_dir):
    """Customers as cell lines of one OWL file that derive from a taxon, a tissue, another tissue, or say nothing of it."""
    c, key = table(spark, sf_dir, "customer"), _s("c_custkey")
    some = lambda prop, target: _cat(f'<owl:Restriction><owl:onProperty rdf:resource="http://x/{prop}"/><owl:someValuesFrom rdf:resource="http://x/', target, '"/></owl:Restriction>')
    up = lambda x: _cat("<rdfs:subClassOf>", x, "</rdfs:subClassOf>")
    m, nothing = F.col("c_custkey") % 5, L("")
    taxon = F.when(m < 3, up(some("RO_0001000", _cat("NCBITaxon_", _s("c_nationkey"))))).otherwise(nothing)
    tissue = F.when(m == 1, _cat(up(some("RO_0001000", "BTO_1")), up(some("RO_0001000", _cat("BTO_", key))))).otherwise(nothing)
    within = F.when(m == 2, _cat("<owl:equivalentClass><owl:Class><owl:intersectionOf>", some("RO_0001000", "UBERON_7"), "</owl:intersectionOf></owl:Class></owl:equivalentClass>")).otherwise(nothing)
    other = up(some("RO_0002", "BTO_9"))
    label = F.when(m == 4, nothing).otherwise(_cat("<rdfs:label> ", F.col("c_name"), " </rdfs:label>"))
    text = _cat('<owl:Class rdf:about="http://x/CLO_', key, '">', label, taxon, tissue, within, other, "</owl:Class>")
    folder = f"{shared_folder(spark)}/clo-{uuid.uuid4().hex}"
    c.select(text.alias("value")).write.text(folder)
    return D.cell_line_origins(P.owl_classes(spark, folder))


def derived_tissues(spark, sf_dir):
    """Tissues of suppliers as diseases, cell types, and terms that refer to others."""
    s = table(spark, sf_dir, "supplier")
    key, m = _s("s_suppkey"), F.col("s_suppkey") % 4
    located = F.when(m < 2, _cat("\nrelationship: located_in UBERON:", _s("s_nationkey"), " ! x\nrelationship: located_in X:1")).otherwise(L(""))
    refers = F.when(m != 3, L("\nxref: UBERON:5\nxref: UBERON:3\nxref: Y:1")).otherwise(L(""))
    text = _cat("[Term]\nid: DOID:", key, "\nname: x", located, refers, "\nrelationship: part_of UBERON:8")
    t = S.obo_tables(S.obo_terms(s.select(_cat("o/", key).alias("path"), text.alias("text"))), ("part_of", "located_in"))
    parts = (("disease", D.disease_tissues(t)), ("cell_type", D.cell_type_tissues(t)), ("reference", D.cross_references(t)))
    out = None
    for kind, d in parts:
        d = d.select(L(kind).alias("kind"), "id", F.array_join("tissues", ";").alias("tissues"))
        out = d if out is None else out.unionAll(d)
    return out


def sample_table_cells(spark, sf_dir):
    """Parts of a brand as a sample table with a repeated header, short and blank lines."""
    p = table(spark, sf_dir, "part")
    line = _cat(_s("p_partkey"), "\t", F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(L("\t"), _s("p_size"))).otherwise(""), F.when(F.col("p_size") % 5 == 0, "\n  ").otherwise(""))
    f = _lines(p, _cat("x/", F.replace("p_brand", L("#"), L("")), ".tsv"), F.col("p_partkey"), line, "name\ttype\ttype\n")
    return S.sample_cells(f).filter("occ > 0 or header = 'name'").select("pxd", "header", "occ", "cell")


def annotated_values(spark, sf_dir):
    """The same labels in three dialects."""
    p = table(spark, sf_dir, "part")
    k = _s("p_partkey")
    file = lambda d, line: S.annotations(_lines(p, _cat("a/", F.replace("p_brand", L("#"), L("")), ".ann"), F.col("p_partkey"), line, "", "\nR1 no"), d).withColumn("dialect", L(d))
    tab = file("tab", _cat("T", k, "\ttissue 0 5\t", F.col("p_type")))
    return tab.unionAll(file("pipe", _cat("T", k, "|||tissue 0 5|||", F.col("p_type")))).unionAll(file("flat", _cat("tissue : ", F.col("p_type"))))


def vocabulary_terms(spark, sf_dir):
    f = _lines(table(spark, sf_dir, "nation"), L("v/nations.txt"), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, _cat("# ", F.col("n_name"), "\n")).otherwise(F.col("n_name")))
    return S.vocabulary(f, "nation")


def json_documents(spark, sf_dir):
    """Events' properties as files; every fifth is broken."""
    e = table(spark, sf_dir, "events")
    f = e.select(_cat("j/", _s("event_id"), ".json").alias("path"), F.when(F.col("event_id") % 5 == 0, F.concat(L("{"), F.col("props"))).otherwise(F.col("props")).alias("text"))
    r = S.json_records(f, "k long")
    return r.select(F.col("doc_id").cast("long").alias("event_id"), F.col("record.k").alias("k"), F.col("broken").isNotNull().alias("broken"))


def article_sections(spark, sf_dir):
    """Documents as articles: title, abstract and a section, with a dropped table among the text."""
    d = table(spark, sf_dir, "documents")
    esc = lambda c: F.replace(F.replace(F.replace(c, L("&"), L("&amp;")), L("<"), L("&lt;")), L(">"), L("&gt;"))
    t = esc(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    xml = _cat("<article><front><article-title>T ", _s("doc_id"), '</article-title><abstract abstract-type="teaser"><p>no</p></abstract><abstract><p>', F.col("lang"), "</p></abstract></front><body><sec><title>Methods</title><p>", t, "<table><td>gone</td></table></p></sec></body></article>")
    a = S.articles(d.select(_cat("x/", _s("doc_id"), ".xml").alias("path"), F.when(F.col("doc_id") % 9 == 0, "<broken").otherwise(xml).alias("text")))
    return a.select("path", "title", "abstract", F.length(F.try_element_at("sections", L("methods"))).alias("n"))


def section_passages(spark, sf_dir):
    """Conversations as BioC: turns of two kinds in order, others left out."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.create_map(L("section_type"), F.lower("role")).alias("infons"), F.concat(_s("turn"), L(":"), F.md5("text")).alias("text"))).alias("p"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), ",").alias("ps"))
    f = g.select(_cat("b/", _s("conv_id"), ".json").alias("path"), _cat('[{"documents":[{"passages":[', F.col("ps"), "]}]}]").alias("text"))
    return S.passages(f, ["USER", "ASSISTANT"]).select("path", "section", F.array_join("texts", "|").alias("texts"))


def _repositories(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    item = lambda n: F.struct(n.alias("name"), L("A:1").alias("accession"), L("").alias("value"))
    k = F.col("c_custkey")
    meta = F.struct(
        F.array(item(F.concat(L(" org"), (k % 4).cast("string"))), item(F.when(k % 2 == 0, "n/a").otherwise("Mus"))).alias("organisms"), F.array(item(F.col("c_mktsegment"))).alias("instruments"),
        F.array(L("b"), L("a")).alias("keywords"), F.array(F.struct((k % 50).alias("pubmedID"))).alias("references"),
    )
    files = F.create_map(L("f2"), F.struct(F.struct(F.when(k % 3 == 0, "HCD").otherwise("CID").alias("fragmentation_tag")).alias("spectra_stats")), L("f1"), F.struct(F.struct(F.when(k % 2 == 0, "ETD").otherwise("unknown").alias("fragmentation_tag")).alias("spectra_stats")))
    j = F.to_json(F.struct(F.concat(L("PXD"), F.lpad(_s("c_custkey"), 6, "0")).alias("pxd_id"), meta.alias("pride_metadata"), F.struct(files.alias("files")).alias("runAssessor")))
    return S.repositories(c.select(_cat("r/", F.lpad(_s("c_custkey"), 6, "0"), ".json").alias("path"), j.alias("text")))


def project_lines(spark, sf_dir):
    return S.property_lines(_repositories(spark, sf_dir))


def project_index(spark, sf_dir):
    return S.project_index(_repositories(spark, sf_dir))


def first_file_fact(spark, sf_dir):
    return S.first_file_fact(_repositories(spark, sf_dir), "spectra_stats.fragmentation_tag")


def listed_accessions(spark, sf_dir):
    """Accessions in texts that name each twice."""
    c = table(spark, sf_dir, "customer")
    a = F.concat(L("PXD"), F.lpad(_s("c_custkey"), 6, "0"))
    return S.accessions(_lines(c, _cat("l/", _s("c_nationkey")), F.col("c_custkey"), _cat("see ", a, ", ", a, ".")))


def model_responses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = F.to_json(F.struct(F.col("event_type").alias("response"), F.col("event_id").alias("eval_count"), F.when(F.col("event_id") % 3 != 0, L(2_000_000_000)).otherwise(0).alias("eval_duration")))
    return S.responses(e.select(_cat("m/", _s("event_id"), ".json").alias("path"), j.alias("text"))).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


def resolved_paths(spark, sf_dir):
    """Tables of customers as projects: their own file, one in their folder, one that starts with their name, or several."""
    c = table(spark, sf_dir, "customer")
    k, p = F.col("c_custkey") % 5, F.concat(L("PXD"), _s("c_custkey"))
    names = F.when(k == 0, F.array(_cat("a/", p, ".sdrf.tsv"))).when(k == 1, F.array(_cat("a/", p, "/x.sdrf.tsv"), _cat("a/", p, "/y.txt"))).when(k == 2, F.array(_cat("a/", p, "_run.tsv"))).when(k == 3, F.array(_cat("a/", p, "_run.tsv"), _cat("b/", p, "-x.tsv"))).otherwise(F.array(L("a/none.txt")))
    return S.resolved_paths(c.select(p.alias("pxd")), c.select(F.explode(names).alias("path")).distinct())


def chosen_files(spark, sf_dir):
    """Of three places with files of a part's size class, the first that has any, and there the largest."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("key"), F.concat(L("f"), _s("p_partkey")).alias("path"), F.col("p_size").cast("long").alias("bytes"), F.col("p_partkey").alias("k"))
    return S.first_place_largest([p.filter("k % 301 < 40"), p.filter("k % 299 < 100"), p], "key")


def discovered_sets(spark, sf_dir):
    """The ten first allowed data sets: a limit that is the feature."""
    p = table(spark, sf_dir, "part").select(F.concat(L("d/PXD"), (F.col("p_partkey") % 40).cast("string"), L("/PXD9.txt")).alias("path"))
    return S.discovered(p, r"^PXD\d+$", [f"PXD{i}" for i in range(5, 200)], 10)


def merged_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(_s("conv_id").alias("doc_id"), F.col("role").alias("agent"), F.concat(L("f"), (F.col("turn") % 2).cast("string")).alias("field"), F.md5("text").alias("value"), L("e").alias("evidence"))
    m = Wr.merged_records(c, ["assistant", "user"])
    field = lambda f, x: F.get_json_object("record", f"$.{x}.{f}")
    return m.select("doc_id", field("f0.value", "fields").alias("f0"), field("f0", "_provenance").alias("by0"), field("f1.value", "fields").alias("f1"), field("f1", "_provenance").alias("by1"))


def sample_lines(spark, sf_dir):
    """Cells written as lines of a sample table."""
    p = table(spark, sf_dir, "part")
    p = p.withColumn("row_idx", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    cells = p.select(F.col("p_brand").alias("pxd"), "row_idx", F.explode(F.array(F.struct(L(0).alias("col_idx"), L("name").alias("header"), F.col("p_name").alias("cell")), F.struct(L(1).alias("col_idx"), L("size").alias("header"), _s("p_size").alias("cell")))).alias("x"))
    return Wr.sample_lines(cells.select("pxd", "row_idx", "x.*"))


def clipped_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(Wr.clipped(F.col("text"), 500)).alias("cell"))


def manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("shard", F.col("doc_id") % 9)
    n = Wr.shard_manifest(d, "shard")
    first = Wr.first_rows(d, ["shard"], ["n_chars", "doc_id"]).select("shard", "doc_id")
    return n.join(first, "shard")


def _events(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return I.follow(spark, f"{sf_dir}/events.parque[t]", t.schema, 1000).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windows(spark, sf_dir):
    """Events counted by day and type on a stream of the table's files. (The path is a pattern, as a stream takes a single file by pattern alone.)"""
    w = I.windowed(_events(spark, sf_dir), "ts", "30 days", "1 day", None, ["event_type"])
    return I.drained(w).select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_once(spark, sf_dir):
    """Events of a user and type, the first of each within the watermark alone."""
    e = _events(spark, sf_dir).select("ts", "user_id", "event_type", "value")
    once = I.once(e, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    return I.drained(once, "append")


QUERIES = {f.__name__: f for f in (obo_edges, obo_names, ontology_by_ending, owl_in_pieces, cell_line_origins, derived_tissues, sample_table_cells, annotated_values, vocabulary_terms, json_documents, article_sections, section_passages, project_lines, project_index, first_file_fact, listed_accessions, model_responses, resolved_paths, chosen_files, discovered_sets, merged_records, sample_lines, clipped_cells, manifest, stream_windows, stream_once)}

PXD = "'PXD' || lpad(c_custkey::VARCHAR, 6, '0')"
ORACLES = {
    "obo_edges": "SELECT 'S:' || s_suppkey child, 'N:' || s_nationkey parent, 'is_a' relation FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'S:' || s_suppkey, 'N:0', 'part_of' FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 = 0",
    "obo_names": "SELECT 'N:' || n_nationkey id, n_name AS name, lower(n_name) synonym, 'EXACT' scope, 'R:' || n_regionkey xrefs FROM nation UNION ALL SELECT 'S:' || s_suppkey, 'Supplier ' || s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 7 <> 0",
    "ontology_by_ending": """SELECT 'x/r' || n_regionkey || '.obo' AS path, 'N:' || n_nationkey id, n_name AS name, '' parents FROM nation UNION ALL SELECT 'x/r' || n_regionkey || '.obo', 'S:' || s_suppkey, 'Supplier ' || s_suppkey, 'N:' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0
      UNION ALL SELECT 'y/n' || s_nationkey || '.owl', 'P:' || s_suppkey, s_suppkey::VARCHAR, 'N:' || s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0""",
    "cell_line_origins": """
SELECT 'CLO:' || c_custkey id, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE c_name END AS label, CASE WHEN c_custkey % 5 < 3 THEN 'NCBITaxon_' || c_nationkey END species_ncbi,
  CASE WHEN c_custkey % 5 = 1 THEN 'BTO:' || c_custkey END tissue_bto, CASE WHEN c_custkey % 5 = 2 THEN 'UBERON:7' END tissue_uberon FROM customer WHERE c_custkey % 5 <> 4""",
    "derived_tissues": """
SELECT 'disease' kind, 'DOID:' || s_suppkey id, CASE WHEN s_suppkey % 4 < 2 THEN 'UBERON:' || s_nationkey ELSE 'UBERON:3;UBERON:5' END tissues FROM supplier WHERE s_suppkey % 4 <> 3
UNION ALL SELECT 'cell_type', 'DOID:' || s_suppkey, 'UBERON:8' FROM supplier UNION ALL SELECT 'reference', 'DOID:' || s_suppkey, 'UBERON:3;UBERON:5' FROM supplier WHERE s_suppkey % 4 <> 3""",
    "owl_in_pieces": """
SELECT 'C:' || c_custkey id, CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS name, CASE WHEN c_custkey % 50 <> 7 THEN 'N:' || c_nationkey ELSE '' END parents, CASE WHEN c_custkey % 50 = 7 THEN 'not parsed' END status FROM customer""",
    "sample_table_cells": "SELECT replace(p_brand, '#', '') pxd, 'name' header, 0 occ, p_partkey::VARCHAR cell FROM part UNION ALL SELECT replace(p_brand, '#', ''), 'type', 1, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END FROM part",
    "annotated_values": "SELECT replace(p_brand, '#', '') doc, 'tissue' AS label, p_type AS value, d dialect FROM part, (VALUES ('tab'), ('pipe'), ('flat')) t(d)",
    "vocabulary_terms": "SELECT printf('nation:%04d', row_number() OVER (ORDER BY n_nationkey)) id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0",
    "json_documents": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::BIGINT END k, event_id % 5 = 0 broken FROM events",
    "article_sections": "SELECT 'x/' || doc_id || '.xml' AS path, CASE WHEN doc_id % 9 <> 0 THEN 'T ' || doc_id END title, CASE WHEN doc_id % 9 <> 0 THEN lang END abstract, CASE WHEN doc_id % 9 <> 0 THEN length(trim(regexp_replace('Methods ' || text, '\\s+', ' ', 'g'))) END::INT n FROM documents",
    "section_passages": "SELECT 'b/' || conv_id || '.json' AS path, upper(role) AS section, string_agg(turn || ':' || md5(text), '|' ORDER BY turn) texts FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, role",
    "project_lines": f"SELECT {PXD} pxd_id, unnest(['instruments: ' || c_mktsegment, 'keywords: b; a', 'organisms: org' || (c_custkey % 4) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '; Mus' END]) line FROM customer",
    "project_index": f"SELECT {PXD} AS key, 'r/' || lpad(c_custkey::VARCHAR, 6, '0') || '.json' AS path FROM customer UNION ALL SELECT (c_custkey % 50)::VARCHAR, 'r/' || lpad(max(c_custkey)::VARCHAR, 6, '0') || '.json' FROM customer GROUP BY 1",
    "first_file_fact": f"SELECT {PXD} pxd_id, CASE WHEN c_custkey % 2 = 0 THEN 'ETD' WHEN c_custkey % 3 = 0 THEN 'HCD' ELSE 'CID' END AS value FROM customer",
    "listed_accessions": f"SELECT 'l/' || c_nationkey AS path, {PXD} pxd, (2 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1))::INT pos FROM customer",
    "model_responses": "SELECT event_id::VARCHAR doc_id, event_type response, event_id tokens, CASE WHEN event_id % 3 <> 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS seconds, CASE WHEN event_id % 3 <> 0 THEN round(event_id / 2.0, 6) END::DOUBLE tokens_per_second FROM events",
    "resolved_paths": "SELECT 'PXD' || c_custkey pxd, CASE c_custkey % 5 WHEN 0 THEN 'a/PXD' || c_custkey || '.sdrf.tsv' WHEN 1 THEN 'a/PXD' || c_custkey || '/x.sdrf.tsv' WHEN 2 THEN 'a/PXD' || c_custkey || '_run.tsv' END AS path FROM customer",
    "chosen_files": """WITH p AS (SELECT p_partkey % 300 AS key, p_partkey k, p_size::BIGINT b FROM part), f AS (SELECT *, 0 place FROM p WHERE k % 301 < 40 UNION ALL SELECT *, 1 FROM p WHERE k % 299 < 100 UNION ALL SELECT *, 2 FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, b DESC, 'f' || k) i FROM f)
      SELECT key, place, 'f' || k AS path, b AS bytes FROM r WHERE i = 1""",
    "discovered_sets": "SELECT DISTINCT 'PXD' || (p_partkey % 40) dataset FROM part WHERE p_partkey % 40 >= 5 ORDER BY 1 LIMIT 10",
    "merged_records": """WITH c AS (SELECT conv_id, turn % 2 f, role, md5(text) v FROM conversations WHERE role IN ('assistant', 'user')), b AS (SELECT conv_id, f, first(v ORDER BY role, v) v, min(role) r FROM c GROUP BY 1, 2)
      SELECT conv_id::VARCHAR doc_id, max(v) FILTER (f = 0) f0, max(r) FILTER (f = 0) by0, max(v) FILTER (f = 1) f1, max(r) FILTER (f = 1) by1 FROM b GROUP BY 1""",
    "sample_lines": "SELECT p_brand pxd, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) line_no, p_name || chr(9) || p_size line FROM part UNION ALL SELECT DISTINCT p_brand, 0, 'name' || chr(9) || 'size' FROM part",
    "clipped_cells": "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 499) || '…' ELSE text END) cell FROM documents",
    "manifest": "SELECT doc_id % 9 shard, count(*) n, first(doc_id ORDER BY n_chars, doc_id) doc_id FROM documents GROUP BY 1",
    "stream_windows": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2",
    "stream_once": "SELECT DISTINCT user_id, event_type FROM events",
}

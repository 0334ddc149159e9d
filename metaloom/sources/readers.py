"""Readers: each takes a path that Spark can open, or a DataFrame of (path, text), and returns rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.functions import text as X


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole text files below ``path``."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def documents(found: DataFrame) -> DataFrame:
    """(doc_id, text): a file's stem, or its folder's name for manuscript.txt."""
    folder = F.element_at(F.split("path", "/"), -2)
    return found.select(F.when(F.col("path").endswith("/manuscript.txt"), folder).otherwise(stem(F.col("path"))).alias("doc_id"), "text")


def json_records(found: DataFrame, schema: str) -> DataFrame:
    """(doc_id, record, broken) of JSON files; a broken one has a null record and its text."""
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("text").isNotNull()
    return found.select(stem(F.col("path")).alias("doc_id"), F.when(ok, parsed).alias("record"), F.when(~ok, F.col("text")).alias("broken"))


def preferred(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Of records found in several places that of the first place, with its number in ``place``."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("place", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy("place")
    return out.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


# ---- ontologies --------------------------------------------------------------------------------------------------


def obo_terms(found: DataFrame) -> DataFrame:
    """(path, id, lines) of the [Term] stanzas of OBO files."""
    stanza = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(\[Term\].*?)(?=\n\[[A-Z]|\z)"), F.lit(1))).alias("stanza")
    s = found.select("path", stanza)
    lines = F.transform(F.split(F.replace("stanza", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x))
    s = s.select("path", lines.alias("lines"))
    return s.select("path", F.regexp_extract(F.get(F.filter("lines", lambda x: x.startswith("id: ")), F.lit(0)), r"^id: (\S+)", 1).alias("id"), "lines").filter("id <> ''")


def obo_tables(terms: DataFrame, relations: tuple[str, ...] = ("part_of",), keep_obsolete: bool = False) -> dict[str, DataFrame]:
    """Tables node, synonym, edge, taxon, xref of OBO terms; obsolete ones are left out.

    A synonym without a scope is UNSPECIFIED; edges are is_a and the given relations; taxa come from in_taxon lines.
    """

    def tagged(tag: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.trim(F.regexp_replace(F.substr(x, F.lit(len(tag) + 3)), r"\s*!.*$", "")))

    t = terms.withColumn("is_obsolete", F.exists("lines", lambda x: x == "is_obsolete: true"))
    if not keep_obsolete:
        t = t.filter("not is_obsolete")
    raw = F.filter("lines", lambda x: x.startswith("synonym: "))
    names = F.transform(F.filter("lines", lambda x: x.startswith("name: ")), lambda x: F.trim(F.substr(x, F.lit(7))))
    node = t.select("id", F.get(names, F.lit(0)).alias("name"), F.regexp_extract(F.coalesce(F.get(F.filter("lines", lambda x: x.startswith("def: ")), F.lit(0)), F.lit("")), r'^def: "((?:[^"\\]|\\.)*)"', 1).alias("definition"), "is_obsolete")
    syn = t.select("id", F.posexplode(raw).alias("pos", "line"))
    syn = syn.select("id", "pos", F.regexp_extract("line", r'^synonym: "((?:[^"\\]|\\.)*)"', 1).alias("synonym"), F.coalesce(F.nullif(F.regexp_extract("line", r'"\s+(EXACT|RELATED|BROAD|NARROW)\b', 1), F.lit("")), F.lit("UNSPECIFIED")).alias("scope"))
    is_a = t.select("id", F.explode(tagged("is_a")).alias("v")).select(F.col("id").alias("child"), F.substring_index("v", " ", 1).alias("parent"), F.lit("is_a").alias("relation"))
    rel = t.select("id", F.explode(tagged("relationship")).alias("v")).select(F.col("id").alias("child"), F.regexp_extract("v", r"^\S+\s+(\S+)", 1).alias("parent"), F.substring_index("v", " ", 1).alias("relation"))
    taxon = rel.filter("relation in ('in_taxon', 'only_in_taxon')").select(F.col("child").alias("id"), F.col("parent").alias("taxon_id"))
    xref = t.select("id", F.explode(tagged("xref")).alias("v")).select("id", F.substring_index("v", " ", 1).alias("xref"))
    return {"node": node, "synonym": syn, "edge": is_a.unionAll(rel.filter(F.col("relation").isin(*relations))), "taxon": taxon, "xref": xref, "relation": rel}


def xrefs(tables: dict[str, DataFrame], prefix: str) -> DataFrame:
    return tables["xref"].filter(F.col("xref").startswith(prefix)).groupBy("id").agg(F.array_sort(F.collect_set("xref")).alias("xrefs"))


def curie_of(iri: str) -> str:
    tail = iri.rsplit("/", 1)[-1].rsplit("#", 1)[-1]
    return tail.replace("_", ":", 1)


def _owl(text: str) -> Iterator[tuple]:
    import xml.etree.ElementTree as ET

    rdf, rdfs, owl, obo = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}", "{http://www.w3.org/2002/07/owl#}", "{http://www.geneontology.org/formats/oboInOwl#}"
    try:
        top = ET.fromstring(text)
    except ET.ParseError:
        return
    for c in top.iter(f"{owl}Class"):
        if not (about := c.get(f"{rdf}about")):
            continue
        parents, links = [], []
        for s in c.findall(f"{rdfs}subClassOf"):
            if r := s.get(f"{rdf}resource"):
                parents.append(curie_of(r))
            for q in s.iter(f"{owl}Restriction"):
                p, v = q.find(f"{owl}onProperty"), q.find(f"{owl}someValuesFrom")
                if p is not None and v is not None and v.get(f"{rdf}resource"):
                    links.append((curie_of(p.get(f"{rdf}resource") or ""), curie_of(v.get(f"{rdf}resource"))))
        dead = c.find(f"{owl}deprecated")
        yield curie_of(about), c.findtext(f"{rdfs}label"), [x.text for x in c.findall(f"{obo}hasExactSynonym") if x.text], parents, links, dead is not None and (dead.text or "").strip().lower() == "true"


OWL = T.StructType([T.StructField("path", T.StringType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("synonyms", T.ArrayType(T.StringType())), T.StructField("parents", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StructType([T.StructField("relation", T.StringType()), T.StructField("target", T.StringType())]))), T.StructField("deprecated", T.BooleanType())])


def owl_classes(found: DataFrame) -> DataFrame:
    """(path, id, name, synonyms, parents, links, deprecated) of the classes of OWL files; files that aren't XML give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b["path"], b["text"], strict=True) for r in _owl(t or "")]
            yield pd.DataFrame(rows, columns=OWL.names)

    return found.select("path", "text").mapInPandas(run, OWL)


def vocabulary(found: DataFrame, name: str) -> DataFrame:
    """(id, name): a term a line, comments and blank lines left out, numbered in order as name:0001."""
    lines = found.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    n = F.row_number().over(W.partitionBy("path").orderBy("pos"))
    return lines.select(F.format_string(f"{name}:%04d", n).alias("id"), F.col("line").alias("name"))


# ---- tables of samples and annotations ----------------------------------------------------------------------------


def sample_cells(found: DataFrame) -> DataFrame:
    """(pxd, row_idx, col_idx, header, occ, cell) of tab-separated sample tables.

    Headers may repeat: ``occ`` counts them. Blank rows are left out, short rows padded with empty cells.
    """
    rows = found.select(stem(F.col("path")).alias("pxd"), F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line", "raw")).filter("trim(raw) <> ''")
    head = rows.filter("line = 0").select("pxd", F.transform(F.split("raw", "\t"), lambda x: F.trim(x)).alias("heads"))
    occ = F.transform("heads", lambda h, i: F.size(F.filter(F.slice("heads", 1, i), lambda g: g == h)))
    head = head.withColumn("occs", occ)
    body = rows.filter("line > 0").select("pxd", (F.row_number().over(W.partitionBy("pxd").orderBy("line")) - 1).alias("row_idx"), F.split("raw", "\t").alias("cells"))
    j = body.join(head, "pxd")
    cells = F.transform("heads", lambda h, i: F.struct(i.alias("col_idx"), h.alias("header"), F.get("occs", i).alias("occ"), F.trim(F.coalesce(F.get("cells", i), F.lit(""))).alias("cell")))
    return j.select("pxd", "row_idx", F.explode(cells).alias("c")).select("pxd", "row_idx", "c.*")


def annotations(found: DataFrame, dialect: str) -> DataFrame:
    """(doc, label, value) of annotation files: ``tab`` (T1, label with offsets, text), ``flat`` (label : value) or ``pipe`` (three pipes between the parts)."""
    lines = found.select(stem(F.col("path")).alias("doc"), F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line"))
    if dialect == "flat":
        p = F.split("line", r"\s*:\s*", 2)
        return lines.filter("line like '%:%'").select("doc", F.trim(p[0]).alias("label"), F.trim(p[1]).alias("value")).filter("label <> ''")
    p = F.split("line", "\t" if dialect == "tab" else r"\|\|\|")
    return lines.filter((F.size(p) >= 3) & F.col("line").rlike(r"^T\d+")).select("doc", F.substring_index(F.trim(p[1]), " ", 1).alias("label"), F.trim(p[2]).alias("value"))


def table(spark: SparkSession, path: str, columns: str, sep: str = "\t") -> DataFrame:
    """A TSV or CSV with a header and a given schema; only its columns are read."""
    return spark.read.csv(path, sep=sep, header=True, schema=columns, enforceSchema=False)


# ---- papers and repositories ----------------------------------------------------------------------------------------

#: Elements of an article that hold no prose, and kinds of abstracts that aren't the abstract.
NOT_PROSE = frozenset("xref table-wrap table fig disp-formula inline-formula ref-list".split())
OTHER_ABSTRACTS = frozenset("graphical teaser summary precis key-points".split())


def article_parts(xml: str | None) -> tuple[str | None, str | None, dict[str, str]]:
    """Title, abstract and sections of a JATS article; text after a dropped element stays."""
    import xml.etree.ElementTree as ET

    if not xml:
        return None, None, {}
    try:
        top = ET.fromstring(xml)
    except ET.ParseError:
        return None, None, {}

    def words(e) -> str:
        out = [e.text or ""]
        for c in e:
            tag = c.tag.rsplit("}", 1)[-1]
            out += ["" if tag in NOT_PROSE else words(c), " " if tag in ("p", "sec", "title") else "", c.tail or ""]
        return "".join(out)

    tidy = lambda s: " ".join(s.split())
    title = top.find(".//article-title")
    abstracts = [a for a in top.iter("abstract") if a.get("abstract-type") not in OTHER_ABSTRACTS]
    sections: dict[str, str] = {}
    body = top.find(".//body")
    for s in body.findall("sec") if body is not None else []:
        sections.setdefault(tidy(s.findtext("title") or "").lower(), tidy(words(s)))
    return tidy(words(title)) if title is not None else None, tidy(words(abstracts[0])) if abstracts else None, sections


ARTICLE = T.StructType([T.StructField("path", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("sections", T.MapType(T.StringType(), T.StringType()))])


def articles(found: DataFrame) -> DataFrame:
    """(path, title, abstract, sections) of JATS files; a broken one has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *article_parts(t)) for p, t in zip(b["path"], b["text"], strict=True)], columns=ARTICLE.names)

    return found.select("path", "text").mapInPandas(run, ARTICLE)


BIOC = "array<struct<documents: array<struct<passages: array<struct<infons: map<string,string>, text: string>>>>>>"


def passages(found: DataFrame, kinds: list[str]) -> DataFrame:
    """(path, section, texts) of BioC JSON, sections of the given kinds alone, in order."""
    p = found.select("path", F.explode(F.flatten(F.transform(F.from_json("text", BIOC), lambda c: F.flatten(F.transform(c["documents"], lambda d: d["passages"]))))).alias("p"))
    s = p.select("path", F.upper(F.coalesce(F.try_element_at(F.col("p.infons"), F.lit("section_type")), F.lit(""))).alias("section"), F.col("p.text").alias("t"), F.monotonically_increasing_id().alias("pos"))
    s = s.filter(F.col("section").isin(*kinds))
    return s.groupBy("path", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("texts"))


CV = "array<struct<name: string, accession: string, cvLabel: string, value: string>>"
REPOSITORY = f"struct<pxd_id: string, pipeline_version: string, pride_metadata: struct<organisms: {CV}, organismParts: {CV}, diseases: {CV}, instruments: {CV}, identifiedPTMStrings: {CV}, experimentTypes: {CV}, quantificationMethods: {CV}, keywords: array<string>, references: array<struct<pubmedID: bigint>>>, runAssessor: struct<files: map<string, struct<instrument_model: struct<name: string, accession: string>, spectra_stats: struct<acquisition_type: string, fragmentation_tag: string, n_ms2_spectra: bigint, n_spectra: bigint>>>>>"


def repositories(found: DataFrame) -> DataFrame:
    """(path, pxd_id, repo) of aggregated repository JSON."""
    r = F.from_json("text", REPOSITORY.removeprefix("struct<").removesuffix(">").join(["struct<", ">"]))
    return found.select("path", r.alias("repo")).select("path", "repo.pxd_id", "repo")


def cv_items(items: Column) -> Column:
    """Named items with trimmed fields; those without a name are left out."""
    named = F.filter(F.coalesce(items, F.array().cast(CV)), lambda x: ~X.is_nullish(x["name"]))
    return F.transform(named, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.nullif(F.trim(x["accession"]), F.lit("")).alias("accession"), F.nullif(F.trim(x["value"]), F.lit("")).alias("value")))


def first_file_fact(repos: DataFrame, fact: str) -> DataFrame:
    """(pxd_id, value): the first filled ``fact`` (a path such as spectra_stats.fragmentation_tag) of a project's files by name."""
    f = repos.select("pxd_id", F.explode("repo.runAssessor.files").alias("file", "info")).select("pxd_id", "file", F.col(f"info.{fact}").cast("string").alias("value"))
    return f.filter(~X.is_nullish("value")).groupBy("pxd_id").agg(F.min_by("value", "file").alias("value"))


def flat_project(repos: DataFrame) -> DataFrame:
    """A row for each project, its lists joined by '; '."""
    names = lambda c: F.array_join(F.transform(cv_items(F.col(f"repo.pride_metadata.{c}")), lambda x: x["name"]), "; ").alias(c)
    return repos.select("pxd_id", *[names(c) for c in ("organisms", "organismParts", "diseases", "instruments", "experimentTypes", "quantificationMethods")], F.array_join("repo.pride_metadata.keywords", "; ").alias("keywords"))


def project_index(repos: DataFrame) -> DataFrame:
    """(key, path): projects by accession and by each reference's number; of several files for a key the last by name."""
    a = repos.select(F.col("pxd_id").alias("key"), "path")
    b = repos.select(F.explode("repo.pride_metadata.references.pubmedID").alias("key"), "path").withColumn("key", F.col("key").cast("string"))
    return a.unionAll(b).filter("key is not null").groupBy("key").agg(F.max("path").alias("path"))


def accessions(found: DataFrame) -> DataFrame:
    """(path, pxd, pos): the distinct accessions of a text in the order they first stand."""
    a = found.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(PXD\d+)"), F.lit(1))).alias("pos", "pxd"))
    return a.groupBy("path", "pxd").agg(F.min("pos").alias("pos"))


def cache(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """(key, value) of a cache table behind JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load().select("key", "value")


def cache_conflicts(entries: DataFrame) -> DataFrame:
    """Keys with several values, which are an error."""
    return entries.groupBy("key").agg(F.countDistinct("value").alias("values")).filter("values > 1")


@F.pandas_udf(T.StringType())
def pickled_json(content: pd.Series) -> pd.Series:
    """The one JSON object among the strings of a pickle; nothing is unpickled. Null if there is none or are several."""
    import json
    import pickletools

    def one(raw) -> str | None:
        found = set()
        try:
            for _, arg, _ in pickletools.genops(bytes(raw)):
                if isinstance(arg, str) and arg.lstrip().startswith("{"):
                    try:
                        json.loads(arg)
                    except ValueError:
                        continue
                    found.add(arg)
        except Exception:  # noqa: BLE001  a broken pickle has no payload
            return None
        return found.pop() if len(found) == 1 else None

    return content.map(lambda x: None if x is None else one(x))


def responses(found: DataFrame) -> DataFrame:
    """(doc_id, response, tokens, seconds, tokens_per_second) of a local model server's envelopes."""
    e = F.from_json("text", "struct<response: string, eval_count: bigint, eval_duration: bigint>")
    s = found.select(stem(F.col("path")).alias("doc_id"), e.alias("e")).select("doc_id", "e.response", F.col("e.eval_count").alias("tokens"), (F.col("e.eval_duration") / 1e9).alias("seconds"))
    return s.withColumn("tokens_per_second", F.try_divide("tokens", "seconds"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, small) of files; ontologies of under 10 KB are failed downloads."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    return f.withColumn("small", F.col("bytes") < 10_000)


# ---- finding and choosing files -------------------------------------------------------------------------------------


def ontology_terms(found: DataFrame) -> DataFrame:
    """(path, id, name, parents) of ontology files by their ending: .obo, or .owl and .xml; others raise an error when they are read."""
    path = F.lower("path")
    known = path.endswith(".obo") | path.endswith(".owl") | path.endswith(".xml")
    checked = found.withColumn("text", F.when(known, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no ontology reader for "), "path"))))
    t = obo_terms(checked.filter(path.endswith(".obo") | ~known))
    line = lambda tag: F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.substr(x, F.lit(len(tag) + 3)))
    parents = F.transform(line("is_a"), lambda x: F.substring_index(F.trim(x), " ", 1))
    obo = t.filter(~F.exists("lines", lambda x: x == "is_obsolete: true")).select("path", "id", F.trim(F.get(line("name"), F.lit(0))).alias("name"), parents.alias("parents"))
    owl = owl_classes(checked.filter(path.endswith(".owl") | path.endswith(".xml"))).filter("not deprecated").select("path", "id", "name", "parents")
    return obo.unionAll(owl)


def resolved_paths(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(pxd, path): a project's table among files: <pxd>.sdrf.tsv itself, else one in a folder of that name, else the only file whose name starts with it. Nothing where several do."""
    name = F.substring_index("path", "/", -1)
    p = paths.select("path", name.alias("name"), F.element_at(F.concat(F.array(F.lit(""), F.lit("")), F.split("path", "/")), -2).alias("folder"), F.regexp_extract(name, r"^([A-Za-z]+\d+)", 1).alias("lead"))
    w = wanted.select("pxd").distinct()
    exact = w.join(p, F.col("name") == F.concat("pxd", F.lit(".sdrf.tsv"))).select("pxd", F.lit(1).alias("rank"), "path")
    nested = w.join(p.filter(F.col("name").endswith(".sdrf.tsv")), F.col("folder") == F.col("pxd")).select("pxd", F.lit(2).alias("rank"), "path")
    lead = w.join(p, F.col("lead") == F.col("pxd")).groupBy("pxd").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("pxd", F.lit(3).alias("rank"), "path")
    best = exact.unionAll(nested).unionAll(lead).groupBy("pxd").agg(F.min(F.struct("rank", "path")).alias("b"))
    return w.join(best, "pxd", "left").select("pxd", F.col("b.path").alias("path"))


def first_place_largest(sources: list[DataFrame], key: str) -> DataFrame:
    """Of files (key, path, bytes) found in several places, those of the first place that has the key, and of these the largest, of equal ones the first by path."""
    out = None
    for i, s in enumerate(sources):
        s = s.select(key, "path", "bytes", F.lit(i).alias("place"))
        out = s if out is None else out.unionAll(s)
    return out.groupBy(key).agg(F.min(F.struct("place", (-F.col("bytes")).alias("m"), "path")).alias("b")).select(key, F.col("b.place").alias("place"), F.col("b.path").alias("path"), (-F.col("b.m")).alias("bytes"))


def discovered(paths: DataFrame, pattern: str, allowed: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(dataset): the names of folders, by a pattern, that hold files, in order; of an allow-list if one is given, the first ``limit`` if asked for."""
    d = paths.select(F.explode(F.filter(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda x: x.rlike(pattern))).alias("dataset")).distinct()
    d = d.filter(F.col("dataset").isin(*allowed)) if allowed is not None else d
    return d.orderBy("dataset").limit(limit) if limit is not None else d


def property_lines(repos: DataFrame) -> DataFrame:
    """(pxd_id, line): labelled lines 'name: a; b' of a project's filled properties, in order of name."""
    flat = flat_project(repos)
    names = [c for c in flat.columns if c != "pxd_id"]
    each = F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in sorted(names)])
    return flat.select("pxd_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("line"))


def settings(given: dict, file: dict, defaults: dict) -> dict:
    """Settings by precedence: those given, then the file's, then the defaults; nested ones are merged, None counts as not given."""
    out = {}
    for k in {**defaults, **file, **given}:
        values = [d[k] for d in (given, file, defaults) if d.get(k) is not None]
        nested = [v for v in values if isinstance(v, dict)]
        out[k] = settings(*([*nested, {}, {}, {}][:3])) if values and isinstance(values[0], dict) else values[0] if values else None
    return out

"""Ontology files of any size, read in pieces: Spark cuts them at element ends by byte range, so many tasks share one file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.session import kept
from metaloom.sources.readers import curie_of

END = "</owl:Class>"
#: The name spaces that the wanted elements are in, also as entities in attribute values.
SPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#", "obo": "http://purl.obolibrary.org/obo/", "oboInOwl": "http://www.geneontology.org/formats/oboInOwl#",
}
_TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z_][\w.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ENTITY = re.compile(r"&(?!amp;|lt;|gt;|quot;|apos;|#)([\w.-]*;?)")
_SHAPE = "path string, start long, id string, name string, synonyms array<string>, parents array<string>, links array<struct<relation:string,target:string>>, deprecated boolean, status string, rest string"
_LINKS = pa.list_(pa.struct([("relation", pa.string()), ("target", pa.string())]))
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), _LINKS, pa.bool_(), pa.string(), pa.string()]


def _open(text: str, stack: list[str]) -> bool:
    """Moves ``stack``, the open elements, past a piece of text; whether every end tag in it had its element."""
    whole = True
    for m in _TAG.finditer(text):
        slash, tag, _, alone = m.groups()
        if tag is None or tag == "rdf:RDF" or alone:
            continue
        if not slash:
            stack.append(tag)
        elif tag in stack:
            # What was left open within ends with it, so one broken class doesn't swallow those after it.
            del stack[len(stack) - 1 - stack[::-1].index(tag) :]
        else:
            whole = False
    return whole


def _classes(text: str) -> Iterator[tuple]:
    """(id, name, synonyms, parents, links, deprecated, status) of the named classes at the top of a balanced piece of text; what can't be parsed has its error as the status."""
    import xml.etree.ElementTree as ET

    for m in re.finditer(r"<owl:Class[\s>]", text):  # what stands before the first class is of no interest
        text = text[m.start() :]
        break
    else:
        return
    body = _ENTITY.sub(lambda m: SPACES.get(m[1].rstrip(";"), f"&amp;{m[1]}"), text)
    names = {*SPACES, *re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", body)} - {"xml", "xmlns"}
    head = "".join(f' xmlns:{n}="{SPACES.get(n, "urn:" + n)}"' for n in sorted(names))
    body = re.sub(r"</rdf:RDF>.*", "", body, flags=re.S)
    try:
        top = ET.fromstring(f"<top{head}>{body}</top>")
    except ET.ParseError as e:
        about = re.search(r"rdf:about\s*=\s*[\"']([^\"']*)", body)
        yield curie_of(about[1]) if about else None, None, [], [], [], None, f"not parsed: {e}"
        return
    at = {k: f"{{{v}}}" for k, v in SPACES.items()}
    for c in top.findall(f"{at['owl']}Class"):
        if not (about := c.get(f"{at['rdf']}about")):
            continue
        parents, links = [], []
        for s in c.findall(f"{at['rdfs']}subClassOf"):
            if r := s.get(f"{at['rdf']}resource"):
                parents.append(curie_of(r))
        for q in c.iter(f"{at['owl']}Restriction"):
            p, v = q.find(f"{at['owl']}onProperty"), q.find(f"{at['owl']}someValuesFrom")
            if p is not None and v is not None and v.get(f"{at['rdf']}resource"):
                links.append({"relation": curie_of(p.get(f"{at['rdf']}resource") or ""), "target": curie_of(v.get(f"{at['rdf']}resource"))})
        dead = c.findtext(f"{at['owl']}deprecated")
        yield curie_of(about), c.findtext(f"{at['rdfs']}label"), [x.text for x in c.findall(f"{at['oboInOwl']}hasExactSynonym") if x.text], parents, links, (dead or "").strip().lower() == "true", None


def _walk(pieces: Iterator[tuple[str, int, str]], inside: bool) -> Iterator[tuple]:
    """Rows of _SHAPE of pieces (path, start, text) in order. What a range of a file begins or ends with that belongs to a class that another range has part of is given as ``rest``, if ``inside`` ranges are known to."""
    place, stack, held, known = None, [], [], True

    def leave(path, start, text):
        return (path, start, None, None, [], [], [], None, None, text)

    def end():
        text = "".join(held)
        if stack and inside:
            yield leave(*place, text)
        elif stack:
            yield (*place, None, None, [], [], [], None, "unclosed: " + ">".join(stack[:4]), None)
        else:
            yield from ((*place, *c, None) for c in _classes(text))

    for path, start, text in pieces:
        if (path, start) != place:
            if place is not None:
                yield from end()
            place, stack, held, known = (path, start), [], [], not inside or start == 0
        after = list(stack)
        whole = _open(text, after)
        if not whole and not known:
            # The range begins within a class: up to here all is the rest of it.
            yield leave(path, start, "".join(held) + text)
            stack, held = [], []
            continue
        held.append(text)
        stack = after
        if not stack:
            # Between classes: nothing before this can belong to one that began in another range.
            known = True
            yield from ((path, start, *c, None) for c in _classes("".join(held)))
            held = []
    if place is not None:
        yield from end()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names, held = [x.split()[0] for x in re.sub(r"<[^ ]*>+", "", _SHAPE).split(", ")], []
    for r in rows:
        held.append(r)
        if len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names)


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, name, synonyms, parents, links, deprecated, status) of the named classes of OWL files in RDF/XML, of any size; links are all their restrictions to some values of a class.

    Spark's text reader cuts a file at the ends of its class elements, by byte range, from any store; each task follows
    the open elements of its range. A class with others inside is put together again; the few that two ranges share are joined by
    one group for each file, which holds no more than those. A class that isn't well-formed, and a file that ends within one, has a
    row with ``status``; the others of its file are read all the same.
    """
    raw = spark.read.text(path, lineSep=END, recursiveFileLookup=True)
    # Each piece lost its end tag, but for the last of a file, which has none.
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value"))
    text = F.when(F.col("value").rlike(r"</rdf:RDF>\s*$") | (F.trim("value") == ""), F.col("value")).otherwise(F.concat("value", F.lit(END)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_walk(((p, s, t) for b in batches for p, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True)), True))

    found = raw.select("path", "start", text.alias("text")).mapInArrow(run, _SHAPE)
    # Both the whole classes and the rests come from one pass, stored, as ranges are walked in order.
    found = kept(found.withColumn("turn", F.monotonically_increasing_id()))
    rests = found.filter("rest is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "turn", "rest"))).alias("rests"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((p, 0, r["rest"]) for b in batches for p, rs in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in rs)
        yield from _batches(_walk(pieces, False))

    both = found.filter("rest is null").drop("turn").unionAll(rests.mapInArrow(join, _SHAPE))
    return both.drop("start", "rest")


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, lines) of the [Term] stanzas of OBO files of any size, which Spark cuts where a line begins with a bracket; see readers.obo_tables."""
    raw = spark.read.text(path, lineSep="\n[", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    stanza = F.regexp_replace("value", r"^\[", "")
    lines = F.transform(F.split(stanza, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    s = raw.filter(stanza.startswith("Term]")).select("path", lines.alias("lines"))
    return s.select("path", F.regexp_extract(F.get(F.filter("lines", lambda x: x.startswith("id: ")), F.lit(0)), r"^id: (\S+)", 1).alias("id"), "lines").filter("id <> ''")

"""Records of mixed shapes: prompts, term lists, raw and normalised pairs, back-fills, technical records, raters, staging and preflight."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """A template with its '{{ name }}' marks filled; a null value leaves nothing, other marks stay."""
    out = F.lit(template)
    for name, value in values.items():
        for mark in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}"):
            out = F.replace(out, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return out


def terms_of(cell: Column) -> Column:
    """The distinct known terms of a cell that may hold a JSON object with ``ontology_name``, ``name`` or ``value``, a list of such, of strings or of other lists, or plain text with ';', in order.

    The cell is parsed once, as a VARIANT, whatever its shape: a list gives its items, lists within it theirs, and an object or a
    value stands for a list of one. Text that only looks like JSON is plain text.
    """
    v = F.try_parse_json(cell)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    flat = F.flatten(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))

    def one(x: Column) -> Column:
        fields = [X.known(F.try_variant_get(x, f"$.{name}", "string")) for name in ("ontology_name", "name", "value")]
        text = F.when(~F.schema_of_variant(x).startswith("OBJECT") & ~F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "string"))
        return F.coalesce(*fields, X.known(text))

    json = v.isNotNull() & F.substring(F.trim(cell), 1, 1).isin("{", "[")
    found = F.when(json, F.transform(flat, one)).otherwise(F.transform(F.split(cell, ";"), lambda x: X.known(x)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def raw_and_normalised(items: Column) -> Column:
    """(raw, norm) of an array of items (value, ontology_name): the value as it was and its name, or the value again where there is none; items without a value go."""
    return F.transform(F.filter(items, lambda x: ~X.is_nullish(x["value"])), lambda x: F.struct(F.trim(x["value"]).alias("raw"), F.coalesce(X.known(x["ontology_name"]), F.trim(x["value"])).alias("norm")))


def backfilled(enriched: DataFrame, *others: DataFrame, key: Sequence[str] = ("id", "field")) -> DataFrame:
    """(key..., value, place): enriched fields, and of the others those it lacks, the earlier table first. Unknown values lack."""
    known = [d.filter(~X.is_nullish("value")).groupBy(*key).agg(F.min("value").alias("value")).withColumn("place", F.lit(i)) for i, d in enumerate((enriched, *others))]
    out = known[0]
    for d in known[1:]:
        out = out.unionAll(d.join(out.select(*key), list(key), "left_anti"))
    return out


#: The fields of a technical record, and those that a project's properties tell.
TECHNICAL = (
    "acquisition_method", "alkylation_concentration", "alkylation_reagent", "cleavage_agent", "collision_energy", "enrichment_method", "fractionation_method", "fragmentation_method",
    "instrument", "ionization_type", "labeling", "mass_analyzer", "ptm", "reduction_concentration", "reduction_reagent",
)
TOLD = {"acquisition_method": "experiment types", "instrument": "instruments", "labeling": "quantification", "ptm": "modifications"}


def technical_record(texts: DataFrame) -> DataFrame:
    """(id, field, seq, value, evidence) of texts (id, text) by the properties that they print.

    The properties are the lines 'key: value; value' between '=== PRIDE PROJECT PROPERTIES ===' and the next line that
    begins with '=== '; case in keys aside, of a repeated key the last line counts. Experiment types, instruments,
    modifications and quantification give the values of TOLD, each with the printed line as evidence. An instrument
    whose name holds "orbitrap" gives the analyser Orbitrap, with the line as inferred evidence. All other fields of TECHNICAL,
    and such without values, are unknown, without evidence.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    after = F.regexp_extract(text, r"(?s)(?:^|\n)[^\S\n]*=== PRIDE PROJECT PROPERTIES ===[^\S\n]*\n(.*)", 1)
    block = F.regexp_replace(F.concat(F.lit("\n"), after), r"(?s)\n=== .*", "")
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    t = texts.select("id", lines.alias("lines"))
    named = lambda key: F.try_element_at(F.filter("lines", lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == key), F.lit(-1))
    values = lambda line: F.filter(F.transform(F.split(F.regexp_replace(line, "^[^:]*:", ""), ";"), lambda v: F.trim(v)), lambda v: v != "")
    entry = lambda v, e: F.struct(v.alias("value"), e.alias("evidence"))
    told = lambda line: F.transform(values(line), lambda v: entry(v, line))
    unknown = F.array(entry(F.lit("unknown"), F.lit("")))
    records = []
    for field in TECHNICAL:
        found = F.lit(None)
        if field in TOLD:
            line = named(TOLD[field])
            found = told(line)
        elif field == "mass_analyzer":
            line = named(TOLD["instrument"])
            found = F.when(F.exists(values(line), lambda v: F.lower(v).contains("orbitrap")), F.array(entry(F.lit("Orbitrap"), F.concat(F.lit("inferred: "), line))))
        found = unknown if field not in TOLD and field != "mass_analyzer" else F.when(F.size(F.coalesce(found, F.array().cast("array<struct<value:string,evidence:string>>"))) > 0, found).otherwise(unknown)
        records.append(F.struct(F.lit(field).alias("field"), found.alias("entries")))
    r = t.select("id", F.explode(F.array(*records)).alias("r"))
    return r.select("id", F.col("r.field").alias("field"), F.posexplode("r.entries").alias("seq", "x")).select("id", "field", "seq", "x.value", "x.evidence")


def distinct_raters(annotations: DataFrame) -> DataFrame:
    """``annotations`` (rater, doc, label, value) without raters whose whole work is another's, row for row; the first by name stays."""
    row = F.struct("doc", "label", "value")
    # The sum of row hashes doesn't depend on order, so no rater is gathered.
    prints = annotations.groupBy("rater").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(row).cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(20,0)")).alias("b"))
    keep = prints.groupBy("n", "a", "b").agg(F.min("rater").alias("rater")).select("rater")
    return annotations.join(keep, "rater", "left_semi")


def obo_text(species: DataFrame, prefix: str) -> DataFrame:
    """(id, stanza): OBO stanzas of curated species (taxon, name, common array): the names as exact synonyms, the binomial's short forms as related ones."""
    syn = F.transform("common", lambda c: F.concat(F.lit('synonym: "'), c, F.lit('" EXACT []')))
    short = F.transform(F.coalesce(X.binomial_short("name"), F.array().cast("array<string>")), lambda c: F.concat(F.lit('synonym: "'), c, F.lit('" RELATED []')))
    head = F.array(F.lit("[Term]"), F.concat(F.lit(f"id: {prefix}:"), F.col("taxon").cast("string")), F.concat(F.lit("name: "), "name"))
    return species.select(F.concat(F.lit(f"{prefix}:"), F.col("taxon").cast("string")).alias("id"), F.array_join(F.concat(head, syn, short), "\n").alias("stanza"))


def rescored(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b, kind, score) scored again by another model's vectors (term, vec): pairs that were equal stay, others are SEMANTIC from a cosine of ``least`` on, else NO_MATCH, which keeps the cosine."""
    x = vectors.select(F.col("term").alias("a"), F.col("vec").alias("__x"))
    y = vectors.select(F.col("term").alias("b"), F.col("vec").alias("__y"))
    c = F.coalesce(M.cosine(F.col("__x"), F.col("__y")), F.lit(0.0))
    fixed = F.col("kind").isin("EXACT", "NORMALIZED", "ONTOLOGY", "HIERARCHICAL")
    j = pairs.join(x, "a", "left").join(y, "b", "left")
    return j.select("a", "b", F.when(fixed, F.col("kind")).when(c >= least, "SEMANTIC").otherwise("NO_MATCH").alias("kind"), F.when(fixed, F.col("score")).otherwise(c).alias("score"))


def staged(files: DataFrame, agents: Mapping[str, str]) -> DataFrame:
    """``files`` (id, agent, stage) with ``target``, where the comparer looks for them: normalised outputs below NormalizedAgent, others by the agent's own folder."""
    folder = F.create_map(*[F.lit(x) for kv in agents.items() for x in kv])
    place = F.coalesce(F.try_element_at(folder, F.col("agent")), F.col("agent"))
    return files.withColumn("target", F.concat_ws("/", F.when(F.col("stage") == "normalised", F.lit("NormalizedAgent")), place, F.concat("id", F.lit("_"), "agent", F.lit(".json"))))


def preflight(required: DataFrame, present: DataFrame) -> DataFrame:
    """(name, problem) of required resources (name, least_bytes) that are ``missing`` or ``too_small`` among those present (name, bytes)."""
    j = required.join(present.groupBy("name").agg(F.max("bytes").alias("bytes")), "name", "left")
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < F.col("least_bytes"), "too_small")
    return j.select("name", problem.alias("problem")).filter("problem is not null")


def checked_counts(before: DataFrame, after: DataFrame, shard: str) -> DataFrame:
    """``after``, whose every shard must hold as many rows as ``before``: a shard that doesn't makes its rows raise an error when they are read, so no result is written in part."""
    n = before.groupBy(shard).agg(F.count(F.lit(1)).alias("__before"))
    m = after.groupBy(shard).agg(F.count(F.lit(1)).alias("__after"))
    bad = n.join(m, shard, "full").filter(~F.col("__before").eqNullSafe(F.col("__after"))).select(F.concat_ws(",", F.col(shard).cast("string")).alias("__s"))
    told = bad.agg(F.count(F.lit(1)).alias("__bad"))
    return after.crossJoin(F.broadcast(told)).filter(F.when(F.col("__bad") > 0, F.raise_error(F.lit("shards differ in their number of rows"))).otherwise(F.lit(True))).drop("__bad")  # one row


def text_support(needle: Column, text: Column) -> Column:
    """1 where a text holds a value, .95 where it has the binomial's abbreviated form, else 0."""
    n, t = X.key(needle), X.key(text)
    short = F.concat(F.left(n, F.lit(1)), F.lit(". "), F.substring_index(n, " ", -1))
    two = F.size(F.split(n, " ")) == 2
    return F.when((n != "") & F.contains(t, n), 1.0).when(two & F.contains(F.concat(F.lit(" "), t), F.concat(F.lit(" "), short)), 0.95).otherwise(0.0)

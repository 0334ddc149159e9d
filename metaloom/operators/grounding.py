"""Evidence grounded in its source: quotes snapped to the source's words, unsupported claims, and audits of multi-value records.

Entries are rows (id, field, seq, value, evidence); a source's text meets its entries by one join on the id, after the quotes
that stand in it as written have been told by a JVM-side test, so Python sees only the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions import text as X
from metaloom.operators.guards import present
from metaloom.refdata import COMPARISON_FIELDS, CONTROL_WORDS


def _quote(evidence: Column) -> Column:
    return F.trim(F.regexp_replace(evidence, r"(?i)^\s*inferred\s*: *", ""))


def snapped(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``entries`` with ``evidence`` in the source's own words where it is found, and ``status`` (see functions.text.snapped). sources: (id, text). An ``inferred:`` is kept before the words.

    Entries may have a ``place``: the character (from 0) of the source at which the quote, without its outer blanks, was taken. It tells which words are meant where a quote stands there in several
    places; ``status`` tells, as ever, whether the quote stands anywhere as written.
    """
    j = entries.join(sources.select("id", "text"), "id", "left")
    q = _quote(F.col("evidence"))
    here = F.coalesce((q != "") & F.contains("text", q), F.lit(False))
    place = F.col("place").cast("int") if "place" in entries.columns else F.lit(None).cast("int")
    # The Python side is asked only where the quote isn't there as written, at its place if that is known.
    done = here & (place.isNull() | (F.substr("text", place + 1, F.length(q)) == q))
    j = j.withColumn("__snap", F.when(done | q.isNull() | (q == "") | F.col("text").isNull(), None).otherwise(X.snap(F.when(~done, q), F.when(~done, F.col("text")), place)))
    status = F.when(here, "verbatim").when(F.col("__snap").isNull(), "absent").otherwise(F.col("__snap.status"))
    words = F.coalesce(F.col("__snap.quote"), q)
    inferred = X.inferred("evidence")
    evidence = F.when(status == "absent", F.col("evidence")).when(F.coalesce(inferred, F.lit(False)), F.concat(F.lit("inferred: "), words)).otherwise(words)
    return j.withColumn("status", status).withColumn("evidence", evidence).select(*entries.columns, "status")


def comparison_unsupported(value: Column, evidence: Column) -> Column:
    """Whether a value claims a comparison, 'a vs b', treated and control, or no treatment, that its evidence bears neither by a word for a control nor by a word of both sides."""
    v, e = F.lower(value), F.lower(F.coalesce(evidence, F.lit("")))
    claims = F.contains(F.concat(F.lit(" "), v, F.lit(" ")), F.lit(" vs ")) | (v.contains("treated") & v.contains("control")) | v.contains("no treatment")
    control = F.lit(False)
    for w in CONTROL_WORDS:
        control = control | e.contains(w)
    terms = lambda side: F.filter(F.regexp_extract_all(side, F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 2)
    named = lambda side: F.exists(terms(side), lambda t: F.contains(e, t))
    both = F.contains(v, F.lit(" vs ")) & ~v.startswith("treated vs control") & named(F.substring_index(v, " vs ", 1)) & named(F.regexp_replace(v, r"^.*? vs ", ""))
    return claims & ~(control | both)


def grounded(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``entries`` after snapping, with ``flags``: cleared (evidence of an unknown value), no_evidence, not_grounded, no_comparison."""
    s = snapped(entries, sources)
    unknown = F.coalesce(F.lower(F.trim("value")) == "unknown", F.lit(True))
    has = F.coalesce(F.col("evidence") != "", F.lit(False))
    flags = present([
        (unknown & has, "cleared"), (~unknown & ~has, "no_evidence"), (~unknown & has & (F.col("status") == "absent"), "not_grounded"),
        (F.col("field").isin(*COMPARISON_FIELDS) & comparison_unsupported(F.col("value"), F.col("evidence")), "no_comparison"),
    ])
    return s.withColumn("flags", flags).withColumn("evidence", F.when(unknown, F.lit("")).otherwise(F.col("evidence")))


def contract_problems(entries: DataFrame, sources: DataFrame, flagged: DataFrame) -> DataFrame:
    """(id, field, seq, problem) of entries that break the contract: an unknown value with evidence, a known one without, or evidence that the source lacks, unless flagged (id, field, value, evidence)."""
    f = flagged.select("id", "field", "value", "evidence").distinct().withColumn("__flagged", F.lit(True))
    j = entries.join(sources.select("id", "text"), "id", "left").join(f, ["id", "field", "value", "evidence"], "left")
    unknown, none = F.lower("value") == "unknown", F.coalesce(F.col("evidence") == "", F.lit(True))
    inferred = F.lower("evidence").startswith("inferred: ")
    quote = F.lower(F.when(inferred, F.substr("evidence", F.lit(11))).otherwise(F.col("evidence")))
    absent = ~F.contains(F.lower("text"), quote)
    told = F.col("__flagged").isNotNull()
    problem = (
        F.when(F.col("text").isNull(), "no_source").when(F.col("value").isNull() | F.col("evidence").isNull(), "not_text").when(unknown, F.when(~none, "unknown_with_evidence"))
        .when(none, F.when(~told, "no_evidence")).when(absent & ~told, F.when(inferred, "inferred_absent").otherwise("evidence_absent"))
    )
    return j.select("id", "field", "seq", problem.alias("problem")).filter("problem is not null")


def schema_summary(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_fields, n_errors, valid_share, ok) of records' fields (error: null where there is none)."""
    g = fields.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fields"), F.count("error").alias("n_errors"))
    return g.withColumn("valid_share", 1 - F.col("n_errors") / F.col("n_fields")).withColumn("ok", F.col("n_errors") == 0)


def truncations(requests: DataFrame, limit: int) -> DataFrame:
    """(id, model, n_tokens, removed) of requests that were cut to ``limit`` tokens."""
    return requests.filter(F.col("n_tokens") > limit).select("id", "model", "n_tokens", (F.col("n_tokens") - limit).alias("removed"))


def validated(original: DataFrame, answers: DataFrame, schema: str) -> DataFrame:
    """``original`` (id, record) with the validated record where the answer (id, answer) holds JSON of the schema, else as it was; ``changed`` tells which."""
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    good = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(body)
    a = answers.select("id", F.when(F.size(F.coalesce(keys, F.array())) > 0, F.to_json(good)).alias("__new"))
    j = original.join(a, "id", "left")
    return j.select("id", F.coalesce("__new", "record").alias("record"), F.col("__new").isNotNull().alias("changed"))

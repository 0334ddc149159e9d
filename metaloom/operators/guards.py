"""Quality rules: validation of records, evidence scores, flags, verdicts and repairs of tables of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import text as X
from metaloom.operators.negation import negated  # noqa: F401: by scope


def present(conditions: list[tuple[Column, str]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, n) for c, n in conditions]), lambda x: x.isNotNull())


def format_error(items: Column) -> Column:
    """What is wrong with a field's array of value and evidence; null if nothing is."""
    n = F.size(items)
    return (
        F.when(items.isNull(), "missing").when(n == 0, "empty").when(n == 1, "no_evidence").when(n > 2, "too_long")
        .when(items[0].isNull() | (F.trim(items[0]) == ""), "blank_value").otherwise(F.lit(None).cast("string"))
    )


def evidence_score(value: Column, evidence: Column, source: Column) -> Column:
    """How well a field's evidence bears it: 1 if the source has the quote and the quote the value, .9 if the source has the quote, .6 if the quote but not the source has the value, .2 for other evidence; an unknown value needs none and has 1 without, .5 with."""
    quoted = F.contains(X.key(source), X.key(evidence))
    holds = F.contains(X.key(evidence), X.key(value))
    none = X.is_nullish(evidence)
    return (
        F.when(X.is_nullish(value), F.when(none, 1.0).otherwise(0.5)).when(none, 0.0).when(quoted & holds, 1.0).when(quoted, 0.9).when(holds, 0.6).otherwise(0.2)
    )


def record_confidence(fields: DataFrame, by: list[str], expected: int) -> DataFrame:
    """(by..., schema, evidence, completeness, overall, gate) of records' fields (valid boolean, score double, value): overall .3, .5, .2; the gate opens at .7."""
    g = fields.groupBy(*by).agg(F.avg(F.col("valid").cast("double")).alias("schema"), F.avg("score").alias("evidence"), (F.count_if(~X.is_nullish("value")) / F.lit(expected)).alias("completeness"))
    overall = 0.3 * F.col("schema") + 0.5 * F.col("evidence") + 0.2 * F.least(F.col("completeness"), F.lit(1.0))
    return g.withColumn("overall", F.bround(overall, 3)).withColumn("gate", F.col("overall") >= 0.7)


def critiques(value: Column, evidence: Column, source: Column) -> Column:
    """What a reviewer would say of a field."""
    known = ~X.is_nullish(value)
    return present([
        (known & X.is_nullish(evidence), "no_evidence"),
        (known & ~X.is_nullish(evidence) & ~F.coalesce(F.contains(X.key(source), X.key(evidence)), F.lit(False)), "not_in_text"),
        (known & ~F.coalesce(F.contains(X.key(source), X.key(value)), F.lit(False)) & ~F.coalesce(F.contains(X.key(evidence), X.key(value)), F.lit(False)), "fabricated"),
    ])


def numeric_mismatch(value: Column, evidence: Column) -> Column:
    """Whether a number of the value is nowhere in its evidence."""
    n = F.regexp_extract_all(value, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    e = F.regexp_extract_all(evidence, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.size(F.array_except(F.transform(n, lambda x: x.cast("double")), F.transform(e, lambda x: x.cast("double")))) > 0


def retry_winner(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Each record's attempt of highest confidence; of equal ones the first."""
    best = F.max_by(F.struct("attempt", "temperature", "value", "confidence"), F.struct("confidence", (-F.col("attempt")).alias("a"))).alias("b")
    return attempts.groupBy(*by).agg(best).select(*by, "b.*")


def next_temperature(t: Column) -> Column:
    return F.least(t + 0.1, F.lit(0.5))


def degenerate(answer: Column, expect_verdict: bool = True) -> Column:
    """Whether a model's answer has run wild: a dash and letter on and on, mixed scripts with hardly any variety, or a long answer without its verdict. Answers of under 100 characters never have."""
    a = F.coalesce(answer, F.lit(""))
    n = F.length(a)
    variety = lambda x: F.size(F.array_distinct(F.split(x, "")))
    script = r"[\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff\u1100-\u11ff\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff]{3,}"
    tail = F.substr(a, F.floor(n / 2).cast("int") + 1)
    return (n >= 100) & (
        a.rlike(r"(?:- a[- ]){10,}")
        | (F.size(F.regexp_extract_all(a, F.lit(r"((?:- a){5,})"), F.lit(1))) >= 3)
        | (a.rlike(script + "[- a-z0-9]{0,5}" + script) & (variety(tail) < 30) & (F.length(tail) > 200))
        | ((n > 500) & (variety(F.right(a, F.lit(500))) < 25))
        | (F.lit(expect_verdict) & (n > 4000) & ~F.lower(a).contains("verdict"))
    )


def audit(normalised: DataFrame) -> DataFrame:
    """(id, problem) of normalised terms (id, raw, node, candidates, prefixes array, taxon_ok): corrections, ambiguous ones, foreign namespaces and taxon conflicts."""
    problems = present([
        (F.col("node").isNotNull() & (X.key("raw") != X.key("name")), "correction"),
        (F.size("candidates") > 1, "ambiguous"),
        (F.col("node").isNotNull() & ~F.exists("prefixes", lambda p: F.col("node").startswith(p)), "cross_namespace"),
        (~F.coalesce("taxon_ok", F.lit(True)), "taxon"),
    ])
    return normalised.select("id", F.explode(problems).alias("problem"))


def units(cells: DataFrame) -> DataFrame:
    """Distinct judging units of cells (pxd, field, row_idx, col_idx, cell): one of each meaning, with its spellings, rows and columns."""
    g = cells.filter(~X.is_nullish("cell", "sample")).groupBy("pxd", "field", X.cell_identity("cell").alias("unit"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("row_idx")).alias("rows"), F.array_sort(F.collect_set("col_idx")).alias("cols"), F.array_sort(F.collect_set("cell")).alias("variants"))


def apply_verdicts(cells: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cells with ``fixed``: blank for ``remove``, the corrected value for ``replace`` (with the accession kept if the name is the same), else as they were. verdicts: (pxd, field, unit, verdict, corrected)."""
    c = cells.withColumn("unit", X.cell_identity("cell"))
    j = c.join(verdicts, ["pxd", "field", "unit"], "left")
    keyed = F.contains(F.col("cell"), F.lit("NT="))
    ac = X.cell_value("cell", "AC")
    same = X.key(X.cell_value("cell")) == X.key("corrected")
    styled = F.when(keyed & same & ac.isNotNull(), F.concat_ws(";", F.concat(F.lit("NT="), "corrected"), F.concat(F.lit("AC="), ac))).when(keyed, F.concat(F.lit("NT="), "corrected")).otherwise(F.col("corrected"))
    fixed = F.when(F.col("verdict") == "remove", "not available").when((F.col("verdict") == "replace") & F.col("corrected").isNotNull(), styled).otherwise(F.col("cell"))
    return j.withColumn("fixed", fixed).drop("unit", "verdict", "corrected")


def column_coverage(cells: DataFrame) -> DataFrame:
    """(pxd, field, rows, filled, distinct_values, status) of the fields of sample tables."""
    g = cells.groupBy("pxd", "field").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~X.is_nullish("cell", "sample")).alias("filled"), F.countDistinct(F.when(~X.is_nullish("cell", "sample"), F.col("cell"))).alias("distinct_values"))
    return g.withColumn("status", F.when(F.col("filled") == 0, "empty").when(F.col("filled") < F.col("rows"), "partial").when(F.col("distinct_values") == 1, "constant").otherwise("varying"))


def compact_mapping(runs: DataFrame, by: list[str], value: str, key: str, shown: int = 3) -> DataFrame:
    """(by..., value, n, first_keys): how many keys have each value, and the first few of them."""
    return runs.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(key)), 1, shown), "; ").alias("first_keys"))


def complete(expected: DataFrame, raw: DataFrame, normalised: DataFrame, by: str) -> DataFrame:
    """(by, expected, raw, normalised, ok) of record counts per shard: ok if all three are one."""
    n = lambda d, c: d.groupBy(by).agg(F.count(F.lit(1)).alias(c))
    j = n(expected, "expected").join(n(raw, "raw"), by, "full").join(n(normalised, "normalised"), by, "full").na.fill(0)
    return j.withColumn("ok", (F.col("expected") == F.col("raw")) & (F.col("raw") == F.col("normalised")))


def append_new(existing: DataFrame, repaired: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` and those repaired records that it lacks; nothing is overwritten."""
    return existing.unionByName(repaired.join(existing.select(*key), key, "left_anti"))


def support_origin(items: DataFrame, before: str, added: str, value: str) -> DataFrame:
    """``items`` with ``origin``: whether a quote stands in the earlier text, the added one, both or neither."""
    q = X.key(value)
    a, b = F.coalesce(F.contains(X.key(before), q), F.lit(False)), F.coalesce(F.contains(X.key(added), q), F.lit(False))
    return items.withColumn("origin", F.when(a & b, "mixed").when(a, "earlier_context").when(b, "added_section").otherwise("unverified"))


def without_repeated_lines(docs: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """(id, text, dropped): texts without long lines that repeat an earlier line of theirs by key; lines of under ``least`` characters all stay. A document's lines stay in its row, so there is no shuffle."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x, i: F.struct(x.alias("line"), F.when(F.length(x) >= least, F.md5(X.key(x))).alias("k"), i.alias("i")))
    d = docs.select(id_col, lines.alias("lines")).withColumn("keys", F.transform("lines", lambda s: s["k"]))
    kept = F.filter("lines", lambda s: s["k"].isNull() | (F.array_position("keys", s["k"]) == s["i"] + 1))
    return d.withColumn("kept", kept).select(id_col, F.array_join(F.transform("kept", lambda s: s["line"]), "\n").alias("text"), (F.size("lines") - F.size("kept")).alias("dropped"))


def duplicate_flags(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``duplicate``: whether its key occurs again."""
    n = df.groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    return df.join(n, key)


def first_of_ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

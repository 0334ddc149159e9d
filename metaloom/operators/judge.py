"""Judging units of sample tables: hints, the guards that an answer passes, per-sample rules, recovered values and modifications.

A unit is a row; each guard is a step over columns, applied in a fixed order, so that Catalyst makes one projection of the
chain and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import text as X
from metaloom.operators.guards import present
from metaloom.refdata import DONOR_FIELDS, ONE_VALUE_FIELDS, OVERLAP_PAIRS, REGROUP_FIELDS, REPLICATE_FIELDS, SAMPLE_FIELDS, TOLERANCE_FIELDS

NUMBER = r"(\d+(?:\.\d+)?)"


def keyed(cell: Column) -> Column:
    return F.contains(cell, F.lit("NT="))


def readable(cell: Column) -> Column:
    """A cell in plain words: its name, and in brackets its residues, position and kind."""
    extra = F.filter(F.array(*[X.cell_value(cell, k) for k in ("TA", "PP", "MT")]), lambda x: x.isNotNull())
    name = X.cell_value(cell)
    return F.when(~keyed(cell), F.trim(cell)).when(F.size(extra) > 0, F.concat(name, F.lit(" ("), F.array_join(extra, ", "), F.lit(")"))).otherwise(name)


def modification_key(cell: Column) -> Column:
    """What a modification cell means: its name, sorted residues, position and kind, without case."""
    residues = F.array_join(F.array_sort(F.transform(F.split(F.coalesce(X.cell_value(cell, "TA"), F.lit("")), ","), lambda r: F.trim(r))), ",")
    return F.lower(F.concat_ws("|", F.coalesce(X.cell_value(cell), F.lit("")), residues, F.coalesce(X.cell_value(cell, "PP"), F.lit("")), F.coalesce(X.cell_value(cell, "MT"), F.lit(""))))


def modifications(value: Column) -> Column:
    """Cells of a list in words, 'Oxidation (M) variable, Phospho (ST)': name, residues or position, and Fixed or Variable; 'all variable' counts for those that say neither."""
    parts = X.split_outside_parens(value, ",;")
    kind = lambda p: F.when(F.lower(p).rlike(r"\b(?:fixed|static)\b"), "Fixed").when(F.lower(p).rlike(r"\bvariable\b"), "Variable")
    alone = lambda p: F.lower(p).rlike(r"^(?:all\s+)?(?:fixed|static|variable)(?:\s+modifications?)?$")
    whole = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(parts, alone), kind)), -1)

    def cell(p: Column) -> Column:
        bare = F.trim(F.regexp_replace(p, r"(?i)\b(?:fixed|static|variable)\b", ""))
        site = F.trim(F.regexp_extract(bare, r"\(([^)]*)\)\s*$", 1))
        residues = F.array_join(F.regexp_extract_all(F.upper(site), F.lit("([A-Z])"), F.lit(1)), ",")
        where = F.when(F.lower(site).contains("term"), F.concat(F.lit("PP="), site)).when(residues != "", F.concat(F.lit("TA="), residues))
        mt = F.coalesce(kind(p), whole)
        return F.concat_ws(";", F.concat(F.lit("NT="), F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))), where, F.when(mt.isNotNull(), F.concat(F.lit("MT="), mt)))

    return F.when(keyed(value), F.array(F.trim(value))).otherwise(F.transform(F.filter(parts, lambda p: ~alone(p)), cell))


def printed_sites(name: Column, text: Column) -> Column:
    """What stands in brackets after each mention of a name in a text."""
    ends = F.slice(F.split(F.lower(text), F.concat(F.lit(r"(?<![\w-])\Q"), F.lower(name), F.lit(r"\E\s*\("))), 2, 1 << 30)
    sites = F.transform(ends, lambda e: F.trim(F.regexp_extract(e, r"^([^()]{1,40})\)", 1)))
    return F.filter(sites, lambda s: s != "")


def modification_of_sites(cell: Column, sites: Column) -> Column:
    """A modification cell with the residues and the position of its printed sites, name, accession and kind kept; null where the sites tell nothing."""
    position = F.get(F.filter(sites, lambda s: s.contains("term")), F.lit(0))
    place = F.when(position.isNotNull(), F.concat(F.when(position.contains("protein"), "Protein ").otherwise("Any "), F.when(position.rlike("n[- ]term"), "N-term").otherwise("C-term")))
    letters = F.filter(sites, lambda s: ~s.contains("term"))
    odd = F.exists(letters, lambda s: ~s.rlike(r"^[a-z ,/]+$"))
    residues = F.array_distinct(F.flatten(F.transform(letters, lambda s: F.regexp_extract_all(F.upper(s), F.lit("([A-Z])"), F.lit(1)))))
    part = lambda k: F.when(X.cell_value(cell, k).isNotNull(), F.concat(F.lit(f"{k}="), X.cell_value(cell, k)))
    built = F.concat_ws(";", part("NT"), part("AC"), F.when(F.size(residues) > 0, F.concat(F.lit("TA="), F.array_join(residues, ","))), F.when(place.isNotNull(), F.concat(F.lit("PP="), place)), part("MT"))
    return F.when(~odd & ((F.size(residues) > 0) | place.isNotNull()), built)


def numbers_printed(value: Column, text: Column) -> Column:
    """Whether every number of a value stands in a text as a number of its own."""
    return F.forall(F.regexp_extract_all(value, F.lit(NUMBER), F.lit(1)), lambda n: F.array_contains(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), n))


def same_quantity(a: Column, b: Column) -> Column:
    """Whether two strings are one quantity, in whatever unit prefix."""
    x, y = X.quantity(a), X.quantity(b)
    return F.coalesce((x["unit"] == y["unit"]) & X.same_number(x["value"], y["value"]), F.lit(False))


def quantity_printed(value: Column, text: Column) -> Column:
    """Whether a text prints a quantity, in whatever unit prefix."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?\s?[fpnuµμmckMG]?(?:g|l|m|M|Da|s|Hz|V|K))\b"), F.lit(1))
    return F.exists(found, lambda q: same_quantity(value, q))


def in_dalton(value: Column) -> Column:
    """A tolerance in mmu as one in Da; others as they are."""
    n = F.regexp_extract(value, r"(?i)^\s*(\d+(?:\.\d+)?)\s*mmu\s*$", 1).try_cast("double")
    return F.when(n.isNotNull(), F.concat(F.regexp_replace(F.format_number(n / 1000, 6), r"\.?0+$", ""), F.lit(" Da"))).otherwise(value)


def hints(units: DataFrame) -> DataFrame:
    """``units`` (field, kind, cell, paper) with ``hints``: what can be told of each without judging."""
    cell, field, paper = F.col("cell"), F.col("field"), X.key("paper")
    words = readable(cell)
    name = X.key(F.when(keyed(cell), X.cell_value(cell)).otherwise(words))
    tolerance = field.isin(*TOLERANCE_FIELDS)
    unit = words.rlike(r"\d") & F.lower(words).rlike("ppm|da|mmu|th")
    runs = F.transform(F.split(cell, r"\|"), lambda v: F.trim(F.substring_index(v, "=", -1)))
    is_runs, is_mod = F.col("kind") == "runs", F.col("kind") == "modification"
    return units.withColumn("hints", present([
        (~is_runs & F.contains(paper, name) & (name != ""), "in_text"),
        (~is_runs & ~(F.contains(paper, name) & (name != "")), "not_verbatim"),
        (tolerance & ~unit, "tolerance_without_unit"),
        (tolerance & unit & ~numbers_printed(words, paper), "tolerance_not_printed"),
        ((field == "disease_state") & (X.key(words) != "normal") & F.lower(words).rlike(r"\b(?:healthy|normal|control)\b"), "write_normal"),
        (is_mod & X.cell_value(cell, "MT").isNull(), "no_kind"),
        (is_mod & X.cell_value(cell, "TA").isNull() & X.cell_value(cell, "PP").isNull(), "no_site"),
        (is_runs & field.isin(*REPLICATE_FIELDS) & F.exists(runs, lambda v: ~v.rlike(r"^\d+$")), "not_a_number"),
    ]))


def with_context(units: DataFrame, related: DataFrame) -> DataFrame:
    """``units`` (pxd, field, ...) with ``context``: 'field: values' of the fields beside theirs. related: (field, other), a small table of names."""
    values = units.select("pxd", F.col("field").alias("other"), readable(F.col("cell")).alias("v")).groupBy("pxd", "other").agg(F.array_join(F.array_sort(F.collect_set("v")), ", ").alias("vs"))
    beside = values.join(F.broadcast(related), "other").groupBy(F.col("pxd").alias("__p"), F.col("field").alias("__f")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("other", F.lit(": "), "vs"))), "; ").alias("context"))
    return units.join(beside, (F.col("pxd") == F.col("__p")) & (F.col("field") == F.col("__f")), "left").drop("__p", "__f")


def _runs(value: Column) -> Column:
    """The map of a 'run = value | run = value' cell; of a repeated run the last."""
    parts = F.filter(F.split(value, r"\|"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    last = F.aggregate(F.reverse(pairs), F.slice(pairs, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(F.reverse(last))


def guarded(answers: DataFrame) -> DataFrame:
    """Judge answers after the safety rules.

    answers: field, kind (value, runs or modification), value, verdict (high, medium, low or null), hallucinated,
    type_correct, correct_type, value_correct, value_complete, corrected, run_keys (array), paper. The columns
    come back as the rules leave them, with mismatch, match_type and guards, the names of the rules that took effect, in order:

    mismatch_veto: a field that may share a fact with another is no mismatch. reconcile: what is hallucinated or of another
    field is never kept. one_value: a list that holds the value is no fix. runs: a mapping must cover every run.
    unit: the same quantity in another unit is right. regroup: runs move between levels only if the text names them.
    accession: a bare accession stays beside the corrected name. modification: a searched modification of other sites is a
    wrong detail. number: a corrected tolerance, in Da, must be printed. Only a medium verdict keeps a correction.
    """
    high, low, medium = F.lit("high"), F.lit("low"), F.col("verdict") == "medium"
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = answers.withColumn("hallucinated", no("hallucinated")).withColumn("mismatch", F.coalesce(~F.col("type_correct"), F.lit(False)))
    d = d.withColumn("correct_type", F.when(F.col("mismatch"), F.col("correct_type"))).withColumn("guards", F.array().cast("array<string>"))

    def rule(d: DataFrame, name: str, when: Column, then: dict[str, Column]) -> DataFrame:
        d = d.withColumn("__hit", F.coalesce(when, F.lit(False)))
        d = d.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in then.items()})
        return d.withColumn("guards", F.when(F.col("__hit"), F.concat("guards", F.array(F.lit(name)))).otherwise(F.col("guards"))).drop("__hit")

    right = {"verdict": high, "corrected": F.lit(None).cast("string"), "value_correct": F.lit(True), "value_complete": F.lit(True)}
    none = {"corrected": F.lit(None).cast("string")}
    pair = F.array_sort(F.array("field", "correct_type"))
    allowed = F.lit(False)
    for a, b in OVERLAP_PAIRS:
        allowed = allowed | (pair == F.array(*[F.lit(x) for x in sorted((a, b))]))
    d = rule(d, "mismatch_veto", F.col("mismatch") & F.col("correct_type").isNotNull() & allowed, {"mismatch": F.lit(False), "correct_type": F.lit(None).cast("string")})
    bad = F.col("hallucinated") | F.col("mismatch")
    d = rule(d, "reconcile", F.col("verdict").isin("high", "medium") & bad, {"verdict": low})
    d = d.withColumn("value_correct", F.when(bad, False).otherwise(F.coalesce("value_correct", F.col("verdict").isin("high", "medium"), F.lit(False))))
    d = d.withColumn("value_complete", F.when(F.col("hallucinated"), False).otherwise(F.coalesce("value_complete", F.col("verdict") == "high", F.lit(False))))
    d = d.withColumn("corrected", F.when(medium & (X.key("corrected") != X.key("value")), F.col("corrected")))
    fix, value = F.col("corrected"), F.col("value")
    kind = lambda k: F.col("kind") == k
    bare = lambda c: X.key(F.coalesce(X.cell_value(c), c))
    items = F.transform(F.filter(F.split(fix, r"[,;/]|\band\b"), lambda x: F.trim(x) != ""), lambda x: bare(F.trim(x)))
    d = rule(d, "one_value", medium & fix.isNotNull() & kind("value") & F.col("field").isin(*ONE_VALUE_FIELDS) & (F.size(items) > 1) & F.array_contains(items, bare(value)), right)
    # Run mappings: columns of their own, so that later rules read them and don't parse again.
    keys = F.coalesce("run_keys", F.array().cast("array<string>"))
    d = d.withColumn("__new", F.when(kind("runs"), _runs(fix))).withColumn("__old", F.when(kind("runs"), _runs(value)))
    covered = F.forall(keys, lambda k: F.map_contains_key("__new", k)) & (F.size(keys) > 0)
    d = rule(d, "runs", kind("runs") & fix.isNotNull() & ~F.coalesce(covered, F.lit(False)), none)
    old, new = (lambda k: F.try_element_at("__old", k)), (lambda k: F.try_element_at("__new", k))
    kept = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.when(same_quantity(old(k), new(k)), old(k)).otherwise(new(k)))))
    d = d.withColumn("__new", F.when(kind("runs") & fix.isNotNull(), kept))
    unchanged = F.forall(keys, lambda k: X.key(F.coalesce(old(k), F.lit(""))) == X.key(F.coalesce(new(k), F.lit("")))) & (F.size("__old") > 0)
    d = rule(d, "unit", kind("runs") & fix.isNotNull() & unchanged, right)
    d = d.withColumn("corrected", F.when(kind("runs") & fix.isNotNull(), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(" = "), new(k))), " | ")).otherwise(fix))
    paper = F.lower(F.coalesce("paper", F.lit("")))
    moved = F.filter(keys, lambda k: X.key(F.coalesce(old(k), F.lit(""))) != X.key(F.coalesce(new(k), F.lit(""))))
    links = F.array_distinct(F.transform(keys, lambda k: F.struct(X.key(F.coalesce(old(k), F.lit(""))).alias("o"), X.key(F.coalesce(new(k), F.lit(""))).alias("n"))))
    splits = F.size(links) > F.size(F.array_distinct(F.transform(links, lambda x: x["o"])))
    named = F.forall(moved, lambda k: F.contains(paper, F.lower(X.run_stem(k))))
    d = rule(d, "regroup", kind("runs") & F.col("corrected").isNotNull() & F.col("field").isin(*REGROUP_FIELDS) & splits & ~named, none).drop("__new", "__old")
    plain = kind("value") & ~F.col("mismatch")
    printed = quantity_printed(value, F.coalesce("paper", F.lit("")))
    d = rule(d, "unit", plain & (F.col("verdict") == "low") & F.col("hallucinated") & printed, {**right, "hallucinated": F.lit(False)})
    d = rule(d, "unit", plain & medium & same_quantity(value, F.col("corrected")), right)
    accession = r"^[A-Za-z]+[:_]\d+$"
    d = rule(d, "accession", plain & medium & F.trim(value).rlike(accession) & ~keyed(F.col("corrected")) & ~F.trim("corrected").rlike(accession), {"corrected": F.concat(F.lit("NT="), F.trim("corrected"), F.lit(";AC="), F.trim(value))})
    d = d.withColumn("__fixed", F.when(kind("modification") & (F.col("verdict") == "low") & F.col("hallucinated") & ~F.col("mismatch") & keyed(value), modification_of_sites(value, printed_sites(X.cell_value(value), paper))))
    same = X.key("__fixed") == X.key(value)
    d = rule(d, "modification", F.col("__fixed").isNotNull(), {"hallucinated": F.lit(False), "value_correct": same, "value_complete": F.lit(True), "verdict": F.when(same, "high").otherwise("medium"), "corrected": F.when(~same, F.col("__fixed"))}).drop("__fixed")
    tolerance = medium & F.col("corrected").isNotNull() & F.col("field").isin(*TOLERANCE_FIELDS)
    d = d.withColumn("corrected", F.when(F.coalesce(tolerance, F.lit(False)), in_dalton(F.col("corrected"))).otherwise(F.col("corrected")))
    d = rule(d, "unit", tolerance & same_quantity(value, F.col("corrected")), right)
    d = rule(d, "number", tolerance & ~numbers_printed(F.col("corrected"), paper) & ~quantity_printed(F.col("corrected"), F.coalesce("paper", F.lit(""))), {"verdict": low, **none})
    v = F.col("verdict")
    match = F.when(v.isNull(), "ERROR").when(F.col("hallucinated"), "HALLUCINATED").when(F.col("mismatch"), "TYPE_MISMATCH").when(v == "high", "CORRECT").when(v == "medium", "PARTIAL").otherwise("NO_MATCH")
    return d.withColumn("match_type", match)


def sample_sheet_guard(results: DataFrame, cells: DataFrame, ranges: DataFrame, least: int = 5) -> DataFrame:
    """``results`` with values of single samples, which a text can't confirm, as ``unverifiable``.

    results: pxd, field, kind, value, verdict, hallucinated, mismatch, rows (array of row numbers); cells: pxd, field,
    row_idx, cell; ranges: pxd, field, lo, hi, the ranges that the text prints. In order: in a column of ``least`` distinct
    values with a printed range, a number within it is unverifiable and one outside low (``range``); of the
    hallucinated ones, a donor's attribute in rows that all name a cell line (``cell_line``), and a sample's value in a column
    of ``least`` distinct values, or 2 for sex (``sample_sheet``). Adds ``guard``.
    """
    told = cells.filter(~X.is_nullish("cell", "sample"))
    distinct = told.groupBy("pxd", "field").agg(F.countDistinct(X.key("cell")).alias("__n"))
    lines = told.filter(F.col("field") == "cell_line").groupBy("pxd").agg(F.collect_set("row_idx").alias("__lines"))
    span = ranges.groupBy("pxd", "field").agg(F.collect_list(F.struct("lo", "hi")).alias("__ranges"))
    d = results.join(distinct, ["pxd", "field"], "left").join(lines, "pxd", "left").join(span, ["pxd", "field"], "left")
    n = F.coalesce("__n", F.lit(0))
    number = F.regexp_extract("value", r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    open_ = (F.col("kind") == "value") & ~F.coalesce("mismatch", F.lit(False)) & F.col("verdict").isNotNull()
    ranged = open_ & (n >= least) & number.isNotNull() & (F.size("__ranges") > 0)
    inside = F.exists("__ranges", lambda r: (number >= r["lo"]) & (number <= r["hi"]))
    made_up = open_ & (F.col("verdict") == "low") & F.col("hallucinated") & F.col("field").isin(*SAMPLE_FIELDS)
    donor = F.col("field").isin(*DONOR_FIELDS) & (F.size("rows") > 0) & (F.size(F.array_except("rows", "__lines")) == 0)
    many = n >= F.when(F.col("field") == "sex", 2).otherwise(least)
    yes = lambda c: F.coalesce(c, F.lit(False))
    guard = F.when(yes(ranged & inside), "range_inside").when(yes(ranged), "range_outside").when(yes(made_up & donor), "cell_line").when(yes(made_up & many), "sample_sheet")
    d = d.withColumn("guard", guard)
    verdict = F.when(F.col("guard") == "range_outside", "low").when(F.col("guard").isNotNull(), "unverifiable").otherwise(F.col("verdict"))
    return d.withColumn("verdict", verdict).withColumn("hallucinated", F.when(F.col("guard").isNotNull(), False).otherwise(F.col("hallucinated"))).drop("__n", "__lines", "__ranges")


#: Why a recovered value isn't taken, in the order in which it is asked.
REJECTIONS = ("unknown_field", "not_open", "several", "empty", "rejected", "present", "duplicate", "evidence_length", "evidence_absent")


def recovered(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``candidates`` (pxd, seq, field, value, evidence, paper) with ``reason``: the first of REJECTIONS that holds; null for values to verify. ``evidence_check`` tells how a quote that was looked for stands in the paper: verbatim, normalized or absent.

    accepted and rejected: (pxd, field, value) so far. First a candidate's field gets its canonical name of ``fields``, case and
    blanks aside, and the value of a modification is written as a cell, so that it compares with those there. A field
    with an accepted value isn't open, but for modifications, which may have several; of several candidates for
    another field none is taken; of candidates alike the first by seq is. Quotation marks around the evidence are no part of it.
    """
    names = F.create_map(*[F.lit(x) for f in fields for x in (f.lower(), f)])
    candidates = candidates.withColumn("field", F.coalesce(F.try_element_at(names, F.lower(F.trim("field"))), F.trim("field")))
    value, cells = F.trim("value"), modifications(F.trim("value"))
    cell = F.when((F.col("field") == "modification") & ~X.is_nullish("value") & (F.size(cells) == 1), cells[0]).otherwise(value)
    candidates = candidates.withColumn("value", cell).withColumn("evidence", F.trim("evidence"))
    quote = F.trim(F.regexp_replace("evidence", '^"+|"+$', ""))
    norm = X.key(readable(F.col("value")))
    mod = F.col("field") == "modification"
    known = lambda d, name: d.select(F.col("pxd").alias("__p"), F.col("field").alias("__f"), X.key(readable(F.col("value"))).alias("__v")).distinct().withColumn(name, F.lit(True))
    a = accepted.select(F.col("pxd").alias("__p"), F.col("field").alias("__f")).distinct().withColumn("__open", F.lit(False))
    d = candidates.join(a, (F.col("pxd") == F.col("__p")) & (F.col("field") == F.col("__f")), "left").drop("__p", "__f")
    for table, name in ((rejected, "__rejected"), (accepted, "__present")):
        d = d.join(known(table, name), (F.col("pxd") == F.col("__p")) & (F.col("field") == F.col("__f")) & (norm == F.col("__v")), "left").drop("__p", "__f", "__v")
    words = F.size(F.split(F.trim("evidence"), r"\s+"))
    per = F.count(F.lit(1)).over(W.partitionBy("pxd", "field"))
    said = F.coalesce(F.contains("paper", quote) & (quote != ""), F.lit(False))
    found = said | F.coalesce(F.contains(X.key("paper"), X.key(quote)) & (quote != ""), F.lit(False))
    sound = (F.length("evidence") >= 8) & (words <= 60) & F.coalesce(found, F.lit(False)) & ~X.is_nullish("value") & F.col("__rejected").isNull()
    # Only candidates that would be taken count as the first of those alike.
    d = d.withColumn("__norm", X.key("value")).withColumn("__sound", F.coalesce(sound, F.lit(False)))
    before = F.sum(F.col("__sound").cast("int")).over(W.partitionBy("pxd", "field", "__norm").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    conditions = [
        ~F.col("field").isin(*fields) | F.col("field").isNull(), ~mod & F.col("__open").isNotNull(), ~mod & (per > 1), X.is_nullish("value"), F.col("__rejected").isNotNull(),
        mod & F.col("__present").isNotNull(), F.coalesce(before, F.lit(0)) > 0, (F.length("evidence") < 8) | (words > 60) | F.col("evidence").isNull(), ~F.coalesce(found, F.lit(False)),
    ]
    reason = F.lit(None).cast("string")
    for c, name in reversed(list(zip(conditions, REJECTIONS, strict=True))):
        reason = F.when(c, name).otherwise(reason)
    looked = reason.isNull() | (reason == "evidence_absent")
    check = F.when(looked, F.when(said, "verbatim").when(found, "normalized").otherwise("absent"))
    return d.withColumn("reason", reason).withColumn("evidence_check", check).drop("__open", "__rejected", "__present", "__norm", "__sound")


def named_checks(text: Column, names: Sequence[str] = ("HALLUCINATED", "TYPE_CORRECT", "VALUE_CORRECT", "VALUE_COMPLETE")) -> Column:
    """A map of the named checks of an answer and what is said of each; of a repeated one the last."""
    return F.create_map(*[c for n in names for c in (F.lit(n), X.last_answer(text, n))])


#: Answers that name no field.
NO_FIELD = ("NONE", "N/A", "NULL", "SAME", "YES", "NO")


def plain_answer(reason: Column) -> Column:
    """An answer without its markdown: bold and code marks, bullets, headings and quotes."""
    text = F.replace(F.coalesce(reason, F.lit("")), F.lit("\r"), F.lit("\n"))
    for mark in ("**", "__", "`"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.regexp_replace(text, r"(?m)^[ \t]*(?:[-*+]|#+|>)[ \t]+", "")


def corrected_field(reason: Column, own: Column, fields: Sequence[str]) -> Column:
    """The field of ``fields`` that an answer says a value belongs to, other than its own; null if none.

    The last CORRECT_TYPE_NAME at the beginning of a line counts, else the last anywhere; where that names no other field, the first
    of "correct field is ...", then of "belongs in ...", that does, there only as a field is written: with an underscore or a capital.
    """
    text = plain_answer(reason)
    names = F.create_map(*[F.lit(x) for f in fields for x in (f.lower(), f)])
    edge = r"['\"`,.()\[\]:]+"

    def accepted(name: Column, strict: bool = False) -> Column:
        n = F.regexp_replace(F.trim(name), f"^{edge}|{edge}$", "")
        known = F.try_element_at(names, F.lower(n))
        right = F.lower(known) != F.lower(F.coalesce(own, F.lit("")))
        return F.when(right & n.rlike("[_A-Z]") if strict else right, known)

    label = r"CORRECT_TYPE_NAME[ \t]*:[ \t]*(\S+)"
    found = [F.try_element_at(F.regexp_extract_all(text, F.lit(p + label), F.lit(1)), F.lit(-1)) for p in (r"(?im)^[ \t]*", r"(?i)\b")]
    said = F.coalesce(*found)
    said = F.when(~F.upper(F.trim(said)).isin(*NO_FIELD), accepted(said))
    prose = []
    for pattern in (r"(?i)correct\s+(?:field|type)\s+is\s+([A-Za-z][A-Za-z_]+)", r"(?i)belongs\s+(?:in|to)\s+(?:the\s+)?([A-Za-z][A-Za-z_]+)"):
        options = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: accepted(x, True))
        prose.append(F.try_element_at(F.filter(options, lambda x: x.isNotNull()), F.lit(1)))
    return F.coalesce(said, *prose)

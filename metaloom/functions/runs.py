"""What a run's file name says: instrument, acquisition, labels, species, tissue, cell line and more; and cohort predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.text import is_nullish
from metaloom.refdata import BODY_FLUIDS, COLLECTED, RUN_FLUIDS, RUN_LINES, RUN_WORDS, TISSUE_CLASS

# A run's name is read as words: runs of digits, of capitals, or of letters of which only the first may be one. Names of
# the tables below are matched with up to GRAM words in a row, written together in lower case.
WORD = r"\d+|\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{L}+"
GRAM = 5


SEP = "\x01"  # between the words of a name; no word holds it


def _words(name: Column) -> Column:
    """What is read of a name, once for all tables: its words, the words with SEP between and around them, as they are and in lower case, all of them together, and the whole name, the last two in lower case."""
    words = F.regexp_extract_all(name, F.lit(f"({WORD})"), F.lit(1))
    written = F.concat(F.lit(SEP), F.array_join(words, SEP), F.lit(SEP))
    return F.struct(words.alias("words"), written.alias("written"), F.lower(written).alias("folded"), F.lower(F.array_join(words, "")).alias("joined"), F.lower(name).alias("whole"))


def _runs(words: Column) -> Column:
    """All runs of up to GRAM words, written together."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.array_join(F.slice(words, i, n), ""))))


def _holds(g: Column, kind: str, alias: str) -> Column:
    """Whether the words hold an alias: anywhere in the name, or as a run of up to GRAM words."""
    if kind == "anywhere":
        return F.contains(g["whole"], F.lit(alias))
    exact = kind == "as written"
    run = F.array_contains(_runs(g["words"]) if exact else F.transform(_runs(g["words"]), lambda r: F.lower(r)), F.lit(alias))
    if not alias.isascii():
        return run
    # From cheap to dear: the letters stand together; they begin and end with words; where these are too many, another run may do.
    met = F.regexp_extract(g["written" if exact else "folded"], SEP + f"{SEP}?".join(map(re.escape, alias)) + SEP, 0)
    return F.contains(g["joined"], F.lit(alias.lower())) & (met != "") & ((F.length(met) <= len(alias) + GRAM + 1) | run)


def _found(table: list[tuple[str, str, str]], g: Column) -> Column:
    """The canonical names of a table that the words hold, distinct, in the table's order."""
    return F.array_except(F.array(*[F.when(_holds(g, kind, alias), F.lit(canonical)) for canonical, kind, alias in table]), F.array(F.lit(None).cast("string")))


def _of(tables: dict[str, list[tuple[str, str, str]]], name: Column) -> Column:
    """A record with what each of the tables finds in a name, whose words are read once."""
    return F.get(F.transform(F.array(_words(name)), lambda g: F.struct(*[_found(t, g).alias(f) for f, t in tables.items()])), F.lit(0))


def _line_table(lines: list[str]) -> list[tuple[str, str, str]]:
    return [*[(t, "words", "".join(c for c in t.lower() if c.isalnum())) for t in lines], *RUN_LINES]


def hits(name: Column, field: str) -> Column:
    """All canonical names of a field that a run's name holds, distinct, in the order of the table."""
    return _of({field: RUN_WORDS[field]}, name)[field]


def line_hits(name: Column, lines: list[str]) -> Column:
    """Cell lines of a given vocabulary that a run's name holds, however their blanks and hyphens are written."""
    return _of({"line": _line_table(lines)}, name)["line"]


def run_hits(name: Column, lines: list[str] | None = None) -> Column:
    """A record of all fields' names that a run's name holds, and of its cell lines as ``lines``; for ``fields_of``. Kept as a column, it is made once a row."""
    return _of(RUN_WORDS | ({"lines": _line_table(lines)} if lines else {}), name)


def fields_of(found: Column | dict[str, Column], lines: bool = False) -> dict[str, Column]:
    """A column for each field of a record of ``run_hits``: the first name found, or all of them for COLLECTED fields.

    A body fluid beats a solid tissue. A human cell line (of a record with ``lines``) makes the species human, beside another that the name gives.
    """
    out = {f: F.nullif(F.array_join(found[f], "; "), F.lit("")) if f in COLLECTED else F.get(found[f], F.lit(0)) for f in RUN_WORDS}
    out["tissue"] = F.coalesce(F.get(F.filter(found["tissue"], lambda x: x.isin(*RUN_FLUIDS)), F.lit(0)), out["tissue"])
    if lines:
        out["cell_line"] = F.get(found["lines"], F.lit(0))
        human, org = F.lit("Homo sapiens"), out["organism"]
        out["organism"] = F.when(out["cell_line"].isNull(), org).when(org.isNull() | (org == human), human).otherwise(F.concat_ws("; ", org, human))
    return out


def run_fields(name: Column, lines: list[str] | None = None) -> dict[str, Column]:
    """The columns of ``fields_of``, straight from a name. Each reads the name again; over many rows keep ``run_hits`` as a column."""
    return fields_of({f: hits(name, f) for f in RUN_WORDS} | ({"lines": line_hits(name, lines)} if lines else {}), bool(lines))


# ---- cohorts ------------------------------------------------------------------------------------------------------------


def is_human(species: Column) -> Column:
    return F.exists(species, lambda x: F.lower(x).rlike(r"homo sapiens|\bhuman\b"))


def is_culture(values: Column) -> Column:
    return F.exists(values, lambda x: F.lower(x).rlike(r"cell culture|cell line|organoid|stem cell"))


def is_healthy(diseases: Column) -> Column:
    """Every known disease is a word for none."""
    known = F.filter(diseases, lambda x: ~is_nullish(x))
    return (F.size(known) > 0) & F.forall(known, lambda x: F.lower(x).rlike(r"^(?:healthy|normal|control|disease[- ]free)"))


def is_cancer(diseases: Column) -> Column:
    return F.exists(diseases, lambda x: F.lower(x).rlike(r"cancer|carcinoma|tumou?r|neoplasm|leuk[a]?emia|lymphoma|melanoma|sarcoma|glioma|glioblastoma|myeloma"))


def is_fluid(tissue: Column) -> Column:
    """A body fluid by name, or a word for one unless a solid organ is named with it."""
    t = F.lower(F.trim(tissue))
    return t.isin(*BODY_FLUIDS) | (t.rlike(r"\b(?:plasma|serum|urine|blood|saliva|fluid|milk|sweat|tears?)\b") & ~t.rlike(r"gland|vessel|bladder|muscle|node|marrow"))


def tissue_class(tissue: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in TISSUE_CLASS.items() for v in kv])
    return F.try_element_at(table, F.lower(F.trim(tissue)))


def licence_flags(licence: Column, note: Column) -> dict[str, Column]:
    """Whether a licence allows text mining: public domain and attribution ones do, no-derivatives ones and notes against it don't."""
    x = F.lower(F.coalesce(licence, F.lit("")))
    open_ = x.rlike(r"\bcc0\b|public domain|\bcc[ -]by\b") & ~x.rlike(r"\bnd\b")
    return {"open": open_, "minable": open_ & ~F.coalesce(F.lower(note).rlike("no text mining|not permitted"), F.lit(False))}


def relationship(score: Column, note: Column) -> Column:
    """The kind of a pair by words of its note, else by its score."""
    n = F.lower(F.coalesce(note, F.lit("")))
    return (
        F.when(n.rlike(r"same|identical|synonym"), "same").when(n.rlike(r"part of|within|region"), "part").when(n.rlike(r"kind of|subtype|is a"), "kind")
        .when(score >= 0.7, "near").when(score >= 0.35, "distant").otherwise("unrelated")
    )

"""Negation by scope: which spans of a sentence its triggers negate, and fields whose evidence negates their value."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the published negation algorithm for English. Those of PSEUDO look like triggers and negate nothing.
PSEUDO = (
    "not only|not just|not merely|not simply|not necessarily|not certain if|not certain whether|no increase|no change|no significant change|no suspicious change|"
    "no further|without difficulty|without further|without any further|not cause|not extend|not drain|not limited to|no doubt|no wonder|not to mention|if not"
).split("|")
BEFORE = (
    "no|not|n't|without|never|neither|nor|none of|no evidence of|no signs of|no sign of|absence of|lack of|lacks|lacked|lacking|lacked any|cannot|can not|could not|did not|does not|do not|"
    "was not|were not|is not|are not|has not|have not|had not|free of|excluding|excluded|exclude|excludes|except|except for|denies|denied|denying|deny|rules out|ruled out|rule out|"
    "failed to|fails to|fail to|failure to|instead of|rather than|in the absence of|devoid of|no longer|negative for|unable to|other than"
).split("|")
AFTER = [f"{be} {w}" for be in ("was", "were", "is", "are", "be", "been") for w in ("ruled out", "absent", "excluded", "omitted", "lacking", "unavailable", "negative", "declined", "unlikely")]
AFTER += [f"{be}not {w}" for be in ("was ", "were ", "is ", "are ", "") for w in "applied carried collected considered detected done employed found included observed performed present seen used".split()]
ENDS = (
    "but|however|nevertheless|yet|though|although|still|aside from|apart from|because|since|therefore|whereas|while|which|who|that|where|when|secondary to|due to|cause of|cause for|causes for|"
    "causes of|reason for|reasons for|source of|sources of|origin of|origins for|trigger event for|as there are|other possibilities of|then|so that|instead|and used|and we|and was|and were"
).split("|")
# Values that say that something is absent, and so are borne out by a negation.
ABSENT = ("unknown", "label-free", "none", "n/a")

_TOKEN = re.compile(r"[^\W_]+?(?=n['’]t\b)|n['’]t\b|[^\W_]+(?:[-_][^\W_]+)*|[^\w\s]")
_STOP = re.compile(r"[.!?]+(?=\s+[^a-z\s]|\s*$)|[\r\n]+|;")


@lru_cache(2)
def _trie(pseudo: bool) -> dict:
    """The phrases word by word; under the empty word the kind of a phrase that ends there. A phrase of two kinds is of the later one."""
    root: dict = {}
    for kind, phrases in (("pseudo", PSEUDO),) if pseudo else (("end", ENDS), ("before", BEFORE), ("after", AFTER)):
        for p in phrases:
            node = root
            for w in p.split():
                node = node.setdefault(w, {})
            node[""] = kind
    return root


def _longest(node: dict, words: list, i: int, hidden: list[bool] | None = None) -> tuple[str | None, int]:
    """The kind of the longest phrase that begins at word i and the word after it."""
    kind, last, k = None, i, i
    while k < len(words) and not (hidden and hidden[k]) and (node := node.get(words[k][0])) is not None:
        k += 1
        if "" in node:
            kind, last = node[""], k
    return kind, last


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of a text: a stop ends one before white space and what is no small letter; line ends and semicolons always do."""
    start = 0
    for m in _STOP.finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def scopes(sentence: str) -> list[tuple[int, int, str]]:
    """(start, end, trigger) of the spans that a sentence's triggers negate, in characters.

    A scope automaton reads the words from left to right and takes the longest phrase that begins at each. A trigger of
    BEFORE opens a scope to the right, which the next phrase of ENDS, or the sentence's end, closes; a trigger of AFTER
    negates what stands between the last such phrase, or the sentence's beginning, and itself; a phrase of PSEUDO does
    nothing and hides the words within it from all others. Contractions count as "not".
    """
    words = [(m.group().lower().replace("’", "'"), m.start(), m.end()) for m in _TOKEN.finditer(sentence)]
    hidden, i = [False] * len(words), 0
    while i < len(words):
        kind, last = _longest(_trie(True), words, i)
        if kind:
            hidden[i:last] = [True] * (last - i)
        i = max(last, i + 1)
    out: list[tuple[int, int, str]] = []
    open_: list[tuple[int, str]] = []
    left = i = 0
    while i < len(words):
        kind, last = _longest(_trie(False), words, i, hidden)
        if kind is None:
            i += 1
            continue
        begin, end = words[i][1], words[last - 1][2]
        phrase = sentence[begin:end].lower()
        if kind == "before":
            open_.append((end, phrase))
        elif kind == "after":
            out.append((left, begin, phrase))
        else:
            out += [(s, begin, t) for s, t in open_]
            open_, left = [], end
        i = last
    out += [(s, len(sentence), t) for s, t in open_]
    return sorted(out)


def trigger(value: str | None, evidence: str | None) -> str | None:
    """The trigger in whose scope the first mention of ``value`` in ``evidence`` stands, case aside; null if none, or if there is no mention."""
    if not value or not evidence or not value.strip():
        return None
    m = re.search(re.escape(value.strip()), evidence, re.IGNORECASE)
    if m is None:
        return None
    for start, end in sentences(evidence):
        if start <= m.start() < end:
            at, to = m.start() - start, min(m.end(), end) - start
            return next((t for s, e, t in scopes(evidence[start:end]) if s <= at and to <= e), None)
    return None


def negating(value: Column, evidence: Column) -> Column:
    """``trigger`` of columns, on Arrow batches."""

    def run(value: pd.Series, evidence: pd.Series) -> pd.Series:
        return pd.Series([trigger(v, e) for v, e in zip(value, evidence, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(value.cast("string"), evidence.cast("string"))


def negated(value: Column, evidence: Column) -> Column:
    """Whether the evidence negates the value, by scope."""
    return negating(value, evidence).isNotNull()


def flags(fields: DataFrame) -> DataFrame:
    """Rows of ``fields`` (field, value, evidence and keys) whose evidence negates the value, with type 'negated_evidence' and the trigger.

    Fields whose name begins with an underscore, values of ABSENT, null or empty values and evidence, and evidence that
    says "inferred: " are left alone. Only rows that hold the value and a possible trigger reach Python.
    """
    value, evidence = F.col("value"), F.col("evidence")
    wanted = ~F.col("field").startswith("_") & ~F.lower(F.trim(value)).isin(*ABSENT) & (F.trim(value) != "") & ~F.lower(evidence).startswith("inferred: ")
    first = sorted({p.split()[0] for p in (*BEFORE, *AFTER)} | {"n't"})
    likely = F.contains(F.lower(evidence), F.lower(F.trim(value))) & F.replace(F.lower(evidence), F.lit("’"), F.lit("'")).rlike("|".join(first))
    found = fields.filter(wanted & likely).withColumn("trigger", negating(value, evidence))
    return found.filter(F.col("trigger").isNotNull()).withColumn("type", F.lit("negated_evidence"))

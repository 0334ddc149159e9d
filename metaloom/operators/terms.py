"""Terms to nodes from end to end: aliases of modifications, exact lookup, and the nearest name by embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.text import key
from metaloom.operators import matching as V
from metaloom.operators import normalisation as N
from metaloom.operators import ontology as O
from metaloom.refdata import MODIFICATION_ALIASES
from metaloom.session import kept

EMBEDDED = 1 << 13  # texts that one task embeds


def modification_nodes(terms: DataFrame, names: DataFrame, prefix: str = "UNIMOD:") -> DataFrame:
    """(term, node): nodes of one namespace whose name a term is, or is another word for; only names of one node."""
    word = F.create_map(*[F.lit(x) for kv in MODIFICATION_ALIASES.items() for x in kv])
    k = F.coalesce(F.try_element_at(word, key("term")), key("term"))
    own = names.filter(F.col("node").startswith(prefix)).groupBy(key("name").alias("__k")).agg(F.min("node").alias("node"), F.countDistinct("node").alias("__n")).filter("__n = 1")
    return terms.select("term").distinct().withColumn("__k", k).join(own, "__k").select("term", "node")


def neighbours(terms: DataFrame, names: DataFrame, embed: Callable[[DataFrame], DataFrame] = V.hashed_ngrams, k: int = 1) -> DataFrame:
    """(term, node, name, similarity): the ``k`` nearest of ``names`` (node, name) to each term, by cosine of what ``embed`` makes of distinct texts (term) -> (term, vec).

    Each text of both sides is embedded once; the search is exact and goes block by block.
    """
    known = names.select(F.col("name").alias("term")).filter("term is not null").distinct()
    v = kept(embed(known).select("term", "vec", F.xxhash64("term").alias("id")))
    own = F.xxhash64("term", F.lit("term")).alias("id")
    t = kept(terms.select("term").filter("term is not null").distinct().select("term", own))
    rows = t.count()
    # The terms' vectors are wide: they are made where they are sent from, once, and not kept. Short texts are work too, so they are dealt by number, not by size.
    fresh = t.select("term").join(known, "term", "left_anti").repartition(max(1, -(-rows // EMBEDDED)), "term")
    q = embed(fresh).select(own, "vec").unionAll(v.join(t.select("term"), "term", "left_semi").select(own, "vec"))
    near = V.knn(q, v.select("id", "vec"), k, rows=rows)
    found = near.join(v.select("id", F.col("term").alias("name")), "id").join(t.select(F.col("id").alias("q"), "term"), "q")
    return found.join(names.select("node", "name").distinct(), "name").select("term", "node", "name", F.col("cosine").alias("similarity"))


def normalised(items: DataFrame, names: DataFrame, synonyms: DataFrame, expansions: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = V.hashed_ngrams, least: float = 0.70, prefix: str | None = None) -> DataFrame:
    """``items`` (term and keys) with node, method and similarity, each item in its place, each distinct term resolved once.

    names: (node, name); synonyms: (node, synonym, scope); expansions: (term, expanded). In order: a modification by its name
    or another word for it (``unimod``); a unique name or synonym (``exact``, ``exact_synonym``, ``related_synonym``); the nearest
    name or exact synonym to the term, or to its expanded form where that is strictly nearer, from ``least`` on
    (``semantic``). An ambiguous name is not guessed at. Only terms that neither of the first two knows are embedded.
    """
    terms = items.select("term").filter("term is not null").distinct()
    mods = modification_nodes(terms, names)
    lexical = kept(O.resolve(terms, names, synonyms, prefix))
    open_ = lexical.filter("status = 'unresolved'").select("term").join(mods.select("term"), "term", "left_anti")
    known = names.select("node", "name").unionAll(synonyms.filter("scope = 'EXACT'").select("node", F.col("synonym")))
    if prefix:
        known = known.filter(F.col("node").startswith(prefix))
    own = open_.select("term", F.col("term").alias("__text"), F.lit(False).alias("expanded"))
    if expansions is not None:
        own = own.unionAll(open_.join(expansions.select("term", "expanded"), "term").select("term", "expanded", F.lit(True)))
    own = kept(own)
    near = neighbours(own.select(F.col("__text").alias("term")), known, embed).withColumnRenamed("term", "__text")
    near = own.join(near, "__text").withColumn("entity", F.lit(""))
    best = N.nearest_names(near, least).select("term", "node", "similarity")
    found = V.normalise(terms, lexical, best, mods, least)
    return items.join(found, "term", "left").withColumn("method", F.coalesce("method", F.lit("unmapped")))

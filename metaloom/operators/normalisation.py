"""Normalisation of values by entity type, forced names, cell lines, consistency between fields, and graded agreement.

Items are rows (id, field, seq, value); each entity type has its own names. A batch of any size is one plan of joins: a
value that no tier knows keeps a null name, so a type without names fails none of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X


def lines_matched(items: DataFrame, lines: DataFrame) -> DataFrame:
    """``items`` (value, ...) with ``line``: the canonical cell line of the same key. lines: (place, canonical, alias); of several canonical names of a key the first by place wins."""
    first = lines.groupBy(X.line_key("alias").alias("__k")).agg(F.min_by("canonical", "place").alias("line"))
    return items.join(first, X.line_key("value") == F.col("__k"), "left").drop("__k")


def forced(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """``items`` (entity, name, ...) with names replaced by forced ones. overrides: (entity, source, target), sources without case, of equal ones the first target."""
    o = overrides.groupBy(F.col("entity").alias("__e"), F.lower("source").alias("__s")).agg(F.min("target").alias("__target"))
    j = items.join(o, (F.col("entity") == F.col("__e")) & (F.lower("name") == F.col("__s")), "left")
    return j.withColumn("forced", F.col("__target").isNotNull() & (F.col("__target") != F.col("name"))).withColumn("name", F.coalesce("__target", "name")).drop("__e", "__s", "__target")


def nearest_names(neighbours: DataFrame, least: float = 0.70) -> DataFrame:
    """(entity, term, node, name, similarity, expanded): the most similar name of each term or of its expanded form.

    neighbours: (entity, term, expanded boolean, node, name, similarity). The expanded form wins only where it is strictly
    better; of equal names the smallest node. Below ``least`` nothing is near.
    """
    best = F.max_by(F.struct("node", "name", "similarity", "expanded"), F.struct("similarity", (~F.col("expanded")).alias("own"), F.struct(F.lit(0)))).alias("b")
    # Ties between nodes go to the smallest: they are settled before.
    per = neighbours.groupBy("entity", "term", "expanded", "similarity").agg(F.min(F.struct("node", "name")).alias("n")).select("entity", "term", "expanded", "similarity", "n.node", "n.name")
    return per.groupBy("entity", "term").agg(best).select("entity", "term", "b.*").filter(F.col("similarity") >= least)


def normalised(items: DataFrame, router: DataFrame, names: DataFrame, synonyms: DataFrame, neighbours: DataFrame, overrides: DataFrame, lines: DataFrame) -> DataFrame:
    """``items`` (id, field, seq, value) with entity, node, name, similarity and status.

    router: (field, entity), a field without a type stays ``unrouted``; names: (entity, node, name); synonyms: (entity, node,
    synonym, scope). In order: a cell line by its key (``exact_match``), a unique primary name, a unique exact synonym,
    the nearest name (``mapped``); a forced name makes it ``post_mapped``; an ambiguous name is not guessed at; else
    ``unmapped``. Each distinct (entity, value) is resolved once, whatever the number of items.
    """
    d = items.join(router, "field", "left")
    terms = d.filter("entity is not null").select("entity", F.col("value").alias("term"), X.key("value").alias("k")).distinct()
    ranked = names.select("entity", "node", X.key("name").alias("k"), F.lit(1).alias("rank")).unionAll(synonyms.filter("scope = 'EXACT'").select("entity", "node", X.key("synonym").alias("k"), F.lit(2)))
    per = ranked.distinct().groupBy("entity", "k", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    best = per.groupBy("entity", "k").agg(F.min(F.struct("rank", "n", "node")).alias("b"))
    primary = names.groupBy("entity", "node").agg(F.min("name").alias("own"))
    found = terms.join(best, ["entity", "k"], "left").withColumn("lexical", F.when(F.col("b.n") == 1, F.col("b.node"))).withColumn("ambiguous", F.coalesce(F.col("b.n") > 1, F.lit(False)))
    found = found.join(primary.select(F.col("entity").alias("__e"), F.col("node").alias("__n"), "own"), (F.col("entity") == F.col("__e")) & (F.col("lexical") == F.col("__n")), "left").drop("__e", "__n")
    near = nearest_names(neighbours).select("entity", "term", F.col("node").alias("near"), F.col("name").alias("near_name"), "similarity")
    found = lines_matched(found.join(near, ["entity", "term"], "left").withColumn("value", F.col("term")), lines)
    line = F.when(F.col("entity") == "cell_line", F.col("line"))
    semantic = ~F.col("ambiguous") & F.col("lexical").isNull() & F.col("near").isNotNull() & (F.col("entity") != "cell_line")
    found = found.select(
        "entity", "term",
        F.coalesce("lexical", F.when(semantic, F.col("near"))).alias("node"),
        F.coalesce(line, F.when(F.col("lexical").isNotNull(), F.col("own")), F.when(semantic, F.col("near_name"))).alias("name"),
        F.when(line.isNotNull() | F.col("lexical").isNotNull(), 1.0).otherwise(F.when(semantic, F.round("similarity", 4))).alias("similarity"),
        F.when(line.isNotNull(), "exact_match").when(F.col("lexical").isNotNull() | semantic, "mapped").when(F.col("ambiguous"), "ambiguous").otherwise("unmapped").alias("status"),
    )
    found = forced(found, overrides).withColumn("status", F.when(F.col("forced"), "post_mapped").otherwise(F.col("status"))).drop("forced")
    out = d.join(found.withColumnRenamed("entity", "__e").withColumnRenamed("term", "__t"), (F.col("entity") == F.col("__e")) & (F.col("value") == F.col("__t")), "left").drop("__e", "__t")
    return out.withColumn("status", F.when(F.col("entity").isNull(), "unrouted").otherwise(F.coalesce("status", F.lit("unmapped"))))


def normalised_cells(cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """``cells`` (id, field, cell) with ``norm``: the names of its ';'-separated parts in order, unmapped parts dropped, null if none is left. resolved: (field, value, name)."""
    parts = cells.select("id", "field", F.posexplode(F.split("cell", ";")).alias("seq", "value")).withColumn("value", F.trim("value")).filter("value <> ''")
    hit = parts.join(resolved.select("field", "value", "name"), ["field", "value"]).filter("name is not null")
    norm = hit.groupBy("id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), "; ").alias("norm"))
    return cells.join(norm, ["id", "field"], "left")


def disambiguated(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One candidate (by..., place, node, name, similarity, context) of each term: the first whose name is the context, else the first."""
    same = F.coalesce(X.key("name") == X.key("context"), F.lit(False))
    first = F.min(F.struct((~same).alias("other"), "place", "node", "name", "similarity")).alias("b")
    return candidates.groupBy(*by).agg(first).select(*by, "b.node", "b.name", "b.similarity")


def inconsistencies(records: DataFrame, line_facts: DataFrame, disease_tissue: DataFrame, cell_tissue: DataFrame) -> DataFrame:
    """(id, type, a, b, expected) of records whose fields contradict one another.

    records: id and, for line, species, tissue, disease and cell_type, a value and an id (``line``, ``line_id`` ...).
    line_facts: (line_id, name, species, tissue) with arrays; a line without an id is found by its name. The other
    tables: (node, tissue_id), several rows to a node. Unknown values and nodes without expectations are no contradiction.
    """
    known = lambda c: ~X.is_nullish(c, "checker")
    by_name = line_facts.groupBy(X.key("name").alias("__k")).agg(F.min("line_id").alias("__by_name"))
    d = records.join(by_name, X.key("line") == F.col("__k"), "left").drop("__k")
    d = d.withColumn("__line", F.when(known("line"), F.coalesce(X.curie("line_id"), "__by_name")))
    facts = line_facts.groupBy(F.col("line_id").alias("__l")).agg(F.first("species").alias("__species"), F.first("tissue").alias("__tissue"))
    d = d.join(facts, F.col("__line") == F.col("__l"), "left")

    def expected(name: str, table: DataFrame, node: str) -> None:
        nonlocal d
        e = table.groupBy(X.curie("node").alias("__n")).agg(F.array_sort(F.collect_set(X.curie("tissue_id"))).alias(name))
        d = d.join(e, X.curie(node) == F.col("__n"), "left").drop("__n")

    expected("__of_disease", disease_tissue, "disease_id")
    expected("__of_cell", cell_tissue, "cell_type_id")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    foreign = lambda c, xs: ~F.coalesce(F.array_contains(xs, c), F.lit(False))
    flags = [
        ("line_species_mismatch", known("species") & some("__species") & foreign(X.key("species"), F.transform("__species", lambda x: X.key(x))), "line", "species", F.col("__species")),
        ("line_tissue_mismatch", known("tissue") & F.col("tissue_id").isNotNull() & some("__tissue") & foreign(X.curie("tissue_id"), F.transform("__tissue", lambda x: X.curie(x))), "line", "tissue", F.col("__tissue")),
        ("disease_tissue_mismatch", known("disease") & known("tissue") & F.col("tissue_id").isNotNull() & some("__of_disease") & foreign(X.curie("tissue_id"), F.col("__of_disease")), "disease", "tissue", F.col("__of_disease")),
        ("cell_type_tissue_mismatch", known("cell_type") & known("tissue") & F.col("tissue_id").isNotNull() & some("__of_cell") & foreign(X.curie("tissue_id"), F.col("__of_cell")), "cell_type", "tissue", F.col("__of_cell")),
    ]
    row = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("type"), F.col(a).alias("a"), F.col(b).alias("b"), F.array_join(e, ", ").alias("expected"))) for n, c, a, b, e in flags])
    return d.select("id", F.explode(F.filter(row, lambda x: x.isNotNull())).alias("f")).select("id", "f.*")


def concordance(runs: DataFrame, scores: DataFrame, classes: DataFrame) -> DataFrame:
    """``runs`` (id, given, predicted) with exact, in_vocabulary, lin, hops and tier.

    ``given`` is ';'-separated; scores: (given, predicted, lin, hops) of single values, lower case, for resolved pairs; classes:
    (name). The best Lin and the fewest hops over the parts count, each on its own. Tiers: exact; near from Lin .70 or within
    2; distant from .35 or within 4; conflict; unconnected where nothing joins them.
    """
    p = F.lower(F.trim("predicted"))
    parts = runs.select("id", p.alias("predicted"), F.explode(X.split_set("given")).alias("given"))
    vocabulary = classes.select(X.key("name").alias("given")).distinct().withColumn("__in", F.lit(1))
    j = parts.join(scores, ["given", "predicted"], "left").join(vocabulary, "given", "left")
    g = j.groupBy("id").agg(F.max((F.col("given") == F.col("predicted")).cast("int")).alias("e"), F.max(F.coalesce("__in", F.lit(0))).alias("v"), F.max("lin").alias("l"), F.min("hops").alias("h"))
    d = runs.join(g.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")
    exact = F.coalesce(F.col("e") == 1, F.lit(False))
    best = F.coalesce("l", F.lit(0.0))
    tier = F.when(exact, "exact").when((best >= 0.70) | (F.col("h") <= 2), "near").when((best >= 0.35) | (F.col("h") <= 4), "distant").when((best > 0) | F.col("h").isNotNull(), "conflict").otherwise("unconnected")
    return d.select(*runs.columns, exact.alias("exact"), F.coalesce(F.col("v") == 1, F.lit(False)).alias("in_vocabulary"), F.when(exact, 1.0).otherwise(best).alias("lin"), F.when(exact, 0).otherwise(F.col("h")).alias("hops"), tier.alias("tier"))


def graded(golden: DataFrame, predicted: DataFrame, scores: DataFrame, resolvable: DataFrame) -> DataFrame:
    """(id, score): over an id's golden values the mean of the best score against its predicted ones.

    golden, predicted: (id, value); scores: (a, b, score); resolvable: (value). Golden values that no graph knows are left
    out, an id without any other has none; a predicted value that is missing or unknown scores 0.
    """
    g = golden.select("id", F.col("value").alias("a")).distinct().join(resolvable.select(F.col("value").alias("a")).distinct(), "a", "left_semi")
    j = g.join(predicted.select("id", F.col("value").alias("b")).distinct(), "id", "left").join(scores.select("a", "b", "score"), ["a", "b"], "left")
    s = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return j.groupBy("id", "a").agg(F.max(s).alias("best")).groupBy("id").agg(F.avg("best").alias("score"))


def graph_ic(pairs: DataFrame, whole: DataFrame, ti: DataFrame) -> DataFrame:
    """(a, b, ti_mica, graph_ic): twice the topological information of the best common ancestor over the sum of both, within 0 and 1; 1 for one node."""
    x = whole.select(F.col("node").alias("a"), "ancestor")
    y = whole.select(F.col("node").alias("b"), "ancestor")
    t = ti.select("node", "ti")
    common = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "ancestor"]).join(t.select(F.col("node").alias("ancestor"), "ti"), "ancestor")
    best = common.groupBy("a", "b").agg(F.max("ti").alias("top"), F.min(F.struct((-F.col("ti")).alias("m"), "ancestor")).alias("m"))
    side = lambda p: t.select(F.col("node").alias(p), F.col("ti").alias(f"ti_{p}"))
    j = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").join(best, ["a", "b"], "left")
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), M.ratio_or(2 * F.col("top"), F.col("ti_a") + F.col("ti_b"))))
    return j.select("a", "b", F.col("m.ancestor").alias("ti_mica"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(s, F.lit(0.0))).alias("graph_ic"))


def information_jaccard(pairs: DataFrame, whole: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, jaccard_ic): the information of the common ancestors over that of all of either."""
    w = whole.join(ic.select(F.col("node").alias("ancestor"), "ic"), "ancestor")
    total = w.groupBy("node").agg(F.sum("ic").alias("s"))
    shared = pairs.select("a", "b").distinct().join(w.select(F.col("node").alias("a"), "ancestor", "ic"), "a").join(whole.select(F.col("node").alias("b"), "ancestor"), ["b", "ancestor"]).groupBy("a", "b").agg(F.sum("ic").alias("x"))
    side = lambda p: total.select(F.col("node").alias(p), F.col("s").alias(f"s_{p}"))
    j = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").join(shared, ["a", "b"], "left")
    x = F.coalesce("x", F.lit(0.0))
    return j.select("a", "b", M.ratio_or(x, F.col("s_a") + F.col("s_b") - x).alias("jaccard_ic"))


def rank_of_tiers(df: DataFrame, by: list[str], score: Column, tiers: list[tuple[str, float]]) -> DataFrame:
    """``df`` with ``tier``: the first of (name, least) that the score reaches; and ``rank`` within its group by falling score."""
    tier = F.lit("none")
    for name, least in reversed(tiers):
        tier = F.when(score >= least, name).otherwise(tier)
    return df.withColumn("tier", tier).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(score.desc(), *df.columns)))

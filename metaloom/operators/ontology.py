"""Graphs of terms: closures, information content, similarities, and resolution of names.

Edges are (child, parent); closures (node, ancestor, hops), hops at least 1 unless ``own`` adds each node at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions.text import key
from metaloom.operators import ancestry
from metaloom.session import kept, unsent


def closure(edges: DataFrame, levels: int | None = None, most: int = 64) -> DataFrame:
    """All ancestors of each node with the fewest hops to them.

    With ``levels``, ancestors within so many hops, as one lazy plan. Without, tasks that hold the graph walk up from their
    nodes (see ancestry.closure); of graphs that it leaves, levels are added until there are no new
    pairs; each new level is checkpointed, so nothing is walked twice. Diamonds give one row, and cycles end.
    A graph of more than ``most`` levels raises an error: no closure is given in part.
    """
    e = edges.select(F.col("child"), F.col("parent")).filter("child is not null and parent is not null and child <> parent").distinct()
    if levels is None:
        e = kept(e)
        if (walked := ancestry.closure(e, most)) is not None:
            return walked
    level = e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    side = unsent if levels is None else lambda x: x
    found = level
    for h in range(2, (levels or most) + 1):
        step = level.join(side(e), F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(h).alias("hops")).filter("node <> ancestor").distinct()
        step = step.join(side(found.select("node", "ancestor")), ["node", "ancestor"], "left_anti")
        if levels is None:
            step = kept(step)
            if step.isEmpty():
                break
        found, level = found.unionAll(step), step
    else:
        if levels is None:
            raise RuntimeError(f"more than {most} levels")
    return found


def own(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """The closure with each node its own ancestor at 0 hops."""
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops")).unionAll(closed)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).unionAll(edges.select("parent")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def descendants(closed: DataFrame) -> DataFrame:
    """(node, n_desc) for all nodes with descendants."""
    return closed.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_desc"))


def information_content(nodes: DataFrame, closed: DataFrame, variant: str = "plus_one") -> DataFrame:
    """(node, n_desc, ic). ``plus_one``: -log2((d + 1) / (N + 1)); ``plain``: -log2((d + 1) / N); ``ratio``: (log2 N - log2 (d + 1)) / log2 N."""
    n = nodes.agg(F.count(F.lit(1)).alias("total"))
    d = F.col("n_desc") + 1
    ic = {"plus_one": -F.log2(d / (F.col("total") + 1)), "plain": -F.log2(d / F.col("total")), "ratio": M.ratio_or(F.log2(F.col("total")) - F.log2(d), F.log2(F.col("total")))}[variant]
    filled = nodes.join(descendants(closed), "node", "left").withColumn("n_desc", F.coalesce("n_desc", F.lit(0)))
    return filled.crossJoin(F.broadcast(n)).select("node", "n_desc", ic.alias("ic"))  # the total is one row


def corpus_counts(nodes: DataFrame, closed: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, total): the counts (node, n) of each node and all its descendants."""
    return own(nodes, closed).join(counts.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")).groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("total"))


def corpus_ic(nodes: DataFrame, closed: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, total, ic): -log2((count + 1) / (N + V)), as a share of its maximum; N all counts, V the number of nodes."""
    totals = nodes.join(corpus_counts(nodes, closed, counts), "node", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    whole = counts.agg(F.sum("n").alias("all")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("v")))
    raw = totals.crossJoin(F.broadcast(whole)).withColumn("raw", -F.log2((F.col("total") + 1) / (F.col("all") + F.col("v"))))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("node", "total", M.ratio_or(F.col("raw"), F.col("top")).alias("ic"))


def depths(nodes: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, depth, max_depth): the fewest edges to a root, and the most levels from one; 0 and 1 for roots."""
    top = roots(edges).withColumnRenamed("node", "ancestor")
    to_root = closed.join(top, "ancestor").groupBy("node").agg(F.min("hops").alias("depth"), (F.max("hops") + 1).alias("max_depth"))
    return nodes.join(to_root, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("max_depth", F.lit(1)).alias("max_depth"))


def common_ancestors(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, ancestor, hops_a, hops_b) for each common ancestor of the given pairs, the nodes themselves among them. Only listed pairs are joined."""
    x = whole.select(F.col("node").alias("a"), "ancestor", F.col("hops").alias("hops_a"))
    y = whole.select(F.col("node").alias("b"), "ancestor", F.col("hops").alias("hops_b"))
    return pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "ancestor"]).select("a", "b", "ancestor", "hops_a", "hops_b")


def lowest_common(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, lca, hops_a, hops_b): the common ancestor nearest to b, then to a, then first by name."""
    best = F.min(F.struct("hops_b", "hops_a", "ancestor")).alias("m")
    return common_ancestors(pairs, whole).groupBy("a", "b").agg(best).select("a", "b", F.col("m.ancestor").alias("lca"), F.col("m.hops_a").alias("hops_a"), F.col("m.hops_b").alias("hops_b"))


METRICS = ("mica", "lin", "resnik", "jc", "wu_palmer", "jaccard", "hops")


def pair_metrics(pairs: DataFrame, whole: DataFrame, ic: DataFrame, depth: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Similarities of each pair from one join of the closure with itself.

    Columns: a, b and the ``metrics`` asked for: mica (the common ancestor of most information, ties by name), lin, resnik
    (of the greatest IC), jc (Jiang-Conrath distance), wu_palmer, jaccard (of the ancestor sets), hops (the shortest way
    over a common ancestor). Only the tables that those need are joined. Pairs without a common ancestor have lin, resnik,
    wu_palmer and jaccard 0, and null mica, jc and hops.
    """
    wanted = set(metrics)
    by_ic, by_depth, by_size = bool(wanted & {"mica", "lin", "resnik", "jc"}), "wu_palmer" in wanted, "jaccard" in wanted
    info, best = common_ancestors(pairs, whole), [F.min(F.col("hops_a") + F.col("hops_b")).alias("hops"), F.count(F.lit(1)).alias("shared")]
    facts = []
    if by_ic:
        info = info.join(ic.select(F.col("node").alias("ancestor"), F.col("ic").alias("ic_c")), "ancestor")
        best += [F.min(F.struct((-F.col("ic_c")).alias("minus"), F.col("ancestor"))).alias("m"), F.max("ic_c").alias("ic_c")]
        facts.append(ic.select("node", "ic"))
    if by_depth:
        info = info.join(depth.select(F.col("node").alias("ancestor"), F.col("depth").alias("depth_c")), "ancestor")
        best.append(F.max("depth_c").alias("depth_c"))
        facts.append(depth.select("node", "depth"))
    if by_size:
        facts.append(whole.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    j = pairs.select("a", "b").distinct().join(info.groupBy("a", "b").agg(*best), ["a", "b"], "left")
    if facts:
        known = facts[0]
        for f in facts[1:]:
            known = known.join(f, "node")
        for p in "ab":
            j = j.join(known.select(F.col("node").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in known.columns if c != "node"]), p)
    if wanted & {"resnik", "jc"}:
        j = j.crossJoin(F.broadcast(ic.agg(F.max("ic").alias("ic_top"))))  # one row
    zero = F.lit(0.0)
    c = F.col
    forms = {
        "mica": lambda: c("m.ancestor"),
        "lin": lambda: F.when(c("a") == c("b"), 1.0).otherwise(F.coalesce(M.lin(c("ic_a"), c("ic_b"), c("ic_c")), zero)),
        "resnik": lambda: F.coalesce(M.ratio_or(c("ic_c"), c("ic_top")), zero),
        "jc": lambda: M.jiang_conrath(c("ic_a") / c("ic_top"), c("ic_b") / c("ic_top"), c("ic_c") / c("ic_top")),
        "wu_palmer": lambda: F.coalesce(M.ratio_or(2 * c("depth_c"), c("depth_a") + c("depth_b"), None), F.when(c("a") == c("b"), 1.0).otherwise(0.0)),
        "jaccard": lambda: F.coalesce(c("shared") / (c("n_a") + c("n_b") - c("shared")), zero),
        "hops": lambda: c("hops"),
    }
    return j.select("a", "b", *[forms[m]().alias(m) for m in METRICS if m in wanted])


def go_universal(pairs: DataFrame, whole: DataFrame, ti: DataFrame) -> DataFrame:
    """(a, b, similarity): the topological information of the common ancestors over that of all."""
    weight = ti.withColumnRenamed("node", "ancestor")
    shared = common_ancestors(pairs, whole).join(weight, "ancestor").groupBy("a", "b").agg(F.sum("ti").alias("shared"))
    total = whole.join(weight, "ancestor").groupBy("node").agg(F.sum("ti").alias("t"))
    j = pairs.select("a", "b").distinct().join(total.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(shared, ["a", "b"], "left")
    s = F.coalesce("shared", F.lit(0.0))
    return j.select("a", "b", M.ratio_or(s, F.col("ta") + F.col("tb") - s).alias("similarity"))


def resolve(terms: DataFrame, names: DataFrame, synonyms: DataFrame, prefix: str | None = None) -> DataFrame:
    """(term, node, status, candidates) by exact lookup of keys.

    A unique primary name is ``exact``; of none, a unique EXACT synonym is ``exact_synonym``, and of none, a unique other
    synonym ``related_synonym``. Several nodes of one rank are ``ambiguous`` (no node); nothing is ``unresolved``. names:
    (node, name); synonyms: (node, synonym, scope). ``prefix`` keeps nodes of one namespace.
    """
    ranked = names.select("node", key("name").alias("k"), F.lit(1).alias("rank")).unionAll(synonyms.select("node", key("synonym").alias("k"), F.when(F.col("scope") == "EXACT", 2).otherwise(3).alias("rank")))
    if prefix:
        ranked = ranked.filter(F.col("node").startswith(prefix))
    per = ranked.distinct().groupBy("k", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    best = per.groupBy("k").agg(F.min(F.struct("rank", "n", "node")).alias("b"))
    j = terms.select("term").distinct().withColumn("k", key("term")).join(best, "k", "left")
    status = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") > 1, "ambiguous").when(F.col("b.rank") == 1, "exact").when(F.col("b.rank") == 2, "exact_synonym").otherwise("related_synonym")
    return j.select("term", F.when(F.col("b.n") == 1, F.col("b.node")).alias("node"), status.alias("status"), F.coalesce("b.n", F.lit(0)).alias("candidates"))


def longest_contained(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name): the longest name that a term contains as whole words, ties to the first. Names meet terms on their first word, so not all pairs are compared."""
    t = terms.select("term").distinct().withColumn("k", key("term")).withColumn("word", F.explode(F.array_distinct(F.split("k", " "))))
    n = names.select("name").distinct().withColumn("nk", key("name")).withColumn("word", F.substring_index("nk", " ", 1))
    hit = t.join(n, "word").filter(F.contains(F.concat(F.lit(" "), "k", F.lit(" ")), F.concat(F.lit(" "), "nk", F.lit(" "))))
    best = hit.groupBy("term").agg(F.min(F.struct((-F.length("nk")).alias("l"), "name")).alias("b"))
    return terms.select("term").distinct().join(best, "term", "left").select("term", F.col("b.name").alias("name"))


def taxon_flags(entries: DataFrame, constraints: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, node, species, compatible): whether a node's taxon constraints meet the species or one of its ancestors; null where either is unknown."""
    line = lineage.select(F.col("node").alias("species"), F.col("ancestor").alias("taxon"))
    known = entries.select("id", "node", "species").distinct()
    met = known.join(constraints, "node").join(line.withColumn("hit", F.lit(1)), ["species", "taxon"], "left").groupBy("id", "node", "species").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    has = line.select("species").distinct().withColumn("line", F.lit(True))
    return known.join(met, ["id", "node", "species"], "left").join(has, "species", "left").select("id", "node", "species", F.when(F.col("line").isNotNull() & F.col("hit").isNotNull(), F.col("hit") == 1).alias("compatible"))


def add_synonyms(synonyms: DataFrame, more: DataFrame) -> DataFrame:
    """``synonyms`` and those of ``more`` (node, synonym, scope) whose node and key it lacks; adding twice adds once."""
    k = ["node", "__k"]
    have = synonyms.withColumn("__k", key("synonym")).select(*k).distinct()
    new = more.withColumn("__k", key("synonym")).dropDuplicates(k).join(have, k, "left_anti")
    return synonyms.select("node", "synonym", "scope").unionAll(new.select("node", "synonym", "scope"))


def route(terms: DataFrame, router: DataFrame, names: DataFrame) -> DataFrame:
    """(term, entity, onto, node): terms looked up in the ontology of their entity type only. router: (entity, onto), bounded by the number of types; names: (onto, node, name)."""
    j = terms.join(router, "entity", "left").withColumn("k", key("term"))
    n = names.select("onto", key("name").alias("k"), "node").groupBy("onto", "k").agg(F.min("node").alias("node"), F.countDistinct("node").alias("n")).filter("n = 1").drop("n")
    return j.join(n, ["onto", "k"], "left").select("term", "entity", "onto", "node")


def best_over_sets(items: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """(id, score): over an id's values the mean of each one's best score against the other side; null where none resolves. items: (id, side 'a' or 'b', node); pair_scores: (a, b, score)."""
    a, b = (items.filter(F.col("side") == s).select("id", F.col("node").alias(s)) for s in "ab")
    best = a.join(b, "id").join(pair_scores, ["a", "b"], "left").groupBy("id", "a").agg(F.max("score").alias("best"))
    return items.select("id").distinct().join(best.groupBy("id").agg(F.avg("best").alias("score")), "id", "left")


def prefixed(closed: DataFrame, prefix: str) -> DataFrame:
    """The closure's rows whose ancestor is of one namespace."""
    return closed.filter(F.col("ancestor").startswith(prefix))


def rank_by(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an explicit order."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")

"""Orders and ways in large graphs, round by round over stored tables: each round touches what changed, and ends by itself.

Edges are (child, parent). Rounds are checkpointed, so their lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.session import kept, unsent


def _both_ways(edges: DataFrame) -> DataFrame:
    """(x, y, weight): edges in either direction, the lightest of parallel ones; edges without a weight or an end are none."""
    e = edges.select(F.col("child").alias("x"), F.col("parent").alias("y"), F.col("weight").cast("double").alias("weight"))
    e = e.unionAll(e.select(F.col("y"), F.col("x"), F.col("weight"))).filter("x is not null and y is not null and weight is not null and x <> y")
    return e.groupBy("x", "y").agg(F.min("weight").alias("weight"))


def _folded(pairs: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(a, b, p, q, before, after) of pairs (a, b), and the edges (x, y, weight) between the nodes p and q that are left.

    A node with a single neighbour lies on no way between others, so a way that begins or ends there does so by its only
    edge: the pair goes on from the neighbour, ``before`` or ``after`` dearer by that edge, and the node leaves the graph.
    Where p = q nothing is left to search. Rounds go on while half of the nodes leave at least, so there are no more than
    the logarithm of their number; None if the first has no such half.
    """
    zero = F.lit(0).cast(e.schema["weight"].dataType)
    at, folds = pairs.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"), zero.alias("before"), zero.alias("after")), False
    while True:
        ends = kept(e.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y"), F.min("weight").alias("weight")))
        nodes, single = ends.agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
        if not nodes or 2 * single < nodes:
            return (at, e) if folds else None
        single = ends.filter("n = 1").select("x", "y", "weight")
        # Of two nodes with no neighbour but each other the smaller stays.
        other = single.select(F.col("x").alias("__y"))
        gone = kept(single.join(unsent(other), F.col("y") == F.col("__y"), "left").filter("__y is null or y < x").select("x", "y", "weight"))
        for end, more in (("p", "before"), ("q", "after")):
            step = gone.select(F.col("x").alias(f"__{end}"), F.col("y").alias(f"__to_{end}"), F.col("weight").alias(f"__{more}"))
            at = at.join(unsent(step), (F.col(end) == F.col(f"__{end}")) & (F.col("a") != F.col("b")), "left")
        open_ = F.col("p") != F.col("q")
        to = lambda end, more: (F.when(open_ & F.col(f"__{end}").isNotNull(), F.col(f"__to_{end}")).otherwise(F.col(end)).alias(end), (F.col(more) + F.when(open_, F.coalesce(f"__{more}", zero)).otherwise(zero)).alias(more))
        at = kept(at.select("a", "b", *to("p", "before"), *to("q", "after")))
        left = unsent(gone.select("x"))
        e, folds = kept(e.join(left, "x", "left_anti").join(unsent(left.withColumnRenamed("x", "y")), "y", "left_anti").select("x", "y", "weight")), True


def _between(pairs: DataFrame, e: DataFrame, search, name: str) -> DataFrame:
    """(a, b, ``name``) of pairs (a, b): what ``search`` (pairs, edges) gives between the nodes that folding leaves, and the edges before and after."""
    wanted = kept(pairs.select("a", "b").distinct())
    folded = _folded(wanted, e)
    if folded is None:
        return search(wanted, e)
    at, e = folded
    core = search(kept(at.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()), e)
    core = core.select(F.col("a").alias("__p"), F.col("b").alias("__q"), F.col(name).alias("__core"))
    found = at.join(unsent(core), (F.col("p") == F.col("__p")) & (F.col("q") == F.col("__q")), "left")
    inner = F.when(F.col("p") == F.col("q"), F.lit(0).cast(core.schema["__core"].dataType)).otherwise(F.col("__core"))
    return found.select("a", "b", (F.col("before") + inner + F.col("after")).alias(name))


def cheapest(pairs: DataFrame, edges: DataFrame, delta: float | None = None, most: int = 10_000) -> DataFrame:
    """(a, b, cost): the cheapest way between the pairs' nodes over edges (child, parent, weight) in either direction; null if there is none.

    Delta-stepping from all the pairs' first nodes at once. Costs are kept in buckets of width ``delta`` (by default eight
    mean weights: rounds cost more than a few nodes looked at twice). Of the lowest bucket with changed nodes, those nodes alone send their costs over light edges (up to
    ``delta``) until the bucket changes no more; then all that were in it send theirs over heavy edges, once. A node that
    no cheaper way reaches is never looked at again. The search from a node goes on until nothing changes, or, where all
    its pairs are settled, to the bucket of the dearest.

    A negative weight raises, as do ``most`` rounds without an end: no cost is given that a further round would lower. A
    round is one join of the changed nodes with the edges and one sum by (a, node). Nodes with a single neighbour are
    folded into it beforehand where they are many (see ``_folded``).
    """
    e = kept(_both_ways(edges))
    low = e.agg(F.min("weight")).first()[0]
    if low is not None and low < 0:
        raise ValueError("negative weights")
    return _between(pairs, e, lambda p, e: _stepped(p, e, delta, most), "cost")


def _stepped(wanted: DataFrame, e: DataFrame, delta: float | None, most: int) -> DataFrame:
    """(a, b, cost) of distinct pairs over edges (x, y, weight) both ways, by delta-stepping."""
    mean = e.agg(F.avg("weight")).first()[0]
    width = float(delta or 8 * (mean or 0.0)) or 1.0
    bucket = F.floor(F.col("cost") / F.lit(width))
    # changed: its cost hasn't gone over light edges; heavy: nor over heavy ones
    state = kept(wanted.filter("a is not null").select("a", F.col("a").alias("at")).distinct().select("a", "at", F.lit(0.0).alias("cost"), F.lit(True).alias("changed"), F.lit(True).alias("heavy")))
    for _ in range(most):
        light, deep = state.agg(F.min(F.when(F.col("changed"), bucket)), F.min(F.when(F.col("heavy"), bucket))).first()
        if light is None and deep is None:
            break
        by_light = light is not None and (deep is None or light <= deep)
        now = light if by_light else deep
        going = F.col("changed" if by_light else "heavy") & (bucket == now)
        way = e.filter(F.col("weight") <= width) if by_light else e.filter(F.col("weight") > width)
        sent = state.filter(going).select("a", F.col("at").alias("x"), "cost").join(unsent(way), "x").select("a", F.col("y").alias("at"), (F.col("cost") + F.col("weight")).alias("cost"))
        old = state.select("a", "at", "cost", F.col("cost").alias("before"), *[F.when(going, F.lit(False)).otherwise(F.col(c)).alias(c) if (c == "changed") == by_light else F.col(c) for c in ("changed", "heavy")])
        new = sent.select("a", "at", "cost", F.lit(None).cast("double").alias("before"), F.lit(False).alias("changed"), F.lit(False).alias("heavy"))
        met = old.unionAll(new).groupBy("a", "at").agg(F.min("cost").alias("cost"), F.min("before").alias("before"), F.max("changed").alias("changed"), F.max("heavy").alias("heavy"))
        fell = F.col("before").isNull() | (F.col("cost") < F.col("before"))
        state = met.select("a", "at", "cost", (F.col("changed") | fell).alias("changed"), (F.col("heavy") | fell).alias("heavy"))
        # Where all pairs of a node cost less than the bucket at hand begins with, nothing dearer matters.
        if not by_light:
            done = wanted.join(unsent(state.select("a", F.col("at").alias("b"), "cost")), ["a", "b"], "left").groupBy("a").agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("dearest"))
            state = state.join(done.filter(F.col("dearest") <= width * (now + 1)), "a", "left")
            over = F.col("dearest").isNotNull()
            state = state.select("a", "at", "cost", (F.col("changed") & ~over).alias("changed"), (F.col("heavy") & ~over).alias("heavy"))
        state = kept(state)
    else:
        raise RuntimeError(f"no fixed point in {most} rounds")
    return wanted.join(unsent(state.select("a", F.col("at").alias("b"), "cost")), ["a", "b"], "left").select("a", "b", "cost")


def fewest(pairs: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(a, b, hops, distance): the fewest edges between the pairs' nodes in either direction, and hops / (1 + hops); null if there is no way.

    Searches start at the pairs' first nodes, and each level goes on from the nodes that the one before reached first, until
    it reaches none. ``most`` levels without an end raise. Nodes with a single neighbour are folded into it beforehand
    where they are many (see ``_folded``).
    """
    e = edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).filter("child is not null and parent is not null and child <> parent")
    e = kept(e.unionAll(e.select("y", "x")).distinct().withColumn("weight", F.lit(1)))
    found = _between(pairs, e, lambda p, e: _levelled(p, e, most), "hops")
    return found.select("a", "b", "hops", (F.col("hops") / (1 + F.col("hops"))).alias("distance"))


def _levelled(wanted: DataFrame, e: DataFrame, most: int) -> DataFrame:
    """(a, b, hops) of distinct pairs over edges (x, y) both ways, level by level."""
    level = reached = kept(wanted.select("a", F.col("a").alias("at")).distinct().withColumn("hops", F.lit(0)))
    for h in range(1, most + 1):
        step = level.join(unsent(e), F.col("at") == F.col("x")).select("a", F.col("y").alias("at")).distinct()
        level = kept(step.join(unsent(reached.select("a", "at")), ["a", "at"], "left_anti").withColumn("hops", F.lit(h)))
        if level.isEmpty():
            break
        reached = reached.unionAll(level)
    else:
        raise RuntimeError(f"more than {most} levels")
    return wanted.join(unsent(reached.withColumnRenamed("at", "b")), ["a", "b"], "left").select("a", "b", "hops")


def _peeled(edges: DataFrame, most: int) -> DataFrame:
    """(node, level, total): Kahn's order. total: the sum over parents of their total and of ln(their number of children); 0 for roots.

    A node waits for as many parents as it has; those that wait for none are a level, and their children wait for as many
    fewer. Each round joins one level with the edges and sums what reaches a child. A cycle raises.
    """
    e = edges.select("child", "parent").filter("child is not null and parent is not null").distinct()
    weight = e.groupBy("parent").agg(F.ln(F.count(F.lit(1)).cast("double")).alias("w"))
    e = kept(e.join(unsent(weight), "parent"))
    nodes = e.select(F.col("child").alias("node")).unionAll(e.select("parent")).distinct()
    need = e.groupBy(F.col("child").alias("__c")).agg(F.count(F.lit(1)).alias("need"))
    waiting = nodes.join(unsent(need), F.col("node") == F.col("__c"), "left").select("node", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0.0).alias("total"))
    waiting, out = kept(waiting), None
    for level in range(most + 1):
        free = waiting.filter("need = 0").select("node", F.lit(level).alias("level"), "total")
        if free.isEmpty():
            if not waiting.isEmpty():
                raise ValueError("the graph has a cycle")
            break
        out = free if out is None else out.unionAll(free)
        sent = free.join(unsent(e), F.col("node") == F.col("parent")).groupBy(F.col("child").alias("__c")).agg(F.count(F.lit(1)).alias("came"), F.sum(F.col("total") + F.col("w")).alias("more"))
        left = waiting.filter("need > 0").join(unsent(sent), F.col("node") == F.col("__c"), "left")
        waiting = kept(left.select("node", (F.col("need") - F.coalesce("came", F.lit(0))).alias("need"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
    else:
        raise RuntimeError(f"more than {most} levels")
    return out if out is not None else waiting.select("node", F.lit(0).alias("level"), "total")


def topological_order(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, level) of an acyclic graph: 0 for roots, else one more than the deepest parent's; a cycle, or more than ``most`` levels, raises."""
    return _peeled(edges, most).select("node", "level")


def topological_information(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, ti): 0 for roots; for others the sum over parents of the parent's ti + ln(its number of children), in topological order, of graphs of any depth."""
    return _peeled(edges, most).select("node", F.col("total").alias("ti"))


def path_to_root(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, path): the chain of first parents (smallest name) as 'node>parent>...'. A cycle, or more than ``most`` steps, raises.

    Chains double at each round: a node's chain is joined by that of the node at its end, so rounds grow with the
    logarithm of the depth.
    """
    first = kept(edges.filter("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent")))
    # Chains that haven't come to a root end at ``at``; ``rest`` is what follows their node.
    chain = kept(first.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.col("parent").cast("string").alias("rest"), F.lit(1).alias("steps")))
    steps = 0
    while True:
        far = chain.select(F.col("node").alias("__n"), F.col("at").alias("__at"), F.col("rest").alias("__rest"), F.col("steps").alias("__steps"))
        more = chain.join(far, F.col("at") == F.col("__n"), "left")
        chain = kept(more.select("node", F.coalesce("__at", "at").alias("at"), F.when(F.col("__n").isNull(), F.col("rest")).otherwise(F.concat_ws(">", "rest", "__rest")).alias("rest"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps")))
        before, steps = steps, chain.agg(F.coalesce(F.max("steps"), F.lit(0))).first()[0]
        if steps == before:
            break
        if steps > most:
            raise RuntimeError(f"a cycle, or more than {most} steps")
    c = chain.select(F.col("node").alias("__n"), "rest")
    return nodes.select("node").join(c, F.col("node") == F.col("__n"), "left").select("node", F.concat_ws(">", F.col("node").cast("string"), "rest").alias("path"))

"""Matching of values and vectors: tiers, exact nearest neighbours, clusters and sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions import measures as M
from metaloom.functions import text as X
from metaloom.operators import phrases
from metaloom.session import kept


def compare(golden: Column, predicted: Column, golden_id: Column, predicted_id: Column, hops: Column, cosine: Column, threshold: float = 0.75) -> tuple[Column, Column]:
    """(kind, score) of a predicted value by five levels.

    EXACT 1; NORMALIZED .95 (equal keys, or equal numbers); a different number is NO_MATCH 0, numbers are never matched
    by meaning; ONTOLOGY .9 for one id; HIERARCHICAL by the edges between, up to 4; SEMANTIC for a cosine of
    ``threshold``; else NO_MATCH, which keeps the cosine as its score.
    """
    g, p = X.plain(golden), X.plain(predicted)
    ng, np_ = X.number_of(golden), X.number_of(predicted)
    c = F.coalesce(cosine, F.lit(0.0))
    kinds = [
        (X.is_nullish(predicted) | X.is_nullish(golden), "MISSING", F.lit(0.0)),
        (F.trim(golden) == F.trim(predicted), "EXACT", F.lit(1.0)),
        (X.key(g) == X.key(p), "NORMALIZED", F.lit(0.95)),
        (ng.isNotNull() & np_.isNotNull() & X.same_number(ng, np_), "NORMALIZED", F.lit(0.95)),
        (ng.isNotNull() | np_.isNotNull(), "NO_MATCH", F.lit(0.0)),
        (golden_id == predicted_id, "ONTOLOGY", F.lit(0.9)),
        (hops.between(1, 4), "HIERARCHICAL", M.hop_score(hops)),
        (c >= threshold, "SEMANTIC", c),
    ]
    kind, score = F.lit("NO_MATCH"), c
    for when, k, s in reversed(kinds):
        kind, score = F.when(when, k).otherwise(kind), F.when(when, s).otherwise(score)
    return kind, score


def score_lists(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., mean_score, recall, kind) of pairs (by..., g, v, kind, score): each golden value's best by rank of kind and score; recall counts precise kinds alone; partial recall is SEMANTIC."""
    order = F.array(*[F.lit(k) for k in ("NO_MATCH", "SEMANTIC", "HIERARCHICAL", "ONTOLOGY", "NORMALIZED", "EXACT")])
    ranked = pairs.withColumn("r", F.array_position(order, F.col("kind")))
    best = ranked.groupBy(*by, "g").agg(F.max(F.struct("r", "score")).alias("b"))
    out = best.groupBy(*by).agg(F.bround(F.avg("b.score"), 4).alias("mean_score"), F.avg((F.col("b.r") >= 3).cast("double")).alias("recall"), F.min("b.r").alias("low"))
    kind = F.when(F.col("recall") == 1, F.element_at(order, F.col("low").cast("int"))).when(F.col("recall") > 0, "SEMANTIC").otherwise("NO_MATCH")
    return out.withColumn("kind", kind).drop("low")


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096, query_block: int = 512, rows: int | None = None) -> DataFrame:
    """(q, rank, id, cosine): each query's ``k`` rows of greatest cosine, ties to the smaller id, itself left out; exact.

    Blocks of queries meet blocks of vectors; each meeting gives its ``k`` best, so the rows between are queries times
    blocks times ``k``. Few vectors meet larger blocks of queries. queries and vectors: (id, vec). Vectors of length 0 have
    cosine 0. ``rows``: the number of queries, where it is known; with it they are computed once.
    """

    def blocks(df: DataFrame, rows: int, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-rows // size))
        return df.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("blk")), n

    have = max(1, vectors.count())
    v, nv = blocks(vectors, have, block)
    q, nq = blocks(queries, queries.count() if rows is None else rows, query_block * max(1, min(8, block // have)))
    q = q.select(F.col("id"), "vec", F.col("blk").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    v = v.select(F.col("id"), "vec", F.col("blk").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def matrix(c: pa.ChunkedArray) -> np.ndarray:
        m = np.array([x for chunk in c.chunks for x in chunk.to_numpy(zero_copy_only=False)], np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(n == 0, 1, n)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, s = b.column("id").to_numpy(), matrix(a.column("vec")) @ matrix(b.column("vec")).T
            for i, row in zip(a.column("id").to_pylist(), s, strict=True):
                bound = np.partition(row, -min(k + 1, len(row)))[-min(k + 1, len(row))]
                near = np.flatnonzero((row >= bound) & (ids != i))
                near = near[np.lexsort((ids[near], -row[near]))][:k]
                out += [(i, int(ids[j]), float(np.clip(row[j], 0, 1))) for j in near]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    met = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(run, "q long, id long, cosine double")
    w = W.partitionBy("q").orderBy(F.col("cosine").desc(), "id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "id", "cosine")


def _meetings(vectors: DataFrame, by: list[str], block: int) -> DataFrame:
    """``vectors`` dealt within groups into blocks __b of about ``block``, a row for each meeting (__x, __y) of two blocks."""
    size = vectors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("__n"))
    v = vectors.join(size, by).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n").cast("long")).cast("int"))
    v = v.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return v.withColumn("__x", F.least("__b", "__o")).withColumn("__y", F.greatest("__b", "__o"))


def threshold_pairs(vectors: DataFrame, by: list[str], least: float, block: int = 2048) -> DataFrame:
    """(by..., a, b, cosine) of the pairs within a group of cosine ``least`` or more, a < b; exact.

    A group, the values of one field or label, is dealt into blocks of about ``block`` vectors; each two blocks meet in
    one task, so a large group is spread over many, and only pairs that reach ``least`` become rows.
    """
    v = _meetings(vectors.select(*by, "id", "vec"), by, block)
    kinds = vectors.select(*by).schema
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["a long", "b long", "cosine double"])

    def run(t: pa.Table) -> pa.Table:
        ids, blk = t.column("id").to_numpy(), t.column("__b").to_numpy()
        x, y = t.column("__x")[0].as_py(), t.column("__y")[0].as_py()
        m = np.array(t.column("vec").to_pylist(), np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m /= np.where(n == 0, 1, n)
        p, q = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        s = m[p] @ m[q].T
        keep = (s >= least) & (n[p] > 0) & (n[q] > 0).T
        keep &= ids[p][:, None] < ids[q][None, :] if x == y else ids[p][:, None] != ids[q][None, :]
        i, j = np.nonzero(keep)
        u, w = ids[p][i], ids[q][j]
        cols = [pa.array([t.column(c)[0].as_py()] * len(u), t.schema.field(c).type) for c in by]
        return pa.table([*cols, pa.array(np.minimum(u, w)), pa.array(np.maximum(u, w)), pa.array(np.clip(s[i, j], 0, 1))], [*by, "a", "b", "cosine"])

    return v.groupBy(*by, "__x", "__y").applyInArrow(run, shape)


def best_between(vectors: DataFrame, by: list[str], side: Column, block: int = 2048) -> DataFrame:
    """(by..., cosine): the greatest cosine of two vectors of a group that differ in ``side``; exact. Each meeting of blocks gives one row, so no pair becomes one."""
    v = _meetings(vectors.select(*by, "id", "vec", side.cast("long").alias("__s")), by, block)
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*by).schema] + ["cosine double"])

    def run(t: pa.Table) -> pa.Table:
        blk, side_ = t.column("__b").to_numpy(), t.column("__s").to_numpy()
        m = np.array(t.column("vec").to_pylist(), np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m /= np.where(n == 0, 1, n)
        p, q = np.flatnonzero(blk == t.column("__x")[0].as_py()), np.flatnonzero(blk == t.column("__y")[0].as_py())
        keep = (side_[p][:, None] != side_[q][None, :]) & (n[p] > 0) & (n[q] > 0).T
        best = [float(np.clip((m[p] @ m[q].T)[keep].max(), 0, 1))] if keep.any() else []
        cols = [pa.array([t.column(c)[0].as_py()] * len(best), t.schema.field(c).type) for c in by]
        return pa.table([*cols, pa.array(best, pa.float64())], [*by, "cosine"])

    return v.groupBy(*by, "__x", "__y").applyInArrow(run, shape)


SMALL = 1 << 18  # links that one task may join


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars, each node linked to the smallest of its component there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = p
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def clusters(nodes: DataFrame, links: DataFrame, most: int = 60, small: int = SMALL) -> DataFrame:
    """(id, cluster): connected components of links (a, b), named by their smallest id; nodes without links are their own.

    Partitions first turn their links into stars. Where at most ``small`` are left, one task joins them. Else rounds of large
    star and small star follow: a node's larger neighbours, then its smaller ones, go to the smallest near it, until
    nothing changes; their number grows with the logarithm of the longest chain, and ``most`` rounds without an end raise
    an error. Rounds are checkpointed, in the folder set on the context or, on a local master alone, in a temporary one.
    """
    shape = "a long, b long"
    e = kept(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_stars, shape))
    if e.count() <= small:
        found = e.coalesce(1).mapInArrow(_stars, shape).toDF("__n", "cluster")
    else:
        every = e.select(F.col("a").alias("__n")).distinct()
        e = kept(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = None
        for _ in range(most):
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            star = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
            e = kept(star.filter("a <> b").distinct())
            now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == state:
                break
            state = now
        else:
            raise RuntimeError(f"no fixed point in {most} rounds")
        up = e.select(F.col("a").alias("__a"), F.col("b").alias("cluster"))
        found = every.join(up, F.col("__n") == F.col("__a"), "left").select("__n", F.coalesce("cluster", "__n").alias("cluster"))
    return nodes.join(found, F.col("id") == F.col("__n"), "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def max_similarity(pairs: DataFrame) -> DataFrame:
    """(id, best): the greatest cosine between two value sets, of pairs (id, cosine)."""
    return pairs.groupBy("id").agg(F.max("cosine").alias("best"))


def restricted_choice(ranked: Column, allowed: Column) -> Column:
    """The first of a ranked list that is allowed; null if none is."""
    return F.get(F.filter(ranked, lambda x: F.array_contains(allowed, x)), F.lit(0))


def hashed_ngrams(texts: DataFrame, dims: int = 256, n: int = 3) -> DataFrame:
    """(term, vec): unit vectors of hashed character n-grams, where no model is at hand. Each text is embedded once; a text's grams are counted where it is read."""
    t = texts.select("term").filter("term is not null").distinct()
    slots = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(k) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substr(k, i, F.lit(n))), F.lit(dims)).cast("int"))
    grams = F.transform(F.array(F.concat(F.lit(" "), X.key("term"), F.lit(" "))), slots)[0]  # so that the key is made once, not for each gram
    step = max(1, (1 << 19) // dims)  # rows whose vectors are made at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                sizes, slots = pc.list_value_length(b.column(1)).to_numpy(), b.column(1).flatten().to_numpy()
                m = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dims + slots, minlength=len(sizes) * dims).reshape(-1, dims).astype(np.float64)
                m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, m.size + 1, dims, dtype=np.int32), m.ravel())], ["term", "vec"])

    return t.select("term", grams.alias("slots")).mapInArrow(run, "term string, vec array<double>")


def embed(texts: DataFrame, model, batch: int = 64) -> DataFrame:
    """(term, vec) by ``model``, a picklable function from a list of texts to a list of vectors; distinct texts, ``batch`` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b["term"].iloc[i : i + batch].tolist()
                yield pd.DataFrame({"term": part, "vec": [list(map(float, v)) for v in model(part)]})

    return texts.select("term").distinct().mapInPandas(run, "term string, vec array<double>")


def normalise(terms: DataFrame, lexical: DataFrame, neighbours: DataFrame, unimod: DataFrame, least: float = 0.70) -> DataFrame:
    """(term, node, method, similarity): the first tier that gives a node: modification alias, exact lookup, nearest name of ``least`` cosine or more.

    lexical: (term, node, status) as of ontology.resolve; neighbours: (term, node, similarity); unimod: (term, node).
    An ambiguous lookup is not guessed at by meaning.
    """
    near = neighbours.filter(F.col("similarity") >= least).groupBy("term").agg(F.max(F.struct("similarity", "node")).alias("s"))
    j = terms.select("term").distinct().join(unimod.select("term", F.col("node").alias("u")), "term", "left").join(lexical.select("term", F.col("node").alias("l"), "status"), "term", "left").join(near, "term", "left")
    semantic = F.when(F.coalesce("status", F.lit("unresolved")) != "ambiguous", F.col("s.node"))
    method = F.when(F.col("u").isNotNull(), "unimod").when(F.col("l").isNotNull(), F.col("status")).when(semantic.isNotNull(), "semantic").when(F.col("status") == "ambiguous", "ambiguous").otherwise("unmapped")
    return j.select("term", F.coalesce("u", "l", semantic).alias("node"), method.alias("method"), F.when(F.coalesce("u", "l").isNotNull(), 1.0).otherwise(F.when(semantic.isNotNull(), F.col("s.similarity"))).alias("similarity"))


def evidence_status(quotes: DataFrame, sources: DataFrame, **sizes: int) -> DataFrame:
    """(item_id, doc_id, status): where each quote stands, ``verbatim`` or ``normalized`` (but for case and white space).

    Quotes found nowhere have a row with null doc_id, ``absent``; empty quotes are nowhere. See phrases.found, which
    ``sizes`` are for.
    """
    q = quotes.select(F.col("item_id").cast("long").alias("item_id"), "quote")
    texts = sources.select(F.col("doc_id").alias("doc"), X.key("text").alias("key"), "text")
    met = phrases.found(q.select(F.col("item_id").alias("id"), X.key("quote").alias("key"), F.col("quote").alias("written")), texts, **sizes)
    met = kept(met.select(F.col("id").alias("item_id"), F.col("doc").alias("doc_id"), F.when(F.col("verbatim"), "verbatim").otherwise("normalized").alias("status")))
    none = q.select("item_id").join(met.select("item_id").distinct(), "item_id", "left_anti")
    return met.unionAll(none.select("item_id", F.lit(None).cast(sources.schema["doc_id"].dataType).alias("doc_id"), F.lit("absent").alias("status")))

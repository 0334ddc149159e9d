"""Scores: precision and recall, matching of value lists, agreement of raters, ranks, tiers and calibration."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.functions import measures as M
from metaloom.operators.matching import clusters
from metaloom.session import kept


def prf(scored: DataFrame, by: list[str], score: Column, predicted: Column, golden: Column) -> DataFrame:
    """tp, fp, fn, p, r and f1 by group; see measures.prf_counts for what counts."""
    out = scored.groupBy(*by).agg(*[c.alias(n) for n, c in M.prf_counts(score, predicted, golden).items()])
    return out.withColumns(M.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(per_group: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The means of p, r and f1 over groups."""
    return per_group.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("p", "r", "f1")])


def counts_by_kind(df: DataFrame, by: str, kind: str, kinds: list[str], share: bool = False) -> DataFrame:
    """A column for each of the given kinds with its rows, or with its share of the group's."""
    out = df.groupBy(by).pivot(kind, kinds).count()
    cols = [F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in kinds]
    if share:
        total = sum(cols[1:], cols[0])
        cols = [M.ratio_or(c, total) for c in cols]
    return out.select(by, *[c.alias(k) for c, k in zip(cols, kinds, strict=True)])


def best_matches(golden: DataFrame, predicted: DataFrame, by: list[str], score: Column) -> DataFrame:
    """Per golden value its best predicted one by score, ties to the smaller value. golden: (*by, g); predicted: (*by, v)."""
    j = golden.join(predicted, by, "left").withColumn("s", F.when(F.col("v").isNotNull(), score))
    best = j.groupBy(*by, "g").agg(F.min(F.when(F.col("s").isNotNull(), F.struct((-F.col("s")).alias("m"), "v"))).alias("b"))
    return best.select(*by, "g", F.col("b.v").alias("v"), F.coalesce(-F.col("b.m"), F.lit(0.0)).alias("score"))


def greedy_pairs(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs by falling score; of equal scores, larger i and then larger j come first."""
    seen_i, seen_j, out = set(), set(), []
    for s, i, j in sorted(pairs, reverse=True):
        if i not in seen_i and j not in seen_j:
            seen_i.add(i)
            seen_j.add(j)
            out.append((i, j, s))
    return out


def assignment(weights) -> list[tuple[int, int]]:
    """One-to-one pairs of the greatest total weight, by shortest augmenting paths over whole rows at a time; pairs of weight 0 are left out."""
    w = np.asarray(weights, float)
    if not w.size:
        return []
    size = max(w.shape)
    cost = np.zeros((size, size))
    cost[: w.shape[0], : w.shape[1]] = -w
    u, v = np.zeros(size), np.zeros(size)
    row_of = np.full(size, -1)
    for start in range(size):
        low, back, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        i, column, seen = start, -1, [start]
        while True:
            reach = cost[i] - u[i] - v
            better = ~done & (reach < low - 1e-12)
            low[better], back[better] = reach[better], column
            column = int(np.argmin(np.where(done, np.inf, low)))
            step = low[column]
            # Prices move so that the tree's edges stay tight.
            u[seen] += step
            v[done] -= step
            low[~done] -= step
            done[column] = True
            if row_of[column] < 0:
                break
            i = int(row_of[column])
            seen.append(i)
        while column >= 0:
            before = int(back[column])
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    return sorted((int(row_of[j]), j) for j in range(w.shape[1]) if row_of[j] < w.shape[0] and w[row_of[j], j] > 0)


LARGE = 1 << 16  # candidate pairs of a group that one task matches


def _by_task(scored: DataFrame, by: list[str], method: str) -> DataFrame:
    """One-to-one pairs of groups that a task holds each."""
    schema = scored.select(*by, "i", "j", "s").schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["i", "j"])
        if method == "greedy":
            rows = greedy_pairs(list(zip(pdf["s"], pdf["i"], pdf["j"], strict=True)))
        else:
            I, J = sorted(set(pdf["i"])), sorted(set(pdf["j"]))
            at_i, at_j = ({v: k for k, v in enumerate(side)} for side in (I, J))
            bonus = 10 * (min(len(I), len(J)) + 1)
            w, score = np.zeros((len(I), len(J))), {}
            for s, i, j, rank in zip(pdf["s"], pdf["i"], pdf["j"], pdf["rank"], strict=True):
                if s > 0:
                    a, b = at_i[i], at_j[j]
                    w[a, b], score[a, b] = bonus + rank + s / 10, s
            rows = [(I[a], J[b], score[a, b]) for a, b in assignment(w)]
        out = pd.DataFrame(rows, columns=["i", "j", "s"])
        for k, c in enumerate(by):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    return scored.select(*by, "i", "j", "s", "rank").groupBy(*by).applyInPandas(run, schema)


def _dominant(scored: DataFrame, by: list[str], most: int = 10_000) -> DataFrame:
    """The greedy pairs of groups of any size: in each round those that are the best both of their i and of their j, which greedy choice would take before all others of the two; then the next, without these i and j."""
    left, out = kept(scored.groupBy(*by, "i", "j").agg(F.max("s").alias("s"))), None
    order = F.struct("s", "i", "j")
    for _ in range(most):
        top_i = left.groupBy(*by, "i").agg(F.max(order).alias("x")).select(*by, "x.s", "x.i", "x.j")
        top_j = left.groupBy(*by, "j").agg(F.max(order).alias("x")).select(*by, "x.s", "x.i", "x.j")
        best = kept(top_i.join(top_j, [*by, "s", "i", "j"]).select(*by, "i", "j", "s"))
        if best.isEmpty():
            return out if out is not None else best
        out = best if out is None else out.unionAll(best)
        left = kept(left.join(best.select(*by, "i"), [*by, "i"], "left_anti").join(best.select(*by, "j"), [*by, "j"], "left_anti"))
    raise RuntimeError(f"no end in {most} rounds")


def one_to_one(scored: DataFrame, by: list[str], method: str = "greedy", large: int = LARGE) -> DataFrame:
    """One-to-one pairs within each group of candidate pairs (*by, i, j, s): ``greedy`` by score, or ``optimal``: the most pairs first, then the strongest tiers (column ``rank``, 1 where there is none), then the most score.

    A pair weighs 10 * (fewer of both sides + 1) + rank + s / 10; pairs without a score are none. Groups of up to ``large``
    pairs are matched in one task each. A larger one is matched greedily in rounds of joins, with the same result; for the
    optimal pairs it is taken apart into its connected parts, which can be matched alone, and a part that is still larger
    raises.
    """
    scored = scored if "rank" in scored.columns else scored.withColumn("rank", F.lit(1))
    scored = scored.select(*by, "i", "j", "s", "rank")
    big = kept(scored.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > large).select(*by))
    if big.isEmpty():
        return _by_task(scored, by, method)
    small, rest = scored.join(big, by, "left_anti"), scored.join(big, by, "left_semi")
    if method == "greedy":
        return _by_task(small, by, method).unionByName(_dominant(rest, by))
    ends = kept(rest.filter("s > 0").select("*", F.xxhash64(F.lit("i"), *by, "i").alias("__i"), F.xxhash64(F.lit("j"), *by, "j").alias("__j")))
    parts = clusters(ends.select(F.col("__i").alias("id")).distinct(), ends.select(F.col("__i").alias("a"), F.col("__j").alias("b")))
    rest = kept(ends.join(parts.select(F.col("id").alias("__i"), F.col("cluster").alias("__part")), "__i").select(*by, "__part", "i", "j", "s", "rank"))
    worst = rest.groupBy(*by, "__part").count().agg(F.max("count")).first()[0] or 0
    if worst > large:
        raise ValueError(f"{worst} connected candidate pairs; optimal matching takes {large} at most: raise the least score, or match greedily")
    return _by_task(small, by, method).unionByName(_by_task(rest, [*by, "__part"], method).drop("__part"))


def greedy_counts(pairs: list[tuple[float, str, str]], left: dict[str, list[int]], right: dict[str, list[int]]) -> Counter:
    """{(v, w): number} of one-to-one pairs by falling score between the rows of values, for pairs (score, v, w) of values.

    left, right: the places of each value's rows in the order of choice, rising. Rows of a value are chosen in that order, so a
    number for each value says which are left. Where several values meet at one score, their rows are merged by place, and
    each takes the row of the first place; the result is that of greedy_pairs over all pairs of rows.
    """
    out, taken = Counter(), (Counter(), Counter())
    open_ = lambda v, w: taken[0][v] < len(left[v]) and taken[1][w] < len(right[w])

    def take(v: str, w: str, n: int) -> None:
        out[v, w] += n
        taken[0][v] += n
        taken[1][w] += n

    for _, level in itertools.groupby(sorted(pairs, reverse=True), key=lambda x: x[0]):
        level = [(v, w) for _, v, w in level if open_(v, w)]
        n_v, n_w, several = Counter(v for v, _ in level), Counter(w for _, w in level), {}
        for v, w in level:
            if n_v[v] == n_w[w] == 1:
                take(v, w, min(len(left[v]) - taken[0][v], len(right[w]) - taken[1][w]))
            else:
                several.setdefault(v, []).append(w)
        for _, v in heapq.merge(*[[(place, v) for place in left[v][taken[0][v] :]] for v in several]):
            several[v] = [w for w in several[v] if taken[1][w] < len(right[w])]
            if several[v]:
                take(v, min(several[v], key=lambda w: right[w][taken[1][w]]), 1)
    return out


def _counted_by_task(rows: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., predicted, golden, n): greedy pairs of rows (by..., side, value, place) by the pairs (by..., predicted, golden, s) of their values, a group in a task."""

    def run(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        sides = [{v: sorted(x) for v, x in rows[rows["__side"] == k].groupby("value")["__place"]} for k in (0, 1)]
        found = greedy_counts(list(zip(pairs["s"], pairs["predicted"], pairs["golden"], strict=True)), *sides)
        out = pd.DataFrame([(v, w, n) for (v, w), n in found.items()], columns=["predicted", "golden", "n"])
        for k, c in enumerate(by):
            out.insert(k, c, pairs[c].iloc[0] if len(pairs) else None)
        return out

    schema = T.StructType([*pairs.select(*by, "predicted", "golden").schema, T.StructField("n", T.LongType())])
    keys = [f"__{c}" for c in by]  # both sides come from one table
    rows = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "__side", "value", "__place")
    return rows.groupBy(*keys).cogroup(pairs.groupBy(*by)).applyInPandas(run, schema)


def _counted_in_rounds(rows: DataFrame, pairs: DataFrame, by: list[str], most: int = 10_000) -> DataFrame:
    """As _counted_by_task, of groups of any size, in rounds of joins.

    In each round those pairs of values are taken that are the best of both values, by score and by the first places that are
    left; of their rows all that come before those of the next value of the same score. ``most`` rounds without an end raise.
    """
    own = W.partitionBy(*by, "__side", "value").orderBy("__place")
    ranked, out = rows.withColumn("__k", F.row_number().over(own)), None
    names = ("predicted", "golden")
    sides = {c: kept(ranked.filter(F.col("__side") == k).select(*by, F.col("value").alias(c), "__place", "__k")) for k, c in enumerate(names)}
    taken = {c: kept(x.select(*by, c).distinct().withColumn("__taken", F.lit(0).cast("long"))) for c, x in sides.items()}
    for _ in range(most):
        e = pairs
        for c in names:
            head = taken[c].join(sides[c], [*by, c]).filter("__k = __taken + 1")
            e = e.join(head.select(*by, c, F.col("__taken").alias(f"__taken_{c}"), F.col("__place").alias(f"__head_{c}")), [*by, c])
        for c, other in (names, names[::-1]):
            w = W.partitionBy(*by, c).orderBy(F.desc("s"), f"__head_{other}")
            rival = F.when(F.lead("s").over(w) == F.col("s"), F.lead(f"__head_{other}").over(w))
            e = e.withColumns({f"__rank_{c}": F.row_number().over(w), f"__rival_{other}": rival})
        best = step = kept(e.filter("__rank_predicted = 1 and __rank_golden = 1"))
        if best.isEmpty():
            break
        for c in names:
            free = best.join(sides[c], [*by, c]).filter((F.col("__k") > F.col(f"__taken_{c}")) & (F.col(f"__rival_{c}").isNull() | (F.col("__place") < F.col(f"__rival_{c}"))))
            step = step.join(free.groupBy(*by, c).agg(F.count(F.lit(1)).alias(f"__n_{c}")), [*by, c])
        step = kept(step.select(*by, *names, F.least("__n_predicted", "__n_golden").alias("n")))
        out = step if out is None else out.unionAll(step)
        for c in names:
            more = taken[c].join(step.select(*by, c, "n"), [*by, c], "left")
            taken[c] = kept(more.select(*by, c, (F.col("__taken") + F.coalesce("n", F.lit(0))).alias("__taken")))
    else:
        raise RuntimeError(f"no end in {most} rounds")
    return (step.select(*by, *names, F.lit(0).cast("long").alias("n")) if out is None else out).groupBy(*by, *names).agg(F.sum("n").alias("n"))


def field_scores(predicted: DataFrame, golden: DataFrame, vectors: DataFrame, by: list[str], least: float = 0.75, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Scores of fields with several values: (by..., n_predicted, n_golden, tp, p, r, f1), and the matched pairs (by..., predicted, golden, score, method).

    predicted, golden: (by..., seq, value); vectors: (term, vec). Two values score 1 if they are equal, case and blanks around aside
    (``exact``), else the cosine of their vectors if that is ``least`` or more (``semantic``), else 0. Pairs are taken greedily,
    one to one, of equal scores those of larger seq first. A field that only one side has scores 0; null values are none.

    Different values of a field meet once, however many rows hold them. Fields of up to ``large`` rows and pairs of values are
    matched in a task each, larger ones in rounds of joins, with the same result.
    """
    p = predicted.filter("value is not null").select(*by, "seq", "value")
    g = golden.filter("value is not null").select(*by, "seq", "value")
    values = lambda x, name: x.select(*by, F.col("value").alias(name)).distinct().withColumn(f"__{name}", F.lower(F.trim(name)))
    met = values(p, "predicted").join(values(g, "golden"), by)
    same = F.col("__predicted") == F.col("__golden")
    pairs = met.filter(~same).select("predicted", "golden").distinct()
    pairs = pairs.join(vectors.select(F.col("term").alias("predicted"), F.col("vec").alias("__x")), "predicted").join(vectors.select(F.col("term").alias("golden"), F.col("vec").alias("__y")), "golden")
    near = pairs.select("predicted", "golden", M.cosine(F.col("__x"), F.col("__y")).alias("cosine")).filter(F.col("cosine") >= least)
    scored = met.join(near, ["predicted", "golden"], "left").withColumn("s", F.when(same, 1.0).otherwise(F.coalesce("cosine", F.lit(0.0)))).filter("s > 0")
    scored = kept(scored.select(*by, "predicted", "golden", "s", F.when(same, "exact").otherwise("semantic").alias("method")))
    size = p.select(*by).unionAll(g.select(*by)).groupBy(*by).count().unionAll(scored.groupBy(*by).count())
    size = size.groupBy(*by).agg(F.sum("count").alias("__size"))
    big = kept(size.filter(F.col("__size") > large).select(*by))
    # Rows in the order of choice: of larger seq first.
    rows = p.withColumn("__side", F.lit(0)).unionAll(g.withColumn("__side", F.lit(1))).join(scored.select(*by).distinct(), by, "left_semi")
    place = F.row_number().over(W.partitionBy(*by).orderBy("__side", F.desc_nulls_last("seq"), "value"))
    rows, met = rows.select(*by, "__side", "value", place.alias("__place")), scored.select(*by, "predicted", "golden", "s")
    if big.isEmpty():
        chosen = _counted_by_task(rows, met, by)
    else:
        chosen = _counted_by_task(rows.join(big, by, "left_anti"), met.join(big, by, "left_anti"), by)
        chosen = chosen.unionByName(_counted_in_rounds(rows.join(big, by, "left_semi"), met.join(big, by, "left_semi"), by))
    chosen = kept(chosen)
    matched = scored.join(chosen, [*by, "predicted", "golden"]).withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    matched = matched.select(*by, "predicted", "golden", F.col("s").alias("score"), "method")
    counts = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_predicted")).join(g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_golden")), by, "full").join(chosen.groupBy(*by).agg(F.sum("n").alias("tp")), by, "left").na.fill(0, ["n_predicted", "n_golden", "tp"])
    r = counts.withColumn("p", M.ratio_or(F.col("tp"), F.col("n_predicted"))).withColumn("r", M.ratio_or(F.col("tp"), F.col("n_golden")))
    return r.withColumn("f1", M.ratio_or(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))), matched


def multi_kappa(ratings: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, po, pe, kappa) of two categorical ratings; rows where either is null are left out, and kappa is null where chance agreement is complete."""
    by = by or []
    rows = ratings.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    pa = rows.groupBy(*by, F.col(a).alias("c")).agg(F.count(F.lit(1)).alias("na"))
    pb = rows.groupBy(*by, F.col(b).alias("c")).agg(F.count(F.lit(1)).alias("nb"))
    chance = pa.join(pb, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    j = base.join(chance, by, "left") if by else base.crossJoin(chance)
    pe = F.coalesce(F.col("x"), F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(*by, "n", "po", pe.alias("pe"), F.try_divide(F.col("po") - pe, 1 - pe).alias("kappa"))


def rater_pairs(ratings: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """(r1, r2, item, v1, v2) for each two raters, by name, of an item."""
    x = ratings.select(item, F.col(rater).alias("r1"), F.col(value).alias("v1"))
    y = ratings.select(item, F.col(rater).alias("r2"), F.col(value).alias("v2"))
    return x.join(y, item).filter("r1 < r2")


MOST_RATERS = 20  # C(20, 10) choices are 184,756 rows


def permutation_test(pairs: DataFrame, special: list[str]) -> DataFrame:
    """Exact test of whether pairs with a special rater differ in mean value from the other pairs.

    pairs: (r1, r2, value), bounded by the square of the number of raters. Every choice of as many raters as special ones
    is an assignment; p is the share of assignments whose difference is as large in size as the observed one.
    """
    spark = pairs.sparkSession
    if pairs.select("r1").unionAll(pairs.select("r2")).distinct().limit(MOST_RATERS + 1).count() > MOST_RATERS:
        raise ValueError(f"an exact test enumerates choices of at most {MOST_RATERS} raters")
    raters = sorted({r for x in pairs.select("r1", "r2").distinct().collect() for r in x})
    rows = [(k, list(c)) for k, c in enumerate(itertools.combinations(raters, len(special)))]
    combos = F.broadcast(spark.createDataFrame(rows, "k int, chosen array<string>"))
    mixed = F.array_contains("chosen", F.col("r1")) != F.array_contains("chosen", F.col("r2"))
    diff = pairs.crossJoin(combos).groupBy("k", "chosen").agg((F.avg(F.when(mixed, F.col("value"))) - F.avg(F.when(~mixed, F.col("value")))).alias("d"))
    seen = diff.filter(F.col("chosen") == F.array(*[F.lit(s) for s in sorted(special)])).select(F.col("d").alias("observed"))
    return diff.crossJoin(F.broadcast(seen)).agg(F.first("observed").alias("observed"), F.count(F.lit(1)).alias("assignments"), F.avg((F.abs("d") >= F.abs("observed") - 1e-12).cast("double")).alias("p"))


def average_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Ranks from 1 with ties at their mean, within groups. Equal values are counted before they are ordered."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*by).orderBy(value))
    r = n.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(value).alias("__v"), (upto - (F.col("__n") - 1) / 2).alias(out))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(value) == F.col("__v")]
    return df.join(r, on).drop("__v", *[f"__{c}" for c in by])


def tie_sum(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., ties): the sum of t ** 3 - t over groups of t equal values."""
    n = F.col("__n").cast("double")
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.sum(n**3 - n).alias("ties"))


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """The normal probability of a deviate as large in size. For rows of results, which are few."""
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """The probability that chi-square with ``df`` degrees of freedom exceeds x, by the series and the continued fraction of the incomplete gamma function."""

    def tail(x: float, k: float) -> float | None:
        if x is None or k is None or x != x or k != k or k <= 0:
            return None
        a, h = k / 2, x / 2
        if h <= 0:
            return 1.0
        scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
        if h < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= h / n
                total += term
            return max(0.0, 1 - total * scale)
        b = h + 1 - a
        c, d = 1e300, 1 / b
        f = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            f *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return f * scale

    return pd.Series([tail(p, q) for p, q in zip(x, df, strict=True)], dtype="float64")


def auc(df: DataFrame, value: str, positive: Column, by: list[str], ties: bool = False) -> DataFrame:
    """(by..., n_pos, n_neg, auc, z): the Mann-Whitney share of positive over negative values, ties half, and its normal deviate; null where a side is empty. ``ties``: the variance is corrected for equal values."""
    r = average_ranks(df.withColumn("__pos", positive), value, by)
    g = r.groupBy(*by).agg(F.count_if("__pos").alias("n_pos"), F.count_if(~F.col("__pos")).alias("n_neg"), F.sum(F.when(F.col("__pos"), F.col("rank"))).alias("s"))
    u = F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    nn, n = F.col("n_pos") * F.col("n_neg"), F.col("n_pos") + F.col("n_neg")
    variance = nn * (n + 1) / 12
    if ties:
        t = tie_sum(df, value, by)
        g = g.join(t, by) if by else g.crossJoin(t)  # one row
        variance = variance - F.try_divide(nn * F.col("ties"), (12 * n * (n - 1)).cast("double"))
    return g.select(*by, "n_pos", "n_neg", F.try_divide(u, nn.cast("double")).alias("auc"), F.try_divide(u - nn / 2, F.sqrt(variance)).alias("z"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by..., rho): the correlation of average ranks."""
    return average_ranks(average_ranks(df, a, by, "__ra"), b, by, "__rb").groupBy(*by).agg(F.corr("__ra", "__rb").alias("rho"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(groups, n, h, p): Kruskal and Wallis's H over all groups, corrected for ties, and its probability by chi-square."""
    all_ = df.withColumn("__all", F.lit(1))
    r = average_ranks(all_, value, ["__all"])
    g = r.groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.sum("rank").alias("s"))
    out = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("k").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q")).crossJoin(F.broadcast(tie_sum(all_, value, ["__all"]).select("ties")))  # one row each
    n = F.col("n").cast("double")
    plain = 12 * F.col("q") / (n * (n + 1)) - 3 * (n + 1)
    h = F.try_divide(plain, 1 - F.col("ties") / (n**3 - n))
    return out.select("groups", "n", h.alias("h")).withColumn("p", chi_square_tail("h", (F.col("groups") - 1).cast("double")))


def wilcoxon(df: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """(by..., n, w_plus, w_minus, z, p): the signed-rank sums of differences that aren't 0, the normal deviate of w_plus, corrected for ties, and its two-sided probability."""
    d = df.filter(F.col(difference) != 0).withColumn("__abs", F.abs(difference))
    r = average_ranks(d, "__abs", by)
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(difference) < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    t = tie_sum(d, "__abs", by)
    g = g.join(t, by) if by else g.crossJoin(t)
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return g.select(*by, "n", "w_plus", "w_minus", z.alias("z")).withColumn("p", two_sided("z"))


def calibration(df: DataFrame, confidence: str, right: Column, edges: list[float], keep_empty: bool = False) -> DataFrame:
    """(bin, lo, hi, n, mean_confidence, accuracy) by right-closed bins (lo, hi]; values outside all bins are left out."""
    c = F.col(confidence)
    index = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(itertools.pairwise(edges)))):
        index = F.when((c > lo) & (c <= hi), k).otherwise(index)
    g = df.withColumn("bin", index).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(right.cast("double")).alias("accuracy"))
    bins = df.sparkSession.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in enumerate(itertools.pairwise(edges))], "bin int, lo double, hi double")
    j = F.broadcast(bins).join(g, "bin", "left" if keep_empty else "inner")
    return j.select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def cumulative_shares(df: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """(kind, n, pct, cum_pct) in the given order of kinds."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    g = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).withColumn("__at", place)
    total = F.sum("n").over(W.partitionBy())  # a row for each kind
    return g.select(kind, "n", (100.0 * F.col("n") / total).alias("pct"), (100.0 * F.sum("n").over(W.orderBy("__at")) / total).alias("cum_pct"))


def unanimity(votes: DataFrame, slot: list[str], value: str, replicates: int) -> DataFrame:
    """(slots, unanimous, informative, informative_unanimous): slots with a vote by each replicate whose values are all one, over all and over those with a value."""
    g = votes.groupBy(*slot).agg(F.countDistinct(F.coalesce(F.col(value).cast("string"), F.lit("∅"))).alias("d"), F.count(F.lit(1)).alias("n"), F.count(value).alias("filled"))
    same = (F.col("d") == 1) & (F.col("n") == replicates)
    return g.agg(F.count(F.lit(1)).alias("slots"), F.count_if(same).alias("unanimous"), F.count_if(F.col("filled") > 0).alias("informative"), F.count_if(same & (F.col("filled") > 0)).alias("informative_unanimous"))


def replicate_spread(df: DataFrame, by: list[str], replicate: str, value: str) -> DataFrame:
    """(by..., mean, sd, n): over the means of replicates, the sample deviation."""
    return df.groupBy(*by, replicate).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("n"))


def confidence(validity: Column, evidence: Column, completeness: Column) -> Column:
    """.3 validity, .5 evidence, .2 completeness, to 3 places, half to even."""
    return F.bround(0.3 * validity + 0.5 * evidence + 0.2 * completeness, 3)

"""Fuzzy joins of names by matching blocks, without comparing every pair: a q-gram index with length and prefix filters."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions.text import abbreviated, similarity
from metaloom.session import kept


def _matched(total: int, least: float) -> int:
    """The fewest matched characters of two strings of ``total`` characters whose ratio is ``least`` or more."""
    return math.ceil(round(least * total / 2, 9))


def _shared(total: int, least: float) -> int:
    """A lower bound of their shared bigrams: M matched characters stand in blocks; between two blocks a character is unmatched, so there are total - 2 M + 1 blocks at most, and each has one bigram fewer than characters."""
    m = _matched(total, least)
    return m - (total - 2 * m + 1)


@lru_cache(1 << 16)
def prefixes(n: int, least: float) -> tuple[int, int, int, int]:
    """For a string of n characters: the shortest and longest partner, and how many of its rarest characters and bigrams a partner must share one of; 0 where no partner is met by them."""
    low, high = max(1, math.ceil(round(n * least / (2 - least), 9))), int(round(n * (2 - least) / least, 9))
    singles = pairs = 0
    for m in range(low, high + 1):
        if _matched(n + m, least) > min(n, m):
            continue
        c = _shared(n + m, least)
        if c >= 1:
            pairs = max(pairs, n - 1 - c + 1)
        else:
            singles = max(singles, n - _matched(n + m, least) + 1)
    return low, high, singles, pairs


def _grams(names: DataFrame, least: float) -> DataFrame:
    """(s, n, q, gram) of distinct strings s: characters and bigrams, those of several places numbered, as far as a partner may be met by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for s in b.column(0).to_pylist():
                _, _, singles, pairs = prefixes(len(s), least)
                for q, wanted in ((1, singles), (2, pairs)):
                    if wanted:
                        seen: Counter[str] = Counter()
                        for i in range(len(s) - q + 1):
                            g = s[i : i + q]
                            seen[g] += 1
                            out.append((s, len(s), q, f"{g}{seen[g]}"))
            s, n, q, gram = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(n, pa.int32()), pa.array(q, pa.int32()), pa.array(gram, pa.string())], ["s", "n", "q", "gram"])

    return names.mapInArrow(run, "s string, n int, q int, gram string")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of the strings s of both sides, among them all whose ratio of matching blocks is ``least`` or more.

    Strings of lengths that can't reach it never meet. Of the others both must share some number of grams (bigrams where
    their lengths together ask for one at least, else characters; those of several places count as often); so they
    share one of their rarest, of which each side lists as many as its length asks for. Grams are ordered by how many strings
    hold them, so common ones are rarely listed. Pairs meet by an equality join on a gram; there is no cross join.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    sides = [kept(_grams(x.select("s").distinct(), least)) for x in (left, right)]
    count = kept(sides[0].unionAll(sides[1]).groupBy("q", "gram").agg(F.count(F.lit(1)).alias("f")))

    @F.pandas_udf("array<int>")
    def sizes(n):
        return n.map(lambda k: list(prefixes(int(k), least)))

    def listed(side: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy("s", "q").orderBy("f", "gram")
        ranked = side.join(count, ["q", "gram"]).withColumn("r", F.row_number().over(w)).withColumn("p", sizes(F.col("n")))
        ranked = ranked.filter(F.col("r") <= F.col("p")[F.col("q") + 1])
        return ranked.select("q", "gram", F.col("s").alias(name), F.col("n").alias(f"n_{name}"), F.col("p")[0].alias(f"low_{name}"), F.col("p")[1].alias(f"high_{name}"))

    met = listed(sides[0], "a").join(listed(sides[1], "b"), ["q", "gram"])
    return met.filter("n_b BETWEEN low_a AND high_a").select("a", "b").distinct()


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio) of the pairs that reach ``least``; the characters that both have bound the ratio first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = lru_cache(1 << 12)(Counter)
        for b in batches:
            out = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if abbreviated(x, y) or abbreviated(y, x) or 2 * (bag(x) & bag(y)).total() >= least * (len(x) + len(y)) - 1e-9:
                    r = similarity(x, y)
                    if r >= least:
                        out.append((x, y, r))
            x, y, r = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(r, pa.float64())], ["a", "b", "ratio"])

    return pairs.mapInArrow(run, "a string, b string, ratio double")


def matches(left: DataFrame, right: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, ratio): the distinct names of both sides, lower case and trimmed, whose similarity is ``least`` or more; see functions.text.similarity.

    Null and blank names match nothing. An abbreviated first word ('h. sapiens') meets full names on its letter and what follows, by the
    same index. Each pair of different strings is compared once, however many rows hold them.
    """
    sides = [kept(x.select(F.trim(F.lower(F.col(f"`{name}`"))).alias("s")).filter("s <> ''").distinct()) for x in (left, right)]
    pairs = candidates(*sides, least)
    if least <= 0.95:
        short = [x.filter(F.col("s").rlike(r"^[a-z]\. .")).select("s", F.left("s", F.lit(1)).alias("i"), F.substr("s", F.lit(4)).alias("rest")) for x in sides]
        words = F.split(F.trim(F.regexp_replace("s", r"\s+", " ")), " ")
        long = [x.withColumn("w", words).filter(F.size("w") > 1).select("s", F.left(F.col("w")[0], F.lit(1)).alias("i"), F.array_join(F.slice("w", 2, F.size("w")), " ").alias("rest")) for x in sides]
        for k, (x, y) in enumerate(((short[0], long[1]), (short[1], long[0]))):
            near = candidates(x.select(F.col("rest").alias("s")), y.select(F.col("rest").alias("s")), 0.9).toDF("rest", "__rest")
            met = x.join(near, "rest").join(y.select(F.col("s").alias("__s"), "i", F.col("rest").alias("__rest")), ["i", "__rest"])
            pairs = pairs.unionAll(met.select(*[F.col(c).alias(n) for c, n in zip(("s", "__s") if k == 0 else ("__s", "s"), "ab", strict=True)]))
        pairs = pairs.distinct()
    return _verified(pairs, least)


def best(left: DataFrame, right: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, ratio): of each name on the left the likest on the right; of equal ones the first by name."""
    found = matches(left, right, name, least)
    return found.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("m"), "b")).alias("x")).select("a", F.col("x.b").alias("b"), (-F.col("x.m")).alias("ratio"))

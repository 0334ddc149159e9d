"""Rendezvous hashing of record keys over weighted shards, with gapless slots; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096  # into which each group is dealt for ranking; a group of n rows is ranked n / BUCKETS rows at a time


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, whose weighted score for this key is highest.

    Shard s scores -weight / ln(u) with u in (0, 1) from a hash of key and s, so it wins in proportion to its weight, and a
    further shard takes over exactly those keys for which its own score is highest. Ties go to the larger number.
    """
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and not all 0")

    key = key.cast("string")  # so that a key has one hash, whatever its column's type

    def score(s: int, w: float) -> Column:
        # 52 bits of the hash and a half: never 0 or 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(s).alias("shard"))

    own = [score(s, w) for s, w in enumerate(weights) if w > 0]
    return (own[0] if len(own) == 1 else F.greatest(*own))["shard"]


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: int = BUCKETS, facts: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... over the rows of each group, in an order fixed by a hash of ``order`` and then ``order``.

    Each group is dealt into ``buckets`` by that hash; rows are ranked within buckets, and the counts of the buckets before
    are added, so no task has to hold or sort a whole group. Rows alike in ``order`` share a bucket and get ranks of their own.
    ``facts``: a row for each group, with its columns; they come along with the buckets' counts, so that no group is joined whole.
    """
    b, before = "__bucket", "__before"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(buckets)).cast("int"))
    keys = [F.col(f"`{c}`") for c in group]
    counts = dealt.groupBy(*keys, F.col(b)).agg(F.count(F.lit(1)).alias("__n"))
    alias = [f"__key{i}" for i in range(len(group))]
    upto = (F.sum("__n").over(W.partitionBy(*keys).orderBy(b)) - F.col("__n")).alias(before)
    counts = counts.select(*[k.alias(a) for k, a in zip(keys, alias, strict=True)], F.col(b).alias("__key"), upto)
    if facts is not None:
        own = facts.select(*[F.col(f"`{c}`").alias(f"__of{i}") for i, c in enumerate(group)], *[F.col(f"`{c}`") for c in facts.columns if c not in group])
        counts = counts.join(own, [F.col(a).eqNullSafe(F.col(f"__of{i}")) for i, a in enumerate(alias)]).drop(*[f"__of{i}" for i in range(len(group))])
    on = [k.eqNullSafe(F.col(a)) for k, a in zip(keys, alias, strict=True)] + [F.col(b) == F.col("__key")]
    joined = dealt.join(counts, on).drop(*alias, "__key")
    w = W.partitionBy(*keys, F.col(b)).orderBy(*[F.col(f"`{c}`") for c in order])
    return joined.withColumn(name, F.col(before) + F.row_number().over(w) - 1).drop(b, before)


def shard(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", overhead: int = 8, grown_weight: float | None = None) -> DataFrame:
    """Each record's shard by rendezvous hashing of its key, its slot there, and its shard were one more added.

    Columns: key, size (UTF-8 bytes of the text plus ``overhead``), text_crc32, law ('key'), shard, slot (gapless from 0
    in a shard), grown_shard. The new shard weighs ``grown_weight``, by default the mean of the others. Only keys and
    sizes are shuffled, never texts.

    A null text has no bytes (crc32 0); rows with a null key share one hash, as repeated keys do, and so a shard, each
    with a slot of its own; other columns are dropped, whatever their names; an empty table gives no rows.
    """
    bytes_ = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    more = [*weights, grown_weight if grown_weight is not None else sum(weights) / len(weights)]
    k = F.col(f"`{key}`")
    rows = docs.select(
        k,
        (F.octet_length(bytes_).cast("long") + overhead).alias("size"),
        F.crc32(bytes_).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights).cast("int").alias("shard"),
        rendezvous(k, more).cast("int").alias("grown_shard"),
    )
    out = ranked(rows, ["shard"], [key], "slot")
    return out.select(k, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

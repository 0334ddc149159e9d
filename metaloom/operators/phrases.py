"""Many phrases searched for in many texts: phrases in shards, an automaton for each, texts streamed past them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.session import kept

SHARD = 4 << 20  # characters of phrases in one automaton
BLOCK = 64 << 20  # bytes of text that one automaton reads


def found(phrases: DataFrame, texts: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(id, doc, verbatim): which of ``phrases`` (id, key, written) stand in which of ``texts`` (doc, key, text), and whether also as written.

    Phrases are dealt by a hash of their key into shards of about ``shard`` characters, texts into blocks of about ``block``
    bytes; each shard meets each block in one task. There the phrases come first, from which the automaton is built, and
    then the texts one by one, so a task holds one shard's automaton and one batch of texts, whatever the numbers of
    both. Nothing passes through the driver but two sums. All phrases of one key share a place in the automaton. Keys that
    are null or empty are nowhere.
    """
    p = kept(phrases.select("id", "key", "written").filter("key <> ''"))
    t = texts.select("doc", "key", "text").filter("key <> ''")
    letters = p.select("key").distinct().agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    size = t.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    cores = phrases.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-letters // shard))
    blocks = max(1, -(-size // block), min(cores // shards, -(-size // (1 << 20))))
    # Of each place the phrases sort before the texts.
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = p.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), each.alias("block"), F.lit(0).alias("kind"), F.col("id").alias("id"), F.lit(None).cast(t.schema["doc"].dataType).alias("doc"), "key", F.col("written").alias("text"))
    own = F.pmod(F.xxhash64("doc", F.xxhash64("key")), F.lit(blocks)).cast("int")
    then = t.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), own.alias("block"), F.lit(1).alias("kind"), F.lit(None).cast(p.schema["id"].dataType).alias("id"), "doc", "key", "text")
    both = first.unionByName(then).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "kind")
    kinds = [p.schema["id"].dataType.simpleString(), t.schema["doc"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        place, wanted, search = None, {}, None
        for b in batches:
            types = b.schema.field(3).type, b.schema.field(4).type
            out: list[tuple] = []
            for s, k, kind, i, doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, k) != place:
                    place, wanted, search = (s, k), {}, None
                if kind == 0:
                    wanted.setdefault(key, []).append((i, text))
                    continue
                if search is None and wanted:
                    search = ahocorasick.Automaton()
                    for w in wanted:
                        search.add_word(w, w)
                    search.make_automaton()
                if search is not None:
                    for w in {w for _, w in search.iter(key)}:
                        out += [(i, doc, written is not None and written in text) for i, written in wanted[w]]
            ids, docs, as_written = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, types[0]), pa.array(docs, types[1]), pa.array(as_written, pa.bool_())], ["id", "doc", "verbatim"])

    return both.mapInArrow(run, f"id {kinds[0]}, doc {kinds[1]}, verbatim boolean")

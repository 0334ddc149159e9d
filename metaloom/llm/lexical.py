"""Ranked lexical search over a forward index in blocks, pruned by block maxima."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.llm.common import runs, span_hashes, stored, text_slices, thin

#: Fixed value: a term is a maximal match of this; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_DOCS = 256
BLOCK_POSTINGS = 1 << 15
SLICE_BYTES = 1 << 19  # of texts that are cut into terms at once
FILE_BLOCKS = 32  # in a file of the index, all of which a reader decodes at once
MOST_TERMS = 1 << 16  # of the queries that one pass serves, about
MOST_ITEMS = 1 << 12

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Index:
    """``blocks``: a stored row for each block of documents; ``n`` documents with a term, which have ``length`` terms in all."""

    blocks: DataFrame
    n: int
    length: int


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last + 1, terms in each text, and of each distinct term of a text: the text, hash, occurrences), by text and hash."""
    for lo, hi, data, off in text_slices(column, SLICE_BYTES):
        starts, ends = runs(_TERM_BYTE[data], off)
        h = span_hashes(_LOWER[data], starts, ends)
        text = np.searchsorted(off, starts, "right") - 1
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        yield lo, hi, np.bincount(text, minlength=hi - lo), text[at], h[at], np.diff(np.append(at, len(h)))


def impacts(tf: np.ndarray, sizes: np.ndarray, n: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 size n) div length, in integers."""
    if 90 * n * int(sizes.max(initial=0)) < 1 << 63:
        m = 10 + (90 * sizes.astype(np.int64) * n) // max(length, 1)
    else:
        m = np.array([10 + 90 * int(s) * n // length for s in sizes], np.int64)
    return (10**9 * tf) // (1000 * tf + 8 * m)


def _lists(flat, counts) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat if isinstance(flat, pa.Array) else pa.array(flat))


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> Index:
    """A forward index of all documents, stored once for any number of searches.

    A block holds up to ``block_docs`` documents that a task reads one after another, with up to ``block_postings`` distinct
    terms of documents (a longer document is a block of its own). Its row: block, ids, terms (hashes, ascending), tops (each
    term's largest impact in the block), counts (its documents here), firsts, places and impacts (of each document its terms
    by place in ``terms``, and their impacts). Documents are counted first, with built-in functions, since impacts depend
    on the mean length. No shuffle.

    Terms are known by 64-bit hashes: a term of a search is taken for another one with probability 2^-64 for each
    pair. Null texts have no terms, and documents without terms are in no block. Null and repeated ids, and repeated rows,
    are documents of their own. Other columns are not read, whatever their names. An empty table gives an empty index.
    """
    text = F.col(f"`{text_col}`").cast("string")
    size = F.regexp_count(text, F.lit(TERM)).cast("long")
    n, length = docs.select(size.alias("s")).agg(F.coalesce(F.sum(F.when(F.col("s") > 0, 1).otherwise(0)), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, terms array<long>, tops array<int>, counts array<int>, firsts array<int>, places array<int>, impacts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for b in thin(batches, 4 * block_docs):
            for lo, hi, sizes, text, h, tf in terms(b.column(1)):
                impact = impacts(tf, sizes[text], n, length)
                per = np.bincount(text, minlength=hi - lo)
                upto = np.concatenate([[0], np.cumsum(per)])
                rows, first = [], 0
                while first < hi - lo:
                    last = min(first + block_docs, int(np.searchsorted(upto, upto[first] + block_postings, "right")) - 1)
                    last = max(last, first + 1)
                    own = first + np.flatnonzero(per[first:last])
                    s = slice(upto[first], upto[last])
                    if len(own):
                        t, place = np.unique(h[s], return_inverse=True)
                        order = np.argsort(place, kind="stable")
                        counts = np.bincount(place)
                        tops = np.maximum.reduceat(impact[s][order], np.cumsum(counts) - counts)
                        rows.append((own + lo, t, tops, counts, np.cumsum(per[own]) - per[own], place, impact[s]))
                    first = last
                if rows:
                    cols = list(zip(*rows, strict=True))
                    count = [[len(x) for x in c] for c in cols]
                    flat = [np.concatenate(c) for c in cols]
                    cells = [pa.array(number + np.arange(len(rows)), pa.int64()), _lists(b.column(0).take(pa.array(flat[0])), count[0]), _lists(flat[1].view(np.int64), count[1])]
                    cells += [_lists(f.astype(np.int32), c) for f, c in zip(flat[2:], count[2:], strict=True)]
                    number += len(rows)
                    yield pa.RecordBatch.from_arrays(cells, ["block", "ids", "terms", "tops", "counts", "firsts", "places", "impacts"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return Index(stored(rows.mapInArrow(run, schema), "lexical", FILE_BLOCKS), int(n), int(length))


class _Asked:
    """The searches of one pass: their distinct terms ascending, and for each search its terms' places there and weights."""

    def __init__(self, wanted: list[np.ndarray]):
        self.terms = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
        self.places = [np.searchsorted(self.terms, np.unique(t)) for t in wanted]

    def weigh(self, df: np.ndarray, n: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        self.places = [p[w[p] > 0] for p in self.places]
        self.weights = [w[p] for p in self.places]
        # By term: the searches that hold it, for bounds.
        size = [len(p) for p in self.places]
        flat = np.concatenate([*self.places, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.by_term = np.repeat(np.arange(len(size)), size)[order]
        self.by_weight = np.concatenate([*self.weights, np.zeros(0, np.int64)])[order]
        self.first = np.searchsorted(flat[order], np.arange(len(self.terms) + 1))


def _column(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, firsts with an end) of a column of lists."""
    c = b.column(b.schema.get_field_index(name))
    return c.values.to_numpy(), c.offsets.to_numpy()


def _matches(asked: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``own`` of terms that are asked for, and their places in ``asked``; both ascending without repeats."""
    at = np.minimum(np.searchsorted(asked, own), max(len(asked) - 1, 0))
    hit = np.flatnonzero(asked[at] == own) if len(asked) else np.zeros(0, np.int64)
    return hit, at[hit]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... ``count`` numbers for each, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _frequencies(blocks: DataFrame, asked: _Asked) -> np.ndarray:
    """Documents that hold each asked term: summed in each task, then over tasks; one number a term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.terms), np.int64)
        for b in batches:
            (t, off), (c, _) = _column(b, "terms"), _column(b, "counts")
            for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                hit, at = _matches(asked.terms, t[lo:hi].view(np.uint64))
                total[at] += c[lo:hi][hit]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "df"])

    df = np.zeros(len(asked.terms), np.int64)
    for t, n in blocks.select("terms", "counts").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df")).collect():
        df[t] = n
    return df


class _Block:
    """Postings of the asked terms of one block, by term."""

    def __init__(self, hit, at, firsts, places, impact, postings):
        docs = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, postings)))
        wanted = np.full(int(places.max(initial=0)) + 1, -1)
        wanted[hit] = np.arange(len(hit))
        own = wanted[places]
        keep = np.flatnonzero(own >= 0)
        keep = keep[np.argsort(own[keep], kind="stable")]
        self.terms, self.docs, self.impacts, self.n = at, docs[keep], impact[keep].astype(np.int64), len(firsts)
        self.first = np.searchsorted(own[keep], np.arange(len(hit) + 1))

    def scores(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.terms, places), len(self.terms) - 1)
        has = self.terms[k] == places
        k, w = k[has], weights[has]
        count = self.first[k + 1] - self.first[k]
        at = _spread(self.first[k], count)
        # Sums stay far below 2^53, so doubles hold them exactly.
        return np.bincount(self.docs[at], self.impacts[at] * np.repeat(w, count), minlength=self.n).astype(np.int64)


def _order(row: tuple) -> tuple:
    """Highest score first, then the smallest id, null ids last."""
    score, doc = row
    return (-score, doc is None, doc if doc is not None else 0)


def _searched(blocks: DataFrame, asked: _Asked, least: list[int], k: int, best_only: bool, kind: str) -> DataFrame:
    """(q, doc, score, scored) of the ``k`` best documents for each search among those a task reads.

    Up to FILE_BLOCKS blocks of an Arrow batch are sorted by their bound for a search and scored until the bound drops below ``least`` of
    the search and the k-th score so far; with ``best_only`` just the first is. ``scored`` counts the task's blocks scored for q.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in least]
        scored = [0] * len(least)
        id_type = None
        for b in thin(batches, FILE_BLOCKS):
            ids = b.column(b.schema.get_field_index("ids"))
            id_type = ids.type.value_type
            (t, t_off), (tops, _) = _column(b, "terms"), _column(b, "tops")
            (firsts, f_off), (places, p_off), (impact, _) = _column(b, "firsts"), _column(b, "places"), _column(b, "impacts")
            bounds, matched, made = np.zeros((b.num_rows, len(least))), [], {}
            for r in range(b.num_rows):
                s = slice(t_off[r], t_off[r + 1])
                hit, at = _matches(asked.terms, t[s].view(np.uint64))
                matched.append((hit, at))
                count = asked.first[at + 1] - asked.first[at]
                e = _spread(asked.first[at], count)
                bounds[r] = np.bincount(asked.by_term[e], asked.by_weight[e] * np.repeat(tops[s][hit].astype(np.int64), count), minlength=len(least))
            order = np.argsort(-bounds, axis=0, kind="stable")
            for q, rows in enumerate(order.T.tolist()):
                own = found[q]
                for r in rows[:1] if best_only else rows:
                    bound = bounds[r, q]
                    floor = max(least[q], own[-1][0] if len(own) == k else 1)
                    if bound < floor:
                        break
                    if r not in made:
                        made[r] = _Block(*matched[r], firsts[f_off[r] : f_off[r + 1]], places[p_off[r] : p_off[r + 1]], impact[p_off[r] : p_off[r + 1]], p_off[r + 1] - p_off[r])
                    scored[q] += 1
                    s = made[r].scores(asked.places[q], asked.weights[q])
                    good = np.flatnonzero(s >= floor)
                    if len(good) > k:
                        good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
                    if len(good):
                        docs = ids[r].values.take(pa.array(good)).to_pylist()
                        own += zip(s[good].tolist(), docs, strict=True)
                        own.sort(key=_order)
                        del own[k:]
        if id_type is not None:
            flat = [(q, doc, score, scored[q]) for q, own in enumerate(found) for score, doc in own]
            q, doc, score, blocks_scored = zip(*flat, strict=True) if flat else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64()), pa.array(blocks_scored, pa.int64())], ["q", "doc", "score", "scored"])

    return blocks.drop("block", "counts").mapInArrow(run, f"q int, doc {kind}, score long, scored long")


def _asked_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item, terms) of each item with terms, stored, so that numbers of items stay as they are."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, hi, _, text, h, _ in terms(b.column(1)):
                count = np.bincount(text, minlength=hi - lo)
                own = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(own)), pa.int64()), b.column(0).take(pa.array(own + lo)), _lists(h.view(np.int64), count[own])], ["q", "item", "terms"])
                number += len(own)

    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"q long, item {kind}, terms array<long>"), "searches")


def search(found: Index, items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 10, most_terms: int = MOST_TERMS, most_items: int = MOST_ITEMS) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item, rank (from 1), doc, score, scored.

    A term in df of the N documents weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums weight times
    impact (see ``impacts``) over the item's distinct terms. Equal scores go by ascending id, null ids last.

    Items are served in passes of about ``most_terms`` distinct terms and ``most_items`` items, which every task receives. A
    pass reads the index three times: term counts (two columns); the block of the highest bound of each FILE_BLOCKS that a task reads,
    whose scores give every item a least score that k documents reach; and all blocks by falling bound while that isn't below
    the least score and the task's own k-th score. A bound is the sum of weights times block maxima, so no document is
    missed. ``scored`` counts the blocks that the document's task scored for the item. Only tops are shuffled: k for each
    item and task.

    Each row of ``items`` is searched on its own, repeated ones again. Items without terms (null, empty) or without a
    document that scores give no rows. Other columns are not read, whatever their names.
    """
    spark = items.sparkSession
    asked_rows = _asked_rows(items, id_col, text_col)
    rows, size = asked_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    passes = max(1, -(-size // most_terms), -(-rows // most_items))
    blocks, item_kind = found.blocks, items.schema[id_col].dataType.simpleString()
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item {item_kind}, rank int, doc {kind}, score long, scored long")
    for part in range(passes):
        own = asked_rows.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == part).sort("q").collect()
        if not own:
            continue
        asked = _Asked([np.array(r.terms, np.int64).view(np.uint64) for r in own])
        asked.weigh(_frequencies(blocks, asked), found.n)
        tops = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        first = _searched(blocks, asked, [1] * len(own), k, True, kind)
        ranked = first.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") == k)
        least = dict(ranked.select("q", "score").collect())
        best = _searched(blocks, asked, [least.get(q, 1) for q in range(len(own))], k, False, kind)
        best = best.withColumn("rank", F.row_number().over(tops)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item) for q, r in enumerate(own)], f"q int, item {item_kind}")
        out = out.unionByName(best.join(F.broadcast(names), "q").select("item", "rank", "doc", "score", "scored"))
    return out

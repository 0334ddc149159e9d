"""N-gram Jaccard self-join: a MinHash LSH forest finds candidate groups, and exact Jaccard of all their pairs verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.llm.common import discard, fresh, lower, mix64, random_table, repeats, shingles, stored, text_slices, thin, word_hashes
from metaloom.llm.graph import components

CHUNK = 4096  # members of a subtree that one task compares
HEAVY = 2000  # copies of a class that one task joins
MOST_HEAVY = 16_384  # classes of more copies than that
BLOCK = 768  # members of a group that are held as one side of a comparison
BLOCK_HASHES = 1 << 19  # and their shingles, but for the last member's


def planted_prefixes(samples: list[np.ndarray], trees: int, longest: int, threshold: float, variants: int = 4, seed: int = 17) -> np.ndarray:
    """(pairs, trees): the length of the prefix that pairs of sets of likeness ``threshold`` have in common in each tree.

    The pairs are the sampled sets and ``variants`` copies of each, in which as many values are replaced as bring the
    likeness to the threshold, or just above: the hardest pairs that a join has to find.
    """
    rng, sets = np.random.default_rng(seed), []
    for h in samples:
        n = len(h)
        out = int(n * (1 - threshold) / (1 + threshold))
        if not out:
            continue
        for _ in range(variants):
            new = mix64(rng.integers(1, 1 << 63, out).astype(np.uint64))
            sets += [h, np.concatenate([rng.permutation(h)[out:], new])]
    if not sets:
        return np.zeros((0, trees), np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = signatures(np.concatenate(sets), first, trees * longest).reshape(-1, 2, longest, trees)
    same = np.logical_and.accumulate(sig[:, 0] == sig[:, 1], axis=1)
    return same.sum(axis=1)


def forest_depth(prefixes: np.ndarray, trees: int, threshold: float, recall: float, longest: int) -> int:
    """The longest prefix, at most ``longest``, at which the planted pairs meet in one of ``trees`` tries with probability ``recall`` at least.

    Matching starts at full labels and is shortened value by value. A pair meets in a tree at length k if it has k values
    in common there; with p the share of pairs and trees in which it does, it meets in one tree at least with probability 1 -
    (1 - p) ** trees. Without planted pairs p is threshold ** k, what minima give in the mean.
    """
    for k in range(longest, 0, -1):
        p = float((prefixes >= k).mean()) if prefixes.size else threshold**k
        if 1 - (1 - p) ** trees >= recall:
            return k
    raise ValueError("not reached even with prefixes of one value; take more trees")


def signatures(h: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit minima of each text's shingle hashes under random multiply-and-add maps; texts without shingles have the largest value."""
    n = len(first) - 1
    out = np.full((n, count), np.uint32(0xFFFFFFFF))
    has = np.flatnonzero(np.diff(first))
    if not len(has):
        return out
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (h >> np.uint64(32)).astype(np.uint32)
    at = first[:-1][has]
    mult = (random_table(count, 101) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    tmp = np.empty_like(low)
    for k in range(count):
        # Two independent halves of the hash, so that maps differ in more than an odd factor.
        np.multiply(low, mult[k], out=tmp)
        tmp ^= high if k % 2 else (high >> np.uint32(7)) | (high << np.uint32(25))
        tmp *= np.uint32(0x9E3779B1)
        tmp ^= tmp >> np.uint32(15)
        tmp *= mult[-1 - k]
        out[has, k] = np.minimum.reduceat(tmp, at)
    return out


def distinct_sorted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, and each text's first one, with an end."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.searchsorted(text[keep], np.arange(len(first)))


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    column = lower(column.cast(pa.large_string()))
    for lo, hi, data, off in text_slices(column, 1 << 20):
        yield lo, hi, *distinct_sorted(*shingles(*word_hashes(data, off), width))


def _long_list(values: np.ndarray, first: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64) if kind == pa.int64() else values))


def _sample(base: DataFrame, width: int, rows: int, most: int) -> list[np.ndarray]:
    """The ``most`` smallest shingle hashes of each of at most ``rows`` texts, those of the smallest id hashes."""
    picked = base.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, first in _sets(b.column(1), width):
                own = [h[first[i] : first[i + 1]][:most].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], ["id", "hashes"])

    found = base.join(F.broadcast(picked), "id").mapInArrow(run, "id long, hashes binary").groupBy("id").agg(F.min("hashes").alias("h"))
    return [np.frombuffer(r["h"], np.uint64) for r in sorted(found.collect(), key=lambda r: r["id"])]


def signed(docs: DataFrame, width: int, trees: int, depth: int, longest: int, kept: int = 240) -> DataFrame:
    """(id, set_a, set_b, n, tries, rests, minima): a 128-bit digest of each text's shingle set, its size, and its labels.

    A tree's label is ``longest`` minima: ``tries`` holds the hash of the first ``depth`` of them, under which a subtree of the
    trie is known, and ``rests`` the next two as one long, by which labels are sorted in it. ``minima``: the low
    bytes of the first ``kept`` minima, to estimate likeness from.
    """
    salt = random_table(trees, 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            for lo, hi, h, first in _sets(b.column(1), width):
                n = np.diff(first)
                has = np.flatnonzero(n)
                digest = np.zeros((2, hi - lo), np.uint64)
                if len(has):
                    for k in (0, 1):
                        digest[k, has] = np.add.reduceat(mix64(h + np.uint64(k + 1)), first[:-1][has])
                sig = signatures(h, first, trees * longest)
                key = np.zeros((hi - lo, trees), np.uint64)
                for k in range(depth):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * trees : (k + 1) * trees].astype(np.uint64))
                key = mix64(key + salt)
                rest = np.zeros((hi - lo, trees), np.uint64)
                for k in range(depth, min(longest, depth + 2)):
                    rest = rest << np.uint64(32) | sig[:, k * trees : (k + 1) * trees].astype(np.uint64)
                at = np.arange(hi - lo + 1) * trees
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.array(n.astype(np.int32)),
                        _long_list(key.ravel(), at),
                        _long_list(rest.ravel(), at),
                        pa.array([r.tobytes() for r in sig[:, :kept].astype(np.uint8)], pa.binary()),
                    ],
                    ["id", "set_a", "set_b", "n", "tries", "rests", "minima"],
                )

    return docs.mapInArrow(run, "id long, set_a long, set_b long, n int, tries array<long>, rests array<long>, minima binary")


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _subtree_links(same: float, near: float):
    """For the members of many small subtrees, or of a part of a large one: links that join whatever may be alike, and of large ones the leaders left.

    The members are sorted by label, so that those with a longer prefix in common stand together. Runs of the full label
    are compared first; the prefix is then shortened value by value, down to the subtree's own, and at each length only the
    leaders of the longer runs meet. Leaders are taken one by one: a member estimated at ``same`` or more with one is linked
    to it and done; members at ``near`` or more are linked and stay.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, bucket, parts = (t.column(c).to_numpy() for c in ("id", "bucket", "parts"))
        rest = t.column("rest").to_numpy().view(np.uint64)
        order = np.lexsort((ids, rest, bucket))
        ids, bucket, parts, rest = ids[order], bucket[order], parts[order], rest[order]
        sig = np.frombuffer(b"".join(t.column("minima").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(first, len(ids)))
        # Most subtrees hold two members: those are compared all at once.
        two = first[(size == 2) & (parts[first] == 1)]
        like = np.concatenate([(sig[two[k : k + 8192]] == sig[two[k : k + 8192] + 1]).mean(axis=1) for k in range(0, len(two), 8192)]) if len(two) else np.zeros(0)
        x, y = (two + 1)[like >= near], two[like >= near]
        a, b, leads = [ids[x]], [ids[y]], []

        def leaders(left: np.ndarray, forest: Forest, start: int) -> list[int]:
            out = []
            while len(left):
                lead, others = left[0], left[1:]
                out.append(int(lead))
                like = (sig[others] == sig[lead]).mean(axis=1) if len(others) else np.zeros(0)
                new = [x for x in others[like >= near].tolist() if forest.link(x - start, int(lead) - start)]
                a.append(ids[new])
                b.append(np.full(len(new), ids[lead]))
                left = others[like < same]
            return out

        for start, n in zip(first[(size > 2) | (parts[first] > 1)].tolist(), size[(size > 2) | (parts[first] > 1)].tolist(), strict=True):
            forest, now = Forest(n), np.arange(start, start + n)
            for bits in (0, 32, 64):
                label = rest[now] >> np.uint64(bits) if bits < 64 else np.zeros(len(now), np.uint64)
                runs = np.split(now, np.flatnonzero(np.diff(label.view(np.int64))) + 1)
                now = np.array(sorted(x for r in runs for x in (leaders(r, forest, start) if len(r) > 1 else r.tolist())), np.int64)
            if parts[start] > 1:
                leads.append(now)
        lead = np.concatenate(leads) if leads else np.zeros(0, np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        columns = [np.concatenate([np.zeros(len(a), np.int64), bucket[lead]]), np.concatenate([a, ids[lead]]), np.concatenate([b, np.full(len(lead), -1)]), np.concatenate([np.zeros(len(a), bool), np.ones(len(lead), bool)])]
        return pa.table([pa.array(c) for c in columns], ["bucket", "a", "b", "lead"])

    return run


def _block_links(near: float):
    """Links that span what is alike between two blocks of leaders, sides 0 and 1, or within one block, where there is no side 1."""

    def run(t: pa.Table) -> pa.Table:
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        sig = np.frombuffer(b"".join(t.column("minima").to_pylist()), np.uint8).reshape(len(ids), -1)
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, forest = [], Forest(len(ids))
        for i, r in enumerate(rows.tolist()):
            others = cols if len(cols) else rows[i + 1 :]
            like = (sig[others] == sig[r]).mean(axis=1) if len(others) else np.zeros(0)
            links += [(ids[x], ids[r]) for x in others[like >= near].tolist() if forest.link(x, r)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def subtree_links(members: DataFrame, sizes: DataFrame, same: float, near: float) -> DataFrame:
    """Links (a, b) between members (bucket, id, rest, minima) of the same subtree; sizes: (bucket, size).

    A subtree of up to CHUNK members is one task's, with others. Larger ones are compared in parts of about CHUNK; the leaders that
    the parts leave then meet block against block, all of them, in one further round that drops none. So two members that
    are alike are linked through their leaders, of which there is one on each side at most: 1 - Jaccard is a distance, and
    the leaders are no further apart than 2 * (1 - same) plus the pair. Nothing depends on leaders getting fewer: L of them
    make (L / CHUNK) ** 2 / 2 tasks of bounded size, and each leader is sent to L / CHUNK of those.
    """
    part = members.join(sizes.select("bucket", F.ceil(F.col("size") / CHUNK).alias("parts")), "bucket")
    # Small subtrees share tasks of about CHUNK members.
    batches = max(1, sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // CHUNK)
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("bucket"), F.lit(batches))).otherwise(F.xxhash64("bucket", F.pmod(F.xxhash64("id"), F.col("parts"))))
    dealt = part.select("bucket", "id", "rest", "minima", "parts", task.alias("task"), (F.col("parts") > 1).alias("large"))
    out = stored(dealt.groupBy("large", "task").applyInArrow(_subtree_links(same, near), "bucket long, a long, b long, lead boolean"), "links")
    links = out.filter("not lead").select("a", "b")
    large = sizes.filter(F.col("size") > CHUNK).select("bucket")
    if large.isEmpty():
        return links
    lead = stored(out.filter("lead").select("bucket", F.col("a").alias("id")).join(large, "bucket", "left_semi"), "leads")
    blocks = lead.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("blocks"))
    placed = lead.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks").cast("long")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("bucket", "id", low.alias("low"), high.alias("high"), F.when((low != high) & (F.col("block") == high), 1).otherwise(0).alias("side"))
    # In one subtree a member stands once, so (bucket, id) finds its minima.
    met = met.join(members.select("bucket", "id", "minima").dropDuplicates(["bucket", "id"]), ["bucket", "id"])
    more = stored(met.groupBy("bucket", "low", "high").applyInArrow(_block_links(near), "a long, b long"), "links")
    return links.unionAll(more)


def blocks_met(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(id, component, low, high, side): the members of large components, once for each pair of blocks of their component that met in a trie.

    Members are put in order by component, the subtree of their first tree, and id, and cut into blocks of BLOCK members, or
    of BLOCK_HASHES shingles (``cost`` is a member's part of a block, times BLOCK); so those alike in that tree stand together. Two blocks meet if a subtree of any tree holds members of both; each block
    meets itself.
    """
    ordered = groups.repartitionByRange("component", "key", "id").sortWithinPartitions("component", "key", "id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for c, cost in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                last, n = c, (n if c == last else 0)
                at.append(n)
                n += cost
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([task] * len(at), pa.int32()), pa.array(at, pa.int64())], ["id", "component", "cost", "task", "at"])

    # Stored, as ranges are cut from a sample that a second run need not draw alike.
    spread = stored(ordered.select("id", "component", "cost").mapInArrow(number, "id long, component long, cost long, task int, at long"), "places")
    # What of a component stands in the tasks before: a row for each task that holds some of it.
    n = spread.groupBy("component", "task").agg(F.sum("cost").alias("n"))
    before = n.select(F.col("component").alias("__c"), F.col("task").alias("__t"), (F.sum("n").over(W.partitionBy("component").orderBy("task")) - F.col("n")).alias("before"))
    place = spread.join(before, (F.col("component") == F.col("__c")) & (F.col("task") == F.col("__t")))
    placed = stored(place.select("id", "component", F.floor((F.col("before") + F.col("at")) / BLOCK).cast("int").alias("block")), "blocks")
    held = members.select("bucket", "id").join(placed, "id").select("bucket", "component", "block").distinct()
    sets = held.groupBy("bucket", "component").agg(F.array_sort(F.collect_set("block")).alias("bs")).filter(F.size("bs") > 1)
    pairs = sets.select("component", "bs", F.explode("bs").alias("low")).select("component", "low", F.explode(F.filter("bs", lambda x: x > F.col("low"))).alias("high")).distinct()
    pairs = stored(pairs.unionAll(placed.select("component", F.col("block").alias("low"), F.col("block").alias("high")).distinct()), "met")
    pairs = pairs.withColumnRenamed("component", "__c")
    end = lambda c, side: placed.join(pairs.filter("low <> high") if side else pairs, (F.col("component") == F.col("__c")) & (F.col("block") == F.col(c))).select("id", "component", "low", "high", F.lit(side).alias("side"))
    return end("low", 0).unionAll(end("high", 1))


def _pairs_within(ids, weight, n, values, first, rows, cols, threshold, forest, count, copies):
    """Adds the exact links between members ``rows`` and ``cols`` (equal, or disjoint) of one group."""
    same = rows is cols
    all_ = rows if same else np.concatenate([rows, cols])
    size = n[all_]
    text = np.repeat(np.arange(len(all_)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[all_], size)
    _, number, df = np.unique(values[at], return_inverse=True, return_counts=True)
    k = len(rows)
    shared = np.zeros((k, len(cols)), np.float32)
    # Frequent shingles by a dense product, in strips; the others, in few texts each, pair by pair.
    often = df > max(8, len(all_) // 64)
    if often.any():
        column = np.cumsum(often) - 1
        keep = often[number]
        text_f, col_f = text[keep], column[number[keep]]
        width = int(often.sum())
        for lo in range(0, width, 2048):
            m = np.zeros((len(all_), min(2048, width - lo)), np.float32)
            part = (col_f >= lo) & (col_f < lo + 2048)
            m[text_f[part], col_f[part] - lo] = 1
            shared += m[:k] @ (m.T if same else m[k:].T)
    keep = ~often[number] & (df[number] > 1)
    order = np.argsort(number[keep], kind="stable")
    t, s = text[keep][order], number[keep][order]
    for step in range(1, int(df[~often].max(initial=0))):
        if step >= len(s):
            break
        i = np.flatnonzero(s[step:] == s[:-step])
        x, y = t[i], t[i + step]
        if same:
            np.add.at(shared, (x, y), 1)
            np.add.at(shared, (y, x), 1)
        else:
            cross = (x < k) != (y < k)
            x, y = np.minimum(x, y)[cross], np.maximum(x, y)[cross] - k
            np.add.at(shared, (x, y), 1)
    union = n[rows][:, None] + n[cols][None, :] - shared
    hit = shared >= threshold * union - 1e-6 * union
    if same:
        np.fill_diagonal(hit, False)
    count[rows] += hit.sum(axis=1)
    copies[rows] += hit @ weight[cols]
    if not same:
        count[cols] += hit.sum(axis=0)
        copies[cols] += hit.T @ weight[rows]
    # A spanning set of the links: each member's first link, then whatever still joins two trees.
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        near = np.flatnonzero(hit[i])
        forest.link(int(rows[i]), int(cols[near[0]]))
    roots_r = np.array([forest.root(int(x)) for x in rows])
    roots_c = np.array([forest.root(int(x)) for x in cols])
    if len(np.unique(np.concatenate([roots_r, roots_c]))) > 1:
        x, y = np.nonzero(hit & (roots_r[:, None] != roots_c[None, :]))
        for i, j in zip(rows[x].tolist(), cols[y].tolist(), strict=True):
            forest.link(i, j)


def shingled(texts: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            for lo, hi, h, first in _sets(b.column(1), width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _long_list(h, first)], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes array<long>")


def _verify(threshold: float):
    """Exact links in one task's groups: rows (grp, side, id, weight, hashes); side 0 meets itself, or side 1 if there is one."""

    def run(t: pa.Table) -> pa.Table:
        ids, grp, side = (t.column(c).to_numpy() for c in ("id", "grp", "side"))
        weight = t.column("weight").to_numpy().astype(np.float64)
        column = t.column("hashes").combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        at = column.offsets.to_numpy().astype(np.int64)
        n, first, values = np.diff(at), at[:-1], column.values.to_numpy().view(np.uint64)
        forest, count, copies = Forest(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.float64)
        order = np.argsort(grp, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            rows, cols = members[side[members] == 0], members[side[members] == 1]
            _pairs_within(ids, weight, n, values, first, rows, cols if len(cols) else rows, threshold, forest, count, copies)
        root = np.array([forest.root(i) for i in range(len(ids))], np.int64)
        return pa.table({"id": pa.array(ids), "to": pa.array(ids[root]), "texts": pa.array(count), "docs": pa.array(copies.astype(np.int64))})

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, trees: int = 40, longest: int = 8, recall: float = 0.99995, sample_rows: int = 256
) -> DataFrame:
    """Each document's group of near-duplicates and its number of links.

    Two texts are linked if the Jaccard likeness of their sets of ``width``-word shingles (lower case; words are runs of
    letters and digits; a text of fewer words is one shingle) is ``threshold`` or more. Columns: id_col, class_id (the
    smallest id in the connected component of links), copy_id (the smallest id with the same shingle set), n_links (other
    documents linked, copies counted), n_text_links (linked classes of other shingle sets).

    Texts with the same set are one class from the start, so copies are never paired. A class has a MinHash label of
    ``longest`` values in each of ``trees`` tries. Prefixes are shortened until pairs planted at the threshold into
    ``sample_rows`` texts meet with probability ``recall`` (``forest_depth``). Within each subtree of that depth, sorted by
    label, longer prefixes are matched first (``subtree_links``); members are linked unless their minima speak clearly
    against it, and the components of those links are the candidate groups. Pairs of a group are then compared
    exactly: all of a group of up to BLOCK classes and BLOCK_HASHES shingles, and of larger ones all pairs of blocks that met in
    a trie. Each class's shingles are hashed once, and their hashes alone go to the tasks, so a task's memory is bounded by those of
    two blocks and of its longest text. No pair becomes a row: only counts and a spanning tree leave a task.

    Texts without words, null ones among them, have no likeness: they are linked to none and alone in their class. Rows
    with a null id are left out; repeated ids count as one document each and share the results of their id; other columns
    are dropped, whatever their names; an empty table gives no rows.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).filter("id is not null")
    depth = forest_depth(planted_prefixes(_sample(base, width, sample_rows, 256), trees, longest, threshold), trees, threshold, recall, longest)
    sig = stored(signed(base, width, trees, depth, longest), "signed")
    sets = sig.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets, "sets")
    # Minima and labels of the class's first document; a repeated id has one row here.
    reps = sig.filter("n > 0").join(sets.select(F.col("rep")), F.col("id") == F.col("rep"), "left_semi")
    repeated = repeats(base)
    reps = stored((reps.dropDuplicates(["id"]) if repeated else reps).select("id", "n", "tries", "rests", "minima"), "reps")
    tries = reps.select("id", F.explode(F.arrays_zip("tries", "rests")).alias("t")).select("id", F.col("t.tries").alias("bucket"), F.col("t.rests").alias("rest"))
    sizes = tries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = tries.join(sizes, "bucket").select("bucket", "id", "rest").join(reps.select("id", "minima"), "id")
    members, sizes = stored(members, "members"), stored(sizes, "sizes")
    # At most 0.08 to a leader on either side and 0.2 between: leaders are alike by 0.64 or more, and near leaves room for the estimates' errors.
    links = subtree_links(members, sizes, same=0.92, near=0.45)
    found = stored(components(links), "groups")
    # A member costs as much of a block as the larger of its shares in the members and in the shingles.
    cost = F.greatest(F.lit(1), F.ceil(F.col("n") * BLOCK / F.lit(BLOCK_HASHES))).cast("long")
    keyed = reps.select("id", F.element_at("tries", 1).alias("key"), cost.alias("cost"))
    groups = stored(found.join(keyed, F.col("node") == F.col("id")).select("id", "component", "key", "cost"), "costs")
    size = groups.groupBy(F.col("component").alias("__c")).agg(F.sum("cost").alias("size"))
    groups = stored(groups.join(size, F.col("component") == F.col("__c")).drop("__c"), "groups")
    weights = sets.select(F.col("rep").alias("__w"), F.col("copies").alias("weight")).groupBy("__w").agg(F.max("weight").alias("weight"))
    # Small groups share tasks; a large one has a task for each pair of its blocks that met.
    batch = max(1, (groups.agg(F.sum("cost")).first()[0] or 0) // (2 * BLOCK))
    small = groups.filter(F.col("size") <= BLOCK)
    met = small.select("id", F.col("component").alias("grp"), F.pmod(F.xxhash64("component"), F.lit(batch)).alias("task"), F.lit(0).alias("side"), F.lit(False).alias("large"))
    large = groups.filter(F.col("size") > BLOCK)
    if not large.isEmpty():
        pairs = blocks_met(large, members)
        met = met.unionAll(pairs.select("id", F.col("component").alias("grp"), F.xxhash64("component", "low", "high").alias("task"), "side", F.lit(True).alias("large")))
    met = met.join(weights, F.col("id") == F.col("__w")).drop("__w")
    texts = base.groupBy("id").agg(F.min("text").alias("text")) if repeated else base
    held = stored(shingled(texts.join(groups.select("id"), "id", "left_semi"), width), "shingles")
    done = met.join(held, "id").groupBy("large", "task").applyInArrow(_verify(threshold), "id long, to long, texts long, docs long")
    done = stored(done, "verified")
    for t in (members, held, reps):
        discard(docs.sparkSession, t)
    links = components(done.filter("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "__n")
    counts = done.groupBy(F.col("id").alias("__c")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    own = sets.join(links, F.col("rep") == F.col("__n"), "left").join(counts, F.col("rep") == F.col("__c"), "left")
    own = own.select(F.col("set_a").alias("__a"), F.col("set_b").alias("__b"), "rep", "copies", F.coalesce("component", "rep").alias("class"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    # Classes of very many copies, of which there are MOST_HEAVY at most, meet their documents by broadcast; the others by the set.
    rows, same = sig.select("id", "set_a", "set_b", "n"), (F.col("n") > 0) & (F.col("set_a") == F.col("__a")) & (F.col("set_b") == F.col("__b"))
    heavy = max(HEAVY, -(-(sets.agg(F.sum("copies")).first()[0] or 0) // MOST_HEAVY))
    own = stored(own, "classes")
    hot = own.filter(F.col("copies") > heavy)
    out = rows.join(own, same, "left")
    if not hot.isEmpty():
        keys = F.broadcast(hot.select("__a", "__b"))
        out = rows.join(F.broadcast(hot), same).unionByName(rows.join(keys, same, "left_anti").join(own.filter(F.col("copies") <= heavy), same, "left"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("class", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("copy_id"),
        F.coalesce(F.col("copies") - 1 + F.col("docs"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("texts"), F.lit(0)).cast("long").alias("n_text_links"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group of near-duplicates; of a repeated id one row, and all rows with a null id."""
    key, *_ = fresh(docs.columns, "__first")
    first = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter(F.col(id_col) == F.col("class_id")).select(F.col("class_id").alias(key))
    kept = docs.join(first, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_semi")
    if repeats(docs.select(F.col(f"`{id_col}`").alias("id")).filter("id is not null")):
        kept = kept.dropDuplicates([id_col])
    return kept.unionAll(docs.filter(F.col(f"`{id_col}`").isNull()))

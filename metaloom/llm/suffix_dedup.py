"""Removal of byte strings that stand in several places, by suffix sorting: shallow multikey quicksort, then blind tries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import _BYTE, _STEP, discard, mix64, repeats, stored, text_slices, thin

GRAM = 32  # bytes of an anchor
SHALLOW = 32  # bytes to which quicksort goes, a multiple of 8
CHUNK = 1 << 21  # bytes of one text looked at together
BUFFER = 1 << 21  # bytes of pieces sorted together
HOT = 4096  # different pieces under one key that are sorted together
WIDTHS = (48, 6, 1)  # starts of the pieces that hotter keys are split into, step by step
HEAVY = 2000  # rows of a key that one task joins
MOST_HEAVY = 16_384  # keys that are dealt over several tasks
_PLACE = np.uint64((1 << 28) - 1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (np.uint64(_STEP), inverse))


def anchored(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, anchor's place, anchor's hash) of the pieces of texts: runs of starts of ``length`` bytes with one anchor.

    The anchor of a start is the gram of GRAM bytes within its ``length`` bytes whose hash is least, the leftmost of equal ones.
    It depends on those bytes alone, so equal strings have equal anchors at equal distances.
    """
    none = np.zeros(0, np.int64)
    n, width = len(data), length - GRAM + 1
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    power, back = (p[: n + 1] for p in _powers(max(CHUNK + length, n)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])
    h = mix64((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    m = len(h)
    low = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[:m] = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
    low = low.reshape(-1, width)
    # The least of a window is that of the end of one row and the beginning of the next.
    after = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(low, axis=1).ravel()
    room = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    start = np.flatnonzero(room >= length)
    place = (np.minimum(after[start], before[start + width - 1]) & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return start[at], np.diff(np.append(at, len(start))), place[at], h[place[at]]


def _digests(bodies) -> np.ndarray:
    """Two longs of a 128-bit hash for each piece of bytes."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in bodies), np.int64).reshape(-1, 2)


def _marks(docs: DataFrame, length: int) -> DataFrame:
    """(key, at, starts, ahead, times, k, d1, d2) of each piece of each text: where it begins, how many starts it has, the anchor's distance, its hash k, the piece's digest. A piece that follows itself ``times`` times is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            ids = b.column(0).to_numpy()
            for lo, _, data, off in text_slices(b.column(1)):
                step = CHUNK if len(off) == 2 else max(len(data), 1)
                for base in range(0, max(len(data) - length + 1, 0), step):
                    part = data[base : base + step + length - 1]
                    own = off if base == 0 and len(part) == len(data) else np.array([0, len(part)])
                    at, count, place, h = anchored(part, own, length)
                    if not len(at):
                        continue
                    view = memoryview(part)
                    d = _digests(view[a : a + c + length - 1] for a, c in zip(at.tolist(), count.tolist(), strict=True))
                    first = np.ones(len(at), bool)
                    first[1:] = (d[1:] != d[:-1]).any(1) | (at[1:] != at[:-1] + count[:-1])
                    k = np.flatnonzero(first)
                    text = np.searchsorted(own, at[k], "right") - 1
                    cells = [ids[lo:][text], at[k] - own[text] + base, count[k], place[k] - at[k], np.diff(np.append(k, len(at))), h[k].view(np.int64), d[k, 0], d[k, 1]]
                    kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cells, kinds, strict=True)], ["key", "at", "starts", "ahead", "times", "k", "d1", "d2"])

    return docs.select("key", "text").mapInArrow(run, "key long, at long, starts int, ahead int, times long, k long, d1 long, d2 long")


def dealt(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """``left`` joined to ``right``, which is stored and holds each key once, with at least the number of its rows on the left in ``rows``.

    A key of more than HEAVY rows (or, beyond MOST_HEAVY such keys, of so many that no more than MOST_HEAVY are) is dealt
    over as many tasks by a salt; only the list of those keys is broadcast.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy = max(HEAVY, -(-total // MOST_HEAVY))
    salts = F.when(F.col(rows) > heavy, F.ceil(F.col(rows) / F.lit(heavy))).otherwise(1).cast("int")
    hot = right.filter(F.col(rows) > heavy).select(*on, salts.alias("__salts"))
    if hot.isEmpty():
        return left.join(right, on)
    spread = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__salts").cast("long")), F.lit(0)).cast("int")
    left = left.join(F.broadcast(hot), on, "left").withColumn("__salt", spread).drop("__salts")
    return left.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))), [*on, "__salt"]).drop("__salt")


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, so that numbers compare as bytes do."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(data)]
    return out


def _quicksorted(words: np.ndarray, starts: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at places [lo, hi) of ``order`` to a depth of SHALLOW bytes, in place; returns where ties are left.

    Multikey quicksort with eight bytes as a character, all groups a step at a time: each is parted by its own
    median-of-three pivot into less, equal and greater; the equal part goes on eight bytes deeper.
    """
    depth = np.zeros(len(lo), np.int64)
    left = ([], [])
    while len(lo):
        size = hi - lo
        at = _spread(lo, size)
        seg = np.repeat(np.arange(len(lo)), size)
        item = order[at]
        key = words[starts[item] + depth[seg]]
        first = np.cumsum(size) - size
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        side = (key > pivot).astype(np.int8) - (key < pivot) + 1
        begin, parts = lo, []
        for s in (0, 1, 2):
            m = np.flatnonzero(side == s)
            count = np.bincount(seg[m], minlength=len(lo))
            order[_spread(begin, count)] = item[m]
            parts.append((begin, begin + count))
            begin = begin + count
        deeper = depth + 8
        done = deeper >= SHALLOW
        tied = done & (parts[1][1] - parts[1][0] > 1)
        left[0].append(parts[1][0][tied])
        left[1].append(parts[1][1][tied])
        rest = [(*parts[0], depth), (*(x[~done] for x in parts[1]), deeper[~done]), (*parts[2], depth)]
        lo, hi, depth = (np.concatenate(x) for x in zip(*rest, strict=True))
        keep = hi - lo > 1
        lo, hi, depth = lo[keep], hi[keep], depth[keep]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in left)


def _tried(words: np.ndarray, starts: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Sorts suffixes that tie to SHALLOW bytes by blind tries, in place; returns whether each place's suffix shares ``length`` bytes with that before.

    A trie's nodes know a depth and the byte where each branch leaves; the bytes between are looked at once. All tries grow
    a path at a time: the first suffix of a group is the path; each other one leaves it at its first different byte, and those
    that leave at one depth with one byte are the group of that branch. Branches stand before the path, shallow ones first,
    if their byte is less, else behind it, deep ones first.
    """
    same = np.zeros(len(order), bool)
    depth = np.full(len(lo), SHALLOW, np.int64)
    while len(lo):
        size = hi - lo
        at = _spread(lo, size)
        seg = np.repeat(np.arange(len(lo)), size)
        item = order[at]
        mine, path = starts[item] + depth[seg], (starts[order[lo]] + depth)[seg]
        common = np.full(len(at), length, np.int64)
        byte, above = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        todo, k = np.arange(len(at)), 0
        while len(todo):
            todo = todo[depth[seg[todo]] + k < length]
            x, y = words[mine[todo] + k], words[path[todo] + k]
            off = np.flatnonzero(x != y)
            t, x, y = todo[off], x[off], y[off]
            gap = x ^ y  # its leading zero bytes are shared
            lead = np.zeros(len(t), np.int64)
            for bits in (32, 16, 8):
                clear = gap >> np.uint64(64 - bits) == 0
                lead += np.where(clear, bits // 8, 0)
                gap = np.where(clear, gap << np.uint64(bits), gap)
            where = depth[seg[t]] + k + lead
            inside = where < length
            t, x, y, lead, where = t[inside], x[inside], y[inside], lead[inside], where[inside]
            common[t], above[t] = where, x > y
            byte[t] = (x >> (np.uint64(56) - lead.astype(np.uint64) * np.uint64(8))).astype(np.int64) & 255
            rest = np.ones(len(todo), bool)
            rest[off] = False
            todo, k = todo[rest], k + 8
        equal = common == length
        side = np.where(equal, 1, np.where(above, 2, 0))
        rank = (((seg << 2 | side) << 20 | np.where(equal, 0, np.where(above, (1 << 20) - 1 - common, common))) << 8) | byte
        new = np.argsort(rank, kind="stable")
        order[at] = item[new]
        rank, common, equal = rank[new], common[new], equal[new]
        head = np.ones(len(rank), bool)
        head[1:] = rank[1:] != rank[:-1]
        same[at[equal & ~head]] = True
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(rank))
        go = (last - first > 1) & ~equal[first]
        first, last = first[go], last[go]
        lo, hi, depth = at[first], at[first] + (last - first), common[first] // 8 * 8
    return same


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the places in ``starts`` sorted by group and the ``length`` bytes from there, and whether each shares these with the one before.

    ``groups`` are ascending numbers; ``data`` holds ``length`` bytes from each start on. Deep-shallow sorting: multikey
    quicksort to SHALLOW bytes, then blind tries for what still ties.
    """
    order = np.arange(len(starts))
    lo = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(starts) else order
    hi = np.append(lo[1:], len(starts))
    many = hi - lo > 1
    words = _words(data)
    return order, _tried(words, starts, order, *_quicksorted(words, starts, order, lo[many], hi[many]), length)


def _repeated_starts(rows: list[tuple], length: int) -> Iterator[tuple]:
    """(d1, d2, [(from, to), ...]) of the pieces (k, d1, d2, n, starts, body) that have starts whose strings stand elsewhere too; pieces are in the order of k."""
    count = np.array([r[4] for r in rows], np.int64)
    size = np.array([len(r[5]) for r in rows], np.int64)
    k = np.array([r[0] for r in rows], np.int64)
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    piece = np.repeat(np.arange(len(rows)), count)
    group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    order, same = sorted_suffixes(data, _spread(np.cumsum(size) - size, count), group[piece], length)
    head = np.flatnonzero(~same)
    n = np.array([r[3] for r in rows], np.int64)[piece[order]]
    places = np.repeat(np.add.reduceat(n, head), np.diff(np.append(head, len(order))))
    hit = np.zeros(len(order) + 1, bool)
    hit[order] = places > 1
    first = np.cumsum(count) - count
    edge = np.zeros(len(order) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(hit[:-1] & (edge[:-1] | ~np.concatenate([[False], hit[:-2]])))
    end = np.flatnonzero(hit[:-1] & (edge[1:] | (np.arange(1, len(hit)) == len(order)) | ~hit[1:])) + 1
    of = piece[begin]
    if not len(of):
        return
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(of)).tolist(), strict=True):
        p = int(of[i])
        yield rows[p][1], rows[p][2], [{"a": int(a), "b": int(b)} for a, b in zip(begin[i:j] - first[p], end[i:j] - first[p], strict=True)]


_FOUND = "d1 long, d2 long, ranges array<struct<a:int,b:int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """_FOUND of pieces (k, d1, d2, n, starts, body): pieces of one key come to one task together, BUFFER bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            cols = list(zip(*_repeated_starts(held, length), strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], _RANGES)], ["d1", "d2", "ranges"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= BUFFER and row[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield out()

    own = pieces.select("k", "d1", "d2", "n", "starts", "body")
    return own.repartition("k").sortWithinPartitions("k").mapInArrow(run, _FOUND)


def _split(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces of at most ``width`` starts at the same distances from the anchor, keyed by what the strings from all of them share: (p1, p2: the whole's digest, base: starts before, k, d1, d2, n, starts, ahead, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d1, d2, n, starts, ahead, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base = 0
                while base < starts:
                    far = ahead - base  # the distance of the anchor from this start
                    bucket = far // width
                    count = min(starts - base, far - bucket * width + 1)
                    part = body[base : base + count + length - 1]
                    core = body[max(ahead - bucket * width, 0) : ahead - bucket * width - width + 1 + length]
                    rows.append((d1, d2, base, xxhash.xxh3_64_intdigest(core, bucket) - (1 << 63), *_digests([part])[0].tolist(), n, count, far, part))
                    base += count
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["p1", "p2", "base", "k", "d1", "d2", "n", "starts", "ahead", "body"])

    own = pieces.select("d1", "d2", "n", "starts", "ahead", "body")
    return own.mapInArrow(run, "p1 long, p2 long, base int, k long, d1 long, d2 long, n long, starts int, ahead int, body binary")


def _found(pieces: DataFrame, length: int, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """_FOUND of stored pieces (k, d1, d2, n, starts, ahead, body), each digest once: keys of at most ``hot`` pieces are sorted; the pieces of others are split and looked for part by part."""
    sizes = stored(pieces.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot), "suffix-hot")
    if not widths or sizes.isEmpty():
        return _sorted(pieces, length)
    hotter = dealt(pieces, sizes, ["k"], "rows").drop("rows")
    # Of a key's pieces all or none are hot; a row for each hot key is a sum over HOT rows, but may still be too many to broadcast.
    counted = stored(pieces.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") <= hot), "suffix-cold")
    cold = _sorted(dealt(pieces, counted, ["k"], "rows").drop("rows"), length)
    parts = stored(_split(hotter, widths[0], length), "suffix-parts")
    kinds = parts.groupBy("k", "d1", "d2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("starts").alias("starts"), F.min("ahead").alias("ahead"), F.first("body").alias("body"))
    kinds = stored(kinds, "suffix-kinds")
    deeper = _found(kinds.drop("rows"), length, hot, widths[1:])
    deeper = stored(deeper.join(kinds.select("d1", "d2", "rows"), ["d1", "d2"]), "suffix-found")
    up = dealt(parts.select("p1", "p2", "base", "d1", "d2"), deeper, ["d1", "d2"], "rows")
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("base")).alias("a"), (r["b"] + F.col("base")).alias("b")))
    up = up.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.flatten(F.collect_list(shifted)).alias("ranges"))
    return cold.unionByName(up)


def _bodies(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """The pieces of ``kinds`` (k, d1, d2, n, starts, ahead, key, at) with their bytes from the texts."""
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("at", "starts", "ahead", "n", "k", "d1", "d2")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                rows = []
                for text, pieces in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    rows += [(p["k"], p["d1"], p["d2"], p["n"], p["starts"], p["ahead"], text[p["at"] : p["at"] + p["starts"] + length - 1]) for p in pieces]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "d1", "d2", "n", "starts", "ahead", "body"])

    own = docs.select("key", F.col("text").cast("binary").alias("text")).join(wanted, "key").select("text", "pieces")
    return own.mapInArrow(run, "k long, d1 long, d2 long, n long, starts int, ahead int, body binary")


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, list[int], list[int]]:
    """What is left of the bytes without the spans (a, b), and starts and lengths of the runs taken out."""
    runs: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, end = [], 0
    for a, b in runs:
        kept.append(raw[end:a])
        end = b
    return b"".join([*kept, raw[end:]]), [a for a, _ in runs], [b - a for a, b in runs]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Every text's UTF-8 bytes without those that a string of ``length`` bytes covers which starts in another place too.

    Columns: id_col, n_bytes, kept (binary: cuts may part a character), cut_starts, cut_lengths (of the maximal runs taken
    out, in bytes of the text). All occurrences go, overlapping ones count, strings never cross texts, and all is judged on
    the given texts.

    Suffixes can't be sorted where they stand, and each with its own bytes would be ``length`` times the text. So starts are
    gathered in pieces: neighbours whose strings have the same anchor (``anchored``), about 185 starts. Equal strings have
    equal anchors, so pieces whose anchor stands nowhere else are done with, after a sum of one number for each anchor.
    Of the others each different one is fetched once from its text (a join by document), with the number of its occurrences,
    and the suffixes of all pieces of an anchor are sorted together (``sorted_suffixes``); neighbours that share ``length``
    bytes, or one of a piece that occurs more than once, are repeated. What is found is joined back to all pieces, and
    their spans to the texts.

    Under an anchor of more than ``hot`` different pieces (a passage in very many contexts) pieces are split into parts of
    fewer starts, keyed by the bytes that the strings of all these starts share: equal strings stay under one key, and a
    context parts all others. Parts of one start are equal or share no key. Hot keys of joins are dealt over tasks. Executors
    lost at any stage recompute it from the table and the stored results before.

    Pieces are known by 128-bit digests; strings of different pieces are compared byte by byte. ``length`` is 64 at least.

    Null texts are empty. Null and repeated ids and repeated rows are documents of their own, whose strings repeat one
    another. Other columns are dropped, whatever their names. An empty table gives no rows.
    """
    if not 64 <= length < 1 << 20:
        raise ValueError("length must be 64 to 2^20 - 1")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    copied = base.schema["id"].dataType.simpleString() not in ("bigint", "int") or not base.filter("id is null").isEmpty() or repeats(base)
    # Rows without a key of their own get one in a stored copy, where it stays the same.
    base = stored(base.withColumn("key", F.monotonically_increasing_id()), "suffix-docs") if copied else base.withColumn("key", F.col("id").cast("long"))
    marks = stored(_marks(base, length), "suffix-marks")
    many = stored(marks.groupBy("k").agg(F.sum("times").alias("rows")).filter("rows > 1"), "suffix-anchors")
    kept = stored(dealt(marks, many, ["k"], "rows").drop("rows"), "suffix-kept")
    discard(docs.sparkSession, marks)
    kinds = kept.groupBy("k", "d1", "d2").agg(F.sum("times").alias("n"), F.min("starts").alias("starts"), F.min("ahead").alias("ahead"), F.min("key").alias("key"), F.min_by("at", "key").alias("at"))
    kinds = stored(kinds, "suffix-kinds")
    pieces = stored(_bodies(base, kinds, length), "suffix-pieces")
    found = _found(pieces, length, hot, widths)
    found = stored(found.join(kinds.select("d1", "d2", F.col("n").alias("rows")), ["d1", "d2"]), "suffix-found")
    discard(docs.sparkSession, pieces)
    hits = dealt(kept.select("key", "at", "starts", "times", "d1", "d2"), found, ["d1", "d2"], "rows")
    # A piece that follows itself has its ranges at each of its times.
    hits = hits.select("key", "at", "starts", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("turn"), "ranges")
    span = lambda r: F.struct((F.col("at") + F.col("turn") * F.col("starts") + r["a"]).alias("a"), (F.col("at") + F.col("turn") * F.col("starts") + r["b"] + F.lit(length - 1)).alias("b"))
    spans = hits.select("key", F.transform("ranges", span).alias("s")).groupBy("key").agg(F.flatten(F.collect_list("s")).alias("spans"))

    kind = base.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "kept", "cut_starts", "cut_lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                raw = some.column(1).to_pylist()
                kept, starts, lengths = zip(*map(_cut, raw, some.column(2).to_pylist()), strict=True)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(len, raw), pa.int64()), pa.array(kept, pa.binary()), pa.array(starts, longs), pa.array(lengths, longs)], names)

    joined = base.select("key", "id", F.col("text").cast("binary").alias("text")).join(spans, "key", "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, kept binary, cut_starts array<long>, cut_lengths array<long>").withColumnRenamed("id", id_col)

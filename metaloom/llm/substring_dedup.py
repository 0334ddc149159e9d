"""Substring deduplication by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import _STEP, fresh, mix64, random_table, span_hashes, stored, text_slices, thin
from metaloom.llm.common import repeats as repeated

_GEAR = (random_table(256, 31) & np.uint64(0xFFFF)).astype(np.uint16)
WINDOW = 16  # bytes that the hash looks back on: each step shifts by one bit, so older bytes have left 16 bits
BYTES_A_WORD = 8  # a chunk counts one word for each at least
HEAVY = 2000  # occurrences of a digest that one task joins
MOST_HEAVY = 16_384  # digests that are dealt over several tasks
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte] after each byte, in 16 bits.

    The sum over the last 16 bytes is doubled up: over 1, 2, 4, 8, 16 bytes.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        g = h.copy()
        g[k:] += h[:-k] << np.uint16(k)
        h = g
    return h


def boundaries(data: np.ndarray, off: np.ndarray, mean_words: int, span: int, forced: int) -> np.ndarray:
    """Where chunks end (exclusive), ascending, each text's end included.

    A cut may follow a white-space run; it does where the top bits of the gear hash over the bytes before fall below
    1 / ``mean_words``, unless such a place lies within ``span`` bytes before. Text without white space is cut where the
    hash is below 1 / ``forced``. Each cut depends on the bytes just before it alone, so chunks re-align after an insertion.
    """
    if not len(data):
        return np.unique(off[1:])
    h = gear(data)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, _SPACE[data[1:]]
    ok = _SPACE[data] & ~after & (h < np.uint16((1 << 16) // mean_words))
    head = np.empty(len(data), bool)  # the next byte starts a character
    head[-1], head[:-1] = True, (data[1:] & 0xC0) != 0x80
    ok |= head & (h < np.uint16((1 << 16) // forced))
    at = np.flatnonzero(ok) + 1
    if len(at):
        at = at[np.concatenate([[True], np.diff(at) > span])]
    return np.unique(np.concatenate([at, off[1:]]))


def windows(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, digest: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, end, digest) of the shortest run of whole chunks from each chunk on, within its text, that holds ``least_words`` words.

    A chunk counts as many words as begin in it, and one for each BYTES_A_WORD bytes at least, so that text without white
    space is measured too. Chunks from which the text's rest is shorter have no window.
    """
    begins = ~_SPACE[data]
    begins[1:] &= _SPACE[data[:-1]]
    begins[off[:-1][off[:-1] < len(data)]] |= ~_SPACE[data[off[:-1][off[:-1] < len(data)]]]
    words = np.concatenate([[0], np.cumsum(begins)])
    size = np.maximum(words[ends] - words[starts], (ends - starts) // BYTES_A_WORD)
    total = np.concatenate([[0], np.cumsum(size)])
    last = np.searchsorted(total, total[:-1] + least_words, "left")  # chunks up to here, exclusive
    has = np.flatnonzero(last <= len(starts))
    has = has[text[np.maximum(last[has] - 1, has)] == text[has]]
    last = np.maximum(last[has], has + 1)
    # The digest of a window is a polynomial of its chunks' digests, by differences of running sums.
    n = np.uint64(_STEP)
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(starts), n, np.uint64)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(starts), inverse, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(digest * powers[:-1], dtype=np.uint64)])
    return has, ends[last - 1], mix64((sums[last] - sums[has]) * back[has] + (last - has).astype(np.uint64))


def chunked(docs: DataFrame, mean_words: int, span: int, forced: int, least_words: int) -> DataFrame:
    """(keys of ``docs``, at, len, digest, again) for each window of chunks of each text, in bytes of UTF-8; ``docs`` has long keys, then the text. ``again``: its digest came before in the text."""
    keys = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            ids = [c.to_numpy() for c in b.columns[:-1]]
            for lo, hi, data, off in text_slices(b.column(len(ids))):
                ends = boundaries(data, off, mean_words, span, forced)
                ends = ends[ends > 0]
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                full = ends > starts
                starts, ends = starts[full], ends[full]
                text = np.searchsorted(off, starts, "right") - 1
                i, ends, digest = windows(data, off, starts, ends, text, span_hashes(data, starts, ends), least_words)
                starts, text = starts[i], text[i]
                order = np.lexsort((starts, digest, text))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                own = [pa.array(k[lo:hi][text]) for k in ids]
                own += [pa.array((starts - off[text]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(digest.view(np.int64)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(own, [*keys, "at", "len", "digest", "again"])

    return docs.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", at int, len int, digest long, again boolean")


def _cutter(text_at: int):
    """Cuts the texts of column ``text_at`` by the spans in the last column, which gives way to starts, lengths and firsts."""

    def one(text: str, spans: list[dict]) -> tuple[str, list[int], list[int], list[int]]:
        raw = text.encode()
        out, end, starts, lengths, firsts = [], 0, [], [], []
        for lo, hi, first in repeats(sorted((s["at"], s["len"], s["first"]) for s in spans)):
            out.append(raw[end:lo])
            starts.append(len(raw[:lo].decode()))
            lengths.append(len(raw[lo:hi].decode()))
            firsts.append(first)
            end = hi
        return b"".join([*out, raw[end:]]).decode(), starts, lengths, firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int64())
        for b in batches:
            spans = b.column(b.num_columns - 1)
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            cut = {int(i): one(b.column(text_at)[i].as_py(), spans[i].as_py()) for i in hit}
            none = (None, [], [], [])
            new = pa.array([cut[i][0] if i in cut else None for i in range(b.num_rows)], pa.string())
            columns = [pc.coalesce(new, c.cast(pa.string())) if k == text_at else c for k, c in enumerate(b.columns[:-1])]
            columns += [pa.array([cut.get(i, none)[k] for i in range(b.num_rows)], ints) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return run


def repeats(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, document) of the unions of overlapping or adjoining repeated windows (start, length, first document), ascending.

    A union's document is the one that holds the first occurrence of most of its bytes.
    """
    out: list[list] = []
    for at, n, first in spans:
        if not out or out[-1][1] < at:
            out.append([at, at, {}])
        _, end, share = out[-1]
        share[first] = share.get(first, 0) + max(0, at + n - end)
        out[-1][1] = max(end, at + n)
    return [(lo, hi, min(share, key=lambda k: (-share[k], k))) for lo, hi, share in out]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 16, mean_words: int = 3, span: int = 8, forced: int = 256) -> DataFrame:
    """``docs`` with passages removed that repeat what an earlier place holds.

    Texts are cut into content-defined chunks of about ``mean_words`` + 1 words. From each chunk on, the shortest run of whole
    chunks of ``least_words`` words or more (see ``windows``) is a window; windows are compared by a 64-bit digest. The first
    occurrence, by (id, place), of each window stays; later ones are cut out, within a text as well as across texts. So each
    window that is cut stands without a gap in one earlier place; chunks that occur here and there are left alone. A
    passage's ends, up to the nearest chunk bounds and at its close less than a window, remain.

    Columns: those of ``docs``, with the text replaced where something was cut, and added: cut_starts, cut_lengths (code
    points of the given text), cut_firsts (the document that holds the first occurrence of most of a run).

    One row for each window is shuffled to count digests with partial aggregation; the digests that repeat are stored, and
    windows are joined to them. A digest of more than HEAVY occurrences (or, beyond MOST_HEAVY such digests, of so many
    that no more than MOST_HEAVY are) is dealt over as many tasks by a salted key, so a passage that a third of the texts
    hold is in no single task; only the list of those digests is broadcast. A document's repeated windows are gathered by
    document, which its own length bounds. Executors lost at any stage recompute it from the table.

    Digests have 64 bits and are not compared byte by byte: of w different windows about w * w / 2 ** 65 pairs agree by chance.

    Null texts stay null, empty ones empty, with empty lists. Rows with equal ids and different texts are documents of
    their own, in the order of a hash of the text; rows alike in id and text are one document and are each cut as that is.
    Rows with a null id pass through. Columns of ``docs`` that are named like the added ones are replaced; others keep
    their names, whatever these are. An empty table gives no rows.
    """
    added = ["cut_starts", "cut_lengths", "cut_firsts"]
    docs = docs.drop(*added)
    columns = docs.columns
    key, hashed, spans_at = fresh(columns, "__key", "__hash", "__spans")
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    base = base.filter("id is not null and text is not null")
    # Where no id repeats, the id alone is a row's key, and no hash is carried along.
    keys = ["id", "hash"] if repeated(base) else ["id"]
    chunks = chunked(base.select(*keys, "text"), mean_words, span, forced, least_words)
    # Longs alone, so that counts are kept in hash tables from the map side on; places within a text were ranked there.
    many = stored(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"), "digests")
    bound = many.agg(F.sum("n")).first()[0] or 0
    heavy = max(HEAVY, -(-bound // MOST_HEAVY))
    dealt = F.when(F.col("n") > heavy, F.ceil(F.col("n") / F.lit(heavy))).otherwise(1).cast("int")
    salts = many.filter(F.col("n") > heavy).select(F.col("digest").alias("d"), dealt.alias("salts"))
    salted = lambda d, salt: F.when(salt == 0, d).otherwise(F.xxhash64(d, salt))
    seen = many.withColumn("salt", F.explode(F.sequence(F.lit(0), dealt - 1))).select(salted(F.col("digest"), F.col("salt")).alias("k"), "first")
    if salts.isEmpty():
        found = chunks.withColumn("k", F.col("digest"))
    else:
        own_salt = F.coalesce(F.pmod(F.xxhash64("id", "at"), F.col("salts").cast("long")).cast("int"), F.lit(0))
        found = chunks.join(F.broadcast(salts), F.col("digest") == F.col("d"), "left").withColumn("k", salted(F.col("digest"), own_salt))
    wanted = [*keys, "at", "len", "again", "k", *(["digest"] if len(keys) > 1 else [])]
    found = found.select(*wanted).join(seen, "k")
    again = F.col("again") | (F.col("id") != F.col("first"))
    if len(keys) > 1:
        # Of several texts under the first id, that of the smallest hash holds the first occurrence.
        lead = found.filter(F.col("id") == F.col("first")).groupBy("digest").agg(F.min("hash").alias("lead"))
        found = found.join(lead, "digest")
        again = again | (F.col("hash") != F.col("lead"))
    cuts = found.filter(again).select(*keys, F.struct("at", "len", "first").alias("span"))
    spans = cuts.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.collect_list("span").alias("__found"))
    own = {"id": (key, F.col(f"`{id_col}`").cast("long")), "hash": (hashed, F.xxhash64(text))}
    joined = docs.withColumns({name: c for name, c in (own[k] for k in keys)})
    on = [F.col(own[k][0]) == F.col(f"__of_{k}") for k in keys]
    left, *_ = fresh(columns, "__d")
    joined = joined.alias(left).join(spans.alias(f"{left}s"), on, "left")
    given = lambda c: F.col(f"{left}.`{c}`")
    joined = joined.select(*[given(c).cast("string").alias(c) if c == text_col else given(c) for c in columns], F.when(given(text_col).isNotNull(), F.col(f"{left}s.__found")).alias(spans_at))
    kinds = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(joined.schema.fields[:-1])]
    kinds += [f"c{len(columns) + k} array<long>" for k in range(3)]
    return joined.mapInArrow(_cutter(columns.index(text_col)), ", ".join(kinds)).toDF(*columns, *added)

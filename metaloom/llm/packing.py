"""Packing of token streams into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_BITS = 36  # of sequence_id below the task's number


class _Encoder(dict):
    """Little-endian 32-bit ids by chunk of text. A chunk starts at a space before a non-space, where the tokenizer always splits, so chunks encode alone as within their text.

    Vocabulary and merge order are those of the byte-level ``tokenizers`` file; the merges of chunks not yet seen are done
    by tiktoken, several times as fast and with the same ids (tests compare them). Added tokens are looked for first, as the
    tokenizer does, and the text between them is encoded part by part.
    """

    def __init__(self, path: str, most: int = 400_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a byte-level BPE file without normaliser and prefix space")
        added = spec.get("added_tokens", ())
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take white space or want whole words")
        special = {t["content"]: t["id"] for t in added}
        self.added = {s: i.to_bytes(4, "little") for s, i in special.items()}
        # Longer ones first: of added tokens that start at one place the longest is taken.
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=lambda s: (-len(s), s))) + ")").split if special else None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        core = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.encode, self.merge = core.encode_ordinary, core.encode_single_piece
        self.words = {i: s for s, i in ranks.items()}
        self.most = most

    def __missing__(self, chunk: str) -> bytes:
        letters = chunk[1:] if chunk[:1] == " " else chunk
        ids = np.array(self.merge(chunk.encode()) if letters.isascii() and letters.isalpha() else self.encode(chunk), "<u4").tobytes()
        if len(self) < self.most and len(chunk) < 64:
            self[chunk] = ids
        return ids


#: Fixed value: the split pattern of byte-level tokenizers of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_chunks = re.compile(r"(?= \S)").split


@lru_cache(2)
def _encoder(path: str) -> tuple[_Encoder, np.ndarray]:
    """The encoder and, by id, whether a sentence or line ends with that token."""
    enc = _Encoder(path)
    added = {int.from_bytes(i, "little"): s for s, i in enc.added.items()}
    ends = np.zeros(max([*enc.words, *added]) + 1, bool)
    for i, w in enc.words.items():
        ends[i] = w.rstrip(b"\"')")[-1:] in {b".", b"!", b"?", b"\n"} and w != b""
    # An added token named like an end of text ends what stands before it.
    for i, s in added.items():
        ends[i] = "endoftext" in s or s in ("</s>", "<eos>")
    return enc, ends


def token_bytes(enc: _Encoder, text: str | None, end_id: int) -> bytes:
    text, end = text or "", end_id.to_bytes(4, "little")
    if not any(s in text for s in enc.added):
        return b"".join(map(enc.__getitem__, _chunks(text))) + end
    return b"".join(enc.added[s] if s in enc.added else b"".join(map(enc.__getitem__, _chunks(s))) for s in enc.parts(text) if s) + end


def cut(ends: np.ndarray, cost: np.ndarray, window: int, final: bool) -> list[int]:
    """Ends of windows over tokens 0..ends[-1], of at most ``window`` tokens each, that cost least.

    ``ends`` are the ascending places where a cut is allowed (gaps of at most ``window``), ``cost`` what a cut there costs
    in padding tokens. A window of another length than a power of two is padded to ``window``. Without a later part
    (``final`` false) the last window may stay open and is left out.

    best[j] = cost[j] + min(window - ends[j] + min over i in reach of (best[i] + ends[i]), best[i] over i a power of two back);
    the inner minimum slides, so a queue of rising values gives it in constant time.
    """
    at = np.concatenate([[0], ends]).tolist()
    price = [0, *cost.tolist()]
    n = len(at)
    best, back = [0] * n, [0] * n
    free: dict[int, list[int]] = {}  # by place, those a power of two before it
    where = np.array(at)
    for k in range(window.bit_length()):
        if 1 << k <= window:
            i = np.minimum(np.searchsorted(where, where - (1 << k)), n - 1)
            for j in np.flatnonzero(where[i] == where - (1 << k)).tolist():
                free.setdefault(j, []).append(int(i[j]))
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = at[j]
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        least, by = best[i] + at[i] + window - p, i
        for i in free.get(j, ()):
            if best[i] < least:
                least, by = best[i], i
        best[j], back[j] = least + price[j], by
        v = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not final:
        # What is still open may be cut anywhere in reach of the end; the cheapest place so far closes the last window.
        j = min((i for i in range(n) if at[i] > at[-1] - window), key=lambda i: (best[i] + at[i], -at[i]), default=n - 1)
    out = []
    while j > 0:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class _Packer:
    """Packs the documents of one task in their order, holding about ``segment`` tokens at a time."""

    def __init__(self, path: str, window: int, end_id: int, sentence_cost: int, hard_cost: int, segment: int):
        self.enc, self.ends = _encoder(path)
        self.window, self.end_id, self.segment = window, end_id, segment
        self.sentence_cost, self.hard_cost = sentence_cost, hard_cost
        self.docs: list[tuple[object, bytes, int, int]] = []  # id, bytes, its first token here, tokens before it in the document
        self.held, self.sequence = 0, 0

    def add(self, doc_id, text) -> None:
        raw = token_bytes(self.enc, text, self.end_id)
        self.docs.append((doc_id, raw, 0, len(raw) // 4))
        self.held += len(raw) // 4

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where cuts are allowed, and their costs: document ends free, sentence ends cheap, and, where neither comes within a window, any full window at a higher cost."""
        where, price, at = [], [], 0
        for _, raw, skip, n in self.docs:
            ids = np.frombuffer(raw, "<u4")[skip:]
            stop = np.flatnonzero(self.ends[ids[:-1]]) + 1
            where += [stop + at, [at + len(ids)]]
            price += [np.full(len(stop), self.sentence_cost), [0]]
            at += len(ids)
        where, price = np.concatenate(where).astype(np.int64), np.concatenate(price).astype(np.int64)
        gaps = np.diff(where, prepend=0)
        if len(far := np.flatnonzero(gaps > self.window)):
            extra = np.concatenate([np.arange(where[i] - gaps[i] + self.window, where[i], self.window) for i in far])
            where, order = np.unique(np.concatenate([where, extra]), return_index=True)
            price = np.concatenate([price, np.full(len(extra), self.hard_cost)])[order]
        return where, price

    def flush(self, final: bool) -> Iterator[tuple]:
        """Rows of pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""
        if not self.docs:
            return
        where, price = self.places()
        stops = cut(where, price, self.window, final)
        k, used = 0, 0  # the document in turn, its tokens used here
        left = 0
        for stop in stops:
            offset, length = 0, stop - left
            while offset < length:
                doc_id, raw, skip, n = self.docs[k]
                take = min(n - skip - used, length - offset)
                start = skip + used
                yield doc_id, start, take, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + take)]), n, self.sequence, offset, length
                offset, used = offset + take, used + take
                if skip + used == n:
                    k, used = k + 1, 0
            left = stop
            self.sequence += 1
        rest = self.docs[k:]
        if used:
            rest[0] = (*rest[0][:2], rest[0][2] + used, rest[0][3])
        self.docs, self.held = rest, sum(n - skip for _, _, skip, n in rest)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, sentence_cost: int = 2, hard_cost: int = 32, segment: int = 1 << 17) -> DataFrame:
    """Pieces of documents placed in sequences of at most ``window`` tokens.

    A document's tokens are its ids by the ``tokenizer`` file, without added special tokens, and then ``end_id``. The
    documents of a task keep their order; windows are cut at document ends (free), sentence ends (``sentence_cost``), or,
    only where a window has neither, after ``window`` tokens (``hard_cost``), so that padding plus these costs is least
    over each run of about ``segment`` tokens. A sequence is padded to ``window`` unless its length is a power of two.

    Columns: id_col, start (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id, offset
    (gapless from 0 in a sequence), sequence_tokens. No shuffle: each task packs what it reads, and memory is bounded by
    ``segment`` and the longest text. sequence_id holds the task's number above SEQUENCE_BITS bits, so a task that runs
    again after a lost executor gives the same rows.

    Null texts are empty (one token); null ids stay null; repeated rows are packed once each; other columns are dropped,
    whatever their names; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packer = _Packer(tokenizer, window, end_id, sentence_cost, hard_cost, segment)

        def out(rows):
            rows = list(rows)
            if rows:
                cols = list(zip(*rows, strict=True))
                seq = np.array(cols[5], np.int64) + (task << SEQUENCE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(seq if i == 5 else np.array(cols[i], np.int64)) for i in range(1, 8))], names)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            texts = b.column(1)
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                packer.add(doc_id, texts[i].as_py())
                if packer.held >= packer.segment:
                    yield from out(packer.flush(False))
        yield from out(packer.flush(True))

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

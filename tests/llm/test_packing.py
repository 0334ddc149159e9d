import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metaloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_cut(ends, cost, window):
    at = [0, *ends]
    best = [0] + [10**9] * len(ends)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else window - n) + cost[j - 1])
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cut_costs_least(seed):
    r = np.random.default_rng(seed)
    ends = np.cumsum(r.integers(1, 9, 60))
    cost = r.integers(0, 4, 60)
    got = packing.cut(ends, cost, 16, True)
    total, left = 0, 0
    for g in got:
        n = g - left
        assert 0 < n <= 16
        total += (0 if n & (n - 1) == 0 else 16 - n) + cost[list(ends).index(g)]
        left = g
    assert left == ends[-1]
    assert total == brute_cut(ends.tolist(), cost.tolist(), 16)


def test_ids_are_the_tokenizers(prose):
    t = Tokenizer.from_file(PATH)
    enc, _ = packing._encoder(PATH)
    for s in [prose(3, 300), "a  b\n\n c\td's  ", " lead", "trail ", "éàü ☃ 漢字 12,345.6!!", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext| >", "\x1c \x1d a  b", "", "don't  stop\r\n now"]:
        assert np.frombuffer(packing.token_bytes(enc, s, 0), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids + [0]


def test_pieces_tile_documents_and_sequences(spark, odd):
    rows = packing.pack(odd, PATH, segment=2000).collect()
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert set(by_doc) == set(texts)
    for doc, ps in by_doc.items():
        ids = np.array(t.encode(texts[doc] or "", add_special_tokens=False).ids + [0], "<u4")
        copies = 2 if doc == 8 else 1
        assert sum(p.length for p in ps) == copies * len(ids)
        for p in ps:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 1024 and {p.sequence_tokens for p in ps} == {at}


def test_empty(spark, odd):
    assert packing.pack(odd.limit(0), PATH).collect() == []


def test_added_tokens_are_packed_wherever_they_stand(spark, prose):
    end = "<|endoftext|>"
    texts = [end, f"{end} {prose(1, 30)}", f"{prose(2, 30)}{end}", f"{prose(3, 20)} {end} {prose(4, 20)}", end * 5, f"{prose(5, 700)}{end}" * 4, prose(6, 10), end * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    t = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, segment=1500).collect()
    for doc, text in enumerate(texts):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert 50256 in ids or end not in text
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist() and sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in pieces)

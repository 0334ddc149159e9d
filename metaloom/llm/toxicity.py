"""Toxicity scores by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import _WORD_BYTE, free_memory, lower, mix64, runs, span_hashes, text_slices, thin, word_hashes

BUCKETS = 1 << 16  # of each of the two hash tables of embeddings
WIDTHS = (1, 2, 3)
CUT = 0.7  # the score from which a text is predicted toxic

#: Fixed value: frequent words that tell these languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for with was on are this by from",
    "de": "der die und das ist von den mit zu dem nicht ein eine für auf",
    "fr": "le les et des est pour que dans une du sur qui par pas au",
    "es": "el los las y por con para del una que es no se lo como",
}


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


_LANG_HASH = np.concatenate([_hash_words(w.split()) for w in LANGUAGE_WORDS.values()])
_LANG_OF = np.repeat(np.arange(len(LANGUAGE_WORDS)), [len(w.split()) for w in LANGUAGE_WORDS.values()])
_SORT = np.argsort(_LANG_HASH, kind="stable")
_LANG_HASH, _LANG_OF = _LANG_HASH[_SORT], _LANG_OF[_SORT]


def languages(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's language by its frequent words, from the text alone: an index into LANGUAGE_WORDS, or their number where none occurs. Ties go to the earlier."""
    n, k = len(first) - 1, len(LANGUAGE_WORDS)
    text = np.repeat(np.arange(n), np.diff(first))
    counts = np.zeros((n, k), np.int64)
    lo, hi = np.searchsorted(_LANG_HASH, words, "left"), np.searchsorted(_LANG_HASH, words, "right")
    for step in range(int((hi - lo).max(initial=0))):  # a word may belong to several languages
        on = lo + step < hi
        np.add.at(counts, (text[on], _LANG_OF[lo[on] + step]), 1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), k)


PREFIXES = (5, 7)  # bytes
SIZE = (2 + len(PREFIXES)) * BUCKETS + 1


@dataclass
class Words:
    """The words of some texts: hashes, rows of the stacked embedding tables, and each text's first word, with an end."""

    hashes: np.ndarray
    rows: np.ndarray
    first: np.ndarray

    def slices(self, most: int = 1 << 17):
        """Runs of texts of about ``most`` words, so that what is computed for each word stays small."""
        lo, n = 0, len(self.first) - 1
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + most, "right")) - 1))
            a, b = self.first[lo], self.first[hi]
            yield Words(self.hashes[a:b], self.rows[a:b], self.first[lo : hi + 1] - a)
            lo = hi


def read(data: np.ndarray, off: np.ndarray) -> Words:
    """Two rows for the hash of each word, and one for each of its prefixes; the last row, of zeros, where it has none so long."""
    starts, ends = runs(_WORD_BYTE[data], off)
    words = span_hashes(data, starts, ends)
    h, low = mix64(words), np.uint64(BUCKETS - 1)
    rows = [(h & low).astype(np.int32), ((h >> np.uint64(32)) & low).astype(np.int32) + BUCKETS]
    for k, n in enumerate(PREFIXES):
        row = np.full(len(starts), SIZE - 1, np.int32)
        long = np.flatnonzero(ends - starts >= n)
        row[long] = (span_hashes(data, starts[long], starts[long] + n) & low).astype(np.int32) + (2 + k) * BUCKETS
        rows.append(row)
    return Words(words, np.stack(rows, axis=1), np.searchsorted(starts, off))


def _pool(conv: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The maximum of each text's rows; 0 for a text without words."""
    out = np.zeros((len(first) - 1, conv.shape[1]), conv.dtype)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        out[has] = np.maximum.reduceat(conv, first[:-1][has], axis=0)
    return out


def _shifted(x: np.ndarray, first: np.ndarray, by: int) -> np.ndarray:
    """Row i + ``by`` in place of row i; zeros beyond a text's end."""
    if not by:
        return x
    out = np.zeros_like(x)
    out[:-by] = x[by:]
    ends = first[1:][np.diff(first) > 0]
    for k in range(1, by + 1):
        out[np.maximum(ends - k, 0)] = 0
    return out


@dataclass
class Model:
    """``table``: for each bucket what it adds to each filter at each of its places; then biases, output weights, and the logit's cut by language."""

    table: np.ndarray
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    cuts: np.ndarray

    def logits(self, words: Words) -> np.ndarray:
        first = words.first
        y = self.table[words.rows[:, 0]]
        for k in range(1, words.rows.shape[1]):
            y += self.table[words.rows[:, k]]
        pooled, at = [], 0
        for w, bias in zip(WIDTHS, self.bias, strict=True):
            n = len(bias)
            conv = y[:, at : at + n].copy()
            for k in range(1, w):
                conv += _shifted(np.ascontiguousarray(y[:, at + k * n : at + (k + 1) * n]), first, k)
            at += w * n
            pooled.append(np.maximum(_pool(conv, first) + bias, 0))
        return np.concatenate(pooled, axis=1) @ self.out + self.base

    def scores(self, words: Words) -> np.ndarray:
        """The calibrated probability: the logit moved so that its language's cut comes to CUT."""
        z = self.logits(words) - self.cuts[languages(words.hashes, words.first)] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _words_of(texts: list[str | None]) -> Words:
    parts = [read(data, off) for _, _, data, off in text_slices(lower(pa.array(texts, pa.large_string())))]
    if not parts:
        return Words(np.zeros(0, np.uint64), np.zeros((0, 2 + len(PREFIXES)), np.int32), np.zeros(1, np.int64))
    return Words(np.concatenate([w.hashes for w in parts]), np.concatenate([w.rows for w in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.first) for w in parts]))]))


def _best_cut(logit: np.ndarray, y: np.ndarray, precise: float = 0.8) -> float | None:
    """Where predicting logit >= cut has the highest F1, or within a hundredth of it the widest gap between logits, whose middle this is; None if no cut has a precision of ``precise``."""
    if not y.any() or y.all():
        return None
    order = np.argsort(-logit, kind="stable")
    z, t = logit[order], y[order]
    tp = np.cumsum(t)
    f1 = 2 * tp / (np.arange(1, len(t) + 1) + t.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # cuts between equal logits don't exist
    f1[tp < precise * np.arange(1, len(t) + 1)] = -1
    if f1.max() < 0:
        return None
    gap = np.append(z[:-1] - z[1:], 1.0)
    k = int(np.argmax(np.where(f1 >= f1.max() - 0.01, gap, -1)))
    return float(z[k] - gap[k] / 2)


def fit(texts: list[str | None], labels: list[int], *, dims: int = 8, filters: int = 4, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 5) -> Model:
    """Trains on three quarters of the rows by Adagrad on the log loss and calibrates the cuts on the others.

    The first embedding dimension starts as the smoothed log-odds of the bucket's words, the others small and random; max
    pooling sends each gradient to one place of a text. Equal inputs give equal models. Without rows, or with one label
    only, the model gives every text a score below CUT (no toxic row) or the same one.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    n = len(y)
    words = _words_of(texts)
    b, first = words.rows, words.first
    held = np.arange(n) % 4 == 3
    fit_rows = np.flatnonzero(~held)
    counts = np.zeros((2, SIZE))
    for i in fit_rows.tolist():
        counts[int(y[i]), np.unique(b[first[i] : first[i + 1]])] += 1
    pos, neg = max(1.0, y[fit_rows].sum()), max(1.0, len(fit_rows) - y[fit_rows].sum())
    prior = 12 * pos / (pos + neg)  # as of 12 texts at the mean rate
    odds = np.log((counts[1] + prior) / (counts[0] + 12 - prior)) - np.log(pos / neg)
    E = rng.normal(0, 0.02, (SIZE, dims))
    E[:, 0] = np.clip(odds / 2, -1.5, 1.5)
    E[-1] = 0
    W = [rng.normal(0, 0.2, (w, dims, filters)) for w in WIDTHS]
    for w in W:
        w[0, 0, 0] = 1.0
    B = [np.full(filters, -0.5) for _ in WIDTHS]
    out, base = np.full(len(WIDTHS) * filters, 0.5), np.array([np.log(pos / neg)])
    params = [E, *W, *B, out, base]
    grown = [np.full_like(p, 0.1) for p in params]

    def update(i: int, grad: np.ndarray, rows=None) -> None:
        if rows is None:
            grown[i] += grad**2
            params[i] -= rate * grad / np.sqrt(grown[i])
        else:
            np.add.at(grown[i], rows, grad**2)
            np.add.at(params[i], rows, -rate * grad / np.sqrt(grown[i][rows]))

    weight = np.where(y == 1, 0.5 * (pos + neg) / pos, 0.5 * (pos + neg) / neg)
    for _ in range(epochs if y.any() and not y.all() else 0):
        for some in np.array_split(rng.permutation(fit_rows), max(1, len(fit_rows) // batch)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
            start = np.concatenate([[0], np.cumsum(np.diff(first)[some])])
            rows = b[at]
            x = sum(E[rows[:, k]] for k in range(rows.shape[1]))
            pooled, places = [], []
            for w, f in enumerate(W):
                conv = sum(_shifted(x, start, k) @ f[k] for k in range(len(f)))
                p = _pool(conv, start)
                # the first place of each text and filter that has the maximum
                place = np.full(p.shape, -1)
                doc = np.repeat(np.arange(len(some)), np.diff(start))
                hit = conv == p[doc]
                for c in range(filters):
                    i = np.flatnonzero(hit[:, c])[::-1]
                    place[doc[i], c] = i
                pooled.append(np.maximum(p + B[w], 0))
                places.append(place)
            feats = np.concatenate(pooled, axis=1)
            z = feats @ out + base[0]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) * weight[some] / len(some)
            back = np.outer(g, out) * (feats > 0)
            grads, moved = [], []
            for w, f in enumerate(W):
                gw, dW = back[:, w * filters : (w + 1) * filters], np.zeros_like(f)
                d, c = np.nonzero((gw != 0) & (places[w] >= 0))
                where = places[w][d, c]
                for k in range(len(f)):
                    i = where + k
                    ok = i < start[d + 1]
                    v = gw[d[ok], c[ok]]
                    np.add.at(dW[k].T, c[ok], v[:, None] * x[i[ok]])
                    moved.append((rows[i[ok]], v[:, None] * f[k][:, c[ok]].T))
                grads.append((dW, gw.sum(axis=0)))
            update(len(params) - 2, feats.T @ g)
            update(len(params) - 1, np.array([g.sum()]))
            for w, (dW, dB) in enumerate(grads):
                update(1 + w, dW)
                update(1 + len(W) + w, dB)
            for r, v in moved:
                for side in range(r.shape[1]):
                    update(0, v, r[:, side])
            E[-1] = 0
    table = np.concatenate([E @ f[k] for f in W for k in range(len(f))], axis=1).astype(np.float32)
    model = Model(table, [v.astype(np.float32) for v in B], out.astype(np.float32), float(base[0]), np.zeros(len(LANGUAGE_WORDS) + 1))
    if n:
        z = np.concatenate([model.logits(w) for w in words.slices()])
        lang = np.concatenate([languages(w.hashes, w.first) for w in words.slices()])
        # A language without enough labels, or whose labels the text doesn't tell, takes the strictest cut of the others.
        own = {}
        for k in range(len(model.cuts)):
            rows = held & (lang == k)
            if min(y[rows].sum(), (1 - y[rows]).sum()) >= 12 and (c := _best_cut(z[rows], y[rows] == 1)) is not None:
                own[k] = c
        cut = _best_cut(z[held], y[held] == 1)
        strict = max(own.values()) if own else cut if cut is not None else float(z.max()) + 1
        model.cuts[:] = [own.get(k, strict) for k in range(len(model.cuts))]
    else:
        model.cuts[:] = model.base + 1
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of each whole text: the model sees nothing but the text.

    The model, of fixed size, is broadcast; there is no shuffle. Null texts are scored as empty ones; repeated rows are
    scored each; other columns are dropped, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in thin(batches):
            for lo, hi, data, off in text_slices(lower(b.column(1)), 1 << 19):
                s = m.scores(read(data, off)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= CUT).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text isn't predicted toxic. Null and empty texts are judged as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in thin(batches):
            b = pa.RecordBatch.from_arrays(b.columns, names)
            keep = [m.scores(read(data, off)) < CUT for _, _, data, off in text_slices(lower(b.column(at).cast(pa.large_string())), 1 << 19)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, kinds).toDF(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: those with crc32 of the id's text leaving 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 32_768) -> Model:
    """A model from labels outside the held-out part: at most ``rows`` labelled documents, a third of them toxic if there are so many.

    The sample is the first by a hash of the id, so it is the same in each run. Its ids are found among the labels alone.
    Of a repeated id the smallest text is taken, and texts of over ``chars`` characters aren't, so no more than ``rows``
    texts and ``rows * chars`` characters reach the driver. Scores are of whole texts, however long.

    Null texts count as empty; labels other than 0 and 1, null ids and ids without a document are left out; a repeated
    label is toxic if one of its rows is; without labels of both kinds the model rejects nothing; other columns are not read.
    """
    own = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = own.filter("toxic = 1").orderBy(*order).limit(rows // 3)
    clean = own.filter("toxic = 0").orderBy(*order).limit(rows - rows // 3)
    picked = F.broadcast(toxic.unionAll(clean))  # at most ``rows`` pairs of numbers
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= chars)
    data = texts.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    data.sort(key=lambda r: (hash_order(r["doc_id"]), r["text"] or ""))
    texts, marks = [r["text"] for r in data], [r["toxic"] for r in data]
    del data
    model = fit(texts, marks)
    del texts
    free_memory()
    return model


def hash_order(i: int) -> int:
    return int(mix64(np.array([i & ((1 << 64) - 1)], np.uint64))[0])

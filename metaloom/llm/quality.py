"""Quality scores from weak labels: expectation-maximisation over overlapping heuristics, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import lower, mix64, shingles, text_slices, thin, word_hashes
from metaloom.llm.toxicity import LANGUAGE_WORDS, _hash_words

BUCKETS = 1 << 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True  # of a character beyond ASCII, its first byte
_DIGIT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58], _BLANK[[9, 10, 11, 12, 13, 32]] = True, True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_COMMON = np.sort(_hash_words(" ".join(LANGUAGE_WORDS.values()).split()))

STATS = ("symbols", "letters", "capitals", "echo", "variety", "common", "length", "fresh")
#: Per statistic: at or below the first it votes one way, at or above the second the other; between them it abstains. ``True``: high is good.
VOTES = {
    "symbols": (0.005, 0.03, False),
    "letters": (0.88, 0.93, True),
    "capitals": (0.15, 0.4, False),
    "echo": (0.04, 0.1, False),
    "variety": (0.45, 0.6, True),
    "common": (0.05, 0.12, True),
    "length": (6.6, 7.2, False),
    "fresh": (0.6, 0.9, True),
}
#: The fewest words at which a statistic votes.
FROM_WORDS = {"letters": 10, "capitals": 5, "variety": 30, "common": 20, "fresh": 20, "length": 30, "echo": 20}


def _sum(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def stats(data: np.ndarray, off: np.ndarray, low: np.ndarray, low_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """STATS of each text, and its number of words; ``low`` is the text in lower case.

    The share of symbols in characters, that of letters and digits in characters other than white space, of capitals in letters, of words equal to the one before, of
    different words, of common words, the mean bytes of a word, and the share of different five-word shingles.
    """
    n = len(off) - 1
    chars = np.maximum(1, _sum((data & 0xC0) != 0x80, off))
    letters = _sum(_LETTER[data], off)
    words, first = word_hashes(low, low_off)
    count = np.diff(first)
    many = np.maximum(1, count)
    text = np.repeat(np.arange(n), count)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])

    def share(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        t = np.repeat(np.arange(n), np.diff(at))
        order = np.lexsort((values, t))
        v, t = values[order], t[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        return np.bincount(t[new], minlength=n) / np.maximum(1, np.diff(at))

    common = _COMMON[np.minimum(np.searchsorted(_COMMON, words), len(_COMMON) - 1)] == words
    out = [
        _sum(_SYMBOL[data], off) / chars,
        (letters + _sum(_DIGIT[data], off)) / np.maximum(1, chars - _sum(_BLANK[data], off)),
        _sum(_UPPER[data], off) / np.maximum(1, letters),
        np.bincount(text[same], minlength=n) / many,
        share(words, first),
        np.bincount(text[common], minlength=n) / many,
        letters / many,
        share(*shingles(words, first)),
    ]
    return np.stack(out, axis=1), count


def votes(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1 (good), 0 (bad) or -1 (abstains) of each labeller for each text; a text without words gets no votes."""
    out = np.full(values.shape, -1, np.int8)
    for k, name in enumerate(STATS):
        lo, hi, up = VOTES[name]
        out[values[:, k] <= lo, k] = 0 if up else 1
        out[values[:, k] >= hi, k] = 1 if up else 0
        out[words < FROM_WORDS.get(name, 1), k] = -1
    return out


@dataclass
class LabelModel:
    """P(good), and P(vote | class) by labeller, class and vote (-1, 0, 1)."""

    prior: float
    tables: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes) by row."""
        logs = np.log(self.tables)
        k = np.arange(v.shape[1])
        z = np.log(self.prior) - np.log(1 - self.prior) + (logs[k, 1, v + 1] - logs[k, 0, v + 1]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Accuracies of the labellers by EM over vote patterns and their counts, from the majority vote on.

    Votes are taken as independent given the class. Whether a labeller votes at all tells nothing of the class, only how
    it votes: abstentions have one probability for both.
    """
    m = len(STATS)
    counts = counts.astype(np.float64)
    good, bad = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    p = np.where(good + bad > 0, (good + 0.5) / (good + bad + 1), 0.5) if len(patterns) else np.zeros(0)
    model = LabelModel(0.5, np.full((m, 2, 3), 1 / 3))
    for _ in range(rounds):
        prior = (counts @ p + smooth) / (counts.sum() + 2 * smooth)
        tables = np.zeros((m, 2, 3))
        for k in range(m):
            voting = patterns[:, k] >= 0
            silent = (counts[~voting].sum() + smooth) / (counts.sum() + 2 * smooth)
            for c, w in ((0, counts * (1 - p)), (1, counts * p)):
                right = w[voting & (patterns[:, k] == c)].sum() + 2 * smooth
                wrong = w[voting & (patterns[:, k] == 1 - c)].sum() + smooth
                tables[k, c, 0] = silent
                tables[k, c, 1 + c] = (1 - silent) * right / (right + wrong)
                tables[k, c, 2 - c] = (1 - silent) * wrong / (right + wrong)
        new = LabelModel(float(prior), tables)
        q = new.posterior(patterns) if len(patterns) else p
        done = len(q) == 0 or np.abs(q - p).max() < 1e-6
        model, p = new, q
        if done:
            break
    return model


def _features(data: np.ndarray, off: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams, whether each lies within one text, and hashed bins of the statistics."""
    d = data.astype(np.uint32)
    tri = np.zeros(len(d), np.uint32)
    tri[: max(0, len(d) - 2)] = ((d[:-2] * 961 + d[1:-1]) * 961 + d[2:]) if len(d) > 2 else 0
    tri = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(d), bool)
    for k in (1, 2):
        at = off[1:] - k
        inside[at[at >= 0]] = False
    bins = np.minimum((np.sqrt(np.clip(values / np.array([1, 1, 1, 1, 1, 1, 16, 1]), 0, 1)) * 12).astype(np.uint64), np.uint64(11))
    hashed = mix64(bins + np.arange(len(STATS), dtype=np.uint64)[None, :] * np.uint64(64) + np.uint64(1 << 20)) & np.uint64(BUCKETS - 1)
    return tri, inside, hashed.astype(np.int64)


@dataclass
class Scorer:
    """Weights of hashed trigrams (as a mean over a text) and of hashed statistic bins, and the base."""

    trigrams: np.ndarray
    bins: np.ndarray
    base: float

    def score(self, data: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
        tri, inside, bins = _features(data, off, values)
        c = np.concatenate([[0.0], np.cumsum(np.where(inside, self.trigrams[tri], 0))])
        n = np.maximum(1, _sum(inside, off))
        z = (c[off[1:]] - c[off[:-1]]) / n + self.bins[bins].sum(axis=1) + self.base
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str | None], target: np.ndarray, epochs: int = 12, rate: float = 0.3, seed: int = 9, bins_too: bool = True) -> Scorer:
    """Logistic regression on soft labels by Adagrad, text by text in a fixed shuffled order. Without ``bins_too`` it learns from the trigrams alone, and not from the statistics that the labellers vote by."""
    scorer = Scorer(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0)
    rows = []
    for data, off, values, _ in _read(pa.array(texts, pa.large_string())):
        tri, inside, bins = _features(data, off, values)
        for i in range(len(off) - 1):
            own, n = np.unique(tri[off[i] : off[i + 1]][inside[off[i] : off[i + 1]]], return_counts=True)
            rows.append((own, n / max(1, n.sum()), bins[i]))
    gt, gb, g0 = np.full(BUCKETS, 0.01), np.full(BUCKETS, 0.1), 0.1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            own, x, bins = rows[i]
            z = scorer.trigrams[own] @ x + scorer.bins[bins].sum() + scorer.base
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[i]
            gt[own] += (g * x) ** 2
            scorer.trigrams[own] -= rate * g * x / np.sqrt(gt[own])
            gb[bins] += g * g
            if bins_too:
                scorer.bins[bins] -= rate * g / np.sqrt(gb[bins])
            g0 += g * g
            scorer.base -= rate * g / np.sqrt(g0)
    return scorer


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, statistics, words) of slices of texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    for lo, hi, data, off in text_slices(column, 1 << 20):
        (_, _, low, low_off), *_ = text_slices(lower(column.slice(lo, hi - lo)), 1 << 62)
        yield data, off, *stats(data, off, low, low_off)


def patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(votes, n): how many texts have each pattern of votes; at most 3 ** 8 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            for _, _, values, words in _read(b.column(0)):
                own, n = np.unique(votes(values, words), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in own], pa.binary()), pa.array(n, pa.int64())], ["votes", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "votes binary, n long")
    return rows.groupBy("votes").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, rows: int = 4000, chars: int = 32_768, *, id_col: str = "doc_id", text_col: str = "text", bins_too: bool = True) -> tuple[LabelModel, Scorer]:
    """The label model, from the votes on all texts, and the scorer, from the ``rows`` texts of smallest id hash, among those of up to ``chars`` characters, with their posteriors.

    Of a repeated id the smallest text is taken, so no more than ``rows``
    texts and ``rows * chars`` characters reach the driver. Null texts count as empty; rows with a null id vote but
    don't train the scorer; other columns are not read; an empty table gives models that keep everything or nothing alike.
    """
    found = patterns(docs, text_col).collect()
    v = np.array([np.frombuffer(r["votes"], np.int8) for r in found], np.int8).reshape(-1, len(STATS))
    order = np.lexsort(v.T) if len(v) else np.zeros(0, int)
    model = estimate(v[order], np.array([r["n"] for r in found], np.int64)[order])
    short = F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) <= chars
    picked = docs.filter(short).select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= chars)
    data = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text")).collect()
    data.sort(key=lambda r: (str(r["id"]), r["text"] or ""))
    texts = [r["text"] for r in data]
    parts = [model.posterior(votes(values, words)) for _, _, values, words in _read(pa.array(texts, pa.large_string()))]
    learn = fit if bins_too else partial(fit, bins_too=False)
    return model, learn(texts, np.concatenate(parts) if parts else np.zeros(0))


def score(docs: DataFrame, model: LabelModel, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """(id_col, posterior, score, keep): what the labellers say, what the scorer says, and whether the score is ``keep`` at least.

    Both models have a fixed size and are broadcast; there is no shuffle. Null texts are scored as empty ones, for which
    all labellers abstain; repeated rows are scored each; other columns are dropped, whatever their names; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value
        for b in thin(batches):
            at = 0
            for data, off, values, words in _read(b.column(1)):
                n = len(off) - 1
                z = s.score(data, off, values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(m.posterior(votes(values, words))), pa.array(z), pa.array(z >= keep)], [id_col, "posterior", "score", "keep"])
                at += n

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, posterior double, score double, keep boolean")

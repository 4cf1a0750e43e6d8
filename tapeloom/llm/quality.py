"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a short vector of shape statistics over its whole length (no label, language, source or id). Each
feature is cut into bins; cyclic boosting adds one shallow tree at a time to the features' lookup tables in turn,
then to two-way tables of the pairs that explain most of what is left. A score is a sum of looked-up bins through
a logistic. Training sees at most SAMPLE labelled rows of each class, which is a documented bound.

Null or empty texts have the vector of an empty text and get its score. Very long texts are read whole. Repeated rows
get equal scores; ties in the order of the sample are broken by doc_id, equal gains by the first cut. Without labelled rows
every score is 0.5; with one class only, the labels' share. An empty table gives no rows. Other columns pass through; only
one named as the score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.labels import fold, sample
from tapeloom.llm._shared import table

SAMPLE = 8000
NAMES = ("log_words", "word_len", "upper", "digit", "punct", "symbol", "pipe", "bang", "wide", "space", "line_words", "unique", "top_word", "repeat", "unique_lines", "caps_words", "no_letter_words", "stops")
_ASCII = np.arange(256)


def _mask(chars: str) -> np.ndarray:
    return np.isin(_ASCII, [ord(c) for c in chars]).astype(float)


_MASKS = np.stack([_mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), _mask(".,;:'\"()-"), _mask("#$%&*@^_~<>=+{}[]\\/`"), _mask("|"), _mask("!?"), (_ASCII >= 128).astype(float), _mask(" \t\r\n")], 1)


def vectors(texts) -> np.ndarray:
    """One row of NAMES per text."""
    hist, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), 10))
    for i, t in enumerate(texts):
        if not t:
            continue
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        hist[i] = np.bincount(raw, minlength=256)
        words = t.split()
        n = len(words)
        if not n:
            continue
        count = Counter(words)
        lines = t.split("\n")
        rest[i] = (np.log1p(n), (len(t) - n + 1) / n, n / len(lines), len(count) / n, max(count.values()) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), sum(map(str.isupper, words)) / n, sum(not any(map(str.isalnum, w)) for w in count) / len(count), t.count(". ") / n)
    shares = hist @ _MASKS / np.maximum(hist.sum(1, keepdims=True), 1)
    return np.column_stack([rest[:, :2], shares, rest[:, 2:]])


def _tree(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin: a tree over ordered bins with up to `splits` cuts, the best cut first."""
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    leaves = [(0, len(g))]
    for _ in range(splits):
        best = (1e-9, None, None)
        for a, b in leaves:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                won = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        a, b = best[1]
        leaves.remove((a, b))
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 5.0):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.ridge = bins, coarse, rounds, pairs, pair_rounds, rate, ridge
        self.base, self.cuts, self.tables, self.pairs, self.rough = 0.0, [], [], {}, []

    def _binned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        r = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.rough)], 1)
        return b, r

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        q = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
        self.cuts, self.rough = q(self.bins), q(self.coarse)
        b, r = self._binned(x)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * _tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), 3, self.ridge)
                t += step
                f += step[b[:, j]]
        p = 1 / (1 + np.exp(-f))
        scored = []
        for j in range(x.shape[1]):
            for k in range(j + 1, x.shape[1]):
                g, h = self._cells(r, j, k, y - p, p * (1 - p))
                scored.append((self._quadrants(g, h)[0], j, k))
        self.pairs = {(j, k): np.zeros((len(self.rough[j]) + 1, len(self.rough[k]) + 1)) for _, j, k in sorted(scored, reverse=True)[: self.n_pairs]}
        for _ in range(self.pair_rounds):
            for (j, k), t in self.pairs.items():
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._quadrants(*self._cells(r, j, k, y - p, p * (1 - p)))[1]
                t += step
                f += step[r[:, j], r[:, k]]
        return self

    def _cells(self, r, j, k, g, h):
        shape = len(self.rough[j]) + 1, len(self.rough[k]) + 1
        at = r[:, j] * shape[1] + r[:, k]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    def _quadrants(self, g, h):
        """Gain and cell values of the best two-cut tree over a pair's cells."""
        best, out = 0.0, np.zeros_like(g)
        for a in range(1, g.shape[0]):
            for b in range(1, g.shape[1]):
                parts = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
                sums = [(g[s].sum(), h[s].sum() + self.ridge) for s in parts]
                gain = sum(x * x / y for x, y in sums)
                if gain > best:
                    best, out = gain, np.zeros_like(g)
                    for s, (x, y) in zip(parts, sums):
                        out[s] = x / y
        return best, out

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.cuts:
            b, r = self._binned(x)
            for j, t in enumerate(self.tables):
                f += t[b[:, j]]
            for (j, k), t in self.pairs.items():
                f += t[r[:, j], r[:, k]]
        return 1 / (1 + np.exp(-f))


def train(docs: DataFrame, labels: DataFrame, train_rows=None, bound: int = SAMPLE) -> AdditiveModel:
    """A model of `labels.quality`, from at most `bound` rows of each class."""
    usable = F.lit(True) if train_rows is None else train_rows
    picked = sample(docs, labels, "quality", usable, {0: bound, 1: bound})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"x": list(vectors(d["text"].tolist())), "y": d["y"]})

    rows = picked.mapInPandas(run, "x array<double>, y int").collect()  # at most 2 * bound short vectors
    n = {r.y: r.n for r in labels.where(F.col("quality").isin(0, 1) & usable).groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n")).collect()}
    rows.sort(key=lambda r: (r.y, r.x))
    x, y = np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.y for r in rows], float)
    model = AdditiveModel().fit(x, y)
    if len(y) and 0 < y.sum() < len(y):  # the sample's odds back to the labels' own
        model.base += float(np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model if len(y) else AdditiveModel()


def scored(docs: DataFrame, model: AdditiveModel, column: str = "quality_score") -> DataFrame:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(vectors(texts.tolist())))

    return docs.withColumn(column, score("text"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    d = scored(docs, model, "score")
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""Toxicity: a support vector machine on a gapped subsequence kernel with Nyström landmarks.

The kernel compares two terms by the three-character subsequences they share; a gap of one or two characters in a
subsequence costs a factor DECAY each, so inserted or dropped characters weaken a match and don't end it. Scaling a
term's features by its own length keeps the kernel positive. LANDMARKS terms give the Nyström map; a linear SVM
(squared hinge) is trained in that space. Its decision is linear in the kernel, so all landmarks fold into one
weight per hashed subsequence, and a term's decision is a sum of looked-up weights.

Labels mark documents while insults stand in sentences, in many inflected forms, and some of their forms also turn up
by chance in clean documents. So three steps lead from terms to documents. Terms (white-space separated, or spelled out
letter by letter) get their training labels by multiple-instance rules: positive are those that, or whose first STEM
characters, toxic documents hold e times as often as clean ones or more and far oftener than chance explains (a likelihood
ratio of SURE or more); the others of clean documents are negative. Positive terms also train with letters put in. The machine then decides on every term of a text, and a sentence's evidence is what its terms
add up to. A logistic model with squares and products judges the document by its three strongest terms, its strongest
sentence, all its evidence and its length, so a form that clean texts hold once counts when it comes back.

At most SAMPLE labelled documents of each class train, of their terms at most POSITIVE positive, USUAL usual and OTHER
other negative ones (documented bounds; scoring and the counts of the sample's terms leave nothing out). A null or empty
text has no term and gets the features of none; very long texts are read whole, long terms in overlapping windows;
repeated rows get equal scores, ties in evidence are broken by the term; an empty table gives no rows; without both
labels every score is the labels' share. Other columns pass through; only one named as the score is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm._shared import stored, table
from tapeloom.llm.labels import fold, sample
from tapeloom.llm.shingles import chunks

SAMPLE, LANDMARKS, BITS, DECAY, WINDOW, CACHE, CHUNK = 6000, 256, 15, 0.5, 48, 200_000, 1 << 19
POSITIVE, USUAL, OTHER, STEM, ODDS, SURE = 1500, 3000, 6000, 6, 1.0, 20.0
NO_TERM, END = -2.0, 1e4
SPELLED = re.compile(r"(?<!\w)(?:\w[^\w\n]{1,3}){3,}\w(?!\w)")
_PAIRS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]


def tokens(text: str | None) -> list[str]:
    """The terms of a whole text in order, those spelled out letter by letter at its end; a line's end is a term '.'."""
    if not text:
        return []
    t = text.lower()
    out = t.replace("\n", " . ").split()
    if SPELLED.search(t):
        for m in SPELLED.finditer(t):
            out += [".", m.group()]
    return out


def terms(text: str | None) -> set[str]:
    """The distinct terms of a whole text."""
    return set(tokens(text)) - {"."}


def _windows(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all terms, long ones in overlapping windows that cover them whole; the term each row is of."""
    rows, of = [], []
    for i, t in enumerate(batch):
        for k in range(0, max(1, len(t) - WINDOW // 2), WINDOW // 2) if len(t) > WINDOW else (0,):
            rows.append(t[k : k + WINDOW])
            of.append(i)
    width = max(map(len, rows), default=1) + 6
    raw = np.frombuffer("".join(r.ljust(width, "\0") for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), width)
    word = (raw >= 0x61) & (raw <= 0x7A) | (raw >= 0x30) & (raw <= 0x39) | (raw >= 0xAA) & (raw != 0xD7) & (raw != 0xF7) & ~((raw >= 0x2000) & (raw <= 0x206F))
    return np.where(word, raw, 0).astype(np.uint32), np.array(of)


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subsequence and weight per (row, place), both padded, and the term of each row. Rows have unit length."""
    c, of = _windows(batch)
    n = c.shape[1] - 6
    at, weight = [], []
    for a, b in _PAIRS:
        x, y, z = c[:, :n], c[:, a : a + n], c[:, a + b : a + b + n]
        at.append(((x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77) ^ z * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
        weight.append(np.where((x > 0) & (y > 0) & (z > 0), DECAY ** (a + b - 2), 0.0).astype(np.float32))
    at, weight = np.concatenate(at, 1), np.concatenate(weight, 1)
    weight /= np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-6)
    return at, weight, of


def dense(batch: list[str]) -> np.ndarray:
    at, weight, of = features(batch)
    out = np.zeros((len(batch), 1 << BITS), np.float32)
    np.add.at(out, (of[:, None], at), weight)
    return out


def decide(batch: list[str], v: np.ndarray) -> np.ndarray:
    """Decision of each term: its strongest window's."""
    out = np.full(len(batch), -np.inf, np.float32)
    order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
    for k in range(0, len(order), 2048):  # of like lengths, so that little is padding
        part = order[k : k + 2048]
        at, weight, of = features([batch[i] for i in part])
        np.maximum.at(out, np.array(part)[of], (v[at] * weight).sum(1))
    return out


class KernelMachine:
    """v: weight of each hashed subsequence; bias; centre, spread and weights of the model of whole documents; level without one."""

    def __init__(self, v=None, bias=0.0, level=0.0):
        self.v, self.bias, self.level = v, bias, level
        self.centre = self.spread = self.weights = None
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def evidence(self, texts) -> np.ndarray:
        """A row per text: its three strongest terms, its strongest sentence, log of all evidence, log of the number of terms."""
        return np.concatenate([self._evidence(texts[a:b]) for a, b in chunks(texts, CHUNK)] or [np.zeros((0, 6))])

    def _evidence(self, texts) -> np.ndarray:
        found = [tokens(t) for t in texts]
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > CACHE:  # a cache of bounded size; what it forgets is computed again
            self.known = {}
            new = set().union(*found)
        if new:
            names = sorted(new)
            ends = np.array([x[-1] in ".!?" for x in names]) * END  # a term that ends a sentence is told by its size
            self.known.update(zip(names, (decide(names, self.v) + self.bias + ends).tolist()))
        get, out = self.known.__getitem__, np.zeros((len(texts), 6))
        out[:, :3] = NO_TERM
        for i, words in enumerate(found):
            if not words:
                continue
            f = np.fromiter(map(get, words), float, len(words))
            end = f > END / 2
            f[end] -= END
            top = np.sort(np.partition(f, len(f) - 3)[-3:])[::-1] if len(f) > 3 else np.sort(f)[::-1]
            out[i, : len(top)] = top
            sure = np.clip(f + 0.5, 0, 2)
            out[i, 3] = np.bincount(np.cumsum(end) - end, sure).max()
            out[i, 4:] = np.log1p(sure.sum()), np.log1p(len(f))
        return out

    def inputs(self, evidence: np.ndarray) -> np.ndarray:
        """The document model's inputs: the evidence in standard units, its squares and products, and 1."""
        z = np.clip((evidence - self.centre) / self.spread, -4, 4)
        return np.column_stack([z, *[z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])], np.ones(len(z))])

    def scores(self, texts) -> np.ndarray:
        f = np.full(len(texts), self.level) if self.v is None else self.inputs(self.evidence(texts)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM with per-row costs by Newton steps over the rows inside the margin; last weight: bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        if not on.any():
            break
        new = np.linalg.solve(ridge + (x[on] * c[on, None]).T @ x[on], (x[on] * c[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def disguised(term: str) -> list[str]:
    """The term with a letter put in after a third and after two thirds of it: virtual positive examples."""
    n = len(term)
    if n < 4:
        return []
    return [term[:k] + "abcdefghijklmnopqrstuvwxyz"[zlib.crc32(f"{term}{k}".encode("utf-8", "surrogatepass")) % 26] + term[k:] for k in (n // 3, 2 * n // 3)]


def _machine(good: list[str], bad: list[str], weight: np.ndarray, landmarks: int, cost: float) -> KernelMachine:
    """good: negative terms; bad: positive terms by falling evidence `weight`; their disguised forms train with them."""
    picked, near = [], dense(bad[: 2 * landmarks])
    weight = np.asarray(weight, float)
    strong = weight[: len(near)] / weight.max()
    best = strong.copy()
    for _ in range(min(landmarks // 2, len(near))):  # strong terms first, then those least like the picked ones
        i = int(best.argmax())
        picked.append(bad[i])
        best = np.minimum(best, (1 - near @ near[i]) * np.minimum(1, 0.2 + strong))
        best[i] = -1
    del near
    marks = picked + good[: landmarks - len(picked)]
    z = dense(marks)
    value, vector = np.linalg.eigh((z @ z.T).astype(float))
    keep = value > 1e-4 * value.max()
    half = vector[:, keep] / np.sqrt(value[keep])
    to = (z.T @ half).astype(np.float32)  # subsequences to the Nyström space
    forms = [(x, w) for t, w in zip(bad, weight) for x in disguised(t)]
    rows = good + bad + [x for x, _ in forms]
    weight = np.r_[weight, [w / 2 for _, w in forms]]
    x = np.concatenate([dense(rows[k : k + 256]) @ to for k in range(0, len(rows), 256)])
    y = np.r_[-np.ones(len(good)), np.ones(len(rows) - len(good))]
    c = cost * np.r_[np.full(len(good), 1.0), weight / weight.mean()]
    w = _svm(x, y, c)
    return KernelMachine((to @ w[:-1]).astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, train_rows=None, bound: int = SAMPLE, landmarks: int = LANDMARKS) -> KernelMachine:
    """A machine for `labels.toxic`, from at most `bound` documents of each class."""
    rows = F.lit(True) if train_rows is None else train_rows
    picked = sample(docs, labels, "toxic", rows, {1: bound, 0: bound})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            n: dict[tuple[str, bool], list[int]] = {}
            for t, y in zip(d["text"], d["y"]):
                own = terms(t)
                for key in {(w, False) for w in own} | {(w[:STEM], True) for w in own if len(w) > STEM}:
                    n.setdefault(key, [0, 0])[y] += 1
            yield pd.DataFrame({"term": [k[0] for k in n], "stem": [k[1] for k in n], "clean": [a for a, _ in n.values()], "toxic": [b for _, b in n.values()]})

    sizes = {r.y: r.n for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    share = {r.y: r.n for r in labels.where(F.col("toxic").isin(0, 1) & rows).groupBy(F.col("toxic").alias("y")).agg(F.count("*").alias("n")).collect()}
    p = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    unknown = KernelMachine(level=float(np.log(p / (1 - p))))
    if not n0 or not n1:
        return unknown
    counts = picked.mapInPandas(count, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    expected = (F.col("clean") + F.col("toxic")) / float(n0 + n1)
    excess = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (expected * n))).otherwise(0.0)
    counts = stored(counts.withColumn("odds", odds).withColumn("ratio", F.when(F.col("odds") > ODDS, 2 * (excess("toxic", n1) + excess("clean", n0))).otherwise(0.0)))
    stems = counts.where("stem").select(F.col("term").alias("of"), F.col("ratio").alias("stem_ratio"))
    each = counts.where("not stem").withColumn("of", F.when(F.length("term") > STEM, F.substring("term", 1, STEM))).join(stems, "of", "left")
    each = each.withColumn("evidence", F.greatest("ratio", F.coalesce("stem_ratio", "ratio")))
    sure = (F.col("evidence") >= SURE) & (F.col("toxic") > 0)
    bad = each.where(sure).orderBy(F.desc("evidence"), "term").limit(POSITIVE).collect()
    clean = each.where(~sure & (F.col("clean") > 0) & (F.col("odds") < 1))
    usual = clean.orderBy(F.desc(F.col("clean") - F.col("toxic")), "term").limit(USUAL).collect()
    other = clean.orderBy(F.xxhash64("term"), "term").limit(OTHER).collect()
    good = list(dict.fromkeys(r.term for r in other + usual))
    if not bad or not good:
        return unknown
    model = _machine(good, [r.term for r in bad], np.array([r.evidence for r in bad]), landmarks, 4.0)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"f": list(model.evidence(d["text"].tolist())), "y": d["y"]})

    seen = picked.mapInPandas(judged, "f array<double>, y int").collect()  # seven numbers for each of the bounded sample
    seen.sort(key=lambda r: (r.f, r.y))
    f, y = np.array([r.f for r in seen]), np.array([r.y for r in seen], float)
    w = np.where(y > 0, share[1] / n1, share[0] / n0)  # the sample's classes weigh as the labels'
    w *= len(w) / w.sum()
    model.centre, model.spread = f.mean(0), f.std(0) + 1e-9
    x = model.inputs(f)
    model.weights, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.2), 1e-6]
    for _ in range(60):  # ridge logistic by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * model.weights)
        model.weights += np.clip(step, -3, 3)
    model.known = {}
    return model


def scored(docs: DataFrame, model: KernelMachine, column: str = "toxic_score") -> DataFrame:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype=float)

    return docs.withColumn(column, score("text"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    d = scored(docs, model, "score")
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

import random

import numpy as np

from tapeloom.llm import toxicity as x
from tests.llm.conftest import ODD, words


def kernel(s: str, t: str) -> float:
    """The gapped subsequence kernel by full enumeration."""

    def features(w):
        out = {}
        for i in range(len(w)):
            for a in (1, 2, 3):
                for b in (1, 2, 3):
                    if i + a + b < len(w):
                        key = w[i], w[i + a], w[i + a + b]
                        out.setdefault(key, []).append(x.DECAY ** (a + b - 2))
        return out

    f, g = features(s), features(t)
    norm = lambda h: sum(v * v for vs in h.values() for v in vs) ** 0.5
    return sum(sum(f[k]) * sum(g[k]) for k in f if k in g) / (norm(f) * norm(g))


def test_kernel_against_enumeration():
    terms = ["idiot", "idiotic", "idxiot", "worthless", "bananas"]
    d = x.dense(terms)
    for i, s in enumerate(terms):
        for j, t in enumerate(terms):
            assert abs(float(d[i] @ d[j]) - kernel(s, t)) < 1e-3
    assert kernel("idiot", "idxiot") > 4 * kernel("idiot", "bananas")


def test_terms_find_spelled_out_words():
    assert "i d i o t" in x.terms("you I D I O T here")
    assert x.tokens("One two.\nThree") == ["one", "two.", ".", "three"]
    assert x.terms(None) == x.terms("") == set()


def corpus(n: int):
    r = random.Random(2)
    insults = ["zorgblat", "flumjax", "quibbernaut"]
    rows, labels = [], []
    for i in range(n):
        w = words(i, 30 + r.randrange(80)).split()
        bad = i % 3 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(insults))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_and_tolerates_insertions(docs_of, spark):
    rows, labels = corpus(240)
    model = x.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    fresh = [(1000 + k, f"{words(5000 + k, 40)} {w} {words(6000 + k, 40)}", "a") for k, w in enumerate(["zorgblat", "zor-gblat", "flumjxax", "plainword", "quibbernaut!"])]
    got = {r.doc_id: r.s for r in x.scored(docs_of(fresh + ODD), model, "s").collect() if r.doc_id and r.doc_id >= 1000}
    assert all(got[1000 + k] >= 0.3 for k in (0, 1, 2, 4)), got
    assert got[1003] < 0.3


def test_odd_rows_and_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = x.train(docs_of(ODD), none)
    assert {round(r.s, 6) for r in x.scored(docs_of(ODD), model, "s").collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 1), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.s <= 1 for r in x.scored(docs_of(ODD), x.train(docs_of(ODD), one), "s").collect())
    assert x.scored(docs_of([]), model, "s").count() == 0


def test_long_terms_are_read_whole():
    v = np.zeros(1 << x.BITS, np.float32)
    at, w, _ = x.features(["idiot"])
    v[at[w > 0]] = 1
    assert x.decide(["x" * 500 + "idiot" + "y" * 500], v)[0] > x.decide(["x" * 1005], v)[0]


def test_an_inflected_word_counts_when_it_comes_back(docs_of, spark):
    """Forms of one stem: clean documents hold one at times, toxic ones several. Held-out rows must be told apart."""
    r = random.Random(9)
    ends = [a + b for a in "aeiou" for b in ("n", "s", "x", "mu", "ka")]
    rows, labels = [], []
    for i in range(1200):
        bad, w = i % 6 == 0, words(i, 30 + r.randrange(80)).split()
        for _ in range(r.randint(2, 4) if bad else r.random() < 0.1):
            w.insert(r.randrange(len(w)), "blorgwit" + r.choice(ends))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    docs = docs_of(rows)
    held = x.fold(x.F.col("doc_id"), 4) == 2
    model = x.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ~held)
    got = [(s >= 0.3, labels[d][2] == 1) for d, s in x.scored(docs, model, "s").where(held).select("doc_id", "s").collect()]
    hit = sum(a and b for a, b in got)
    assert hit >= 0.9 * sum(b for _, b in got) and hit >= 0.9 * sum(a for a, _ in got)


def brute_evidence(model, text):
    """The features of a text by their definition, term by term."""
    import math
    import re

    t = (text or "").lower()
    words = re.findall(r"\S+", t.replace("\n", " . "))
    for m in x.SPELLED.finditer(t):
        words += [".", m.group()]
    f = [float(x.decide([w], model.v)[0]) + model.bias for w in words]
    sure = [min(2.0, max(0.0, v + 0.5)) for v in f]
    sentences, own = [], 0.0
    for w, s in zip(words, sure):
        own += s
        if w[-1] in ".!?":
            sentences.append(own)
            own = 0.0
    top = (sorted(f, reverse=True) + [x.NO_TERM] * 3)[:3]
    return [*top, max([*sentences, own]) if words else 0.0, math.log1p(sum(sure)), math.log1p(len(f))]


def test_scores_against_brute_force(docs_of, spark):
    rows, labels = corpus(240)
    model = x.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [t for _, t, _ in rows[:12]] + ["Z O R G B L A T you! zorgblat. And\nflumjax", "", None, "one", "é. ñ!", "zor-gblat " * 60]
    assert np.allclose(model.evidence(texts), [brute_evidence(model, t) for t in texts], atol=1e-3)

import numpy as np

from tapeloom.llm import quality
from tests.llm.conftest import ODD, words


def test_additive_model_learns_mains_and_pairs():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (6000, 5))
    y = (1.5 * np.sign(x[:, 0] * x[:, 1]) + 2 * x[:, 2] > 0).astype(float)
    m = quality.AdditiveModel().fit(x[:4000], y[:4000])
    assert ((m.predict(x[4000:]) > 0.5) == y[4000:]).mean() > 0.85
    assert set(m.pairs) & {(0, 1)}


def test_scores(docs_of, spark):
    good = [(i, words(i, 60).capitalize() + ".", "a") for i in range(80)]
    bad = [(100 + i, words(i, 60).upper().replace(" ", "!! "), "a") for i in range(80)]
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0, 0) for i, _, _ in good + bad] + [(None, 1, 1), (7000, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs_of(good[:5] + bad[:5] + ODD), model, "score").collect()
    assert len(got) == 10 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score > 0.5 for r in got[:5]) and all(r.score < 0.3 for r in got[5:10])
    scores = {r.text: r.score for r in got}
    assert scores[None] == scores[""]


def test_without_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs_of(ODD), none)
    assert {r.s for r in quality.scored(docs_of(ODD), model, "s").collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs_of(ODD), one)
    assert all(r.s > 0.5 for r in quality.scored(docs_of(ODD), model, "s").collect())

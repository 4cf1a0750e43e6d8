import numpy as np
import pytest

from tapeloom.llm import decontaminate as d
from tests.llm.conftest import ODD, words
from tests.llm.test_near_dedup import edited


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(i, words(100 + i, 30), "x") for i in range(8)] + [(50, None, "x"), (51, "", "x"), (52, words(103, 30), "x"), (53, "Exactly this", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, key string")


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_the_full_table():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = r.integers(0, 6, r.integers(1, 40)), r.integers(0, 6, r.integers(1, 20))
        assert d.align(a, b)[0] == smith_waterman(a, b)


def test_leaks(docs_of, benchmark):
    clean = [(200 + i, words(3000 + i, 120), "a") for i in range(20)]
    dirty = [
        (300, words(1, 80) + " " + words(100, 30) + " " + words(2, 80), "a"),
        (301, words(3, 10) + " " + edited(words(101, 30), 5, 0.12) + " " + words(4, 10), "a"),
        (302, words(103, 30).upper(), "a"),
        (303, words(5, 60) + " " + " ".join(words(102, 30).split()[:15] + ["put", "in"] + words(102, 30).split()[15:]), "a"),
        (304, "exactly, THIS!", "a"),
    ]
    got = d.contaminated(docs_of(clean + dirty + dirty[:1] + ODD), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(300, 0), (301, 1), (302, 3), (302, 52), (303, 2), (304, 53)}
    assert all(0.5 <= r.score <= 1 for r in got)
    docs = docs_of(clean + dirty + ODD)
    kept = d.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in clean + ODD)


def test_empty(docs_of, benchmark):
    assert d.contaminated(docs_of([]), benchmark).count() == 0
    assert d.contaminated(docs_of(ODD), benchmark.limit(0)).count() == 0


def test_long_partial_copies(spark, docs_of):
    items = [(1, words(900, 59), "x"), (2, words(901, 300), "x"), (3, words(902, 300), "x")]
    part = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = docs_of([(k, words(910 + k, 50) + " " + p + " " + words(920 + k, 50), "a") for k, p in enumerate([part(0, 9, 38), part(1, 100, 240), part(2, 50, 56)])])
    bench = spark.createDataFrame(items, "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(docs, bench).collect()}
    assert got.keys() == {(0, 1), (1, 2)} and all(0.4 < s < 0.5 for s in got.values())


def test_short_items_at_every_offset(spark, docs_of):
    items = [(n, words(950 + n, n), "x") for n in (3, 4, 5)]
    docs = docs_of([(100 * n + k, f"{words(960, 16 + k)} {t} {words(961, 20)}", "a") for n, t, _ in items for k in range(8)])
    bench = spark.createDataFrame(items, "item_id long, text string, key string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()} == {(100 * n + k, n) for n in (3, 4, 5) for k in range(8)}

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tapeloom.llm import mixing
from tests.llm.conftest import ODD, words


def level(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by sharing out again and again what goes over the caps."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def rows_of(docs):
    m = mixing.mix(docs)
    return m.select("doc_id", "text", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()


def test_targets_and_copies(docs_of):
    rows = [(i, words(i, 5 + i * 7 % 90), "abcdefg"[min(6, i % 11)] if i % 13 else None) for i in range(400)]
    got = rows_of(docs_of(rows))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = level(sizes)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r.mix_source_size == sizes[r.source]
        assert math.isclose(r.mix_target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.mix_copies <= 3
        taken[r.source] += r.mix_copies * r.mix_size
        largest[r.source] = max(largest[r.source], r.mix_size)
    for s in sizes:  # the order by size keeps the error under one document
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    assert sorted(rows_of(docs_of(rows)), key=str) == sorted(got, key=str)


def test_odd_rows(docs_of, spark):
    got = rows_of(docs_of(ODD))
    assert len(got) == len(ODD)
    assert all(r.mix_size == 0 for r in got if r.text is None or not r.text.strip())
    assert mixing.mix(docs_of(ODD).limit(0)).count() == 0
    zero = docs_of([(1, None, "a"), (2, "", "b")])
    assert [r.mix_copies for r in rows_of(zero)] == [0, 0]


def test_mixed_keeps_columns_and_repeats(docs_of):
    docs = docs_of([(i, words(i, 20), "a" if i % 4 else "b") for i in range(60)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.mix_copies for r in rows_of(docs) if r.mix_copies}
    assert counts == want


def test_native_plan(docs_of):
    plan = mixing.mix(docs_of(ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.word_count(F.col("x")) is not None

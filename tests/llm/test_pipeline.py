"""Each stage of the pipeline against a brute-force version on a small corpus, and the run as a whole."""

from collections import Counter

import pytest

import corpus_pipeline as p
from tests.llm.conftest import ODD, words
from tests.llm.test_decontaminate import edited
from tests.llm.test_near_dedup import brute

ITEM = words(777, 30)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs_of):
    d = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(150):
        text = words(i, 60)
        if i % 5 == 0:
            text += " zorgblat flumjax"
        if i % 10 == 3:
            text += " " + edited(ITEM, i, 0.05)
        rows.append((i + 10, text, "abc"[i % 3]))
        labels.append((i + 10, 1, int(i % 5 == 0)))
    rows += [(500 + i, edited(words(1, 60), i, 0.01), "a") for i in range(3)] + ODD
    docs_of(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(p.STAGES)
    clean = stage["toxicity"](spark, docs, d)
    want = [r for r in rows if "zorgblat" not in (r[1] or "")]
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want)
    single = stage["near_dedup"](spark, clean, d)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {c for c in brute(want) if c is not None}
    rest = stage["decontaminate"](spark, single, d)
    leaky = {r[0] for r in rows if r[0] is not None and 10 <= r[0] < 500 and (r[0] - 10) % 10 == 3}
    assert {r.doc_id for r in rest.collect()} == {r.doc_id for r in single.collect()} - leaky
    mix = stage["mixing"](spark, rest, d)
    assert mix.columns == docs.columns and max(Counter(r.doc_id for r in mix.collect()).values()) <= 3
    assert stage["sharding"](spark, mix, d).count() == mix.count()


def test_run(spark, folder):
    out = p.run(spark, folder[0])
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_empty_stages(spark, folder, docs_of):
    for _, stage in p.STAGES:
        assert stage(spark, docs_of([]), folder[0]).count() == 0

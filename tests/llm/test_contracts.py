"""Every registered query over a small folder of tables: its columns, their types and what the contract says of them."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import queries, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "removed": "bigint", "near": "bigint", "kept_chars": "bigint"},
    "op6_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_near_dedup": {"doc_id": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def of(name):
        if name not in held:
            df = queries.QUERIES[name](spark, SF)
            assert {c: t for c, t in df.dtypes if c in COLUMNS[name]} == COLUMNS[name]
            held[name] = df.collect()
        return held[name]

    return of


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_ten_are_registered():
    assert sorted(queries.QUERIES) == sorted(COLUMNS)


def test_mixing(result, docs):
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    total, taken, target = Counter(), Counter(), {}
    for d, n in words.items():
        total[docs[d].source] += n
    for r in result("op1_mixing"):
        s = docs[r.doc_id].source
        assert r.size == words[r.doc_id] and r.source_size == total[s] and r.taken <= 3 * r.size
        assert r.target <= 3 * total[s] + 1e-6
        taken[s] += r.taken
        target[s] = r.target
    assert len(result("op1_mixing")) == len(docs) and abs(sum(target.values()) - sum(words.values())) < 1
    assert all(abs(taken[s] - target[s]) <= 2 * max(words[d] for d in docs if docs[d].source == s) for s in target)


@pytest.mark.parametrize(("name", "fold", "held"), [("op2_quality", 5, 0), ("op7_toxicity", 4, 2)])
def test_classifiers(result, docs, name, fold, held):
    rows = result(name)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by_text = defaultdict(set)
    for r in rows:
        by_text[docs[r.doc_id].text].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_embeddings_against_all_pairs(result, spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    ok = [r for r in rows if r.label is not None and r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in ok])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    links = {r.vec_id: int(n) for r, n in zip(ok, near.sum(1))}
    got = result("op3_embedding_dedup")
    assert len(got) == len(rows) and all(r.n_links == links.get(r.vec_id, 0) and r.kept == (r.vec_id == r.component_id) for r in got)


def test_pairs_and_lines(result, docs, spark):
    items = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = [(r.doc_id, r.item_id) for r in result("op4_decontaminate")]
    assert len(got) == len(set(got)) and all(d in docs and i in items for d, i in got)
    for r in result("op5_line_dedup"):
        lines = [x for x in (docs[r.doc_id].text or "").split("\n") if x.strip(" ")]
        assert r.n_lines == len(lines) and 0 <= r.near <= r.removed <= r.n_lines and r.kept_chars <= sum(map(len, lines))


def test_pages(result, spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    for r in result("op8_url_filters"):
        host, path = "", ""
        if pages[r.page_id].url and "://" in pages[r.page_id].url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", pages[r.page_id].url.split("://", 1)[1]).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[2]
    for r in result("op6_html"):
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) and "<p>" not in r.text
    assert len(result("op6_html")) == len(result("op8_url_filters")) == len(pages)


def test_shards(result, docs):
    slots, size, where = defaultdict(list), Counter(), defaultdict(set)
    for r in result("op9_sharding"):
        text = docs[r.doc_id].text
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        if text is not None:
            where[text].add(r.shard)
    assert sum(map(len, slots.values())) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())


def test_copies(result, docs):
    rows = result("op10_near_dedup")
    least = {}
    for r in rows:
        least[r.component_id] = min(r.doc_id, least.get(r.component_id, r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)
    assert len(rows) == len(docs) and all(k == v for k, v in least.items())
    by_text = defaultdict(set)
    for r in rows:
        if docs[r.doc_id].text is not None:
            by_text[docs[r.doc_id].text].add(r.component_id)
    assert all(len(s) == 1 for s in by_text.values())


def test_quality_scores_against_plain_lookups():
    """A score by its definition: for each feature and pair, count the cuts that the value reaches and look the bin up."""
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 5))
    model = quality.AdditiveModel(rounds=10, pair_rounds=5).fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float))
    assert model.pairs
    for row, got in zip(x[:60], model.predict(x[:60])):
        f = model.base
        for j, table in enumerate(model.tables):
            f += table[sum(row[j] >= c for c in model.cuts[j])]
        for (j, k), table in model.pairs.items():
            f += table[sum(row[j] >= c for c in model.rough[j])][sum(row[k] >= c for c in model.rough[k])]
        assert abs(got - 1 / (1 + np.exp(-f))) < 1e-9

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np

from tapeloom.llm import sharding
from tests.llm.conftest import ODD, words


def test_law_groups_and_slots(docs_of):
    rows = [(i, words(i % 300, 10 + i % 40), "a") for i in range(700)]
    got = sharding.shard(docs_of(rows)).collect()
    texts = {i: t for i, t, _ in rows}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    where, size, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        t = texts[r.doc_id]
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert r.law == "bytes" and r.grown_shard is None
        where[t].add(r.shard)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert set(size) == set(range(16))
    assert max(size.values()) - min(size.values()) < 0.05 * np.mean(list(size.values()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_group_above_a_shard_is_dealt_out(docs_of):
    got = sharding.shard(docs_of([(i, "same words here", "a") for i in range(3000)])).collect()
    size = Counter(r.shard for r in got)
    assert len(size) == 16 and max(size.values()) < 1.5 * min(size.values())


def test_odd_rows(docs_of):
    got = sharding.shard(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 1] == [(1, None)]
    assert sharding.shard(docs_of([])).count() == 0


def test_pack_spreads_bytes_evenly():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 50, (400, 3)).astype(float)
    placed = sharding.pack(sizes, np.ones((8, 3)), sizes.sum(0) / 8)
    total = np.bincount(placed, sizes[:, 0], 8)
    assert total.max() - total.min() <= 50


def test_pack_against_exhaustive_search():
    """Bytes, which the law holds, and all dimensions together, against the best of all 3 ** 8 placements."""
    r = np.random.default_rng(4)
    for _ in range(12):
        sizes = r.integers(1, 30, (8, 3)).astype(float)
        unit = sizes.sum(0) / 3
        loads = lambda placed: np.array([sizes[placed == s].sum(0) for s in range(3)]) / unit
        every = [loads(np.array(p)) for p in itertools.product(range(3), repeat=8)]
        own = loads(sharding.pack(sizes, np.ones((3, 3)), unit))
        assert own[:, 0].max() <= min(x[:, 0].max() for x in every) + 0.2
        assert own.max() <= min(x.max() for x in every) + 0.9


def test_pack_places_by_the_dot_product_with_what_is_left():
    left = np.array([[0.9, 0.1, 0.5], [0.1, 0.9, 0.5], [0.5, 0.5, 0.5]])
    sizes = np.array([[0.4, 0.05, 0.1], [0.05, 0.4, 0.1]])
    before = left.copy()
    placed = sharding.pack(sizes, left, np.array([1e-9, 1, 1]) + np.array([1, 0, 0]))
    assert placed.tolist() == [int(np.argmax(np.where((before >= x).all(1), before @ x, -1))) for x in sizes]
    assert np.allclose(before.sum(0) - left.sum(0), sizes.sum(0))


def test_parts_and_large_groups_together(docs_of):
    """Groups of all sizes over many parts: each is whole but those above a shard, and sizes stay near equal."""
    rows = [(i, words(i, 20 + i % 60), "a") for i in range(1500)]
    rows += [(2000 + i, words(7000 + i % 8, 40), "a") for i in range(600)] + [(3000 + i, words(9000, 60), "a") for i in range(700)]
    got = sharding.shard(docs_of(rows), heavy=64, part=100).collect()
    texts = {i: t for i, t, _ in rows}
    where, size, slots = defaultdict(set), Counter(), defaultdict(list)
    for x in got:
        where[texts[x.doc_id]].add(x.shard)
        size[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert len(got) == len(rows) and {t for t, s in where.items() if len(s) > 1} == {words(9000, 60)}
    assert max(size.values()) < 1.1 * min(size.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard(docs_of(rows).repartition(7), heavy=64, part=100).collect()))

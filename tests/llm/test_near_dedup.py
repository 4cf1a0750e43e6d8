import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import near_dedup as n, shingles
from tests.llm.conftest import ODD, words


def shingle_counts(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    """Component (least doc_id) of each row."""
    texts = [shingle_counts(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, t, _) in enumerate(rows):
        for j in range(i):
            u = rows[j][1]
            if t is not None and u is not None and (t == u or texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.8):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [least.get(top(i)) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    out, k = [], 10
    for g in range(25):
        base = words(g, 40 + g * 6)
        for c in range(1 + g % 6):
            out.append((k, base if c % 3 == 0 else edited(base, k, 0.004 * (1 + c)), "a"))
            k += 1
    line = words(999, 30)
    out += [(k + i, words(2000 + i, 60) + " " + line, "a") for i in range(20)]
    return out + ODD


def test_classes_against_all_pairs(docs_of, rows):
    got = n.classes(docs_of(rows)).collect()
    by_row = {(r.doc_id, bytes(r.node)): r.component_id for r in got}
    import hashlib

    for row, want in zip(rows, brute(rows)):
        if row[1] is not None:
            assert by_row[row[0], hashlib.md5(row[1].encode()).digest()] == want, row[0]
    assert len(got) == len(rows)
    alone = [r for r in got if r.doc_id == 1]
    assert alone[0].component_id == 1 and alone[0].kept


def test_copies_unlike_their_hub_against_all_pairs(docs_of):
    """Edited copies of one text, near to it and mostly not to each other, and texts that share a long passage."""
    rows, r = [], random.Random(8)
    for g in range(12):
        base = words(500 + g, 100)
        rows.append((1000 * g, base, "a"))
        for c in range(1, 25):
            w = base.split()
            for i in r.sample(range(100), 2):
                w[i] = f"new{r.randrange(10**6)}"
            rows.append((1000 * g + c, " ".join(w), "a"))
    passage = words(77, 80)
    rows += [(50_000 + i, passage + " " + words(7000 + i // 2, 36) + f" end{i}", "a") for i in range(40)]
    want = {row[0]: c for row, c in zip(rows, brute(rows))}
    assert {r.doc_id: r.component_id for r in n.classes(docs_of(rows)).collect()} == want


def test_deduplicated_keeps_one_of_each_class(docs_of, rows):
    docs = docs_of(rows)
    out = n.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) == len({c for c in brute(rows) if c is not None})
    assert n.deduplicated(docs_of([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    a = words(1, 400) + " " + " ".join(["again and again we say so"] * 20)
    b = edited(a, 3, 0.03)
    units, doc = n.text_units([a, b])
    s = n.signatures(units, doc, 2)
    assert abs((s[0] == s[1]).mean() - jaccard(shingle_counts(a), shingle_counts(b))) < 0.15


def test_signatures_of_a_single_shingle():
    texts = ["one", "one", "two", ""]
    units, doc = n.text_units(texts)
    s = n.signatures(units, doc, 4)
    assert (s[0] == s[1]).all() and not (s[0] == s[2]).any() and not s[3].any()


def test_word_hashes_do_not_depend_on_the_batch():
    texts = [words(i, 30) for i in range(20)] + [None, "", "É è 漢字"]
    whole, count = shingles.words(texts)
    ends = np.cumsum(count)
    for i, t in enumerate(texts):
        alone, m = shingles.words([t])
        assert m[0] == count[i] and (alone == whole[ends[i] - count[i] : ends[i]]).all()

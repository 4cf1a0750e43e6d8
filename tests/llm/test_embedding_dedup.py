import numpy as np
import pytest

from tapeloom.llm import embedding_dedup as e


def brute(rows):
    ok = [i for i, (_, x, y) in enumerate(rows) if y is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i] += 1
                    p, q = top(i), top(j)
                    root[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], links[i], least[top(i)]) for i, r in enumerate(rows)]


def sample(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 5, dim))
    out = []
    for i in range(n):
        x = centres[i % len(centres)] + r.standard_normal(dim) * (0.12 if i % 3 else 0.03)
        out.append((i, [float(np.float32(v)) for v in x * r.uniform(0.1, 10)], int(i % 2)))
    return out


@pytest.mark.parametrize("dim", [8, 33, 64])
def test_against_all_pairs(spark, dim):
    rows = sample(240, dim, dim)
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(20)] + [(1000, rows[7][1], rows[7][2])]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [None] + [1.0] * (dim - 1), 1), (2004, [float("nan")] * dim, 1), (2005, [float("inf")] * dim, 1), (2006, rows[0][1], None), (2007, rows[0][1][:-1], rows[0][2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in e.classes(df).collect())
    want = sorted(brute(rows))
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) <= links and sum(g[1] for g in got) >= 0.98 * links
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[2] != w[2] for g, w in zip(got, want)) <= 0.01 * len(want)
    blocks = sorted((r.vec_id, r.n_links, r.component_id) for r in e.classes(df, block=16).collect())
    assert blocks == got  # cutting filters into blocks changes nothing


def test_empty(spark):
    assert e.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_list_decoding_finds_every_filter_above_the_threshold():
    r = np.random.default_rng(2)
    x = r.standard_normal((20, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = e.codebooks(24, 3, 6)
    row, code, _ = e.decode(x, books, 0.3)
    got = set(zip(row.tolist(), code.tolist()))
    want = set()
    for i in range(20):
        for a in range(6):
            for b in range(6):
                for c in range(6):
                    if sum(x[i, s] @ book[:, k] for (s, book), k in zip(books, (a, b, c))) > 0.3:
                        want.add((i, (a * 6 + b) * 6 + c))
    assert got == want

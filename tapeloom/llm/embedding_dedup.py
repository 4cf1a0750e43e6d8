"""Embedding near-dedup with spherical-cap filters.

Filters are directions built as product codes: the dimensions are cut into PARTS blocks, each block has a random
codebook, and a filter is one code per block. A vector lies in every filter whose inner product with it exceeds a
threshold; list decoding finds these block by block and drops partial codes that can't reach it. The number of filters
grows with the vectors so that a filter holds about LOAD of a label's; the threshold lets a vector into about HITS
filters, and one in fewer than LEAST takes its LEAST best instead.

Vectors of a label that share a filter are compared exactly, in double precision. A filter with many vectors is cut
into blocks of BLOCK, and each pair of blocks is one group, so no task holds a whole filter. A pair that shares several
filters is counted in the least one only, so groups send sums and local components, never pairs. Equal vectors of a
label are one node with a count.

Nulls, odd rows: a null label, a null or empty vector, a zero vector or one with null or non-finite components links
with nothing and is its own component; vectors of different lengths never link; repeated rows are vectors of their own
that link, and rows of one vec_id are one name with a row each, so ties in the least vec_id change nothing. A very long
vector is compared whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm._shared import components, runs, stored, table

COSINE, HITS, LEAST, LOAD, BLOCK, PARTS = 0.98, 12, 5, 64, 1024, 2


def codebooks(dim: int, parts: int, size: int) -> list[tuple[slice, np.ndarray]]:
    """Unit codes of each block of dimensions, scaled so that a whole filter has length 1."""
    r = np.random.default_rng(dim * 1_000_003 + parts * 1009 + size)
    cuts = np.linspace(0, dim, parts + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        c = r.standard_normal((size, b - a))
        out.append((slice(a, b), (c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(parts)).T))
    return out


def decode(x: np.ndarray, books, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter, score) of all filters above the threshold of each unit vector."""
    scores = [x[:, s] @ c for s, c in books]
    most = [s.max(1) for s in scores]
    row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for k, s in enumerate(scores):
        reach = sum(most[k + 1 :]) if k + 1 < len(scores) else np.zeros(len(x))
        t = total[:, None] + s[row]
        i, j = np.nonzero(t + reach[row][:, None] > threshold)
        row, code, total = row[i], code[i] * s.shape[1] + j, t[i, j]
    return row, code, total


def filters(x: np.ndarray, books, hits: float, least: int) -> list[np.ndarray]:
    """Sorted filters of each unit vector."""
    size = math.prod(c.shape[1] for _, c in books)
    least = min(least, size)
    z = NormalDist().inv_cdf(max(1e-12, 1 - min(hits / size, 0.9)))
    out: list[np.ndarray | None] = [None] * len(x)
    todo = np.arange(len(x))
    while len(todo):
        row, code, score = decode(x[todo], books, z / math.sqrt(x.shape[1]) if z > -4 else -np.inf)
        n = np.bincount(row, minlength=len(todo))
        ends = np.concatenate([[0], np.cumsum(n)])
        for i in np.flatnonzero(n >= least):
            own, s = code[ends[i] : ends[i + 1]], score[ends[i] : ends[i + 1]]
            if len(todo) < len(x):  # found by a lowered threshold: the best few
                own = own[np.argsort(-s, kind="stable")[:least]]
            out[todo[i]] = np.sort(own)
        todo = todo[n < least]
        z -= 0.4
    return out  # type: ignore[return-value]


def _keyed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, kind).tobytes() for v in batch.column("embedding").to_pylist()]
            keys = [hashlib.blake2b(b"%d:" % label + r, digest_size=16).digest() for label, r in zip(batch.column("label").to_pylist(), raw)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "node", "label", "vector"])

    return run


def _unit(raw, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(kind: str, parts: int, size: int, hits: float, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for _, same in d.groupby(d["vector"].map(len), sort=False):
                x = _unit(same["vector"], kind)
                f = filters(x, codebooks(x.shape[1], parts, size), hits, least)
                yield pd.DataFrame({"node": same["node"].values, "label": same["label"].values, "copies": same["copies"].values, "vector": same["vector"].values, "filters": f})

    return run


def _linked(kind: str, least_cosine: float):
    def group(f: int, across: bool, rows: pa.RecordBatch) -> tuple[list[bytes], list[int], list[bytes]]:
        """Links inside one pair of blocks of one filter: for each node the weight of those first met here, and its local component."""
        raw = rows.column("vector").to_pylist()
        x = _unit(raw, kind)
        near = x @ x.T >= least_cosine
        np.fill_diagonal(near, False)
        if across:  # pairs inside a block are another group's
            own = rows.column("block").to_numpy()
            near &= own[:, None] != own[None, :]
        on = np.flatnonzero(near.any(1))
        if not len(on):
            return [], [], []
        near, nodes = near[np.ix_(on, on)], rows.column("node").take(pa.array(on)).to_pylist()
        w = rows.column("copies").to_numpy()[on]
        lower = [v[v < f] for v in (np.asarray(v) for v in rows.column("filters").take(pa.array(on)).to_pylist())]
        ids = np.unique(np.concatenate(lower))
        has = np.zeros((len(on), len(ids)), np.float32)
        for k, v in enumerate(lower):
            has[k, np.searchsorted(ids, v)] = 1
        links = ((near & (has @ has.T == 0)) * w).sum(1)  # pairs that share no lesser filter
        root = np.arange(len(on))
        while True:  # local components: the least row reachable
            least = np.minimum(root, np.where(near, root[None, :], len(on)).min(1))
            if (least == root).all():
                break
            root = least
        return nodes, links.tolist(), [nodes[k] for k in root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = [], [], []
        kinds = pa.binary(), pa.int64(), pa.binary()
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["node", "links", "hub"])
        for (_, _, f, i, j), rows in runs(batches, ("label", "bytes", "filter", "i", "j")):
            for to, new in zip(out, group(f, i != j, rows) if rows.num_rows > 1 else ((), (), ())):
                to.extend(new)
            if len(out[0]) > 10_000:
                yield made()
                out = [], [], []
        yield made()

    return run


def comparable():
    """Whether a row can link at all; never null."""
    x = F.col("embedding")
    ok = F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.coalesce(ok, F.lit(False))


def links(vectors: DataFrame, cosine: float = COSINE, hits: float = HITS, load: int = LOAD, block: int = BLOCK, parts: int = PARTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((vec_id, node) of vectors that can link, (node, links, copies), links (u, v) that span the components)."""
    kind = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    ok = comparable()
    d = vectors.where(ok).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x + 0).alias("embedding"))
    rows = stored(d.mapInArrow(_keyed(kind), f"vec_id {dict(vectors.dtypes)['vec_id']}, node binary, label long, vector binary"))
    nodes = rows.groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"))
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    size = max(2, math.ceil((max(largest, 1) * hits / load) ** (1 / parts)))
    made = stored(nodes.mapInPandas(_filtered(kind, parts, size, hits, LEAST), "node binary, label long, copies long, vector binary, filters array<long>"))
    each = made.withColumn("filter", F.explode("filters")).withColumn("bytes", F.octet_length("vector"))
    held = each.groupBy("label", "bytes", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    each = each.join(held, ["label", "bytes", "filter"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = ("label", "bytes", "filter", "i", "j")
    each = each.select(*group, "block", "node", "copies", "vector", "filters").repartition(*group).sortWithinPartitions(*group)
    part = each.mapInArrow(_linked(kind, cosine), "node binary, links long, hub binary")
    part = stored(part)
    count = part.groupBy("node").agg(F.sum("links").alias("links"))
    count = nodes.select("node", "copies").join(count, "node", "left").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("vec_id", "node"), count, part.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))


def classes(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label)."""
    rows, count, spans = links(vectors, **options)
    roots = components(spans)
    named = rows.join(count, "node").join(roots, "node", "left").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = stored(named)
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP3_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), v AS (
  SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM e
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98
), r AS (
  SELECT vec_id AS s, vec_id AS t FROM embeddings
  UNION
  SELECT r.s, l.v FROM r JOIN l ON r.t = l.u
), c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s
), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.s = e.vec_id LEFT JOIN k ON k.u = e.vec_id
"""

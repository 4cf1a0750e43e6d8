"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its five-word shingles (weight: how often each occurs; texts of fewer words have one
shingle of all). Each unit of weight is a region on which darts are thrown at a fixed rate; a dart has a time and
lands on one of COORDINATES coordinates; each coordinate keeps its earliest dart. Darts are drawn by hashes of the
region and a dyadic time slot, so equal regions get equal darts in every text, and a text looks only at the few
slots it needs: about COORDINATES * (ln COORDINATES + 2) darts whatever its length. Two texts agree on a coordinate with
probability equal to their weighted Jaccard similarity. Bands of ROWS coordinates are joined.

Exact copies are one class from the start (128-bit key of the text), so a group of copies costs no links. In each band
bucket every text is first compared with the bucket's hub, the text that meets most others over all bands: the
original, where a bucket holds edited copies of one. Classes are then contracted, and only buckets that still hold
several are compared all against all, in blocks: a bucket is cut into blocks of about BLOCK texts or BLOCK_UNITS
shingles, each pair of blocks is one group, and a group sends back no pairs but the few links that span the classes it
joins. No pair of texts that meet in a bucket is left out but those already in one class, so work beyond the hubs
arises only where texts that meet are really different. Every link is verified on the texts' own shingles: weighted
Jaccard >= 0.8. Classes are the connected components; the least doc_id stays.

Nulls, odd rows: a null text links with nothing; texts without words are near only to their exact copies; equal
(doc_id, text) rows are one document; a null doc_id is the least of a class only if there is no other. Very long texts
are shingled whole, one at a time. Ties (equal least doc_id, different texts of a class) stay by the least text key. An
empty table gives no rows. Other columns are kept by `deduplicated`, whatever their names, and read by nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shingles
from tapeloom.llm._shared import components, gated, row, runs, stored, table, text_key
from tapeloom.llm.shingles import mix

SIMILAR, WORDS, BANDS, ROWS = 0.8, 5, 24, 5
BLOCK, BLOCK_UNITS, DARTS = 512, 1 << 19, 1 << 17
COORDINATES = BANDS * ROWS
_U = np.uint64
_FIRST = 18  # the first time slot ends at 2 ** -_FIRST; slot i ends at 2 ** (i - _FIRST)
_WIDTH = np.array([2.0**-_FIRST, *[2.0 ** (i - 1 - _FIRST) for i in range(1, _FIRST + 14)]])


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    k = np.arange(int(mean + 12 * math.sqrt(mean)) + 40)
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])))


_TABLES = [_poisson_table(COORDINATES * w) for w in _WIDTH]


def unit_hashes(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash per unit of weight: the k-th occurrence of a shingle in a text is a region of its own. Sorted by text."""
    order = np.lexsort((grams, doc))
    g, d = grams[order], doc[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(g) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
    nth = (np.arange(len(g)) - start).astype(_U)
    return np.where(nth == 0, g, mix(g + nth * _U(0xD1B54A32D192ED03))), d


def signatures(units: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, COORDINATES) identities of the earliest darts; texts without units have zeros."""
    out = np.zeros((n_docs, COORDINATES), _U)
    weight = np.bincount(doc, minlength=n_docs)
    need = np.ceil(np.log2((np.log(COORDINATES) + 2) / np.maximum(weight, 1))).astype(int) + _FIRST
    need = np.clip(need, 0, len(_WIDTH) - 1)
    todo = weight > 0
    best = np.full(n_docs * COORDINATES, np.iinfo(np.uint64).max, _U)
    done = np.full(n_docs, -1)
    while todo.any():
        for slot in range(int(need[todo].max()) + 1):
            ask = todo & (need >= slot) & (done < slot)
            if not ask.any():
                continue
            on = np.flatnonzero(ask[doc])
            few = max(1, int(DARTS / max(1, COORDINATES * _WIDTH[slot])))  # units that throw about DARTS darts
            few = min(few, DARTS)
            for a in range(0, len(on), few):
                part = on[a : a + few]
                key = mix(units[part] ^ _U((slot + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                n = np.searchsorted(_TABLES[slot], (key >> _U(11)).astype(float) * 2.0**-53, "right")
                who = np.repeat(np.arange(len(part)), n)
                if not len(who):
                    continue
                nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(key[who] + (nth + 1).astype(_U) * _U(0xA0761D6478BD642F))
                coord = ((dart & _U(0xFFFFFFFF)) * _U(COORDINATES) >> _U(32)).astype(int)
                # rank: the slot, then the time inside it; the bits below tell darts apart
                rank = _U(slot) << _U(58) | mix(dart) >> _U(6)
                np.minimum.at(best, doc[part][who] * COORDINATES + coord, rank)
        done[todo] = np.maximum(done[todo], need[todo])
        full = (best.reshape(n_docs, COORDINATES) != np.iinfo(np.uint64).max).all(1)
        todo = todo & ~full & (need < len(_WIDTH) - 1)  # a coordinate without a dart: look further in time
        need = np.where(todo, need + 1, need)
    out[weight > 0] = best.reshape(n_docs, COORDINATES)[weight > 0]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket of each band; the band's number is part of the hash."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        h = mix(h * _U(0x100000001B3) + parts[:, :, k])
    return h


def text_units(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    h, count = shingles.words(texts)
    g, d, _ = shingles.ngrams(h, count, words, short=True)
    return unit_hashes(g, d)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, texts = batch.column("node"), batch.column("text").to_pylist()
        for a, b in shingles.chunks(texts):
            units, doc = text_units(texts[a:b])
            keep = np.flatnonzero(np.bincount(doc, minlength=b - a) > 0)
            sig = signatures(units, doc, b - a)[keep]
            h = bands(sig)
            size = np.bincount(doc, minlength=b - a)[keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(size, BANDS)),
                nodes.slice(a, b - a).take(pa.array(np.repeat(keep, BANDS))),
            ], ["bucket", "size", "node"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, texts = batch.column("node"), batch.column("text").to_pylist()
        for a, b in shingles.chunks(texts):
            units, doc = text_units(texts[a:b])
            ends = np.searchsorted(doc, np.arange(b - a + 1))
            sets = [np.sort(units[ends[i] : ends[i + 1]]).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), pa.array(sets, pa.binary())], ["node", "units"])


def _unit_sets(column: pa.Array) -> list[np.ndarray]:
    """Views of the sets in a binary column; nothing is copied."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return [np.frombuffer(data, _U, (b - a) // 8, a) if b > a else np.zeros(0, _U) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def alike(same, x, y):
    """Whether sets of x and y units that share `same` are similar enough."""
    return same >= SIMILAR * (x + y - same) - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(_unit_sets(batch.column("a_units")), _unit_sets(batch.column("b_units"))):
            if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)) - 1e-9:
                ok.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            ok.append(bool(alike(int((both[1:] == both[:-1]).sum()), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(ok, pa.bool_())], ["u", "v", "ok"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, ok) for distinct pairs of text keys: whether their shingle sets (node, units) are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("units").alias("a_units"))
    b = sets.select(F.col("node").alias("v"), F.col("units").alias("b_units"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a_units", "b_units").mapInArrow(_verify, "u binary, v binary, ok boolean")


def similar(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Which sets are alike, all against all: shared units are counted by products of incidence matrices."""
    size = np.array([len(x) for x in sets])
    row, units = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(units, kind="stable")
    row, units = row[order], units[order]
    new = np.r_[True, units[1:] != units[:-1]] if len(units) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(units) else new  # units of one set only are of no use
    row, column = row[shared], np.cumsum(new[shared]) - 1
    same = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (k, k + columns))
        has = np.zeros((len(sets), int(column[b - 1]) + 1 - k), np.float32)
        has[row[a:b], column[a:b] - k] = 1
        same += has @ has.T
    return alike(same, size[:, None], size[None, :])


def _spans(root: list[bytes], block: np.ndarray, sets: list[np.ndarray], across: bool) -> list[tuple[bytes, bytes]]:
    """Links between classes that similar texts of a group join, as few as span them; across: between its two blocks only."""
    name, at = np.unique(np.array(root, object), return_inverse=True)
    if len(name) < 2:
        return []
    near = similar(sets) & (at[:, None] != at[None, :])
    if across:
        near &= block[:, None] != block[None, :]
    low = at.copy()
    while True:  # the least class reachable, by rows and by classes in turn
        new = np.minimum(low, np.where(near, low[None, :], len(name)).min(1))
        least = np.arange(len(name))
        np.minimum.at(least, at, new)
        new = least[at]
        if (new == low).all():
            break
        low = new
    return [(name[k], name[m]) for k, m in enumerate(least.tolist()) if k != m]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning links of groups (bucket, i, j) that come one after the other, of about 2 * BLOCK_UNITS units at most."""
    out: list[tuple[bytes, bytes]] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["u", "v"])
    for (_, i, j), group in runs(batches, ("bucket", "i", "j")):
        if group.num_rows > 1:
            out += _spans(group.column("root").to_pylist(), group.column("block").to_numpy(), _unit_sets(group.column("units")), i != j)
        if len(out) > 10_000:
            yield made()
            out.clear()
    yield made()


def links(texts: DataFrame) -> DataFrame:
    """Links (u, v) between distinct texts whose components are the classes; texts: (node, text), copies allowed."""
    found = stored(texts.where("text is not null").select("node", "text").mapInArrow(_buckets, "bucket long, size int, node binary"))
    many = found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("top")).where("low <> top").select("bucket", "n")
    members = stored(found.join(many, "bucket").distinct())  # buckets of two texts or more
    of = stored(members.groupBy("node").agg(F.sum("n").alias("met")))
    hubs = members.join(of, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("x")).select("bucket", F.col("x.node").alias("hub"))
    star = members.join(hubs, "bucket").where("node <> hub")
    star = stored(star.select("bucket", "node", "size", "hub"))
    sets = stored(gated(texts, "node", of).join(of, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_shingle_sets, "node binary, units binary"))
    pairs = star.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    roots = stored(components(verified(pairs, sets).where("ok").select("u", "v")))
    # what the hubs leave apart is compared in blocks; the hub itself has met all others of its bucket
    now = star.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("units") / BLOCK_UNITS)).cast("int")
    split = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("units")).where("low <> high").select("bucket", parts.alias("parts"))
    each = now.join(split, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "node")
    each = each.join(sets, "node").select("bucket", "i", "j", "block", "root", "units").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    spans = each.mapInArrow(_compared, "u binary, v binary")
    return stored(spans.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, root, component_id, kept) of each row of docs (doc_id, text): the class is named by its least doc_id."""
    lone = F.unhex(F.md5(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    texts = docs.select(text_key(F.col("text")).alias("node"), "text")
    rows = docs.select("doc_id", F.coalesce(text_key(F.col("text")), lone).alias("node"))
    rows = stored(rows)
    roots = stored(components(links(texts)))
    exact = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    exact = stored(exact.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "least"))
    least = exact.groupBy("root").agg(F.min("least").alias("component_id"))
    named = exact.join(least, "root").select("node", "root", "component_id", F.col("least").eqNullSafe(F.col("component_id")).alias("has_least"))
    out = rows.join(named, "node")
    return out.select("doc_id", "node", "root", "component_id", (F.col("has_least") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that of the least doc_id (of equal rows and ids, one)."""
    lone = F.unhex(F.md5(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    kept = classes(docs.select("doc_id", "text")).where("kept").groupBy("root").agg(F.min("node").alias("_node"), F.first("component_id").alias("_id")).select("_node", "_id")
    d = docs.select(row(docs), F.coalesce(text_key(F.col("text")), lone).alias("node"), F.col("doc_id").alias("id"))
    d = d.join(kept, (d.node == kept._node) & d.id.eqNullSafe(kept._id))
    return d.dropDuplicates(["node", "id"]).select("row.*")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "component_id", "kept")

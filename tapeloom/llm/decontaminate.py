"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark's word trigrams fill a bitmap of fixed size, the only thing broadcast. One pass over the documents
keeps the trigrams that pass it; joined with the benchmark's, they give how often each occurs in all documents.
Of every BLOCK consecutive trigrams of an item the PER_BLOCK rarest are its seeds, so each stretch of an item is
findable; common phrases are seeds only where a stretch has nothing rarer. A document that holds a seed is aligned with the item around it: match 2,
mismatch and gap -1, over twice the item's words. A leak is a score of at least SCORE of the item's perfect one, or an
aligned stretch whose own score reaches that of LONG matching words: a long copied run is a leak however small its
share of the item. The score reported is the share of the perfect one, so long partial copies may lie below SCORE.

Equal texts are aligned once. A hot seed or item only makes many rows of a join that adaptive execution splits.
Nulls, odd rows: null or wordless texts and items match nothing; an item of fewer than three words matches only a text of exactly its
words; repeated rows each get their result; an item_id that stands for several texts is scored for each, the best counts.
Of equally rare trigrams the first in the item are seeds, of equal scores in a document the first place counts. Very long
texts are read whole and aligned only around their seeds. Empty documents or an empty benchmark give no rows. Other
columns are kept by `decontaminated`, whatever their names, and read by nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import shingles
from tapeloom.llm._shared import gated, row, stored, table, text_key

N, BLOCK, PER_BLOCK, SCORE, LONG, BITS = 3, 4, 2, 0.5, 13, 24
STEP = 8  # starts are rounded down to multiples of it; the window's end makes up for that


def _grams(bits: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = None if bits is None else bits.value
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            for a, b in shingles.chunks(texts):
                g, d, at = shingles.ngrams(*shingles.words(texts[a:b]), N, short=True)
                if table_of is not None:
                    on = g >> np.uint64(64 - BITS)
                    keep = np.flatnonzero(table_of[(on >> np.uint64(3)).astype(np.int64)] >> (on & np.uint64(7)).astype(np.uint8) & 1)
                    g, d, at = g[keep], d[keep], at[keep]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(d)), pa.array(g.view(np.int64)), pa.array(at.astype(np.int32))], ["key", "gram", "at"])

    return run


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local score, index after its last word in doc) of Smith-Waterman over word hashes."""
    slope = np.arange(len(item) + 1)
    h, best, end = np.zeros(len(item) + 1, int), 0, 0
    for i, w in enumerate(doc):
        new = np.zeros_like(h)
        new[1:] = np.maximum(h[:-1] + np.where(item == w, 2, -1), h[1:] - 1)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + slope) - slope  # gaps along the item
        m = int(h.max())
        if m > best:
            best, end = m, i + 1
    return best, end


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, items = batch.column("text").to_pylist(), batch.column("item_text").to_pylist()
        starts = batch.column("starts").to_pylist()
        scores, matched, ends = [], [], []
        for text, item, around in zip(texts, items, starts):
            d, t = shingles.words([text])[0], shingles.words([item])[0]
            n, best, end = len(t), 0, 0
            spans: list[list[int]] = []
            for s in sorted(around):  # stretches that may hold the item, merged where they meet
                a, b = max(0, s - n // 2 - 2), min(len(d), s + STEP - 1 + n + n // 2 + 2)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                score, stop = align(d[a:b], t)
                if score > best:
                    best, end = score, a + stop
            scores.append(best / (2 * max(n, 1)))
            matched.append(best)
            ends.append(end)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("item"), pa.array(scores, pa.float64()), pa.array(matched, pa.int32()), pa.array(ends, pa.int32())], ["node", "item", "score", "matched", "end_word"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """(node, item, score, end_word): text keys of documents and items (text_key) that match."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    grams = stored(items.mapInArrow(_grams(None), "key binary, gram long, at int"))
    top = F.shiftrightunsigned("gram", 64 - BITS)
    words = grams.select(F.shiftright(top, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()  # at most 2 ** BITS / 64 words
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[[r.w for r in words]] = [r.b for r in words]
    bitmap = spark.sparkContext.broadcast(bits.astype("<i8").view(np.uint8))
    texts = docs.where("text is not null").select(text_key(F.col("text")).alias("key"), "text")
    hits = texts.mapInArrow(_grams(bitmap), "key binary, gram long, at int")
    hits = stored(hits.join(grams.select("gram").distinct(), "gram", "left_semi").select(F.col("key").alias("node"), "gram", F.col("at").alias("doc_at")))
    often = hits.groupBy("gram").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("key", F.floor(F.col("at") / BLOCK)).orderBy("often", "at"))
    seeds = grams.join(often, "gram").withColumn("rank", rank).where(F.col("rank") <= PER_BLOCK).select("gram", F.col("key").alias("item"), "at")
    near = hits.join(seeds, "gram").select("node", "item", (F.floor((F.col("doc_at") - F.col("at")) / STEP) * STEP).cast("int").alias("start"))
    pairs = stored(near.groupBy("node", "item").agg(F.collect_set("start").alias("starts")))
    of = pairs.select("node").distinct()
    found = gated(texts.withColumnRenamed("key", "node"), "node", of).join(of, "node").dropDuplicates(["node"])
    work = pairs.join(found, "node").join(items.select(F.col("key").alias("item"), F.col("text").alias("item_text")), "item")
    scored = work.select("node", "item", "text", "item_text", "starts").mapInArrow(_aligned, "node binary, item binary, score double, matched int, end_word int")
    return stored(scored.where((F.col("score") >= least) | (F.col("matched") >= 2 * LONG)).drop("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score): one row for each leaking document and item."""
    found = leaks(docs, benchmark, least)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("node"))
    names = benchmark.select("item_id", text_key(F.col("text")).alias("item")).distinct()
    out = rows.join(found, "node").join(names, "item")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """docs without the documents that leak."""
    bad = leaks(docs, benchmark, least).select("node").distinct()
    return docs.select(row(docs), text_key(F.col("text")).alias("node")).join(bad, "node", "left_anti").select("row.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))

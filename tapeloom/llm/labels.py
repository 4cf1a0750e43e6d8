"""Bounded, repeatable samples of labelled documents for training classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm._shared import stored


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n (null: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: dict[int, int]) -> DataFrame:
    """(text, y) of at most bound[y] labelled rows per class, first by hash of doc_id, among those where `train` holds.

    Only the bounded sample of labels is broadcast; documents are read in place. A null label or doc_id is no label.
    """
    rows = labels.where(F.col(label).isin(*bound) & F.col("doc_id").isNotNull() & train).select("doc_id", F.col(label).cast("int").alias("y"))
    picked = None
    for y, n in bound.items():
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    return stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y"))

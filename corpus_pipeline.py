"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing and sharding over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages are written as Parquet in
the cluster's shared folder and read again, so a lost executor costs no more than part of one stage.

Odd rows, in every stage: null and empty texts stay (near_dedup keeps each null text as a document of its own); very long
texts are read whole; repeated rows and ties are one document for near_dedup and rows of their own elsewhere; an empty
table gives an empty one; columns beyond those of `documents`, whatever their names, come out as they went in, but for
sharding, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from tapeloom.llm._shared import row, settled, table

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of the labelled rows among them. Null and empty texts have no toxic term and stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(row(docs), "text"), model, "score").where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least doc_id; of rows that are equal in text and id, one."""
    return near_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets take them, 0 to 3 times; those without words go by the same law."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place in it of each row of the mix; copies of a document are rows of one group."""
    return sharding.shard(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mixing", mix), ("sharding", shard)]
#: Trained models, MinHash joins and greedy packing are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on its way, and its input, are freed as soon as its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        now = settled(lambda: stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs

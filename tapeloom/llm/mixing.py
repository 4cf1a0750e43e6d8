"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document expects `target / source_size` copies. Documents are put in order of size, these
expectations are summed along that order, one offset per source is added, and a document is emitted once for each
whole number its interval crosses. Because the order follows the sizes, the words taken miss the target by less
than about one document of the source.

The running sum is made in two steps, so that no task needs a whole source: rows are numbered inside
(source, size bin, salt) cells, and the cells' counts are summed over the far smaller table of cells.

Nulls, ties, odd rows: a null source is a source of its own, last in order; a null text has size 0 and takes 0 words;
repeated rows count each on their own, and of equal rows any may be the one taken; documents of equal size go in the
order of a hash of doc_id, null first; a very long text is one document like others, taken whole; a source without words
has target 0; an empty table gives an empty result. Other columns pass through whatever their names; only columns named
as ADDED are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm._shared import bucket, row, stored, table

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) -> also target: the share of all words by weight, held to `most` times the source's size.

    What is cut off goes to the other sources by weight. The level at which this ends is found directly: sources
    in order of `cap / weight` are full up to the first that its share at the level left doesn't fill. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("long"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "k": F.row_number().over(by_fill),
        "full": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy(F.lit(0))),
    }).withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("rest").cast("double"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    s = s.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("k"))).over(Window.partitionBy(F.lit(0))))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = 3, salts: int = SALTS, size: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """docs with `mix_size`, `mix_source_size`, `mix_target` and `mix_copies` (0 to `most`).

    size: a column that holds the words, else they are counted from `text`. counted: rows like `docs` from which
    the cells' counts may be read more cheaply, such as a stored projection.
    """
    def cells(d: DataFrame, *more) -> DataFrame:
        words = F.col(size) if size else word_count(F.col("text"))
        d = d.select(*more, "source", "doc_id", words.alias("words"), bucket(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), salts).alias("salt"))
        return d.withColumn("bin", F.floor(F.sqrt(F.col("words").cast("double"))).cast("long"))

    cell = cells(counted if counted is not None else docs).groupBy("source", "bin", "salt").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    per_source = targets(cell.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("source", "t_source")
    before = Window.partitionBy("source").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cell = cell.join(per_source, F.col("source").eqNullSafe(F.col("t_source")), "left")
    cell = cell.select(F.coalesce("source", F.lit("")).alias("c_source"), F.col("source").isNull().alias("c_null"), F.col("bin").alias("c_bin"), F.col("salt").alias("c_salt"), "before", "source_size", "target")
    d = cells(docs, row(docs, *ADDED)).withColumns({"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
    inside = Window.partitionBy("name", "unnamed", "bin", "salt").orderBy("words", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id")
    d = d.withColumn("nth", F.row_number().over(inside))
    d = d.join(cell, (d.name == cell.c_source) & (d.unnamed == cell.c_null) & (d.bin == cell.c_bin) & (d.salt == cell.c_salt))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("null"))), 1, 4), 16, 10).cast("double") / 65536
    n = (F.col("before") + F.col("nth")).cast("double")
    copies = F.least(F.floor(n * rate + offset) - F.floor((n - 1) * rate + offset), F.ceil(rate)).cast("long")
    return d.select("row.*", *[x.alias(c) for c, x in zip(ADDED, (F.col("words"), F.col("source_size"), F.col("target"), copies))])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix themselves: each document as often as it is taken, with the columns of `docs`."""
    m = mix(docs.select(row(docs), "doc_id", "source", F.col(options["size"]) if options.get("size") else F.col("text")), **options)
    return m.where("mix_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = stored(docs)  # the words are counted once
    m = mix(docs, size="size")
    return m.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"), F.col("mix_copies").alias("copies"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (source_size * 3)::BIGINT AS cap,
    ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s
), f AS (
  SELECT *, row_number() OVER o AS k,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST)
), g AS (
  SELECT *, (total - filled)::DOUBLE / rest::DOUBLE AS level FROM f
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, k) FROM g WHERE level * w <= cap) * w) AS target FROM g
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
    ('0x' || substr(md5(coalesce(d.source, 'null')), 1, 4))::BIGINT::DOUBLE / 65536 AS u,
    (row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(d.size::DOUBLE)),
      ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % 64, d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id))::DOUBLE AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, least(floor(n * rate + u) - floor((n - 1) * rate + u), ceil(rate))::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

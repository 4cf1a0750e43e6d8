"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Groups are equal texts. Groups go, largest first, to the shard where the dot product of the group's vector with the
residual capacity is highest among those it fits; small moves then even the bytes. Greedy packing looks at one group
after another, so it runs in two steps. The driver packs the groups that hold more than 1 / HEAVY of the bytes, tokens or
rows, at most 3 * HEAVY of them. All other groups are dealt by hash into parts of about PART groups; the parts are packed
at the same time, each into its share of the capacity that is left, so no task holds more than a part.

A group stays whole unless it is larger than a shard: it is cut by doc_id into as few pieces as fit shards, as equal sizes
can't hold otherwise. Law held: `bytes` (sizes of the shards near equal).

Nulls, odd rows: a null text has size 1 and groups with nothing; its crc is null. A null doc_id is a row like others.
Repeated rows are one group and get a slot each; ties in size go by the text's key, so reruns agree. A very long text is a
group like others. An empty table gives no rows. Only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm._shared import bucket, runs, stored, table, text_key
from tapeloom.llm.mixing import word_count

HEAVY, PART, SALTS = 4096, 4096, 1024
SUMS = (F.sum, "size", "b"), (F.sum, "tokens", "t"), (F.count, "*", "n")


def pack(sizes: np.ndarray, residual: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Shard of each group. sizes: a row (bytes, tokens, rows) per group; residual: capacity left per shard, taken from
    in place, in units of a whole shard's `unit` (bytes, tokens, rows)."""
    v, placed, shards = sizes / np.maximum(unit, 1e-9), np.zeros(len(sizes), int), len(residual)
    for i in np.argsort(-v.max(1), kind="stable"):
        dot = residual @ v[i]
        fits = (residual + 1e-9 >= v[i]).all(1)
        if not fits.any():  # least overfull in bytes
            dot, fits = residual[:, 0], np.ones(shards, bool)
        s = int(np.argmax(np.where(fits, dot, -np.inf)))
        residual[s] -= v[i]
        placed[i] = s
    for _ in range(64 * shards):  # each move lessens the spread of the bytes left
        hi, lo = int(residual[:, 0].argmin()), int(residual[:, 0].argmax())
        gap = residual[lo, 0] - residual[hi, 0]
        own = np.flatnonzero((placed == hi) & (v[:, 0] > 0) & (v[:, 0] < gap))
        if gap * unit[0] <= 1 or not len(own):
            break
        i = own[np.abs(v[own, 0] - gap / 2).argmin()]
        placed[i] = lo
        residual[hi] += v[i]
        residual[lo] -= v[i]
    return placed


def _part(left: np.ndarray, unit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ("part",)):
            sizes = np.column_stack([rows.column(c).to_numpy(zero_copy_only=False) for c in "btn"]).astype(float)
            share = sizes.sum(0) / np.maximum((left * unit).sum(0), 1e-9)  # of what is left in all shards
            yield pa.RecordBatch.from_arrays([rows.column("g"), pa.array(pack(sizes, left * share, unit), pa.int32())], ["g", "shard"])

    return run


def shard(docs: DataFrame, shards: int = 16, heavy: int = HEAVY, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = stored(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        word_count(F.col("text")).alias("tokens"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.coalesce(text_key(F.col("text")), F.unhex(F.md5(F.concat(F.lit("null "), name)))).alias("g"),
    ))
    sums = [f(c).alias(to) for f, c, to in SUMS]
    groups = stored(d.groupBy("g").agg(*sums))
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    unit = np.array([float(total[c] or 0) for c in "btn"]) / shards
    share = F.greatest(*[F.col(c) / F.lit(float(max(total[c] or 0, 1))) for c in "btn"])
    large = groups.where(share > 1 / heavy).select("g", F.ceil(share * shards).cast("int").alias("pieces")).orderBy("g").collect()  # at most 3 * heavy rows
    starts = np.cumsum([0, *[r.pieces for r in large]]).tolist()
    of = F.broadcast(spark.createDataFrame([(bytearray(r.g), s, r.pieces) for r, s in zip(large, starts)], "g binary, start int, pieces int"))
    pieces = d.join(of, "g").withColumn("unit", (F.col("start") + bucket(name, 1 << 20) % F.col("pieces")).cast("int"))
    units = pieces.groupBy("unit").agg(*sums).orderBy("unit").collect()  # at most 3 * heavy + shards rows
    left = np.ones((shards, 3))
    placed = pack(np.array([[u.b, u.t, u.n] for u in units], float).reshape(-1, 3), left, unit)
    to = spark.createDataFrame([(u.unit, int(s)) for u, s in zip(units, placed)], "unit int, shard int")
    parts = max(1, -(-total.groups // part))
    light = groups.where(share <= 1 / heavy).withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)))
    light = light.select("part", "g", "b", "t", "n").repartition("part").sortWithinPartitions("part", "g").mapInArrow(_part(left, unit), "g binary, shard int")
    columns = ("doc_id", "size", "text_crc32", "shard")
    d = pieces.join(F.broadcast(to), "unit").select(*columns).unionByName(d.join(light, "g").select(*columns))
    d = stored(d.withColumn("salt", bucket(name, SALTS)))
    cell = d.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    cell = cell.select("shard", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size"))
    d = d.withColumn("nth", nth).join(F.broadcast(cell), ["shard", "salt"])  # shards * SALTS rows at most
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Helpers that the corpus operators share: tables, stored intermediates, row-number prefixes and link components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row(df: DataFrame, *but: str) -> Column:
    """All columns of df but those named as one struct, so that no name of theirs meets a name of an operator's."""
    gone = {c.lower() for c in but}
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]).alias("row")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir, else the context's checkpoint folder. If a session names neither, one is made on this
    machine where driver and executors are one process (a local master); on a cluster that would scatter the tables
    over the machines' own disks, so it raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tapeloom-")
        sc.setCheckpointDir(named)
    return named


_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the files are then the cluster's to expire
        pass


@atexit.register
def _delete_all() -> None:
    for spark, path in _WRITTEN:
        _delete(spark, path)


class Stored:
    """A table written to the shared folder; `drop()` frees its disk once later tables no longer read it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/tapeloom-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _WRITTEN.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows survive lost executors because they lie in the shared folder."""
    return Stored(df).df


def settled(make: Callable[[], DataFrame]) -> Stored:
    """The table that make() returns, written; what was stored on the way to it is freed."""
    n = len(_WRITTEN)
    out = Stored(make())
    for spark, path in _WRITTEN[n:-1]:
        _delete(spark, path)
    del _WRITTEN[n:-1]
    return out


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in shuffles."""
    return F.unhex(F.md5(text))


def bucket(key: Column, n: int) -> Column:
    """0 to n - 1 from the leading hex digits of md5, so that other SQL engines can compute the same."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of equal keys (integers) in sorted batches; a run may lie over several batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    whole = lambda: held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(new)].tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[a].item() for c in columns)
            if held and key != last:
                yield last, whole()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, whole()


GATE = 1 << 20


def gated(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose binary `key` may be in ids (all that are, and few others while ids are fewer than GATE).

    What is broadcast are at most GATE numbers, whatever the size of ids; the exact join that follows then
    shuffles little more than it keeps.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(GATE))
    cells = ids.select(cell.alias("_cell")).distinct()
    return rows.withColumn("_cell", cell).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (u, v): one row (node, root) per node, root the least node reachable.

    Alternates large-star and small-star steps. Each step aggregates minima with map-side combine and joins
    them back on the node, a join that adaptive execution can split where one node holds most links. Every
    round's links are written to the shared folder. Nothing is collected but a count and a checksum.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    links = Stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = links.df.unionByName(links.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = Stored(large)
        low = down.df.groupBy("u").agg(F.min("v").alias("m"))
        small = down.df.join(low, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"), "u", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = Stored(small)
        links.drop()
        down.drop()
        links = after
        h = links.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (h.n, h.s) == mark:
            break
        mark = (h.n, h.s)
    star = links.df.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return star.unionByName(links.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

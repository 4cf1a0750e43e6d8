import os
import random

import pytest

from tapeloom.llm import _shared as s


def roots(edges):
    top = {}

    def find(a):
        top.setdefault(a, a)
        while top[a] != a:
            a = top[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {a: find(a) for a in list(top)}


def test_components_against_union_find(spark):
    r = random.Random(7)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    edges += [(1000 + k, 1001 + k) for k in range(60)]  # a long path
    edges += [(2000, 2001 + k) for k in range(200)]  # a star
    edges += edges[:20] + [(b, a) for a, b in edges[:20]]
    df = spark.createDataFrame(edges + [(5, 5), (None, 3)], "u long, v long")
    want = roots([(a, b) for a, b in edges if a != b])
    assert {x.node: x.root for x in s.components(df).collect()} == want


def test_no_links(spark):
    assert s.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gate_keeps_every_row_asked_for(spark):
    rows = spark.range(5000).selectExpr("cast(cast(id as string) as binary) as k", "id")
    ids = rows.where("id % 97 = 0").select("k")
    got = {r.id for r in s.gated(rows, "k", ids).collect()}
    want = {k for k in range(5000) if k % 97 == 0}
    assert want <= got and len(got) < 2 * len(want) + 50


class Session:
    """As much of a session as shared_dir asks."""

    def __init__(self, master, folder=None, conf=None, checkpoint=None):
        self.conf = self
        self.sparkContext, self.master, self.folder, self.of_context, self.checkpoint = self, master, folder, conf, checkpoint

    def get(self, key, default=None):
        return self.folder

    def getConf(self):
        return {"spark.checkpoint.dir": self.of_context} if self.of_context else {}

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_shared_folder_is_the_one_the_session_names():
    assert s.shared_dir(Session("spark://x:7077", "hdfs://a")) == "hdfs://a"
    assert s.shared_dir(Session("spark://x:7077", None, "hdfs://b")) == "hdfs://b"
    assert s.shared_dir(Session("spark://x:7077", checkpoint="hdfs://c")) == "hdfs://c"
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            s.shared_dir(Session(master))
    local = Session("local[4]")
    assert s.shared_dir(local) == local.checkpoint


def test_stored_tables_can_be_dropped(spark):
    t = s.Stored(spark.range(3).toDF("x"))
    assert t.path.startswith(s.shared_dir(spark)) and t.df.count() == 3
    t.drop()
    assert not os.path.exists(t.path.removeprefix("file:"))


def test_row_keeps_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "c`d", "row"])
    assert df.select(s.row(df)).select("row.*").columns == df.columns


def test_settled_frees_what_was_stored_on_the_way(spark):
    made = []

    def make():
        made.append(s.Stored(spark.range(5).toDF("x")))
        return made[0].df.where("x > 2")

    out = s.settled(make)
    assert out.df.count() == 2 and not os.path.exists(made[0].path.removeprefix("file:"))


def test_runs_of_sorted_batches():
    import pyarrow as pa

    keys = [1, 1, 1, 2, 2, 5, 5, 5, 5, 7]
    whole = pa.RecordBatch.from_pydict({"k": keys, "v": list(range(10))})
    for size in (1, 2, 3, 10):
        got = [(k, r.column("v").to_pylist()) for k, r in s.runs((whole.slice(a, size) for a in range(0, 10, size)), ("k",))]
        assert got == [((1,), [0, 1, 2]), ((2,), [3, 4]), ((5,), [5, 6, 7, 8]), ((7,), [9])]

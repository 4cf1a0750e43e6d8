"""The live run gives, bar by bar, what the batch run gives over the same bars."""

import math

from tapeloom import bars_from_records, run_script
from tapeloom.streaming.live import run_live
from tests.tapes import TAPES

SCRIPT = "var n = 0\nif close > open\n    n := n + 1\nplot(n)\nplot(sma(close, 5))\nplot(ema(close, 4))\n"


def drain(spark, folder, **options):
    bars = bars_from_records(spark, [])
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = run_live(stream, SCRIPT, {"timezone": "UTC"}, **({"keep": 1000} | options)).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table("live").orderBy("bar_index").collect()


def write(spark, folder, batches):
    for b in batches:
        bars_from_records(spark, b, "S").coalesce(1).write.mode("append").parquet(folder)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a.bar_index, a.date) == (b.bar_index, b.date)
        for c in ("p0", "p1", "p2"):
            x, y = a[c], b[c]
            assert (x is None or math.isnan(x)) == (y is None) and (y is None or math.isclose(x, y, rel_tol=1e-9))


def test_live_equals_batch(spark, tmp_path):
    bars = TAPES["wavy"][:60]
    write(spark, f"{tmp_path}/in", [bars[:20], bars[20:45], bars[45:]])
    want = run_script(bars_from_records(spark, bars, "S"), SCRIPT, {"timezone": "UTC"}).per_bar().orderBy("bar_index").collect()
    same(drain(spark, f"{tmp_path}/in"), want)


def test_late_bars_are_put_in_order_within_the_delay(spark, tmp_path):
    bars = TAPES["wavy"][:40]
    first = bars[:20] + bars[22:25]
    write(spark, f"{tmp_path}/in", [first, bars[20:22] + bars[25:]])
    got = drain(spark, f"{tmp_path}/in", delay_ms=5 * 60_000)
    want = run_script(bars_from_records(spark, bars, "S"), SCRIPT, {"timezone": "UTC"}).per_bar().orderBy("bar_index").collect()
    same(got, want[: len(got)])
    assert len(got) == 35 and got[-1].late == 0


def test_too_late_bars_are_counted(spark, tmp_path):
    bars = TAPES["wavy"][:20]
    write(spark, f"{tmp_path}/in", [bars[:10] + bars[11:15], bars[10:11] + bars[15:]])
    got = drain(spark, f"{tmp_path}/in")
    assert len(got) == 19 and got[-1].late == 1


def test_only_the_last_bars_are_held(spark, tmp_path):
    """Windows that fit into `keep` give the same values; the running count starts anew over what is held."""
    bars = TAPES["wavy"][:60]
    write(spark, f"{tmp_path}/in", [bars[:30], bars[30:45], bars[45:]])
    got = drain(spark, f"{tmp_path}/in", keep=12)
    want = run_script(bars_from_records(spark, bars, "S"), SCRIPT, {"timezone": "UTC"}).per_bar().orderBy("bar_index").collect()
    assert [(r.bar_index, r.date) for r in got] == [(r.bar_index, r.date) for r in want]
    assert all(a.p1 == b.p1 or math.isclose(a.p1, b.p1, rel_tol=1e-9) for a, b in zip(got[5:], want[5:]))

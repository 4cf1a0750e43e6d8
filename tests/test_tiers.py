"""The native and the fold tier give the same outputs over several tapes at once, nulls included."""

import math

import pytest

from tapeloom import bars, bars_from_records, run_script
from tests.tapes import TAPES

SCRIPTS = {
    "averages": "plot(sma(close, 7))\nplot(ema(close, 9))\nplot(wma(close, 5))\nplot(rsi(close, 6))\nplot(stdev(close, 8))\nplot(dema(close, 4))\nplot(hull(close, 9))\nplot(linreg(close, 6))\n",
    "bars": "plot(atr(5))\nplot(adx(5))\nplot(mfi(6))\nplot(cci(7))\nplot(vwap())\nplot(stoch(5))\nplot(willr(4))\nplot(aroonup(6))\nplot(pivothigh(2, 2))\n",
    "events": "up = crossover(close, sma(close, 5))\nplot(barssince(up))\nplot(valuewhen(up, low))\nplotshape(up)\nalertcondition(up, message=\"c={{close}}\")\nplot(cum(close[1]))\nplot(rising(close, 2))\n",
    "scalars": "plot(round(close))\nplot(min(close, close[1]))\nplot(nz(close[3], -1))\nplot(close != close[1])\nplot(log(close - 100))\nplot(close % 7)\nplot(1 / (bar_index % 2))\n",
    "control": "x = 0.0\nname = \"flat\"\nif close > open\n    x := high\n    name := \"up\"\n    y = 3\n    if volume > 1500\n        x := x + y\nelse if close < open\n    x := low\n    name := \"down\"\nplot(x)\nplot(name == \"up\" ? 1 : 2)\ns = 0.0\nfor k = 0 to 4\n    t = close[k]\n    if t > open\n        s := s + t * k\nplot(s)\nr = 0\nswitch bar_index % 3\n    0 => r := high\n    1 => r := low\n    => r := close\nplot(r)\npick(a, b) =>\n    o = a\n    if b > a\n        o := b\n    o\nplot(pick(close, sma(close, 3)))\n",
    "security": 'plot(security("5m", close))\nplot(security("1h", sma(high, 2)))\n',
}


@pytest.fixture(scope="module")
def tapes(spark):
    gaps = [dict(b) for b in TAPES["wavy"][:80]]
    for k in (3, 10, 11, 40):
        gaps[k]["close"] = None
    parts = [bars_from_records(spark, TAPES["wavy"], "wavy"), bars_from_records(spark, TAPES["trend"], "trend"), bars_from_records(spark, gaps, "gaps"), bars_from_records(spark, TAPES["single"], "single")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition(3)


@pytest.mark.parametrize("name", SCRIPTS)
def test_same(tapes, name):
    native, fold = (run_script(tapes, SCRIPTS[name], {"timezone": "UTC"}, exact=e, windows=True) for e in (False, True))
    assert (native.tier, fold.tier) == ("native", "fold")
    columns = [c for c in native.per_bar().columns if c not in ("symbol", "bar_index", "date")]
    rows = lambda r: {(x.symbol, x.bar_index): x for x in r.per_bar().collect()}
    a, b = rows(native), rows(fold)
    assert a.keys() == b.keys()
    for k in a:
        for c in columns:
            x, y = a[k][c], b[k][c]
            if isinstance(y, float):
                assert x is not None and (x == y or math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-9)), (k, c, x, y)
            else:
                assert x == y, (k, c, x, y)


def test_native_plan_has_one_exchange_by_symbol(tapes):
    plan = run_script(tapes.coalesce(1), SCRIPTS["averages"], {"timezone": "UTC"}, windows=True).per_bar()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1


def test_column_pruning_reaches_the_scan(spark, tapes, tmp_path):
    tapes.write.parquet(f"{tmp_path}/bars")
    df = run_script(bars(spark.read.parquet(f"{tmp_path}/bars"), "symbol", order="seq"), "plot(sma(close, 3))\n").per_bar()
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1]
    assert "close" in schema and "volume" not in schema and "high" not in schema


def test_record_tables(tapes):
    r = run_script(tapes, "strategy.buy(crossover(close, sma(close, 5)), 1)\nstrategy.sell(crossunder(close, sma(close, 5)), 1)\nline.new(0, close, 1, close, when=barstate.islast)\n", {"timezone": "UTC"})
    assert r.tier == "fold" and r.keep() is r
    trades, summary = r.trades(), r.summary()
    assert "InMemoryTableScan" in trades._jdf.queryExecution().executedPlan().toString()
    assert {x.symbol for x in summary.collect()} == {"wavy", "trend", "gaps", "single"}
    assert trades.count() == sum(int(x.trades) for x in summary.collect())
    assert r.records("lines").count() == 4
    assert r.json().count() == 4


def test_panel_of_both_tiers(tapes):
    s = 'plot(close)\ninfopanel(close, title="C")\ninfopanel(close > open ? "up" : "down")\n'
    native, fold = (run_script(tapes, s, {"timezone": "UTC"}, exact=e).panel() for e in (False, True))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(native) == key(fold)


def test_errors_are_per_symbol(spark):
    ok, bad = TAPES["wavy"][:9], TAPES["wavy"][:30]
    df = bars_from_records(spark, ok, "ok").unionByName(bars_from_records(spark, bad, "bad"))
    rows = run_script(df, "plot(sma(close, bar_index > 10 ? 5 : 4))\n").per_bar().select("symbol", "error").distinct().collect()
    assert {r.symbol: r.error is None for r in rows} == {"ok": True, "bad": False}


def test_empty_bars(spark):
    none = bars_from_records(spark, [])
    assert run_script(none, "plot(ema(close, 3))\n").per_bar().count() == 0
    assert run_script(none, "plot(ema(close, 3))\n", exact=True).per_bar().count() == 0


def test_several_recurrences_go_to_the_fold(tapes):
    assert run_script(tapes, "plot(ema(close, 4))\n").tier == "native"
    r = run_script(tapes, "plot(ema(close, 4))\nplot(wilders(close, 4))\n")
    assert r.tier == "fold" and "recurrences" in r.why_fold


def test_security_reads_the_bars_once_more_per_frame(tapes, tmp_path, spark):
    tapes.write.parquet(f"{tmp_path}/bars")
    df = bars(spark.read.parquet(f"{tmp_path}/bars"), "symbol", order="seq")
    s = "".join(f'plot(security("1h", {x}))\n' for x in ("open", "high", "low", "close", "sma(close, 3)"))
    plan = run_script(df, s, {"timezone": "UTC"}).per_bar()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Join") == 1

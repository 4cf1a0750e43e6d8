"""The language itself: syntax, errors, scopes, state, text and time."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom import ScriptError, lang_version, restyled, run_script_json
from tapeloom.functions import calendar
from tapeloom.functions.tapes import tape
from tapeloom.functions.text import fixed_text, number_text, round_half_up
from tapeloom.plans.fold import run_tape
from tapeloom.plans.syntax import parse
from tests.tapes import TAPES

WAVY = tape(TAPES["wavy"])
CLOSE = WAVY.close


def run(source, bars=WAVY, **options):
    return run_tape(source, bars, {"timezone": "UTC"} | options)


def plots(source, **options):
    r = run(source, **options)
    assert r["error"] is None, r["error"]
    return [p["values"] for p in r["plots"]]


#: What a script may not do, by rule, each with scripts that break just that rule.
ERRORS = {
    "names must be known": ["total = volume + turnover\nplot(total)", "plot(kama(high, 12))"],
    "numbers have one point": ["w = low * 7.8.9\nplot(w)"],
    "text ends on its line": ['study("open ended)\nplot(low)'],
    "something must be drawn": ["top = highest(high, 8)", "\n\n", "// a remark and no more"],
    "loops only hold break and continue": ["if high > low\n    break\nplot(low)", "if volume > 0\n    continue\nplot(low)"],
    "loops end": ["n = 0\nwhile n >= 0\n    n := n + 1\nplot(n)", "t = 0.0\nfor n = 1 to 150000\n    t := t + n\nplot(t)"],
    "steps move": ["for n = 9 to 1 by 0\n    z = n\nplot(low)"],
    "bounds and offsets are numbers": ['for n = "a" to 3\n    z = n\nplot(low)', 'plot(low["two"])'],
    "security stands alone and at the top": ['plot(security("1d", sma(security("30m", low), 4)))', 'for n = 1 to 2\n    w = security("30m", low)\nplot(low)', 'n = 0\nwhile n < security("30m", low)\n    n := n + 40\nplot(n)'],
    "security's frames": [f'plot(security("{x}", low))' for x in ("seven", "-5m", "3w", "0h")],
    "orders": ["strategy.sell(high > 5, 2, stop=4, limit=6)", 'strategy.sell(low > high, 3, qty_type="contracts")'],
    "fills have two sides": ["a = plot(low)\nfill(a)"],
    "lengths": ['plot(ema(low, "six"))', "plot(highest(low, bar_index * 2))", "plot(wma(low, 150000))"],
    "assignment": ["level := 4\nplot(level)", "var level = 4\nlevel = 5\nplot(level)", "volume = 1\nplot(volume)", "level = 4\nvar level = 5\nplot(level)"],
    "functions": ["twice(p) => twice(p) * 2\nplot(twice(low))", "ping(p) => pong(p)\npong(p) => ping(p)\nplot(ping(2))", "add(p, p) => p\nplot(add(1, 2))", "add(p q) => p\nplot(add(1, 2))", "one(p) => p\nplot(one(1, 2, 3))", "inner() => hidden * 2\nz = 0.0\nif low > 0\n    hidden = 3\n    z := inner()\nplot(z)"],
    "arrays": ["var box = array.new(4)\narray.set(box, 9, low)\nplot(low)", "array.push(low, high)\nplot(low)", "big = array.new(4000000000)\nplot(low)"],
    "anchors stay": ['plot(vwap(low, bar_index > 4 ? "session" : "week"))'],
    "calls": ["plot(max())", 'plot(low, title="a", title="b")'],
    "blocks": ["if low > 1\nplot(low)", "  plot(low)", "if low > 2\n      z = 1\n   y = 2\nplot(low)", "switch 3\n    => z = 1\n    => z = 2\nplot(low)", "else\n    z = 1\nplot(low)"],
    "grammar": ["plot(2 *)", "plot(low) plot(high)", "if = 3\nplot(low)", f"plot({'-(' * 600}low{')' * 600})"],
    "fixed words and constants": ['plot(low, style="wavy")', 'plotsell(low, price="midpoint")', "hline(volume)", 'plot(low, color=low > low[1] ? "#123456" : "#654321")'],
}


@pytest.mark.parametrize("rule", ERRORS)
def test_errors_empty_the_result(rule):
    for source in ERRORS[rule]:
        r = run(source + "\n")
        assert isinstance(r["error"], str) and r["plots"] == [] and r["strategy"] is None and r["trades"] == [], source


def test_unknown_zone():
    assert run("plot(close)", timezone="Mars/Olympus")["error"]


def test_metadata_survives_errors():
    r = run('study("T", overlay=false)\nn = input.int(3, "N")\nplot(sma(close, bar_index))\n')
    assert (r["title"], r["overlay"], len(r["inputs"])) == ("T", False, 1) and r["error"]


def test_scopes():
    assert plots("x = 1\nif true\n    x = 5\nplot(x)\n")[0][0] == 1
    assert plots("x = 1\nif true\n    x := 5\nplot(x)\n")[0][0] == 5
    assert plots("s = 0.0\nfor k = 0 to 3\n    if k == 0\n        s := s + 1\n    else\n        s := s + k\nplot(s)\n")[0][0] == 7
    assert plots("out = 0.0\nseen = 7\nfor k = 0 to 1\n    out := out + seen\n    seen = 1\nplot(out)\n")[0][0] == 8  # a for body keeps its locals
    assert plots("out = 0.0\nk = 0\nseen = 7\nwhile k < 2\n    k := k + 1\n    out := out + seen\n    seen = 1\nplot(out)\n")[0][0] == 14  # a while body doesn't
    assert plots("t = 0.0\nfor k = 0 to 3\n    t := t + k\n    k = 10\nplot(t)\n")[0][0] == 30


def test_state_of_calls_and_blocks():
    a, b = plots("f(x) => cum(x)\nplot(f(1))\nplot(f(2))\n")
    assert a[9] == 10 and b[9] == 20
    got = plots("n = 0.0\nif bar_index % 2 == 0\n    n := cum(1)\nplot(n)\n")[0]
    assert got[8] == 5 and got[9] == 0
    assert plots("if true\n    var k = 0\n    k := k + 1\n    plot2 = k\nplot(close)\n")[0] == CLOSE
    assert plots("count(x) =>\n    var n = 0\n    n := n + x\n    n\nplot(count(1))\nplot(count(10))\n")[1][3] == 40


def test_history():
    assert plots("x = close * 2\nplot(x[3])\n")[0][10] == CLOSE[7] * 2
    assert plots("plot(close[bar_index])\n")[0][50] == CLOSE[0]
    assert plots("plot((close + 1)[2])\n")[0][10] == CLOSE[8] + 1
    assert plots("var n = 0\nn := n + 1\nplot(n[1])\nplot(n[0])\n")[0][5] == 5
    assert math.isnan(plots("plot(close[-1])\n")[0][5])


def test_security_reads_script_variables_as_they_are_now():
    r = plots('x = bar_index\nplot(security("5m", x))\n')[0]
    assert r[9] == r[5] == 5  # evaluated on the first bar of the next bucket


@pytest.mark.parametrize(("x", "want"), [(0.0, "0"), (-0.0, "0"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"), (123.456, "123.456"), (-5.0, "-5"), (math.nan, "NaN"), (math.inf, "Infinity"), (-math.inf, "-Infinity"), (1.7976931348623157e308, "1.7976931348623157e+308")])
def test_number_text(x, want):
    assert number_text(x) == want


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=300, deadline=None)
def test_number_text_reads_back(x):
    assert float(number_text(x)) == x


def test_rounding():
    assert [round_half_up(x) for x in (-2.5, -1.5, 0.5, 2.5, 2.4)] == [-2, -1, 1, 3, 2]
    assert [fixed_text(x, p) for x, p in ((2.5, 0), (1.005, 2), (-1.5, 0), (1e22, 2), (0.125, 2))] == ["3", "1.00", "-2", "1e+22", "0.13"]


def test_wall_time_in_gaps_and_overlaps():
    ny = calendar.zone("America/New_York")
    assert calendar.from_text("2026-03-08 02:30", ny) == 1772951400000
    assert calendar.from_text("2026-11-01 01:30", ny) == 1793511000000
    assert calendar.from_parts(ny, 2026.0, 14.0, 1.0) == calendar.from_text("2027-02-01", ny)
    assert math.isnan(calendar.from_text("yesterday", ny))


def test_json_run_and_restyling():
    out = json.loads(run_script_json('plot(close, "#123456", 3)\n', json.dumps(TAPES["single"])))
    p = out["plots"][0]
    assert p["values"] == [TAPES["single"][0]["close"]] and lang_version() == "2.4.0"
    src = 'plot(close, "#123456", 3)\n'
    assert restyled(src, [(p["colorSpan"], '"#ffffff"'), (p["widthSpan"], "5"), (None, "x")]) == 'plot(close, "#ffffff", 5)\n'


def test_bad_bars():
    r = run_tape("plot(close)\nplot(volume)\n", tape([{"close": "x", "date": 1}, 5, {"close": 2, "volume": None, "date": 2}]), {"timezone": "UTC"})
    a, b = (p["values"] for p in r["plots"])
    assert len(a) == 2 and math.isnan(a[0]) and a[1] == 2 and b == [0, 0]


def test_pool_keeps_the_last_500():
    r = run("for k = 0 to 1\n    x = k\nlabel.new(bar_index, close, \"a\")\nlabel.new(bar_index, close, \"b\")\nlabel.new(bar_index, close, \"c\")\n")
    assert len(r["labels"]) == 500 and r["labels"][-1]["text"] == "c" and r["labels"][-1]["x"] == 199


@given(st.lists(st.one_of(st.floats(-100, 100), st.just(math.nan)), min_size=1, max_size=60), st.integers(1, 14))
@settings(max_examples=60, deadline=None)
def test_windows_against_naive(values, p):
    bars = tape([{"date": k, "open": v, "high": v, "low": v, "close": v, "volume": 1} for k, v in enumerate(values)])
    r = run_tape(f"plot(sma(close, {p}))\nplot(highest(close, {p}))\nplot(stdev(close, {p}))\nplot(sum(close, {p}))\nplot(median(close, {p}))\n", bars, {"timezone": "UTC"})
    for i in range(len(values)):
        w = values[max(0, i - p + 1) : i + 1]
        full = len(w) == p and not any(math.isnan(v) for v in w)
        got = [x["values"][i] for x in r["plots"]]
        if not full:
            assert all(math.isnan(g) for g in got)
            continue
        mean = sum(w) / p
        s = sorted(w)
        want = [mean, max(w), math.sqrt(sum((v - mean) ** 2 for v in w) / p), sum(w), (s[(p - 1) // 2] + s[p // 2]) / 2]
        assert all(abs(g - x) <= 1e-6 for g, x in zip(got, want))


def test_nodes_are_checked_once():
    with pytest.raises(ScriptError):
        parse("plot(")
    assert parse("plot(close)\n") is parse("plot(close)\n")


def test_far_instants():
    utc, ny = calendar.zone("UTC"), calendar.zone("America/New_York")
    for name, want in (("year", 57983), ("month", 10), ("dayofmonth", 4)):
        assert calendar.part(name, 1767623400000.0 * 1000, utc) == want, name
    for year in (-250_000, -401, -1, 0, 399, 9998, 10_000, 57_983, 299_999):
        for tz in (utc, ny):
            t = calendar.from_parts(tz, float(year), 7.0, 16.0, 13.0, 45.0)
            assert [calendar.part(n, t, tz) for n in ("year", "month", "dayofmonth", "hour", "minute")] == [year, 7, 16, 13, 45]
    assert math.isnan(calendar.from_parts(utc, 300_001.0, 1.0)) and math.isnan(calendar.part("year", math.inf, utc))
    a, b = (calendar.anchor_key("week", 8.0e15 + d * 86_400_000.0, utc) for d in (0, 7))
    assert b - a == 1

"""One query per operator of the script language over the test tables, each with the same result in plain SQL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.run import lang_version, restyled, run_script, run_script_json
from tapeloom.sources.bars import bars, resample


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour bars of each event type."""
    return resample(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", ("event_id",), "4 hours")


def orders_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each order priority."""
    return resample(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", ("o_orderkey",), "1 day")


def lineitem_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each return flag, volume in pieces."""
    return resample(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_shipdate", "l_extendedprice", ("l_orderkey", "l_linenumber"), "1 day", F.col("l_quantity"))


def supplier_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per line item, a tape per supplier: many tapes at once."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, tax = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_tax")
    return bars(d, F.col("l_suppkey"), "l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"), open=price - tax, high=price + tax, low=price - 2 * tax, close=price, volume="l_quantity")


TAPES = {"events": events_tape, "orders": orders_tape, "lineitem": lineitem_tape, "supplier": supplier_tape}


def _resampled(table: str, symbol: str, ts: str, price: str, order: str, bucket: str, volume: str = "count(*)") -> str:
    return f"""
b0 AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, time_bucket(INTERVAL '{bucket}', {ts}::TIMESTAMP) AS start,
    arg_min({price}, row({ts}, {order})) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, row({ts}, {order})) AS close,
    CAST({volume} AS DOUBLE) AS volume FROM {table} WHERE {ts} IS NOT NULL GROUP BY 1, 2
), b AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY start) - 1 AS bar_index, epoch_ms(start) AS date, open, high, low, close, volume FROM b0
)"""


SQL_TAPES = {
    "events": _resampled("events", "event_type", "ts", "value", "event_id", "4 hours"),
    "orders": _resampled("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1 day"),
    "lineitem": _resampled("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "l_orderkey, l_linenumber", "1 day", "sum(l_quantity)"),
    "supplier": """
b AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) - 1 AS bar_index, epoch_ms(l_shipdate::TIMESTAMP) AS date,
    l_extendedprice - l_extendedprice * l_tax AS open, l_extendedprice + l_extendedprice * l_tax AS high, l_extendedprice - 2 * (l_extendedprice * l_tax) AS low, l_extendedprice AS close, l_quantity AS volume FROM lineitem
)""",
}
W = "PARTITION BY symbol ORDER BY bar_index"
U = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def over(p: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def full(x: str, s: str, p: int) -> str:
    return f"CASE WHEN count({s}) {over(p)} = {p} THEN {x} END"


def mean(s: str, p: int) -> str:
    return full(f"avg({s}) {over(p)}", s, p)


def weighted(s: str, p: int) -> str:
    terms = " + ".join(f"{p - k} * {lag(s, k)}" if k else f"{p} * {s}" for k in range(p))
    return f"({terms}) / {p * (p + 1) / 2}"


def recursive(name: str, alpha: float, s: str, of: str) -> tuple[str, str]:
    """A CTE that adds column `name`, the exponential average of expression s over CTE `of`."""
    return (name, f"""r_{name} AS (
  SELECT symbol, bar_index, CAST({s} AS DOUBLE) AS y, {s} IS NOT NULL AS on_ FROM {of} WHERE bar_index = 0
  UNION ALL
  SELECT p.symbol, p.bar_index, CASE WHEN p.x IS NULL THEN r.y WHEN r.y IS NULL THEN p.x ELSE {alpha!r} * p.x + (1 - {alpha!r}) * r.y END, p.x IS NOT NULL
  FROM r_{name} r JOIN (SELECT symbol, bar_index, {s} AS x FROM {of}) p ON p.symbol = r.symbol AND p.bar_index = r.bar_index + 1
), j_{name} AS (SELECT a.*, CASE WHEN r.on_ THEN r.y END AS {name} FROM {of} a JOIN r_{name} r USING (symbol, bar_index))""")


class Sql:
    """A chain of CTEs over a tape."""

    def __init__(self, tape: str = "events"):
        self.parts, self.of = [SQL_TAPES[tape]], "b"

    def add(self, **columns: str) -> Sql:
        """Columns that later ones may read."""
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {self.of})")
        self.of = name
        return self

    def ema(self, name: str, s: str, alpha: float) -> Sql:
        _, cte = recursive(name, alpha, s, self.of)
        self.parts.append(cte)
        self.of = f"j_{name}"
        return self

    def out(self, *columns: str, text: tuple[int, ...] = ()) -> str:
        cols = ", ".join(f"{c} AS p{k}" if k in text else f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS p{k}" for k, c in enumerate(columns))
        return f"WITH RECURSIVE {', '.join(x.strip() for x in self.parts)}\nSELECT symbol, bar_index, date, {cols} FROM {self.of}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.nanvl(c, F.lit(None)), 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "error"])


def add(name: str, script: str, sql: str | None = None, tape: str = "events", options: dict | None = None, exact: bool = False) -> None:
    """Registers a script's per-bar output; `script` may be expressions, one a line, each then plotted."""
    if "plot" not in script and "strategy." not in script:
        script = "\n".join(f"plot({line})" for line in script.strip().splitlines())

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(run_script(TAPES[tape](spark, sf_dir), script + "\n", {"timezone": "UTC"} | (options or {}), exact).per_bar())

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def one(name: str, script: str, *columns: str, tape: str = "events", stages: tuple[dict, ...] = (), **kw) -> None:
    s = Sql(tape)
    for st in stages:
        s.add(**st)
    add(name, script, s.out(*columns), tape, **kw)


flag = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
c1 = lag("close")

# sources and expression operators
one("src_prices", "open\nhigh\nlow\nclose\nvolume", "open", "high", "low", "close", "volume")
one("src_derived", "hl2\nhlc3\nohlc4\nbar_index\ntime\npi", "(high + low) / 2", "(high + low + close) / 3", "(open + high + low + close) / 4", "bar_index", "date", "pi()")
one("src_barstate", "barstate.isfirst\nbarstate.islast", flag("bar_index = 0"), flag(f"lead(bar_index) OVER ({W}) IS NULL"))
last = "max(date) OVER (PARTITION BY symbol)"
one("src_now", "current_datetime\ndate_today\nmarket_open\nmarket_close", last, f"{last} - {last} % 86400000", f"{last} - {last} % 86400000 + 34200000", f"{last} - {last} % 86400000 + 57600000")
one("op_arithmetic", "close + open * 2 - high\nclose / 4\n-close\nclose % 7\n(bar_index - 5) % 3", "close + open * 2 - high", "close / 4", "-close", "fmod(close, 7)", "(bar_index - 5) % 3")
one("op_divide_by_zero", "nz(1 / (close - close) > 5 ? 7 : 8)\nna((close - close) / (close - close))", "7", "1")
one("op_compare", "close > open\nclose >= high\nclose < close[1]\nclose <= open\nclose == high\nclose != close[1]", flag("close > open"), flag("close >= high"), flag(f"close < {c1}"), flag("close <= open"), flag("close = high"), flag(f"coalesce(close <> {c1}, true)"))
one("op_logic", "close > open and volume > 5\nclose > open or volume > 5\nnot (close > open)", flag("close > open AND volume > 5"), flag("close > open OR volume > 5"), flag("NOT close > open"))
one("op_ternary", "close > open ? high : low\nclose[1] > 0 ? 1 : 2", "CASE WHEN close > open THEN high ELSE low END", flag(f"{c1} > 0").replace("0.0 END", "2.0 END"))
one("op_strings", 'close > open ? ("up" + "x" == "upx" ? 1 : 0) : 2', "CASE WHEN close > open THEN 1 ELSE 2 END")
one("history_constant", "close[1]\n(high - low)[3]\nclose[500]\nclose[-1]", c1, lag("high - low", 3), lag("close", 500), "NULL")
add("history_dynamic", "close[bar_index % 5]", Sql().out(f"CASE bar_index % 5 {' '.join(f'WHEN {k} THEN ' + (lag('close', k) if k else 'close') for k in range(5))} END"))

# statements: the fold tier
add("stmt_var", "var n = 0\nvar top = close\nif close > open\n    n := n + 1\nif close > top\n    top := close\nplot(n)\nplot(top)\n", Sql().out(f"sum({flag('close > open')}) {U}", f"max(close) {U}"))
add("stmt_if_chain", "x = 0.0\nif close > open * 2\n    x := 1\nelse if close < open / 2\n    x := 2\nelse\n    x := 3\nplot(x)\n", Sql().out("CASE WHEN close > open * 2 THEN 1 WHEN close < open / 2 THEN 2 ELSE 3 END"))
add("stmt_for", "s = 0.0\nfor k = 0 to 9\n    s := s + close[k]\nplot(s)\n", Sql().out(full(f"sum(close) {over(10)}", "close", 10)))
add("stmt_for_by", "s = 0.0\nfor k = 4 to 0 by -2\n    s := s + k\nplot(s + close)\n", Sql().out("6 + close"))
add("stmt_while", "s = 0.0\nk = 0\nwhile k < 30\n    k := k + 1\n    if k % 2 == 0\n        continue\n    if k > 15\n        break\n    s := s + k\nplot(s * close)\n", Sql().out("64 * close"))
add("stmt_switch", "r = 0\nswitch bar_index % 3\n    0 => r := high\n    1 => r := low\n    => r := close\nplot(r)\n", Sql().out("CASE bar_index % 3 WHEN 0 THEN high WHEN 1 THEN low ELSE close END"))
one("stmt_function", "band(src, len, mult) =>\n    m = sma(src, len)\n    m + mult * (src - m)\nplot(band(close, 10, 2))\nplot(band(high, 5, 3))", f"m + 2 * (close - m)", f"h + 3 * (high - h)", stages=({"m": mean("close", 10), "h": mean("high", 5)},))
add("stmt_conditional_state", "x = 0.0\nif close > open\n    x := cum(1)\nplot(x)\n", Sql().out(f"CASE WHEN close > open THEN sum({flag('close > open')}) {U} ELSE 0 END"))

# moving averages
one("fn_sma", "sma(close, 5)\nsma(close, 1)", mean("close", 5), "close")
one("fn_wma", "wma(close, 5)", weighted("close", 5))
add("fn_ema", "ema(close, 5)\nema(close, 20)", Sql().ema("a", "close", 2 / 6).ema("d", "close", 2 / 21).out("a", "d"))
add("fn_wilders", "wilders(close, 7)", Sql().ema("a", "close", 1 / 7).out("a"))
add("fn_dema", "dema(close, 10)", Sql().ema("a", "close", 2 / 11).ema("d", "a", 2 / 11).out("2 * a - d"))
add("fn_tema", "tema(close, 10)", Sql().ema("a", "close", 2 / 11).ema("d", "a", 2 / 11).ema("e", "d", 2 / 11).out("3 * a - 3 * d + e"))
one("fn_tma", "tma(close, 10)", mean("m", 6), stages=({"m": mean("close", 6)},))
one("fn_hull", "hull(close, 10)", weighted("h", 3), stages=({"h": f"2 * ({weighted('close', 5)}) - ({weighted('close', 10)})"},))
one("fn_alma", "alma(close, 9)", "(" + " + ".join(f"exp(-power({k} - 6.8, 2) / 4.5) * {lag('close', 8 - k) if k < 8 else 'close'}" for k in range(9)) + ") / (" + " + ".join(f"exp(-power({k} - 6.8, 2) / 4.5)" for k in range(9)) + ")")
one("fn_linreg", "linreg(close, 10)", full(f"regr_intercept(close, bar_index) {over(10)} + regr_slope(close, bar_index) {over(10)} * bar_index", "close", 10))
# rolling windows
one("fn_sum", "sum(volume, 5)", full(f"sum(volume) {over(5)}", "volume", 5))
one("fn_stdev", "stdev(close, 10)", full(f"stddev_pop(close) {over(10)}", "close", 10))
one("fn_highest", "highest(close, 5)", full(f"max(close) {over(5)}", "close", 5))
one("fn_lowest", "lowest(close, 5)", full(f"min(close) {over(5)}", "close", 5))
one("fn_highestbars", "highestbars(close, 10)", full(f"bar_index - arg_max(bar_index, row(close, bar_index)) {over(10)}", "close", 10))
one("fn_lowestbars", "lowestbars(close, 10)", full(f"bar_index - arg_max(bar_index, row(-close, bar_index)) {over(10)}", "close", 10))
one("fn_change", "change(close)\nchange(close, 5)", f"close - {c1}", f"close - {lag('close', 5)}")
one("fn_mom", "mom(close, 5)", f"close - {lag('close', 5)}")
one("fn_offset", "offset(close, 3)", lag("close", 3))
one("fn_roc", "roc(close, 5)", "CASE WHEN x <> 0 THEN 100 * (close - x) / x END", stages=({"x": lag("close", 5)},))
one("fn_rising", "rising(close, 2)", flag(f"close > {c1} AND {c1} > {lag('close', 2)}"))
one("fn_falling", "falling(close, 2)", flag(f"close < {c1} AND {c1} < {lag('close', 2)}"))
one("fn_crossover", "crossover(close, sma(close, 10))", flag(f"close > m AND {c1} <= {lag('m')}"), stages=({"m": mean("close", 10)},))
one("fn_crossunder", "crossunder(close, sma(close, 10))", flag(f"close < m AND {c1} >= {lag('m')}"), stages=({"m": mean("close", 10)},))
one("fn_cross", "cross(close, open)", flag(f"close > open AND {c1} <= {lag('open')} OR close < open AND {c1} >= {lag('open')}"))
one("fn_cum", "cum(close[1])", f"sum(coalesce(x, 0)) {U}", stages=({"x": c1},))
one("fn_valuewhen", "valuewhen(close > open, high)", f"last_value(CASE WHEN close > open THEN high END IGNORE NULLS) {U}")
one("fn_barssince", "barssince(close > open)", f"bar_index - max(CASE WHEN close > open THEN bar_index END) {U}")
one("fn_correlation", "correlation(close, volume, 10)", full(f"CASE WHEN max(volume) {over(10)} > min(volume) {over(10)} THEN corr(close, volume) {over(10)} END", "close", 10))
one("fn_percentile", "percentile(close, 10, 90)\npercentile(close, 4, 200)", full(f"quantile_cont(close, 0.9) {over(10)}", "close", 10), full(f"max(close) {over(4)}", "close", 4))
one("fn_median", "median(close, 10)", full(f"quantile_cont(close, 0.5) {over(10)}", "close", 10))
# fed by bars
TR = f"CASE WHEN bar_index = 0 THEN high - low ELSE greatest(high - low, abs(high - {c1}), abs(low - {c1})) END"
one("fn_tr", "tr()", TR)
add("fn_atr", "atr(5)", Sql().add(t=TR).ema("a", "t", 1 / 5).out("a"))
HH, LL = (full(f"max(high) {over(14)}", "high", 14), full(f"min(low) {over(14)}", "low", 14))
one("fn_stoch", "stoch(14)", "CASE WHEN h > l THEN 100 * (close - l) / (h - l) END", stages=({"h": HH, "l": LL},))
one("fn_willr", "willr(14)", "CASE WHEN h > l THEN -100 * (h - close) / (h - l) END", stages=({"h": HH, "l": LL},))
one("fn_mfi", "mfi(14)", "CASE WHEN u IS NULL OR d IS NULL THEN NULL WHEN d = 0 THEN CASE WHEN u = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + u / d) END", stages=({"t": "(high + low + close) / 3"}, {"up": f"CASE WHEN t > {lag('t')} THEN t * volume ELSE 0 END", "dn": f"CASE WHEN t < {lag('t')} THEN t * volume ELSE 0 END"}, {"u": full(f"sum(up) {over(14)}", "up", 14), "d": full(f"sum(dn) {over(14)}", "dn", 14)}))
one("fn_obv", "obv()", f"sum(x) {U}", stages=({"x": f"CASE WHEN close > {c1} THEN volume WHEN close < {c1} THEN -volume ELSE 0 END"},))
for _a, _k in (("session", "date // 86400000"), ("week", "(date // 86400000 + 3) // 7"), ("month", "year(make_timestamp(date * 1000)) * 12 + month(make_timestamp(date * 1000))")):
    _w = "OVER (PARTITION BY symbol, k ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    one(f"fn_vwap_{_a}", f'vwap(hlc3, "{_a}")\nvwap("{_a}")', *[f"sum((high + low + close) / 3 * volume) {_w} / sum(volume) {_w}"] * 2, stages=({"k": _k},))
for _n, _s, _c in (("pivothigh", ">", "high"), ("pivotlow", "<", "low")):
    _test = " AND ".join(f"{lag(_c, 2)} {_s} {lag(_c, k) if k else _c}" for k in (0, 1, 3, 4))
    one(f"fn_{_n}", f"{_n}(2, 2)", f"CASE WHEN {_test} THEN {lag(_c, 2)} END")
_d = Sql().add(u=f"high - {lag('high')}", d=f"{lag('low')} - low", t=f"CASE WHEN bar_index > 0 THEN {TR} END").add(pu="CASE WHEN u IS NULL THEN NULL WHEN u > d AND u > 0 THEN u ELSE 0 END", pd="CASE WHEN u IS NULL THEN NULL WHEN d > u AND d > 0 THEN d ELSE 0 END")
_d = _d.ema("st", "t", 1 / 14).ema("sp", "pu", 1 / 14).ema("sm", "pd", 1 / 14).add(dp="CASE WHEN st > 0 THEN 100 * sp / st END", dm="CASE WHEN st > 0 THEN 100 * sm / st END").add(dx="CASE WHEN dp + dm > 0 THEN 100 * abs(dp - dm) / (dp + dm) WHEN dp IS NOT NULL THEN 0 END").ema("ax", "dx", 1 / 14)
for _n, _c in (("adx", "ax"), ("diplus", "dp"), ("diminus", "dm")):
    add(f"fn_{_n}", f"{_n}(14)", _d.out(_c))
for _n, _v in (("aroonup", "high"), ("aroondown", "-low")):
    one(f"fn_{_n}", f"{_n}(10)", full(f"100 * (10 - (bar_index - arg_max(bar_index, row({_v}, bar_index)) {over(11)})) / 10.0", "high", 11))
one("fn_cci", "cci(14)", "CASE WHEN n = 14 AND dev > 0 THEN (t - m) / (0.015 * dev) END", stages=({"t": "(high + low + close) / 3"}, {"n": f"count(t) {over(14)}", "m": f"avg(t) {over(14)}", "l": f"list(t) {over(14)}"}, {"dev": "list_avg(list_transform(l, lambda x: abs(x - m)))"}))
def rsi_stages(s: Sql) -> Sql:
    """Columns ag and al, Wilder's average gain and loss over 14 steps."""
    s.add(x=f"close - {c1}").add(g="CASE WHEN x IS NULL THEN NULL WHEN x > 0 THEN x ELSE 0 END", l="CASE WHEN x IS NULL THEN NULL WHEN x < 0 THEN -x ELSE 0 END")
    s.add(g2=f"CASE WHEN bar_index = 14 THEN avg(g) {over(14)} WHEN bar_index > 14 THEN g END", l2=f"CASE WHEN bar_index = 14 THEN avg(l) {over(14)} WHEN bar_index > 14 THEN l END")
    return s.ema("ag", "g2", 1 / 14).ema("al", "l2", 1 / 14)


RSI = "CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN CASE WHEN ag = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + ag / al) END"
add("fn_rsi", "rsi(close, 14)", rsi_stages(Sql()).out(RSI))

def sar_sql(start: float, step: float, most: float) -> str:
    s = Sql()
    rising, falling = "least(s, pl, ppl)", "greatest(s, ph, pph)"
    s.parts.append(f"""r AS (
  SELECT x.symbol, x.bar_index, x.close >= y.close AS up, CASE WHEN x.close >= y.close THEN least(x.low, y.low) ELSE greatest(x.high, y.high) END AS sar,
    CASE WHEN x.close >= y.close THEN greatest(x.high, y.high) ELSE least(x.low, y.low) END AS ep, CAST({start} AS DOUBLE) AS af, x.high AS ph, x.low AS pl, y.high AS pph, y.low AS ppl
  FROM b x JOIN b y ON x.symbol = y.symbol AND x.bar_index = 1 AND y.bar_index = 0
  UNION ALL
  SELECT symbol, bar_index, CASE WHEN up THEN low >= c ELSE high > c END, CASE WHEN up AND low < c OR NOT up AND high > c THEN ep ELSE c END,
    CASE WHEN up THEN CASE WHEN low < c THEN low ELSE greatest(ep, high) END ELSE CASE WHEN high > c THEN high ELSE least(ep, low) END END,
    CASE WHEN up AND low < c OR NOT up AND high > c THEN {start} WHEN up AND high > ep OR NOT up AND low < ep THEN least({most}, af + {step}) ELSE af END, high, low, ph, pl
  FROM (SELECT *, CASE WHEN up THEN {rising} ELSE {falling} END AS c FROM (
    SELECT n.symbol, n.bar_index, n.high, n.low, r.up, r.ep, r.af, r.ph, r.pl, r.pph, r.ppl, r.sar + r.af * (r.ep - r.sar) AS s FROM r JOIN b n ON n.symbol = r.symbol AND n.bar_index = r.bar_index + 1))
), j AS (SELECT b.*, r.sar AS v FROM b LEFT JOIN r USING (symbol, bar_index))""")
    s.of = "j"
    return s.out("v")


add("fn_sar", "sar()", sar_sql(0.02, 0.02, 0.2))
add("fn_sar_settings", "sar(0.01, 0.03, 0.3)", sar_sql(0.01, 0.03, 0.3))
_t = Sql().add(t=TR).ema("a", "t", 1 / 10)
_t.parts.append("""r AS (
  SELECT symbol, bar_index, (high + low) / 2 + 3 * a AS u, (high + low) / 2 - 3 * a AS l, CASE WHEN close < (high + low) / 2 - 3 * a THEN -1 ELSE 1 END AS d, close AS c FROM j_a WHERE bar_index = 0
  UNION ALL
  SELECT symbol, bar_index, u2, l2, CASE WHEN d > 0 AND close < l2 THEN -1 WHEN d < 0 AND close > u2 THEN 1 ELSE d END, close FROM (
    SELECT n.symbol, n.bar_index, n.close, r.d, CASE WHEN n.u < r.u OR r.c > r.u THEN n.u ELSE r.u END AS u2, CASE WHEN n.l > r.l OR r.c < r.l THEN n.l ELSE r.l END AS l2
    FROM r JOIN (SELECT symbol, bar_index, close, (high + low) / 2 + 3 * a AS u, (high + low) / 2 - 3 * a AS l FROM j_a) n ON n.symbol = r.symbol AND n.bar_index = r.bar_index + 1)
), j AS (SELECT b.*, CASE WHEN r.d > 0 THEN r.l ELSE r.u END AS v, r.d FROM b JOIN r USING (symbol, bar_index))""")
_t.of = "j"
add("fn_supertrend", "supertrend(10, 3)\nsupertrend_dir(10, 3)", _t.out("v", "d"))
# scalar functions
one("fn_math", "abs(close - open)\nsqrt(volume)\nexp(close / 1000)\nfloor(close)\nceil(close)\nsign(close - open)\npow(close - open, 2)", "abs(close - open)", "sqrt(volume)", "exp(close / 1000)", "floor(close)", "ceil(close)", "sign(close - open)", "power(close - open, 2)")
one("fn_log", "log(volume)\nna(log(close - close - 1))", "ln(volume)", "1")
one("fn_round", "round(close)\nround(-close)\nround(-2.5)\nround(2.5)", "floor(close + 0.5)", "floor(-close + 0.5)", "-2", "3")
one("fn_min_max_avg", "min(open, close, 100)\nmax(open, close, 100)\navg(open, high, low, close)\nmin(close, close[1])", "least(open, close, 100)", "greatest(open, close, 100)", "(open + high + low + close) / 4", f"CASE WHEN {c1} IS NOT NULL THEN least(close, {c1}) END")
one("fn_trig", "sin(close)\ncos(close)\ntan(pi / 8)\nasin(1)\nacos(1)\natan(close)\natan2(high - low, 1)", "sin(close)", "cos(close)", "tan(pi() / 8)", "asin(1)", "acos(1)", "atan(close)", "atan2(high - low, 1)")
one("fn_nz_na_iff", "nz(close[10], close)\nna(close[1])\niff(close > open, 1, -1)", f"coalesce({lag('close', 10)}, close)", flag(f"{c1} IS NULL"), "CASE WHEN close > open THEN 1 ELSE -1 END")
one("fn_tostring", 'str.length(tostring(volume))\ntostring(volume * 1000) == "3000"\nstr.length(tostring(volume / 4))', "length(CAST(CAST(volume AS BIGINT) AS VARCHAR))", flag("volume = 3"), "length(regexp_replace(CAST(volume / 4 AS VARCHAR), '[.]0$', ''))")
one("fn_strings", 'str.length(str.format("v={0}", volume))\nstr.contains("hello", "ell")\nstr.length(str.replace("x.y.z", ".", "--"))\nstr.upper("up") == "UP"\nstr.lower("DOWN") == "down"', "2 + length(CAST(CAST(volume AS BIGINT) AS VARCHAR))", "1", "7", "1", "1")
add("fn_str_split", 'parts = str.split("a,b,c,d", ",")\nplot(array.size(parts) + close)\n', Sql().out("4 + close"))
# arrays
add("array_buffer", "var buf = array.new()\narray.push(buf, close)\nif array.size(buf) > 10\n    gone = array.shift(buf)\nplot(array.avg(buf))\nplot(array.size(buf))\nplot(array.min(buf))\nplot(array.max(buf))\nplot(array.sum(buf))\nplot(array.first(buf))\nplot(array.last(buf))\n", Sql().out(f"avg(close) {over(10)}", "least(bar_index + 1, 10)", f"min(close) {over(10)}", f"max(close) {over(10)}", f"sum(close) {over(10)}", f"first_value(close) {over(10)}", "close"))
add("array_refs", "var a = array.new(3, 0)\nb = a\narray.set(b, bar_index % 3, close)\nplot(array.get(a, 0) + array.get(a, 1) + array.get(a, 2))\nplot(array.get(a, 7))\n", Sql().out(f"sum(close) {over(3)}", "NULL"))
add("array_stack", "a = array.new()\narray.unshift(a, low)\narray.unshift(a, high)\nx = array.pop(a)\nplot(x)\nplot(array.size(a))\narray.clear(a)\nplot(array.size(a))\n", Sql().out("low", "1", "0"))
# calendar
_ts = "make_timestamp(date * 1000)"
one("time_parts", "year(time)\nmonth(time)\ndayofmonth(time)\ndayofweek(time)\nhour(time)\nminute(time)", f"year({_ts})", f"month({_ts})", f"day({_ts})", f"dayofweek({_ts})", f"hour({_ts})", f"minute({_ts})")
_ny = "(make_timestamp(date * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
one("time_parts_new_york", "hour(time)\ndayofweek(time)", f"hour({_ny})", f"dayofweek({_ny})", options={"timezone": "America/New_York"})
one("time_timestamp", 'timestamp("2024-03-10 12:30")\ntimestamp(2024, 13, 1, 2, 5)\nna(timestamp(2024, na, 1))', "1710073800000", "1735697100000", "1")
# resampling
for _f, _k in (("1d", "date // 86400000"), ("1w", "(date // 86400000 + 3) // 7"), ("12h", "date // 43200000")):
    _s = Sql()
    _s.parts.append(f"k AS (SELECT *, {_k} AS k FROM b), g AS (SELECT symbol, k, arg_min(open, bar_index) AS o, max(high) AS h, min(low) AS l, arg_max(close, bar_index) AS c, sum(volume) AS v FROM k GROUP BY symbol, k), l AS (SELECT symbol, k, lag(o) OVER z AS o, lag(h) OVER z AS h, lag(l) OVER z AS l, lag(c) OVER z AS c, lag(v) OVER z AS v FROM g WINDOW z AS (PARTITION BY symbol ORDER BY k)), m AS (SELECT k.symbol, k.bar_index, k.date, l.o, l.h, l.l, l.c, l.v FROM k JOIN l USING (symbol, k))")
    _s.of = "m"
    add(f"security_{_f}", "\n".join(f'plot(security("{_f}", {x}))' for x in ("open", "high", "low", "close", "volume")), _s.out("o", "h", "l", "c", "v"))
add("security_indicator", 'plot(security("1d", sma(close, 3)))\nplot(security("1d", bar_index))\n', (lambda s: (s.parts.append("k AS (SELECT *, date // 86400000 AS k FROM b), g AS (SELECT symbol, k, arg_max(close, bar_index) AS c FROM k GROUP BY symbol, k), h AS (SELECT symbol, k, CASE WHEN count(c) OVER z = 3 THEN avg(c) OVER z END AS a, row_number() OVER (PARTITION BY symbol ORDER BY k) - 1 AS n FROM g WINDOW z AS (PARTITION BY symbol ORDER BY k ROWS 2 PRECEDING)), l AS (SELECT symbol, k, lag(a) OVER z AS a, lag(n) OVER z AS n FROM h WINDOW z AS (PARTITION BY symbol ORDER BY k)), m AS (SELECT k.symbol, k.bar_index, k.date, l.a, l.n FROM k JOIN l USING (symbol, k))"), setattr(s, "of", "m"), s.out("a", "n"))[-1])(Sql()))


def sql_as(names: dict[str, str], tape: str = "events", stages: tuple[dict, ...] = (), text: tuple[str, ...] = ()) -> str:
    s = Sql(tape)
    for st in stages:
        s.add(**st)
    cols = ", ".join(f"{v} AS {k}" if k in text else f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in names.items())
    return f"WITH {', '.join(x.strip() for x in s.parts)}\nSELECT symbol, bar_index, date, {cols} FROM {s.of}"


# outputs
add("draw_hline_fill", "p = plot(close)\nh = hline(70)\nfill(p, h)\nfill(high, 50)\n", sql_as({"p0": "close", "p1": "70", "fill_0_a": "close", "fill_0_b": "70", "fill_1_a": "high", "fill_1_b": "50"}))
add("draw_plotshape", 'plotshape(close > open, shape="circle")\nplotshape(close - open)\n', sql_as({"shape_0": flag("close > open"), "shape_1": "close - open"}))
add("draw_trades", 'plotbuy(close > open, 2, price="low")\nplotsell(close < open, qty=volume, price=hl2)\n', sql_as({"trade_0_value": flag("close > open"), "trade_0_qty": "2", "trade_1_value": flag("close < open"), "trade_1_qty": "volume", "trade_1_price": "(high + low) / 2"}))
add("draw_colors", 'plot(close)\nbarcolor(close > open ? "#22c55e" : "#ef4444")\nbgcolor("#3b82f6", when=volume > 5)\n', sql_as({"p0": "close", "bar_color_0": "CASE WHEN close > open THEN '#22c55e' ELSE '#ef4444' END", "bg_color_0": "CASE WHEN volume > 5 THEN '#3b82f6' END"}, text=("bar_color_0", "bg_color_0")))
add("draw_alert", 'plot(close)\nalertcondition(close > open, title="up", message="i={{bar_index}} v={{volume}}")\n', sql_as({"p0": "close", "alert_0": flag("close > open"), "alert_0_message": "CASE WHEN close > open THEN 'i=' || bar_index || ' v=' || CAST(volume AS BIGINT) END"}, text=("alert_0_message",)))
one("input_declared", 'len = input.int(9, "Length", minval=2, maxval=50)\nk = input.float(0.5, "Factor")\non = input.bool(true, "On")\nmode = input.string("sma", "Mode", options="sma,none")\nplot(mode == "sma" and on ? sma(close, len) * k : 0)', f"0.5 * ({mean('close', 5)})", options={"inputs": {"Length": 5}})


def panel(name: str, script: str, sql: str | None, what: str = "panel") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = run_script(events_tape(spark, sf_dir), script, {"timezone": "UTC"})
        return rounded(r.panel() if what == "panel" else r.records(what))

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_b = SQL_TAPES["events"].strip()
panel("draw_infopanel", 'plot(close)\ninfopanel(close, title="Last")\ninfopanel(close > open ? "up" : "down", title="Dir")\n', f"WITH {_b}, e AS (SELECT symbol, arg_max(close, bar_index) AS c, arg_max(open, bar_index) AS o FROM b GROUP BY symbol) SELECT symbol, 0::BIGINT AS k, 'Last' AS title, round(c, 6) + 0.0 AS value, NULL AS text, 2.0 AS precision FROM e UNION ALL SELECT symbol, 1, 'Dir', NULL, CASE WHEN c > o THEN 'up' ELSE 'down' END, 2.0 FROM e")
for _n, _call, _cols, _sel in (
    ("lines", 'line.new(bar_index - 1, close[1], bar_index, close, when=close > open)', "x1, y1, x2, y2, color, width, lineStyle", f"bar_index - 1.0 AS x1, round({c1}, 6) AS y1, bar_index * 1.0 AS x2, round(close, 6) AS y2, '#8f8f98' AS color, 1.0 AS width, 'solid' AS \"lineStyle\""),
    ("labels", 'label.new(bar_index, high, "top", when=close > open)', "x, y, text, color, textColor, style, size", "bar_index * 1.0 AS x, round(high, 6) AS y, 'top' AS text, '#8f8f98' AS color, NULL::VARCHAR AS \"textColor\", 'down' AS style, 10.0 AS size"),
    ("boxes", 'box.new(bar_index - 1, high, bar_index, low, when=close > open and bar_index > 0)', "x1, y1, x2, y2, color, bgColor, width", "bar_index - 1.0 AS x1, round(high, 6) AS y1, bar_index * 1.0 AS x2, round(low, 6) AS y2, '#8f8f98' AS color, NULL::VARCHAR AS \"bgColor\", 1.0 AS width"),
):
    _y = '"y1"' if _n == "lines" else "1"
    panel(f"draw_{_n}", f"plot(close)\n{_call}\n", f"WITH {_b}, s AS (SELECT symbol, close > open AS hit, bar_index, {_sel} FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_index DESC) AS r FROM s WHERE hit AND bar_index > {0 if _n != 'labels' else -1}) SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar_index) - 1 AS k, {', '.join(chr(34) + x.strip() + chr(34) for x in _cols.split(','))} FROM f WHERE r <= 500", _n)

# strategy: path-dependent
add("strategy_state", "strategy.buy(bar_index == 3, 10)\nstrategy.sell(bar_index == 9, 4)\nplot(strategy.position_size)\nplot(strategy.avg_price)\nplot(strategy.open_pnl)\nplot(strategy.realized_pnl)\nplot(strategy.trades)\n", (lambda s: s.add(a=f"max(CASE WHEN bar_index = 3 THEN close END) {U}", z=f"max(CASE WHEN bar_index = 9 THEN close END) {U}").out("CASE WHEN bar_index > 9 THEN 6 WHEN bar_index > 3 THEN 10 ELSE 0 END", "CASE WHEN bar_index > 3 THEN a END", "CASE WHEN bar_index > 9 THEN 6 * (close - a) WHEN bar_index > 3 THEN 10 * (close - a) ELSE 0 END", "CASE WHEN bar_index > 9 THEN 4 * (z - a) ELSE 0 END", "CASE WHEN bar_index > 9 THEN 1 ELSE 0 END"))(Sql()))
_STRATEGY = "strategy.config(initial_capital=50000, commission_percent=0.1, commission_cash=0.5, slippage=0.02, pyramiding=2)\nup = crossover(close, sma(close, 5))\ndown = crossunder(close, sma(close, 5))\nstrategy.buy(up, qty=5, qty_type=\"percent_of_equity\", stop_loss=20, take_profit=40, trailing=30)\nstrategy.sell(down, qty=2000, qty_type=\"cash\", limit=close + 1, expires=5)\n"


def ledger_sql(select: str) -> str:
    """The ledger of _STRATEGY, bar by bar, as a recursive query; select reads `last`, the state after each symbol's last bar."""
    trade = "STRUCT(side VARCHAR, eb BIGINT, ep DOUBLE, xb BIGINT, xp DOUBLE, qty DOUBLE, pnl DOUBLE, reason VARCHAR)[]"
    state = ["sz", "av", "en", "ne", "st", "tg", "tr", "be", "rz", "cm", "wn", "ls", "nw", "nl", "td", "fl", "lim", "placed", "pk", "dd", "cpk", "cdd", "prev", "n", "s", "q"]
    zero, none, no_bar = "0::DOUBLE", "NULL::DOUBLE", "-1::BIGINT"
    start = [zero, none, no_bar, "0", none, none, none, none, zero, zero, zero, zero, "0", "0", f"[]::{trade}", "[]::STRUCT(bar BIGINT, buy BOOLEAN, qty DOUBLE)[]", none, no_bar, zero, zero, "'-inf'::DOUBLE", zero, none, "0", zero, zero]

    def put(of: str, **new: str) -> str:
        return f"(SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in new.items())}) FROM {of})"

    def more(of: str, **new: str) -> str:
        return f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in new.items())} FROM {of})"

    def fill(of: str, paid: str, wish: str, reason: str, exits: tuple[str, str, str]) -> str:
        """A fill of `wish` (signed) shares at `paid`; wish may read pd, the price paid. Null or 0 wishes nothing."""
        d = more(more(of, pd=paid), w=f"coalesce({wish}, 0.0)")
        d = more(d, c="CASE WHEN sz * w < 0 THEN sign(w) * least(abs(w), abs(sz)) ELSE 0.0 END", rs=reason)
        d = more(d, g="CASE WHEN c <> 0 THEN (av - pd) * c ELSE 0.0 END")
        out = "c <> 0 AND sz + c = 0"
        d = put(d, rz="rz + g", wn="wn + greatest(g, 0.0)", ls="ls + greatest(-g, 0.0)", nw="nw + (g > 0)::INT", nl="nl + (g < 0)::INT",
            cm="CASE WHEN c <> 0 THEN cm + (0.5 + 0.1 / 100 * abs(c) * pd) ELSE cm END",
            td="CASE WHEN c <> 0 THEN list_append(td, {'side': CASE WHEN sz > 0 THEN 'long' ELSE 'short' END, 'eb': en, 'ep': av, 'xb': bar_index, 'xp': pd, 'qty': abs(c), 'pnl': g, 'reason': rs}) ELSE td END",
            fl="CASE WHEN c <> 0 THEN list_append(fl, {'bar': bar_index, 'buy': w > 0, 'qty': abs(c)}) ELSE fl END",
            sz="sz + c", w="w - c", av=f"CASE WHEN {out} THEN NULL ELSE av END", en=f"CASE WHEN {out} THEN -1 ELSE en END", ne=f"CASE WHEN {out} THEN 0 ELSE ne END",
            **{k: f"CASE WHEN {out} THEN NULL ELSE {k} END" for k in ("st", "tg", "tr", "be")})
        on = "w <> 0 AND (sz = 0 OR ne < 2)"
        d = put(d, cm=f"CASE WHEN {on} THEN cm + (0.5 + 0.1 / 100 * abs(w) * pd) ELSE cm END", fl=f"CASE WHEN {on} THEN list_append(fl, {{'bar': bar_index, 'buy': w > 0, 'qty': abs(w)}}) ELSE fl END",
            av=f"CASE WHEN NOT ({on}) THEN av WHEN sz = 0 THEN pd ELSE (av * abs(sz) + pd * abs(w)) / (abs(sz) + abs(w)) END",
            be=f"CASE WHEN NOT ({on}) THEN be WHEN sz = 0 THEN pd WHEN sz > 0 THEN greatest(be, pd) ELSE least(be, pd) END",
            en=f"CASE WHEN {on} AND sz = 0 THEN bar_index ELSE en END", ne=f"CASE WHEN {on} THEN ne + 1 ELSE ne END", sz=f"CASE WHEN {on} THEN sz + w ELSE sz END",
            **{k: f"CASE WHEN {on} THEN coalesce({v}, {k}) ELSE {k} END" for k, v in zip(("st", "tg", "tr"), exits)})
        return f"(SELECT * EXCLUDE (pd, w, c, rs, g) FROM {d})"

    none = (none,) * 3
    d = f"(SELECT b.*, {', '.join(f'r.{c}' for c in state)} FROM r JOIN e b ON b.symbol = r.symbol AND b.bar_index = r.bar_index + 1)"
    # protective exits, then the working order, then the body's orders, then the accounts
    d = more(more(d, lv="greatest(av - st, be - tr)"), hit="CASE WHEN sz > 0 AND bar_index > en AND low <= lv THEN 'stop' WHEN sz > 0 AND bar_index > en AND high >= av + tg THEN 'target' END")
    d = fill(d, "CASE hit WHEN 'stop' THEN least(open, lv) ELSE greatest(open, av + tg) END - 0.02", "CASE WHEN hit IS NOT NULL THEN -sz END", "hit", none)
    d = put(d, lim="CASE WHEN bar_index - placed > 5 THEN NULL ELSE lim END")
    d = put(fill(d, "greatest(open, lim) - 0.02", "CASE WHEN high >= lim THEN -2000 / pd END", "'signal'", none), lim="CASE WHEN high >= lim THEN NULL ELSE lim END")
    d = more(d, eq="50000 + rz - cm + coalesce((close - av) * sz, 0.0)")
    d = fill(d, "close + 0.02", "CASE WHEN up AND eq > 0 THEN eq * 5 / 100 / pd END", "'signal'", ("20.0", "40.0", "30.0"))
    d = put(d, lim="CASE WHEN down THEN close + 1 ELSE lim END", placed="CASE WHEN down THEN bar_index ELSE placed END")
    d = put(d, be="CASE WHEN sz > 0 AND bar_index > en THEN greatest(be, high) WHEN sz < 0 AND bar_index > en THEN least(be, low) ELSE be END", eq="50000 + rz - cm + coalesce((close - av) * sz, 0.0)")
    d = more(d, now="rz + coalesce((close - av) * sz, 0.0)", x="CASE WHEN prev = 0 THEN 0.0 ELSE (eq - prev) / abs(prev) END")
    d = put(put(d, pk="greatest(pk, now)", cpk="greatest(cpk, eq)"), dd="greatest(dd, pk - now)", cdd="CASE WHEN cpk > 0 THEN greatest(cdd, (cpk - eq) / cpk) ELSE cdd END", n="n + (prev IS NOT NULL)::INT", s="s + coalesce(x, 0.0)", q="q + coalesce(x * x, 0.0)", prev="eq")
    up, down = f"coalesce(close > m AND {c1} <= {lag('m')}, false)", f"coalesce(close < m AND {c1} >= {lag('m')}, false)"
    return f"""WITH RECURSIVE {SQL_TAPES['events'].strip()}, m AS (SELECT *, {mean('close', 5)} AS m FROM b), e AS (SELECT *, {up} AS up, {down} AS down FROM m), r AS (
  SELECT symbol, -1::BIGINT AS bar_index, NULL::DOUBLE AS close, {', '.join(f'{v} AS {k}' for k, v in zip(state, start))} FROM b WHERE bar_index = 0
  UNION ALL
  SELECT symbol, bar_index, close, {', '.join(state)} FROM {d}
), last AS (SELECT r.*, span FROM r JOIN (SELECT symbol, max(bar_index) AS bar_index, max(date) - min(date) AS span FROM b GROUP BY symbol) USING (symbol, bar_index))
{select}"""


_six = lambda x, name: f'round(CAST({x} AS DOUBLE), 6) + 0.0 AS "{name}"'
panel("strategy_trades", _STRATEGY, ledger_sql("SELECT symbol, k, t.side AS side, t.eb AS \"entryBar\", " + _six("t.ep", "entryPrice") + ", t.xb AS \"exitBar\", " + ", ".join(_six(f"t.{c}", n) for c, n in (("xp", "exitPrice"), ("qty", "qty"), ("pnl", "pnl"))) + ", t.reason AS reason FROM (SELECT symbol, unnest(td) AS t, unnest(range(len(td))) AS k FROM last)"), "trades")
_open, _end, _years = "coalesce((close - av) * sz, 0.0)", "(50000 + rz - cm + coalesce((close - av) * sz, 0.0))", "(span / (365.25 * 86400000))"
_SUMMARY = {
    "realized": "rz", "openPnl": _open, "netProfit": f"rz + {_open} - cm", "trades": "len(td)", "wins": "nw", "losses": "nl", "winRate": "CASE WHEN len(td) > 0 THEN nw / len(td) END", "grossProfit": "wn", "grossLoss": "ls",
    "profitFactor": "CASE WHEN ls > 0 THEN wn / ls WHEN wn > 0 THEN 'inf'::DOUBLE END", "maxDrawdown": "dd", "initialCapital": "50000", "commissions": "cm", "endEquity": _end, "returnPct": f"({_end} / 50000 - 1) * 100",
    "cagrPct": f"CASE WHEN span > 0 AND {_end} > 0 THEN (pow({_end} / 50000, 1 / {_years}) - 1) * 100 END", "sharpe": "CASE WHEN n > 1 AND q / n - (s / n) * (s / n) > 0 THEN (s / n) / sqrt(q / n - (s / n) * (s / n)) END", "maxDrawdownPct": "cdd * 100",
}
panel("strategy_summary", _STRATEGY, ledger_sql("SELECT symbol, 0::BIGINT AS k, " + ", ".join(_six(v, k) for k, v in _SUMMARY.items()) + " FROM last"), "summary")
panel("strategy_markers", _STRATEGY, ledger_sql("SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY buy DESC, bar) - 1 AS k, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS side, bar, " + _six("sum(qty)", "qty") + " FROM (SELECT symbol, unnest(fl, recursive := true) FROM last) GROUP BY symbol, buy, bar"), "markers")
panel("strategy_open", _STRATEGY, ledger_sql("SELECT symbol, 0::BIGINT AS k, CASE WHEN sz > 0 THEN 'long' ELSE 'short' END AS side, " + _six("abs(sz)", "qty") + ", " + _six("av", "avgPrice") + ", en AS \"entryBar\" FROM last WHERE sz <> 0"), "open")
add("strategy_netting", "strategy.buy(close > open * 3, 1)\nstrategy.sell(close < open / 3, 1)\nplot(strategy.position_size)\n", Sql().out(f"coalesce(sum(CASE WHEN close > open * 3 THEN 1 WHEN close < open / 3 THEN -1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))

# other tapes, many symbols
one("tape_orders", "sma(close, 5)\ncrossover(close, sma(close, 5))", "m", flag(f"close > m AND {c1} <= {lag('m')}"), tape="orders", stages=({"m": mean("close", 5)},))
one("tape_lineitem", "highest(high, 20)\nlowest(low, 20)\nvolume", full(f"max(high) {over(20)}", "high", 20), full(f"min(low) {over(20)}", "low", 20), "volume", tape="lineitem")
one("many_tapes_window", "sma(close, 20)\nstdev(close, 20)\nhighest(high, 20)", mean("close", 20), full(f"stddev_pop(close) {over(20)}", "close", 20), full(f"max(high) {over(20)}", "high", 20), tape="supplier")
add("many_tapes_fold", "var n = 0\nif crossover(close, ema(close, 10))\n    n := n + 1\nplot(n)\nplot(rsi(close, 14))\n", rsi_stages(Sql("supplier").ema("e", "close", 2 / 11).add(up=flag(f"close > e AND {c1} <= {lag('e')}"))).out(f"sum(up) {U}", RSI), tape="supplier")
one("flagship", 'study("Crosses")\nm = sma(close, 10)\nplot(m)\nplotshape(crossover(close, m))', "m", stages=({"m": mean("close", 10)},))
ORACLES["flagship"] = sql_as({"p0": "m", "shape_0": flag(f"close > m AND {c1} <= {lag('m')}")}, stages=({"m": mean("close", 10)},))

# history of variables and scalars
add("history_variable", "x = close * 2\nvar n = 0\nn := n + 1\nplot(x[3])\nplot(n[1])\n", Sql().out(f"2 * {lag('close', 3)}", "CASE WHEN bar_index > 0 THEN bar_index END"))
add("history_scalar", "k = 2.5\nplot(pi[2])\nplot(k[3])\n", Sql().out("CASE WHEN bar_index >= 2 THEN pi() END", "CASE WHEN bar_index >= 3 THEN 2.5 END"))
# other frames, and script variables read at the first bar after a bucket
for _f, _k in (("720m", "date // 43200000"), ("480m", "date // 28800000")):
    _s = Sql()
    _s.parts.append(f"k AS (SELECT *, {_k} AS k FROM b), g AS (SELECT symbol, k, max(high) AS h, arg_max(close, bar_index) AS c FROM k GROUP BY symbol, k), l AS (SELECT symbol, k, lag(h) OVER z AS h, lag(c) OVER z AS c FROM g WINDOW z AS (PARTITION BY symbol ORDER BY k)), m AS (SELECT k.symbol, k.bar_index, k.date, l.h, l.c FROM k JOIN l USING (symbol, k))")
    _s.of = "m"
    add(f"security_{_f}", f'plot(security("{_f}", high))\nplot(security("{_f}", close))\n', _s.out("h", "c"))
_s = Sql()
_s.parts.append("k AS (SELECT *, date // 86400000 AS k, min(date // 86400000) OVER (PARTITION BY symbol) AS k0 FROM b), m AS (SELECT symbol, bar_index, date, CASE WHEN k > k0 THEN first_value(close * 2 + bar_index) OVER (PARTITION BY symbol, k ORDER BY bar_index) END AS v FROM k)")
_s.of = "m"
add("security_variable", 'x = close * 2 + bar_index\nplot(security("1d", x))\n', _s.out("v"))
one("src_now_session", "date_today\nmarket_open\nmarket_close", f"{last} - {last} % 86400000", f"{last} - {last} % 86400000 + 29700000", f"{last} - {last} % 86400000 + 63900000", options={"session": {"open": "08:15", "close": "17:45"}})
add("strategy_sources", "strategy.buy(bar_index == 3, 10)\nstrategy.sell(bar_index == 9, 10)\nplot(strategy.wins)\nplot(strategy.losses)\nplot(strategy.equity)\n", Sql().add(a=f"max(CASE WHEN bar_index = 3 THEN close END) {U}", z=f"max(CASE WHEN bar_index = 9 THEN close END) {U}").out(flag("bar_index > 9 AND z > a"), flag("bar_index > 9 AND z < a"), "CASE WHEN bar_index > 9 THEN 10 * (z - a) WHEN bar_index > 3 THEN 10 * (close - a) ELSE 0 END"))
# text, compared as text
panel("fn_number_text", 'plot(close)\nlabel.new(bar_index, high, tostring(volume) + "/" + tostring(volume / 4) + (close > open ? " up" : " down"), when=bar_index < 40)\n', f"WITH {_b} SELECT symbol, bar_index AS k, bar_index * 1.0 AS x, round(high, 6) + 0.0 AS y, CAST(CAST(volume AS BIGINT) AS VARCHAR) || '/' || regexp_replace(CAST(volume / 4 AS VARCHAR), '[.]0$', '') || CASE WHEN close > open THEN ' up' ELSE ' down' END AS text, '#8f8f98' AS color, NULL::VARCHAR AS \"textColor\", 'down' AS style, 10.0 AS size FROM b WHERE bar_index < 40", "labels")
panel("fn_text_of_series", 'plot(close)\nt = str.upper(str.format("v={0}/{1}", volume, bar_index)) + str.replace(tostring(volume), "1", "__") + str.lower(close > open ? "Up" : "Down")\nlabel.new(bar_index, low, t + (str.contains(t, "5") ? "!" : "") + tostring(str.length(t)), when=bar_index < 60)\n', f"WITH {_b}, t AS (SELECT *, 'V=' || CAST(volume AS BIGINT) || '/' || bar_index || replace(CAST(CAST(volume AS BIGINT) AS VARCHAR), '1', '__') || CASE WHEN close > open THEN 'up' ELSE 'down' END AS t FROM b) SELECT symbol, bar_index AS k, bar_index * 1.0 AS x, round(low, 6) + 0.0 AS y, t || CASE WHEN contains(t, '5') THEN '!' ELSE '' END || length(t) AS text, '#8f8f98' AS color, NULL::VARCHAR AS \"textColor\", 'down' AS style, 10.0 AS size FROM t WHERE bar_index < 60", "labels")


def failing(name: str, script: str) -> None:
    """A script that fails on every symbol: its bars, with whether there is an error and whether outputs are empty."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = run_script(events_tape(spark, sf_dir), script, {"timezone": "UTC"}, exact=True).per_bar()
        empty = F.lit(True)
        for c in set(d.columns) - {"symbol", "bar_index", "date", "error"}:
            empty = empty & F.col(c).isNull()
        return d.select("symbol", "bar_index", F.col("error").isNotNull().alias("failed"), empty.alias("empty"))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {_b} SELECT symbol, bar_index, true AS failed, true AS empty FROM b"


failing("error_loop_cap", "n = 0\nwhile n > -1\n    n := n + 1\nplot(n)\n")
failing("error_offset", 'k = close > open ? "one" : "two"\nplot(close[k])\n')
failing("error_draws_nothing", "x = sma(close, 3)\n")


def result_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON result of each symbol, read back."""
    r = run_script(events_tape(spark, sf_dir), 'study("Mean", overlay=true)\nplot(sma(close, 5), "#112233", 3, title="Five")\n', {"timezone": "UTC"}).json()
    get = lambda path: F.get_json_object("result", path)
    values = F.posexplode(F.from_json(get("$.plots[0].values"), "array<double>")).alias("bar_index", "value")
    d = r.select("symbol", get("$.title").alias("title"), get("$.plots[0].title").alias("plot"), get("$.plots[0].color").alias("color"), get("$.plots[0].width").cast("double").alias("width"), get("$.error").isNull().alias("ok"), values)
    return rounded(d.withColumn("bar_index", F.col("bar_index").cast("long")))


def json_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_script_json on each symbol's bars as JSON text, on the executors."""

    @F.pandas_udf("string")
    def run(bars_json: pd.Series) -> pd.Series:
        return bars_json.map(lambda t: run_script_json("plot(highest(high, 4))\n", t, '{"timezone": "UTC"}'))

    bar = F.struct("date", "open", "high", "low", "close", "volume")
    one_text = events_tape(spark, sf_dir).groupBy("symbol").agg(F.to_json(F.sort_array(F.collect_list(bar))).alias("bars"))
    values = F.from_json(F.get_json_object(run("bars"), "$.plots[0].values"), "array<double>")
    return rounded(one_text.select("symbol", F.lit(lang_version()).alias("version"), F.posexplode(values).alias("bar_index", "value")).withColumn("bar_index", F.col("bar_index").cast("long")))


def restyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plot's colour and width literals replaced at the spans that its result record gives."""
    source = 'plot(close, "#123456", 3)\n'
    p = json.loads(run_script_json(source, '[{"date": 0, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}]'))["plots"][0]
    return spark.createDataFrame([(source.strip(), restyled(source, [(p["colorSpan"], '"#abcdef"'), (p["widthSpan"], "12")]).strip())], "before string, after string")


QUERIES |= {"result_record": result_record, "json_run": json_run, "tool_restyle": restyle}
ORACLES["result_record"] = Sql().out(mean("close", 5)).replace("SELECT symbol, bar_index, date, ", "SELECT symbol, bar_index, 'Mean' AS title, 'Five' AS plot, '#112233' AS color, 3.0 AS width, true AS ok, ").replace("AS p0", "AS value")
ORACLES["json_run"] = Sql().out(full(f"max(high) {over(4)}", "high", 4)).replace("SELECT symbol, bar_index, date, ", "SELECT symbol, bar_index, '2.4.0' AS version, ").replace("AS p0", "AS value")
ORACLES["tool_restyle"] = "SELECT 'plot(close, \"#123456\", 3)' AS before, 'plot(close, \"#abcdef\", 12)' AS after"

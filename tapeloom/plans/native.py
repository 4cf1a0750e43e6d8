"""The native tier: a script becomes staged window columns that Catalyst plans; no Python runs on the executors.

A script is native if it can be made straight-line code over series: assignments, outputs, user functions (inlined),
constant periods (after inputs), `if` and `switch` without state inside (they become CASE expressions) and `for` with
constant bounds (unrolled). `var`, other loops, arrays, orders and anything else raise NotNative: the fold tier runs them. na is NULL. All windows are partitioned by symbol, so a plan has one exchange, whatever it computes.

Recurrences (the EMA family, Wilder averages) are windows too. The finite values of a series are numbered and cut into
blocks; inside a block the average is a prefix sum scaled by the block's start, and what enters a block from earlier
ones is the last value of the few blocks that still weigh at double precision. The scale of a block stays within e^10,
so the result keeps about twelve digits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import calendar, columns as fx
from tapeloom.functions.builtins import MAX_PERIOD, STATEFUL, Tape
from tapeloom.functions.text import round_half_up
from tapeloom.operators.outputs import SITES, Outputs
from tapeloom.plans.fold import BUILT_IN, NOW, frame_key, statements
from tapeloom.plans.syntax import Node, Program, ScriptError, expressions, parse, walk

DECAY_PER_BLOCK, LOOK_BACK, MAX_UNROLLED = 10.0, 4, 64
OHLC = ("open", "high", "low", "close")


class NotNative(Exception):
    """The script needs the fold tier."""


@dataclass
class Val:
    """A value of the script at compile time: a number or string column, a constant, or a plot reference."""

    col: Column | None = None
    const: object = None
    string: bool = False
    ref: object = None
    fixed: bool = False  # const is the value, on every bar

    @property
    def number(self) -> bool:
        return self.ref is None and not self.string


def constant(v) -> Val:
    if isinstance(v, str):
        return Val(F.lit(v), v, True, fixed=True)
    return Val(F.lit(None).cast("double") if v != v else F.lit(float(v)), float(v), fixed=True)


@dataclass
class Frame:
    """A tape being built: its DataFrame with staged columns. Key columns stay first."""

    df: DataFrame
    prefix: str
    parts: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("bar_index",)
    k: int = 0
    seen: dict[str, str] = field(default_factory=dict)
    recurrences: int = 0  # how many are staged; each costs two sorts

    def stage(self, c: Column) -> Column:
        """A column computed once; equal expressions share one."""
        return F.col(self.named(c))

    def named(self, c: Column) -> str:
        key = c._jc.toString() if hasattr(c, "_jc") else str(c)
        if key not in self.seen:
            self.k += 1
            self.seen[key] = f"{self.prefix}{self.k}"
            self.df = self.df.withColumn(self.seen[key], c)
        return self.seen[key]

    @property
    def w(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def last(self, p: int):
        return self.w.rowsBetween(-(p - 1), 0)

    @property
    def so_far(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)


def finite(c: Column) -> Column:
    return F.abs(c) < math.inf


def full(f: Frame, result: Column, s: Column, p: int) -> Column:
    """The result where the window is full of known values."""
    return F.when(F.count(s).over(f.last(p)) == p, result)


# -- indicators: functions of (frame, staged series columns, settings)


def sma(f: Frame, s: Column, p: int) -> Column:
    s = f.stage(F.when(finite(s), s))
    return full(f, F.avg(s).over(f.last(p)), s, p)


def total(f: Frame, s: Column, p: int) -> Column:
    s = f.stage(F.when(finite(s), s))
    return full(f, F.sum(s).over(f.last(p)), s, p)


SHORT = 64  # windows up to here are read by offsets, which share one pass and hold no lists


def window_sum(f: Frame, s: Column, p: int, term) -> Column:
    """Sum of term(value, place) over the window, oldest first; na where a value is."""
    return reduce(lambda a, b: a + b, [term(F.lag(s, p - 1 - k).over(f.w) if k < p - 1 else s, k) for k in range(p)])


def wma(f: Frame, s: Column, p: int) -> Column:
    """The weighted sum about the window's own last value: it loses no digits on long tapes."""
    s = f.stage(F.when(finite(s), s))
    if p <= SHORT:
        return fx.divide(window_sum(f, s, p, lambda v, k: v * F.lit(k + 1.0)), F.lit(p * (p + 1) / 2))
    values = F.collect_list(s).over(f.last(p))
    out = F.aggregate(F.zip_with(values, F.sequence(F.lit(1), F.lit(p)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return full(f, out / F.lit(p * (p + 1) / 2), s, p)


def stdev(f: Frame, s: Column, p: int) -> Column:
    """Population deviation about a value of the tape itself, so that squares stay small."""
    s = f.stage(F.when(finite(s), s))
    raw, mean = F.avg(s * s).over(f.last(p)), F.avg(s).over(f.last(p))
    spread = F.stddev_pop(s).over(f.last(p))
    raw, mean, spread = f.stage(raw), f.stage(mean), f.stage(spread)
    flat = raw - mean * mean <= raw * F.lit(1e-12)
    return full(f, F.when(flat, 0.0).otherwise(spread), s, p)


def extreme(f: Frame, s: Column, p: int, sign: int) -> Column:
    return full(f, (F.max if sign > 0 else F.min)(s).over(f.last(p)), s, p)


def bars_back(f: Frame, s: Column, p: int, sign: int) -> Column:
    at = F.max_by("bar_index", F.struct(s * sign, F.col("bar_index"))).over(f.last(p))
    return full(f, (F.col("bar_index") - at).cast("double"), s, p)


def lagged(f: Frame, s: Column, p: int) -> Column:
    return F.lag(s, p).over(f.w)


def change(f: Frame, s: Column, p: int = 1) -> Column:
    return fx.subtract(s, lagged(f, s, p))


def roc(f: Frame, s: Column, p: int) -> Column:
    base = f.stage(lagged(f, s, p))
    return F.when(base != 0, fx.divide(F.lit(100.0) * (s - base), base))


def linreg(f: Frame, s: Column, p: int) -> Column:
    s = f.stage(F.when(finite(s), s))
    if p == 1:
        return s
    x = F.col("bar_index").cast("double")
    slope, level = F.regr_slope(s, x).over(f.last(p)), F.regr_intercept(s, x).over(f.last(p))
    return full(f, level + slope * x, s, p)


def streak(f: Frame, s: Column, p: int, sign: int) -> Column:
    before = F.lag(s, 1).over(f.w)
    step = f.stage(fx.flag(s > before if sign > 0 else s < before))
    return fx.flag((F.min(step).over(f.last(p)) == 1) & (F.col("bar_index") >= p))


def crossing(f: Frame, a: Column, b: Column, sign: int) -> Column:
    pa, pb = F.lag(a, 1).over(f.w), F.lag(b, 1).over(f.w)
    return fx.flag((a > b) & (pa <= pb) if sign > 0 else (a < b) & (pa >= pb))


def cross(f: Frame, a: Column, b: Column) -> Column:
    return F.greatest(crossing(f, a, b, 1), crossing(f, a, b, -1))


def correlation(f: Frame, a: Column, b: Column, p: int) -> Column:
    both = f.stage(a.isNotNull() & b.isNotNull())
    a, b = f.stage(F.when(both & finite(a) & finite(b), a)), f.stage(F.when(both & finite(a) & finite(b), b))
    varied = (F.max(a).over(f.last(p)) > F.min(a).over(f.last(p))) & (F.max(b).over(f.last(p)) > F.min(b).over(f.last(p)))
    joint, sides = F.covar_pop(a, b).over(f.last(p)), F.stddev_pop(a).over(f.last(p)) * F.stddev_pop(b).over(f.last(p))
    return full(f, F.when(varied, fx.clean(F.try_divide(joint, sides))), a, p)


def percentile(f: Frame, s: Column, p: int, q: float) -> Column:
    return full(f, F.percentile(s, F.lit(min(100.0, max(0.0, q)) / 100)).over(f.last(p)), s, p)


def alma(f: Frame, s: Column, p: int, offset: float, sigma: float) -> Column:
    centre, width = offset * (p - 1), p / (sigma if sigma > 0 else 6.0)
    weights = [math.exp(-((k - centre) ** 2) / (2 * width * width)) for k in range(p)]
    if p <= SHORT:
        return full(f, window_sum(f, s, p, lambda v, k: v * F.lit(weights[k])) / F.lit(sum(weights)), s, p)
    values = F.collect_list(s).over(f.last(p))
    dot = F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return full(f, dot / F.lit(sum(weights)), s, p)


def recurrence(f: Frame, s: Column, alpha: float, skip: int = 0, seed: Column | None = None) -> Column:
    """y = alpha * s + (1 - alpha) * y over the finite values of s, seeded with the first of them.

    skip, seed: the value numbered `skip` gets y = seed instead, and those before it get na.
    """
    f.recurrences += 1
    known = f.stage(finite(s) & s.isNotNull())
    n = f.stage(F.when(F.coalesce(known, F.lit(False)), F.sum(F.coalesce(known, F.lit(False)).cast("int")).over(f.so_far) - 1 - skip))
    if alpha >= 1:
        return F.when(n >= 0, s if seed is None else F.when(n == 0, seed).otherwise(s))
    size = max(1, int(DECAY_PER_BLOCK / -math.log1p(-alpha)))
    block = f.stage(F.when(n >= 0, F.floor(n / size)))
    place = n - block * size
    rate = math.log1p(-alpha)
    first = s if seed is None else seed
    enters = F.when(n == 0, first).otherwise(s * F.lit(alpha))
    scaled = f.stage(F.when(n >= 0, enters * F.exp(-rate * place.cast("double"))))
    inside = Window.partitionBy(*f.parts, block).orderBy(*f.order).rowsBetween(Window.unboundedPreceding, 0)
    own = f.stage(F.when(n >= 0, F.sum(scaled).over(inside) * F.exp(rate * place.cast("double"))))
    carried = None
    for back in range(1, LOOK_BACK + 1):  # the last value of each block before
        of = Window.partitionBy(*f.parts).orderBy(block).rangeBetween(-back, -back)
        end = F.coalesce(F.max_by(own, n).over(of), F.lit(0.0)) * F.exp(rate * (place + 1 + size * (back - 1)).cast("double"))
        carried = end if carried is None else carried + end
    return F.when(n >= 0, own + carried)


def ema(f: Frame, s: Column, p: int) -> Column:
    return recurrence(f, s, 2 / (p + 1))


def wilders(f: Frame, s: Column, p: int) -> Column:
    return recurrence(f, s, 1 / p)


def dema(f: Frame, s: Column, p: int) -> Column:
    a = f.stage(ema(f, s, p))
    b = f.stage(ema(f, a, p))
    return 2 * a - b


def tema(f: Frame, s: Column, p: int) -> Column:
    a = f.stage(ema(f, s, p))
    b = f.stage(ema(f, a, p))
    return 3 * a - 3 * b + f.stage(ema(f, b, p))


def tma(f: Frame, s: Column, p: int) -> Column:
    return sma(f, f.stage(sma(f, s, (p + 2) // 2)), p // 2 + 1)


def hull(f: Frame, s: Column, p: int) -> Column:
    inner = f.stage(fx.subtract(2 * wma(f, s, max(1, p // 2)), wma(f, s, p)))
    return wma(f, inner, max(1, int(round_half_up(math.sqrt(p)))))


def rsi(f: Frame, s: Column, p: int) -> Column:
    s = f.stage(F.when(finite(s), s))
    before = F.last(s, ignorenulls=True).over(f.w.rowsBetween(Window.unboundedPreceding, -1))
    step = f.stage(s - before)
    n = f.stage(F.when(step.isNotNull(), F.count(step).over(f.so_far)))

    def average(x: Column) -> Column:
        x = f.stage(F.when(step.isNotNull(), x))
        seed = f.stage(F.sum(F.when(n <= p, x)).over(f.so_far) / p)
        return f.stage(recurrence(f, x, 1 / p, p - 1, seed))

    up, down = average(F.greatest(step, F.lit(0.0))), average(F.greatest(-step, F.lit(0.0)))
    level = F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + fx.divide(up, down)))
    return F.when(n >= p, level)


def true_range(f: Frame) -> Column:
    h, l, pc = F.col("high"), F.col("low"), F.lag("close", 1).over(f.w)
    parts = [h - l, F.abs(h - pc), F.abs(l - pc)]
    return F.when(F.col("bar_index") == 0, h - l).otherwise(fx.all_or_na(F.greatest(*parts), *parts))


def atr(f: Frame, p: int) -> Column:
    return wilders(f, f.stage(true_range(f)), p)


def range_share(f: Frame, p: int, williams: bool) -> Column:
    h, l = f.stage(extreme(f, F.col("high"), p, 1)), f.stage(extreme(f, F.col("low"), p, -1))
    up = -100 * (h - F.col("close")) if williams else 100 * (F.col("close") - l)
    return F.when(h - l > 0, fx.divide(up, h - l))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def mfi(f: Frame, p: int) -> Column:
    tp = f.stage(typical())
    before, flow = F.lag(tp, 1).over(f.w), tp * F.col("volume")
    up = f.stage(total(f, f.stage(F.when(tp > before, flow).otherwise(0.0)), p))
    down = f.stage(total(f, f.stage(F.when(tp < before, flow).otherwise(0.0)), p))
    level = F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + fx.divide(up, down)))
    return F.when(up.isNotNull() & down.isNotNull(), level)


def obv(f: Frame) -> Column:
    c, before = F.col("close"), F.lag("close", 1).over(f.w)
    step = f.stage(F.when(c > before, F.col("volume")).when(c < before, -F.col("volume")).otherwise(0.0))
    return F.sum(step).over(f.so_far)


def vwap(f: Frame, price: Column, anchor: str, zone: str) -> Column:
    key = f.stage(fx.anchor_key(anchor, F.col("date").cast("double"), zone))
    turns = f.stage(F.when(key == F.lag(key, 1).over(f.w), 0).otherwise(1))
    run = f.stage(F.sum(turns).over(f.so_far))
    v = f.stage(F.when(price.isNotNull(), F.col("volume")).otherwise(0.0))
    money = f.stage(F.coalesce(price * F.col("volume"), F.lit(0.0)))
    w = Window.partitionBy(*f.parts, run).orderBy(*f.order).rowsBetween(Window.unboundedPreceding, 0)
    volume = F.sum(v).over(w)
    return F.when(volume > 0, F.try_divide(F.sum(money).over(w), volume))


def pivot(f: Frame, c: str, left: int, right: int, sign: int) -> Column:
    x, size = F.col(c), left + 1 + right
    centre = f.stage(F.lag(x, right).over(f.w))
    best = (F.max if sign > 0 else F.min)(x)
    older, newer = best.over(f.w.rowsBetween(-(size - 1), -(right + 1))), best.over(f.w.rowsBetween(-(right - 1), 0))
    strict = (centre > older) & (centre > newer) if sign > 0 else (centre < older) & (centre < newer)
    return full(f, F.when(strict, centre), x, size)


def directional(f: Frame, p: int, what: str) -> Column:
    h, l = F.col("high"), F.col("low")
    ph, pl = F.lag("high", 1).over(f.w), F.lag("low", 1).over(f.w)
    up, down = f.stage(h - ph), f.stage(pl - l)
    later = F.col("bar_index") > 0
    tr = f.stage(wilders(f, f.stage(F.when(later, true_range(f))), p))
    a = f.stage(wilders(f, f.stage(F.when(later, F.when((up > down) & (up > 0), up).otherwise(0.0))), p))
    b = f.stage(wilders(f, f.stage(F.when(later, F.when((down > up) & (down > 0), down).otherwise(0.0))), p))
    plus, minus = f.stage(F.when(tr > 0, 100 * fx.divide(a, tr))), f.stage(F.when(tr > 0, 100 * fx.divide(b, tr)))
    if what != "adx":
        return plus if what == "diplus" else minus
    both = plus + minus
    dx = f.stage(F.when(both > 0, 100 * fx.divide(F.abs(plus - minus), both)).otherwise(F.when(both.isNotNull(), 0.0)))
    return F.when(tr > 0, wilders(f, dx, p))


def aroon(f: Frame, p: int, sign: int) -> Column:
    back = bars_back(f, F.col("high" if sign > 0 else "low"), p + 1, sign)
    return 100 * (p - back) / p


def cci(f: Frame, p: int) -> Column:
    tp = f.stage(typical())
    mean = f.stage(F.avg(tp).over(f.last(p)))
    if p <= SHORT:
        apart = f.stage(window_sum(f, tp, p, lambda v, k: F.abs(v - mean)) / p)
    else:
        apart = f.stage(F.aggregate(F.collect_list(tp).over(f.last(p)), F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / p)
    return full(f, F.when(apart > 0, fx.divide(tp - mean, 0.015 * apart)), tp, p)


def cum(f: Frame, s: Column) -> Column:
    return F.sum(F.coalesce(s, F.lit(0.0))).over(f.so_far)


def barssince(f: Frame, test: Column) -> Column:
    at = F.last(F.when(test, F.col("bar_index")), ignorenulls=True).over(f.so_far)
    return (F.col("bar_index") - at).cast("double")


def valuewhen(f: Frame, test: Column, s: Column) -> Column:
    return F.last(F.when(test, F.struct(s.alias("v"))), ignorenulls=True).over(f.so_far).getField("v")


#: fn(series, period)
SERIES = {
    "sma": sma, "sum": total, "wma": wma, "stdev": stdev, "ema": ema, "wilders": wilders, "dema": dema, "tema": tema, "tma": tma, "hull": hull,
    "rsi": rsi, "roc": roc, "linreg": linreg, "offset": lagged,
    "highest": lambda f, s, p: extreme(f, s, p, 1), "lowest": lambda f, s, p: extreme(f, s, p, -1),
    "highestbars": lambda f, s, p: bars_back(f, s, p, 1), "lowestbars": lambda f, s, p: bars_back(f, s, p, -1),
    "rising": lambda f, s, p: streak(f, s, p, 1), "falling": lambda f, s, p: streak(f, s, p, -1), "median": lambda f, s, p: percentile(f, s, p, 50.0),
}
#: fn(period), fed by bars
BARS = {
    "atr": atr, "stoch": lambda f, p: range_share(f, p, False), "willr": lambda f, p: range_share(f, p, True), "mfi": mfi, "cci": cci,
    "adx": lambda f, p: directional(f, p, "adx"), "diplus": lambda f, p: directional(f, p, "diplus"), "diminus": lambda f, p: directional(f, p, "diminus"),
    "aroonup": lambda f, p: aroon(f, p, 1), "aroondown": lambda f, p: aroon(f, p, -1),
}


class Compiler:
    """Walks a program once and stages its columns."""

    def __init__(self, program: Program, bars: DataFrame, options: dict):
        self.p, self.options = program, options
        self.zone_name = options.get("timezone") or calendar.DEFAULT_ZONE
        self.zone = calendar.zone(options.get("timezone"))
        if self.zone_name == "local":
            raise NotNative("the host's zone")
        self.out = Outputs(Tape(), self.zone, options.get("inputs"))
        w = Window.partitionBy("symbol").orderBy("date", "seq")
        df = bars.withColumn("bar_index", F.row_number().over(w).cast("long") - 1)
        self.frame = self.main = Frame(df, "t")
        self.bare = Frame(df, "b")  # what higher timeframes are made of, whatever was joined to the bars meanwhile
        self.higher: dict[int, Val] = {}
        self.names: list[dict[str, Val]] = [{}]
        self.columns: dict[str, Column] = {}
        self.counters: list[str] = []
        self.inside = 0  # blocks around the statement at hand; no state may advance in them
        self.turns = 0
        self.writes = Counter(s.name for s in statements(program) if s.kind in ("assign", "update"))
        self.pools: list[tuple[str, dict]] = []

    # -- names

    def source(self, name: str) -> Val:
        c = F.col
        plain = {
            **{p: c(p) for p in (*OHLC, "volume")}, "time": c("date").cast("double"), "bar_index": c("bar_index").cast("double"),
            "hl2": (c("high") + c("low")) / 2, "hlc3": typical(), "ohlc4": (c("open") + c("high") + c("low") + c("close")) / 4,
        }
        if name in plain:
            return Val(plain[name])
        if self.frame is not self.main:
            raise NotNative(f"{name} inside security")
        if name == "pi":
            return constant(math.pi)
        every = Window.partitionBy("symbol")
        if name == "barstate.isfirst":
            return Val(fx.flag(c("bar_index") == 0))
        if name == "barstate.islast":
            return Val(fx.flag(F.lead("bar_index", 1).over(self.frame.w).isNull()))
        if name in NOW:
            last = self.frame.stage(F.max_by("date", "bar_index").over(every).cast("double"))
            if name == "current_datetime":
                return Val(last)
            session = self.options.get("session") or {}
            h, m = {"date_today": (0, 0), "market_open": calendar.clock(session.get("open"), "09:30"), "market_close": calendar.clock(session.get("close"), "16:00")}[name]
            day = F.unix_millis(F.date_trunc("day", fx.local(last, self.zone_name))).cast("double")
            return Val(fx.from_wall(day + (h * 60 + m) * 60_000.0, self.zone_name))
        raise NotNative(name)

    def lookup(self, name: str, line: int) -> Val:
        for scope in reversed(self.names):
            if name in scope:
                return scope[name]
        if name in BUILT_IN:
            return self.source(name)
        raise ScriptError(f"unknown variable {name}", line)

    # -- statements

    def run(self) -> None:
        for s in self.p.body:
            self.statement(s)
        if not self.out.drew():
            raise ScriptError("the script draws nothing")

    def kept(self, e: Node) -> Val:
        v = self.value(e)
        return v if v.fixed or v.col is None else replace(v, col=self.frame.stage(v.col))

    def statement(self, s: Node) -> None:
        if s.kind == "assign":
            if s.name in BUILT_IN:
                raise ScriptError(f"{s.name} is built in", s.line)
            if s.name in self.counters:
                raise NotNative("a loop variable that is assigned")
            self.names[-1][s.name] = self.kept(s.value)
        elif s.kind == "update":
            v = self.kept(s.value)
            scope = next((x for x in reversed(self.names) if s.name in x), None)
            if scope is None or s.name in self.counters:
                raise ScriptError(f"{s.name} is not declared", s.line) if scope is None else NotNative("a loop variable that is assigned")
            scope[s.name] = v
        elif s.kind == "expr":
            self.value(s.value)
        elif s.kind == "if":
            self.choose([(None if k == 0 else test, body) for k, (test, body) in enumerate(s.arms)], s.other or [], self.value(s.arms[0][0]))
        elif s.kind == "switch":
            subject = self.kept(s.subject)
            arms = [(t, [x]) for t, x in s.arms if t is not None]
            self.choose(arms, next(([x] for t, x in s.arms if t is None), []), None, subject)
        elif s.kind == "for":
            self.unroll(s)
        else:
            raise NotNative(s.kind)

    def choose(self, arms: list, other: list[Node], first: Val | None, subject: Val | None = None) -> None:
        """Runs every arm on a copy of the names and joins what they changed by CASE. first: the test that always runs."""
        self.inside += 1
        before = [dict(x) for x in self.names]
        tests, ends = [], []
        for test, body in arms:
            self.names = [dict(x) for x in before]
            v = first if test is None else self.value(test)
            hit = self.test(v) if subject is None else fx.equal(subject.col, v.col) if subject.string == v.string else F.lit(False)
            tests.append(self.frame.stage(hit))
            ends.append(self.block(body))
        self.names = [dict(x) for x in before]
        ends.append(self.block(other))
        self.inside -= 1
        self.names = before
        for level, scope in enumerate(before):
            for name in scope:
                now = [e[level][name] for e in ends]
                if all(v is scope[name] for v in now):
                    continue
                if any(v.ref is not None for v in now) or len({v.string for v in now}) > 1:
                    raise NotNative("a value is of different kinds on different bars")
                col = now[-1].col
                for t, v in reversed(list(zip(tests, now))):
                    col = F.when(t, v.col).otherwise(col)
                scope[name] = Val(self.frame.stage(col), string=now[0].string)

    def block(self, body: list[Node]) -> list[dict[str, Val]]:
        """The outer names after a block; its own names end with it."""
        self.names.append({})
        for s in body:
            self.statement(s)
        return self.names[:-1]

    def unroll(self, s: Node) -> None:
        bounds = [self.value(x) if x is not None else constant(1.0) for x in (s.start, s.stop, s.step)]
        if not all(v.fixed for v in bounds):
            raise NotNative("loop bounds that vary")
        start, stop, step = (v.const for v in bounds)
        if not all(isinstance(x, float) for x in (start, stop, step)):
            raise ScriptError("loop bounds must be numbers", s.line)
        if step == 0:
            raise ScriptError("a loop step must not be zero", s.line)
        self.inside += 1
        self.counters.append(s.name)
        self.names.append({})
        while start <= stop if step > 0 else start >= stop:
            self.turns += 1
            if self.turns > MAX_UNROLLED:
                raise NotNative("a loop of many turns")
            self.names[-1][s.name] = constant(start)
            for x in s.body:
                self.statement(x)
            start += step
        self.names.pop()
        self.counters.pop()
        self.inside -= 1

    # -- expressions

    def value(self, e: Node) -> Val:
        return getattr(self, f"on_{e.kind}")(e)

    def number(self, e: Node) -> Column:
        v = self.value(e)
        return v.col if v.number else fx.na()

    def staged(self, e: Node) -> Column:
        v = self.value(e)
        if not v.number:
            return fx.na()
        return v.col if v.fixed else self.frame.stage(v.col)

    def test(self, v: Val) -> Column:
        return F.lit(True) if v.ref is not None else fx.truthy(v.col, v.string)

    def on_num(self, e):
        return constant(e.value)

    def on_str(self, e):
        return constant(e.value)

    def on_name(self, e):
        return self.lookup(e.name, e.line)

    def on_unary(self, e):
        v = self.value(e.arg)
        if e.op == "not":
            return Val(fx.flag(~self.test(v)))
        if v.fixed and v.number:
            return constant(-v.const)
        return Val(-v.col if v.number else fx.na())

    def on_binary(self, e):
        a, b, op = self.value(e.left), self.value(e.right), e.op
        if op in ("and", "or"):
            x, y = self.test(a), self.test(b)
            return Val(fx.flag(x & y if op == "and" else x | y))
        if op in ("==", "!="):
            if a.ref is not None or b.ref is not None:
                raise NotNative("plot references compared")
            same = fx.equal(a.col, b.col) if a.string == b.string else F.lit(False)
            return Val(fx.flag(same if op == "==" else ~same))
        if op == "+" and (a.string or b.string):
            if a.fixed and b.fixed and a.string and b.string:
                return constant(a.const + b.const)
            return Val(F.concat(self.text(a), self.text(b)), string=True)
        x, y = (v.col if v.number else fx.na() for v in (a, b))
        if op in ("<", "<=", ">", ">="):
            return Val(fx.flag({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]))
        if a.fixed and b.fixed and a.number and b.number and op in "+-*":
            return constant(a.const + b.const if op == "+" else a.const - b.const if op == "-" else a.const * b.const)
        return Val({"+": fx.add, "-": fx.subtract, "*": fx.multiply, "/": fx.divide, "%": fx.remainder}[op](x, y))

    def text(self, v: Val) -> Column:
        if v.ref is not None:
            raise NotNative("a plot reference as text")
        return v.col if v.string and v.fixed else F.coalesce(v.col, F.lit("NaN")) if v.string else fx.number_text(v.col)

    def on_pick(self, e):
        test, yes, no = (self.value(x) for x in (e.test, e.yes, e.no))
        if yes.ref is not None or no.ref is not None:
            raise NotNative("plot references chosen")
        if test.fixed:
            return yes if self.const_true(test) else no
        na = lambda v: v.fixed and v.number and v.const != v.const
        if yes.string != no.string:
            if not (na(yes) or na(no)):
                raise NotNative("a value is a number on some bars and a string on others")
            c = F.when(self.test(test), F.lit(None).cast("string") if na(yes) else yes.col).otherwise(F.lit(None).cast("string") if na(no) else no.col)
            return Val(c, string=True)
        return Val(F.when(self.test(test), yes.col).otherwise(no.col), string=yes.string)

    @staticmethod
    def const_true(v: Val) -> bool:
        return v.const != "" if v.string else v.const == v.const and v.const != 0

    def on_history(self, e):
        k = self.value(e.back)
        if not k.fixed or k.string:
            raise NotNative("a history offset that varies")
        of = self.value(e.of_)
        if of.ref is not None:
            raise NotNative("history of a plot reference")
        n = int(round_half_up(k.const)) if k.const == k.const and abs(k.const) < 2**31 else -1
        none = F.lit(None).cast("string" if of.string else "double")
        if n < 0:
            return Val(none, string=of.string)
        if self.frame is not self.main and e.of_.kind == "name" and any(e.of_.name in s for s in self.names):
            raise NotNative("history of a script variable inside security")
        named = e.of_.kind == "name"
        if named and self.writes[e.of_.name] > 1 and any(e.of_.name in x for x in self.names):
            raise NotNative("history of a variable that is assigned twice")  # history is of its last value on a bar
        if self.inside and not (named and (e.of_.name in BUILT_IN or e.of_.name in self.names[0])):
            raise NotNative("state inside a block")
        scalar = of.fixed or e.of_.kind == "name" and e.of_.name in BUILT_IN and e.of_.name.startswith(("barstate", "current", "date_", "market_"))
        if n == 0:
            return of
        if scalar and e.of_.kind == "name" and e.of_.name in BUILT_IN:
            return Val(F.when(F.col("bar_index") >= n, of.col), string=of.string)
        return Val(F.lag(of.col if of.fixed else self.frame.stage(of.col), n).over(self.frame.w), string=of.string)

    def period(self, name: str, e: Node | None) -> int:
        v = self.value(e) if e is not None else constant("")
        if v.string:
            raise ScriptError(f"{name}: expected a number", e.line if e is not None else None)
        if not v.fixed:
            raise NotNative("a period that varies")
        if v.const != v.const or math.isinf(v.const):
            raise ScriptError(f"{name}: expected a number", e.line)  # type: ignore[union-attr]
        p = max(1, int(round_half_up(v.const)))
        if p > MAX_PERIOD:
            raise ScriptError(f"{name}: the period is above {MAX_PERIOD}")
        return p

    def setting(self, name: str, args: list[Node], k: int, default: float) -> float:
        if len(args) <= k:
            return default
        v = self.value(args[k])
        if not v.fixed or v.string:
            raise NotNative(f"{name}: a parameter that varies")
        return v.const

    def on_call(self, e):
        name, args, f = e.name, e.args, self.frame
        if self.inside and (name in STATEFUL or name == "security"):
            raise NotNative("state inside a block")
        get = lambda k: args[k] if len(args) > k else None
        if name in self.p.functions:
            return self.inline(self.p.functions[name], [self.value(a) for a in args])
        if name in SITES:
            return self.output(e)
        if name == "security":
            return self.security(e)
        if e.kwargs:
            raise NotNative("keyword arguments of a function")
        series = lambda k: self.staged(args[k]) if len(args) > k else fx.na()
        if name in SERIES:
            s = series(0)
            return Val(SERIES[name](f, s, self.period(name, get(1))))
        if name in ("change", "mom"):
            return Val(change(f, series(0), self.period(name, get(1)) if len(args) > 1 else 1))
        if name in BARS:
            return Val(BARS[name](f, self.period(name, get(0))))
        if name == "percentile":
            return Val(percentile(f, series(0), self.period(name, get(1)), self.setting(name, args, 2, 50.0)))
        if name == "alma":
            return Val(alma(f, series(0), self.period(name, get(1)), self.setting(name, args, 2, 0.85), self.setting(name, args, 3, 6.0)))
        if name == "correlation":
            return Val(correlation(f, series(0), series(1), self.period(name, get(2))))
        if name in ("crossover", "crossunder"):
            return Val(crossing(f, series(0), series(1), 1 if name == "crossover" else -1))
        if name == "cross":
            return Val(cross(f, series(0), series(1)))
        if name in ("pivothigh", "pivotlow"):
            return Val(pivot(f, name[5:], self.period(name, get(0)), self.period(name, get(1)), 1 if name == "pivothigh" else -1))
        if name == "tr":
            return Val(true_range(f))
        if name == "obv":
            return Val(obv(f))
        if name == "cum":
            return Val(cum(f, series(0)))
        if name in ("barssince", "valuewhen"):
            test = f.stage(self.test(self.value(args[0]))) if args else F.lit(False)
            if name == "barssince":
                return Val(barssince(f, test))
            v = self.value(args[1]) if len(args) > 1 else constant(math.nan)
            return Val(valuewhen(f, test, v.col), string=v.string)
        if name == "vwap":
            return self.vwap([self.value(a) for a in args])
        return self.scalar(name, args)

    def vwap(self, args: list[Val]) -> Val:
        anchor = next((a for a in args[:2] if a.string), None)
        if anchor is not None and not anchor.fixed:
            raise NotNative("an anchor that varies")
        price = typical() if not args or args[0].string else args[0].col
        return Val(vwap(self.frame, self.frame.stage(price), anchor.const if anchor is not None else "session", self.zone_name))

    def scalar(self, name: str, args: list[Node]) -> Val:
        v = [self.value(a) for a in args]
        c = [x.col if x.number else fx.na() for x in v]
        at = lambda k: c[k] if len(c) > k else fx.na()
        if name in fx.UNARY:
            return Val(fx.UNARY[name](at(0)))
        if name == "pow":
            return Val(fx.clean(F.pow(at(0), at(1))))
        if name == "atan2":
            return Val(F.atan2(at(0), at(1)))
        if name in ("min", "max", "avg"):
            if not c:
                raise ScriptError(f"{name}: at least one argument")
            total = c[0]
            for x in c[1:]:
                total = total + x
            joined = total / len(c) if name == "avg" else c[0] if len(c) == 1 else (F.least if name == "min" else F.greatest)(*c)
            return Val(fx.all_or_na(joined, *c))
        if name == "nz":
            if v and v[0].string:
                return v[0]
            return Val(F.coalesce(at(0), at(1) if len(c) > 1 else F.lit(0.0)))
        if name == "na":
            return Val(F.lit(0.0) if v and v[0].string else fx.flag(at(0).isNull()))
        if name == "iff":
            yes, no = (v[k] if len(v) > k else constant(math.nan) for k in (1, 2))
            if yes.string != no.string or yes.ref is not None or no.ref is not None:
                raise NotNative("mixed kinds")
            return Val(F.when(self.test(v[0]), yes.col).otherwise(no.col), string=yes.string)
        if name in fx.PARTS:
            return Val(fx.part(name, at(0), self.zone_name))
        if name == "timestamp" and v and all(x.fixed for x in v):
            return constant(calendar.from_text(v[0].const, self.zone) if v[0].string else calendar.from_parts(self.zone, *[x.const if x.number else math.nan for x in v]))
        if name == "tostring" and len(v) == 1:
            return Val(self.text(v[0]), string=True)
        if name.startswith("str.") and name != "str.split":
            return self.string(name, v)
        raise NotNative(name) if name.startswith(("array.", "str.", "tostring", "timestamp", "sar", "supertrend")) else ScriptError(f"unknown function {name}")

    def string(self, name: str, v: list[Val]) -> Val:
        t = [self.text(x) for x in v] + [F.lit("")] * 3
        if name == "str.contains":
            return Val(fx.flag(F.contains(t[0], t[1])))
        if name == "str.replace":
            return Val(F.when(t[1] == "", t[0]).otherwise(F.replace(t[0], t[1], t[2])), string=True)
        if name in ("str.upper", "str.lower"):
            return Val((F.upper if name == "str.upper" else F.lower)(t[0]), string=True)
        if name == "str.length":
            return Val(fx.utf16_length(t[0]))
        if name == "str.format" and v and v[0].fixed:
            parts = re.split(r"\{(\d+)\}", v[0].const if v[0].string else "")
            cols = [F.lit(x) if k % 2 == 0 else t[int(x) + 1] if int(x) + 1 < len(v) else F.lit("") for k, x in enumerate(parts)]
            return Val(F.concat(*cols), string=True)
        raise NotNative(name)

    def inline(self, f, args: list[Val]) -> Val:
        """A pure function's body at its call: parameters and locals in a scope of its own over the script's."""
        saved, self.names = self.names, [self.names[0], dict(zip(f.params, args))]
        counters, self.counters = self.counters, []
        try:
            for s in f.body:
                self.statement(s)
            return self.value(f.result)
        finally:
            saved[0] = self.names[0]  # what the function wrote to the script's variables
            self.names, self.counters = saved, counters

    # -- security: bars of a higher timeframe, joined back to the bars of the bucket after

    def security(self, e: Node) -> Val:
        if len(e.args) < 2:
            raise ScriptError("security takes a timeframe and an expression", e.line)
        frame = self.value(e.args[0])
        if not frame.fixed:
            raise NotNative("a timeframe that varies")
        frame_key(frame.const, self.zone)  # raises if malformed
        if self._reads_script(e.args[1]):
            raise NotNative("security reads script variables")
        if e.uid in self.higher:
            return self.higher[e.uid]
        calls = [e, *[x for x in self._plain_calls(frame.const) if x.uid != e.uid]]
        f = self.frame
        name = self._run(f, frame.const)
        i, run = F.col("bar_index"), F.col(self._run(self.bare, frame.const))
        agg = self.bare.df.select("symbol", run.alias("_run"), "bar_index", "date", *OHLC, "volume").groupBy("symbol", "_run").agg(
            F.min_by("date", i).alias("date"), F.min_by("open", i).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", i).alias("close"), F.sum("volume").alias("volume"),
        ).withColumn("bar_index", F.col("_run") - 1)
        self.frame = q = Frame(agg, f"q{f.k}_")
        try:
            values = [self.value(x.args[1]) for x in calls]
            held = [q.stage(v.col) for v in values]
        finally:
            self.frame = f
        names = [f"{f.prefix}{f.k + 1 + k}" for k in range(len(calls))]
        f.k += len(calls)
        done = q.df.select(F.col("symbol").alias("_s"), (F.col("_run") + 1).alias("_r"), *[h.alias(n) for h, n in zip(held, names)])
        f.df = f.df.join(done, (F.col("symbol") == F.col("_s")) & (F.col(name) == F.col("_r")), "left").drop("_s", "_r")
        out = [Val(F.col(n), string=v.string) for n, v in zip(names, values)]
        self.higher.update({x.uid: v for x, v in zip(calls[1:], out[1:])})
        return out[0]

    def _run(self, f: Frame, frame: str) -> str:
        """The number of a bar's bucket under a timeframe, from 1, as a column of a frame."""
        n, unit, t = int(frame[:-1]), frame[-1], F.col("date").cast("double")
        key = F.floor(t / (n * (60_000.0 if unit == "m" else 3_600_000.0))) if unit in "mh" else fx.anchor_key("session" if unit == "d" else "week", t, self.zone_name)
        key = f.stage(key)
        turns = f.stage(F.when(key == F.lag(key, 1).over(f.w), 0).otherwise(1))
        return f.named(F.sum(turns).over(f.so_far).cast("long"))

    def _plain_calls(self, frame: str) -> list[Node]:
        """The script's other calls of security under a timeframe that read nothing the script names: they share one aggregate and one join."""
        made = {s.name for s in statements(self.p) if s.kind in ("assign", "update", "var")}
        found = [n for s in self.p.body for x, _ in expressions(s) for n in walk(x) if n.kind == "call" and n.name == "security" and len(n.args) > 1]
        named = lambda e: any(n.kind == "name" and n.name in made or n.kind == "call" and n.name in self.p.functions for n in walk(e))
        return [n for n in found if n.args[0].kind == "str" and n.args[0].value == frame and not named(n.args[1])]

    def _reads_script(self, e: Node) -> bool:
        bodies = [e, *(x for n in walk(e) if n.kind == "call" and n.name in self.p.functions for x in [self.p.functions[n.name].result, *[s.value for s in self.p.functions[n.name].body if "value" in s.of]])]
        return any(n.kind == "name" and n.name in self.names[0] and not self.names[0][n.name].fixed for b in bodies for n in walk(b))

    # -- outputs

    def output(self, e: Node) -> Val:
        if self.frame is not self.main:
            raise ScriptError(f"{e.name} inside security", e.line)
        kw, args = {k: self.value(v) for k, v in e.kwargs.items()}, [self.value(a) for a in e.args]
        if e.name.startswith("strategy."):
            raise NotNative("orders")
        if e.name.startswith("input"):
            if not all(v.fixed for v in [*kw.values(), *args]):
                raise NotNative("an input that isn't constant")
            return constant(SITES[e.name](self.out, e)(-1, {k: v.const for k, v in kw.items()}, [v.const for v in args]))
        series = {"plot": {0}, "plotshape": {0}, "plotbuy": {0, 1}, "plotsell": {0, 1}, "infopanel": {0}, "barcolor": {0}, "bgcolor": {0}, "alertcondition": {0}, "fill": {0, 1}, "line.new": {0, 1, 2, 3}, "label.new": {0, 1, 2}, "box.new": {0, 1, 2, 3}}.get(e.name, set())
        free = {"qty", "price", "when"} | ({"color"} if e.name in ("infopanel", "line.new", "label.new", "box.new") else set())
        if any(not v.fixed for k, v in kw.items() if k not in free) or any(not v.fixed for k, v in enumerate(args) if k not in series):
            raise NotNative(f"a style of {e.name} that isn't constant")
        n = {k: len(getattr(self.out, k)) for k in ("plots", "shapes", "trades", "alerts", "bar_colors", "bg_colors", "fills", "panel")}
        show = lambda v: v.ref if v.ref is not None else v.const if v.fixed else ("?" if v.string else 0.0)
        made = SITES[e.name](self.out, e)(-1, {k: show(v) for k, v in kw.items()}, [show(v) for v in args])
        num = lambda k: args[k].col if len(args) > k and args[k].number else fx.na()
        sig = lambda: F.lit(0.0) if not args else args[0].col if args[0].number else fx.flag(self.test(args[0]))
        gate = lambda c: F.when(self.test(kw["when"]), c) if "when" in kw else c
        put = self.columns
        if e.name in ("plot", "hline"):
            put[f"p{n['plots']}"] = num(0)
            return Val(ref=made)
        if e.name == "plotshape":
            put[f"shape_{n['shapes']}"] = sig()
        elif e.name in ("plotbuy", "plotsell"):
            k = n["trades"]
            q = kw.get("qty") or (args[1] if len(args) > 1 else constant(1.0))
            put[f"trade_{k}_value"], put[f"trade_{k}_qty"] = sig(), q.col if q.number else fx.na()
            if "price" in kw:
                if kw["price"].string and not kw["price"].fixed:
                    raise NotNative("a price source that varies")
                if not kw["price"].string:
                    put[f"trade_{k}_price"] = kw["price"].col
        elif e.name in ("barcolor", "bgcolor"):
            c = gate(args[0].col) if args and args[0].string else F.lit(None).cast("string")
            put[f"bar_color_{n['bar_colors']}" if e.name == "barcolor" else f"bg_color_{n['bg_colors']}"] = c
        elif e.name == "alertcondition":
            k, fired = n["alerts"], self.test(args[0]) if args else F.lit(False)
            put[f"alert_{k}"] = fx.flag(fired)
            if "messages" in self.out.alerts[k]:
                put[f"alert_{k}_message"] = F.when(fired, self.message(self.out.alerts[k]["message"]))
        elif e.name == "fill":
            for side, a in zip("ab", args):
                put[f"fill_{n['fills']}_{side}"] = put[f"p{a.ref.index}"] if a.ref is not None else a.col if a.number else fx.na()
        elif e.name == "infopanel":
            put[f"panel_{n['panel']}"] = args[0].col if args and args[0].ref is None else fx.na()
        elif e.name in ("line.new", "label.new", "box.new"):
            self.drawing(e.name, kw, args)
        return constant(0.0)

    def message(self, template: str) -> Column:
        values = {**{p: F.col(p) for p in (*OHLC, "volume")}, "time": F.col("date").cast("double"), "bar_index": F.col("bar_index").cast("double")}
        parts = re.split(r"\{\{(\w+)\}\}", template)
        return F.concat(*[F.lit(x) if k % 2 == 0 else fx.number_text(values[x]) if x in values else F.lit("{{" + x + "}}") for k, x in enumerate(parts)])

    def drawing(self, name: str, kw: dict[str, Val], args: list[Val]) -> None:
        points = 2 if name == "label.new" else 4
        cols = {f"x{k}": (args[k].col if len(args) > k and args[k].number else fx.na()) for k in range(points)}
        ok = self.test(kw["when"]) if "when" in kw else F.lit(True)
        for c in cols.values():
            ok = ok & F.coalesce(finite(c), F.lit(False))
        text = None
        if name == "label.new":
            text = self.text(args[2]) if len(args) > 2 else F.lit("")
        color = kw["color"].col if "color" in kw and kw["color"].string else F.lit("#8f8f98")
        self.pools.append((name.split(".")[0], {"when": ok, **cols, "text": text, "color": color}))


def compile_native(source: str, bars: DataFrame, options: dict | None = None) -> Compiler:
    """A compiler that has staged the whole script, or NotNative / ScriptError."""
    c = Compiler(parse(source), bars, options or {})
    c.run()
    return c


def native_bars(source: str, bars: DataFrame, options: dict | None = None) -> DataFrame:
    """One row a bar: symbol, bar_index, date, and the script's numeric and colour outputs."""
    c = compile_native(source, bars, options)
    keep = {k: v for k, v in c.columns.items() if not k.startswith("panel_")}
    return c.frame.df.select("symbol", "bar_index", "date", *[v.alias(k) for k, v in keep.items()])

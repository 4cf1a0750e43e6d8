"""Builtin functions of the fold tier: how arguments become calls of indicators.

`STATEFUL[name](env)` makes one call site: a function of (bar, args). `PURE[name]` is a plain function of its arguments.
A bar is what the call site sees: `tape` columns and the index in them.
"""

from __future__ import annotations

import math

from tapeloom.functions import calendar, indicators as ind
from tapeloom.functions.text import Series, fixed_text, number_text, round_half_up, text
from tapeloom.plans.syntax import ScriptError

NAN = math.nan
MAX_PERIOD = MAX_ARRAY = 100_000


def num(v) -> float:
    return v if isinstance(v, float) else NAN


def truthy(v) -> bool:
    if isinstance(v, float):
        return v == v and v != 0
    return v != "" if isinstance(v, str) else v is not None


def period(name: str, v, least: int = 1) -> int:
    if not isinstance(v, float) or v != v or math.isinf(v):
        raise ScriptError(f"{name}: expected a number")
    p = max(least, int(round_half_up(v)))
    if p > MAX_PERIOD:
        raise ScriptError(f"{name}: the period is above {MAX_PERIOD}")
    return p


def setting(name: str, args: list, k: int, default: float) -> float:
    if len(args) <= k:
        return default
    if not isinstance(args[k], float) or args[k] != args[k]:
        raise ScriptError(f"{name}: expected a number")
    return args[k]


def arg(args: list, k: int):
    return args[k] if len(args) > k else NAN


class Tape:
    """Columns of bars as lists of floats."""

    __slots__ = ("date", "open", "high", "low", "close", "volume")

    def __init__(self, date=(), open=(), high=(), low=(), close=(), volume=()):
        self.date, self.open, self.high, self.low, self.close, self.volume = map(list, (date, open, high, low, close, volume))

    def __len__(self):
        return len(self.date)

    def bar(self, i: int):
        return self.high[i], self.low[i], self.close[i], self.volume[i]


class Env:
    """What call sites need of a run: its tape (the aggregate one inside security) and time zone."""

    __slots__ = ("tape", "tz")

    def __init__(self, tape: Tape, tz):
        self.tape, self.tz = tape, tz


def _first(env, i, args):
    return num(arg(args, 0))


def _bar(env, i, args):
    return env.tape.bar(i) if i >= 0 else (NAN, NAN, NAN, 0.0)


def _locked(name: str, settings, start, feed):
    """A call site whose settings must not change after its first call.

    settings(args) gives them, start(*settings) the primed indicator, feed(env, i, args) its input.
    """

    def make(env: Env):
        held, send, raw = None, None, None
        first = 0 if feed is _bar else 1 if feed is _first else None  # where the settings begin

        def call(i: int, args: list):
            nonlocal held, send, raw
            if raw is None or args[first:] != raw:
                now = settings(args)
                if send is None:
                    held, send = now, ind.primed(start(*now))
                elif now != held:
                    raise ScriptError(f"{name}: a length or parameter must not change between bars")
                raw = None if first is None else args[first:]
            return send(feed(env, i, args))

        return call

    make.settings, make.start, make.feed = settings, start, feed
    return make


STATEFUL: dict = {}


def fixed_send(name: str, settings: list):
    """The send function of a series indicator whose settings are literals; None if the name or the settings need the checks of a call."""
    make = STATEFUL.get(name)
    if getattr(make, "feed", None) is not _first:
        return None
    try:
        return ind.primed(make.start(*make.settings([NAN, *settings])))
    except ScriptError:
        return None

for _name, _start in {
    "sma": ind.sma, "ema": ind.ema, "wma": ind.wma, "wilders": ind.wilders, "dema": ind.dema, "tema": ind.tema, "tma": ind.tma,
    "hull": ind.hull, "rsi": ind.rsi, "stdev": ind.stdev, "sum": ind.total, "roc": ind.roc, "linreg": ind.linreg, "offset": ind.lagged,
    "highest": lambda p: ind.extreme(p, 1), "lowest": lambda p: ind.extreme(p, -1),
    "highestbars": lambda p: ind.extreme(p, 1, True), "lowestbars": lambda p: ind.extreme(p, -1, True),
    "rising": lambda p: ind.streak(p, 1), "falling": lambda p: ind.streak(p, -1), "median": lambda p: ind.percentile(p, 50.0),
}.items():
    STATEFUL[_name] = _locked(_name, lambda a, n=_name: (period(n, arg(a, 1)),), _start, _first)
for _name in ("change", "mom"):
    STATEFUL[_name] = _locked(_name, lambda a, n=_name: (period(n, a[1]) if len(a) > 1 else 1,), ind.change, _first)
for _name, _start in {
    "atr": ind.atr, "stoch": lambda p: ind.range_share(p, False), "willr": lambda p: ind.range_share(p, True), "mfi": ind.mfi, "cci": ind.cci,
    "adx": lambda p: ind.directional(p, "adx"), "diplus": lambda p: ind.directional(p, "diplus"), "diminus": lambda p: ind.directional(p, "diminus"),
    "aroonup": lambda p: ind.aroon(p, 1), "aroondown": lambda p: ind.aroon(p, -1),
}.items():
    STATEFUL[_name] = _locked(_name, lambda a, n=_name: (period(n, arg(a, 0)),), _start, _bar)
STATEFUL["tr"] = _locked("tr", lambda a: (), ind.true_range, _bar)
STATEFUL["obv"] = _locked("obv", lambda a: (), ind.obv, _bar)
STATEFUL["percentile"] = _locked("percentile", lambda a: (period("percentile", arg(a, 1)), setting("percentile", a, 2, 50.0)), ind.percentile, _first)
STATEFUL["alma"] = _locked("alma", lambda a: (period("alma", arg(a, 1)), setting("alma", a, 2, 0.85), setting("alma", a, 3, 6.0)), ind.alma, _first)
STATEFUL["correlation"] = _locked("correlation", lambda a: (period("correlation", arg(a, 2)),), ind.correlation, lambda e, i, a: (num(arg(a, 0)), num(arg(a, 1))))
for _name, _sign in (("crossover", 1), ("crossunder", -1)):
    STATEFUL[_name] = _locked(_name, lambda a: (), lambda s=_sign: ind.crossing(s), lambda e, i, a: (num(arg(a, 0)), num(arg(a, 1))))
for _name, _sign, _col in (("pivothigh", 1, "high"), ("pivotlow", -1, "low")):
    STATEFUL[_name] = _locked(_name, lambda a, n=_name: (period(n, arg(a, 0)), period(n, arg(a, 1))), lambda l, r, s=_sign: ind.pivot(l, r, s), lambda e, i, a, c=_col: getattr(e.tape, c)[i] if i >= 0 else NAN)
STATEFUL["sar"] = _locked("sar", lambda a: tuple(setting("sar", a, k, d) for k, d in enumerate((0.02, 0.02, 0.2))), ind.parabolic, _bar)
for _name, _dir in (("supertrend", False), ("supertrend_dir", True)):
    STATEFUL[_name] = _locked(_name, lambda a, n=_name: (period(n, arg(a, 0)), setting(n, a, 1, 3.0)), lambda p, m, d=_dir: ind.supertrend(p, m, d), _bar)


def _cross(env: Env):
    up, down = STATEFUL["crossover"](env), STATEFUL["crossunder"](env)

    def call(i, args):
        a, b = up(i, args), down(i, args)
        return max(a, b)

    return call


def _anchor(args: list) -> str:
    return next((a for a in args[:2] if isinstance(a, str)), "session")


def _vwap_input(env, i, args):
    if i < 0:
        return NAN, NAN, None
    h, l, c, v = env.tape.bar(i)
    price = num(args[0]) if args and not isinstance(args[0], str) else (h + l + c) / 3
    return price, v, calendar.anchor_key(_anchor(args), env.tape.date[i], env.tz)


def _cum(env: Env):
    so_far = 0.0

    def call(i, args):
        nonlocal so_far
        v = num(arg(args, 0))
        so_far += v if v == v else 0.0
        return so_far

    return call


def _valuewhen(env: Env):
    held = NAN

    def call(i, args):
        nonlocal held
        if truthy(arg(args, 0)):
            held = arg(args, 1)
        return held

    return call


def _barssince(env: Env):
    last = None

    def call(i, args):
        nonlocal last
        if truthy(arg(args, 0)):
            last = i
        return NAN if last is None else float(i - last)

    return call


STATEFUL |= {"cross": _cross, "vwap": _locked("vwap", lambda a: (_anchor(a),), lambda _: ind.vwap(), _vwap_input), "cum": _cum, "valuewhen": _valuewhen, "barssince": _barssince}


# -- functions of their arguments alone


def divide(a: float, b: float) -> float:
    if b:
        return a / b
    if b != b or a != a or not a:
        return NAN
    return math.copysign(math.inf, a) * math.copysign(1.0, b)


def remainder(a: float, b: float) -> float:
    return NAN if a != a or b != b or math.isinf(a) or not b else math.fmod(a, b)


def _real(f):
    def call(v=NAN):
        v = num(v)
        try:
            return float(f(v)) if v == v else NAN
        except (ValueError, OverflowError):
            return NAN

    return call


def _exp(v: float) -> float:
    try:
        return math.exp(v)
    except OverflowError:
        return math.inf


def _log(v: float) -> float:
    return math.log(v) if v > 0 else -math.inf if v == 0 else NAN


def _whole(f):
    return lambda v: v if math.isinf(v) else float(f(v))


def power(a=NAN, b=NAN) -> float:
    a, b = num(a), num(b)
    if b != b or abs(a) == 1 and math.isinf(b):
        return NAN
    try:
        return float(math.pow(a, b))
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ValueError:
        return NAN if a else math.inf


def _each(name: str, step, last=lambda v, n: v):
    def call(*args):
        if not args:
            raise ScriptError(f"{name}: at least one argument")
        out = num(args[0])
        for v in args[1:]:
            out = step(out, num(v))
        return last(out, len(args))

    return call


def tostring(v=NAN, precision=None) -> str:
    if isinstance(precision, float) and isinstance(v, float) and v == v and precision == precision:
        return fixed_text(v, int(min(8, max(0, round_half_up(precision)))))
    return text(v)


def split(s, sep):
    return Series([s] if sep == "" else s.split(sep))


def fill_in(fmt: str, *values) -> str:
    out, k = [], 0
    while k < len(fmt):
        end = fmt.find("}", k)
        if fmt[k] == "{" and end > k + 1 and fmt[k + 1 : end].isascii() and fmt[k + 1 : end].isdigit():
            n = int(fmt[k + 1 : end])
            out.append(text(values[n]) if n < len(values) else "")
            k = end + 1
        else:
            out.append(fmt[k])
            k += 1
    return "".join(out)


def _strings(f):
    return lambda *args: f(*[text(a) for a in args])


def array(name: str, a) -> Series:
    if not isinstance(a, Series):
        raise ScriptError(f"{name}: expected an array")
    return a


def array_new(size=0.0, initial=NAN) -> Series:
    n = round_half_up(num(size))
    if n != n or n < 0:
        n = 0
    if n > MAX_ARRAY:
        raise ScriptError("array.new: too many elements")
    return Series([initial] * int(n))


def _grow(name: str, at):
    def call(a=None, v=NAN):
        array(name, a)
        if len(a) >= MAX_ARRAY:
            raise ScriptError(f"{name}: too many elements")
        a.insert(at(a), v)
        return 0.0

    return call


def _index(v) -> int:
    v = round_half_up(num(v))
    return int(v) if v == v and not math.isinf(v) else -1


def array_get(a=None, i=NAN):
    k = _index(i)
    return array("array.get", a)[k] if 0 <= k < len(a) else NAN


def array_set(a=None, i=NAN, v=NAN):
    k = _index(i)
    if not 0 <= k < len(array("array.set", a)):
        raise ScriptError("array.set: out of range")
    a[k] = v
    return 0.0


def _numbers(name: str, f):
    def call(a=None):
        v = [x for x in array(name, a) if isinstance(x, float) and x == x]
        return float(f(v)) if v else NAN

    return call


def array_clear(a=None):
    array("array.clear", a).clear()
    return 0.0


PURE = {
    "abs": _real(abs), "sqrt": _real(math.sqrt), "log": _real(_log), "exp": _real(_exp), "round": _real(round_half_up),
    "floor": _real(_whole(math.floor)), "ceil": _real(_whole(math.ceil)), "sign": _real(lambda v: math.copysign(1.0, v) if v else v),
    "sin": _real(math.sin), "cos": _real(math.cos), "tan": _real(math.tan), "asin": _real(math.asin), "acos": _real(math.acos), "atan": _real(math.atan),
    "atan2": lambda y=NAN, x=NAN: math.atan2(num(y), num(x)), "pow": power,
    "min": _each("min", ind.poison_min), "max": _each("max", ind.poison_max), "avg": _each("avg", lambda a, b: a + b, lambda v, n: v / n),
    "nz": lambda v=NAN, r=0.0: r if isinstance(v, float) and v != v else v, "na": lambda v=NAN: 1.0 if isinstance(v, float) and v != v else 0.0,
    "iff": lambda c=NAN, a=NAN, b=NAN: a if truthy(c) else b, "tostring": tostring,
    "str.format": lambda fmt="", *v: fill_in(text(fmt), *v), "str.contains": _strings(lambda s="", sub="": 1.0 if sub in s else 0.0),
    "str.replace": _strings(lambda s="", a="", b="": s.replace(a, b) if a else s), "str.upper": _strings(str.upper), "str.lower": _strings(str.lower),
    "str.length": _strings(lambda s="": float(len(s.encode("utf-16-le", "surrogatepass")) // 2)), "str.split": _strings(lambda s="", sep="": split(s, sep)),
    "array.new": array_new, "array.push": _grow("array.push", len), "array.unshift": _grow("array.unshift", lambda a: 0),
    "array.pop": lambda a=None: array("array.pop", a).pop() if array("array.pop", a) else NAN,
    "array.shift": lambda a=None: array("array.shift", a).pop(0) if array("array.shift", a) else NAN,
    "array.get": array_get, "array.set": array_set, "array.size": lambda a=None: float(len(array("array.size", a))), "array.clear": array_clear,
    "array.first": lambda a=None: array("array.first", a)[0] if array("array.first", a) else NAN,
    "array.last": lambda a=None: array("array.last", a)[-1] if array("array.last", a) else NAN,
    "array.sum": _numbers("array.sum", sum), "array.avg": _numbers("array.avg", lambda v: sum(v) / len(v)), "array.min": _numbers("array.min", min), "array.max": _numbers("array.max", max),
}
#: Pure functions of the time zone.
ZONED = {name: (lambda tz, t=NAN, n=name: calendar.part(n, t, tz)) for name in calendar.PARTS}
ZONED["timestamp"] = lambda tz, *a: calendar.from_text(a[0], tz) if a and isinstance(a[0], str) else calendar.from_parts(tz, *[num(x) for x in a]) if a else NAN
NUMERIC = frozenset(STATEFUL) - {"valuewhen"} | frozenset("abs sqrt log exp round floor ceil sign sin cos tan asin acos atan atan2 pow min max avg na str.contains str.length array.size array.sum array.avg array.min array.max array.push array.unshift array.set array.clear timestamp year month dayofmonth dayofweek hour minute".split())


def plus(a, b):
    if isinstance(a, str) or isinstance(b, str):
        return text(a) + text(b)
    return num(a) + num(b)


def same(a, b) -> float:
    return 1.0 if type(a) is type(b) and a == b else 0.0


def alert_text(template: str, tape: Tape, i: int) -> str:
    """The template with the firing bar's values; unknown names stay."""
    parts, rest = [], template
    while "{{" in rest:
        head, _, tail = rest.partition("{{")
        name, close, after = tail.partition("}}")
        if close and name in ("open", "high", "low", "close", "volume"):
            parts.append(head + number_text(getattr(tape, name)[i]))
        elif close and name in ("time", "bar_index"):
            parts.append(head + number_text(tape.date[i] if name == "time" else float(i)))
        else:
            parts.append(head + "{{")
            after = tail
        rest = after
    return "".join(parts) + rest

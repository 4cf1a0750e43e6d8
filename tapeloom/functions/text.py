"""Number text with ECMAScript rules, in plain Python; the Column forms are in functions/columns.py."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal


class Series(list):
    """A script array: mutable, shared by reference."""

    __slots__ = ()
    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other

    def __ne__(self, other):
        return self is not other


class PlotRef:
    __slots__ = ("index",)

    def __init__(self, index: int):
        self.index = index


def number_text(x: float) -> str:
    """Shortest text that reads back as x, as ECMAScript writes it."""
    if x != x:
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    if 1e-3 <= abs(x) < 1e15:  # no exponent in either notation
        short = repr(x)
        return short[:-2] if short.endswith(".0") else short
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d, k = "".join(map(str, digits)), len(digits)
    n = k + exponent
    if k <= n <= 21:
        body = d + "0" * (n - k)
    elif 0 < n <= 21:
        body = d[:n] + "." + d[n:]
    elif -6 < n <= 0:
        body = "0." + "0" * -n + d
    else:
        body = d[0] + ("." + d[1:] if k > 1 else "") + "e" + ("+" if n > 0 else "-") + str(abs(n - 1))
    return "-" + body if sign else body


def fixed_text(x: float, places: int) -> str:
    if x != x or math.isinf(x) or abs(x) >= 1e21:
        return number_text(x)
    q = abs(Decimal(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    return ("-" if x < 0 and not (q == 0 and x == 0) else "") + format(q, "f")


def text(v) -> str:
    """What + and str.* see of a value."""
    if isinstance(v, str):
        return v
    if isinstance(v, Series):
        return "[array]"
    if isinstance(v, float):
        return number_text(v)
    return "NaN" if v is None else "[object Object]"


def round_half_up(x: float) -> float:
    """Halves go toward +infinity."""
    if x != x or math.isinf(x):
        return x
    f = math.floor(x)
    return float(f + 1 if x - f >= 0.5 else f)

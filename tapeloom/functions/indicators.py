"""Per-bar indicators of the fold tier, one generator per call site.

An indicator is a generator that receives its input with send() and yields the output for that bar, so its locals are
its state. Windows are deques; sums over them are kept as totals that are renewed from the window's own values every
RENEW steps and after any non-finite value has left, which bounds rounding drift.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Generator

NAN = math.nan
RENEW = 256
Stream = Generator[float, object, None]


def finite(v: float) -> bool:
    return v - v == 0


def primed(g: Stream) -> Callable[[object], float]:
    next(g)
    return g.send


class Window:
    """The last `p` values; add() returns whether they are p finite ones. Keeps total and, if asked, weighted total."""

    __slots__ = ("p", "v", "bad", "total", "squares", "weighted", "steps")

    def __init__(self, p: int):
        self.p, self.v, self.bad, self.steps = p, deque(), 0, 0
        self.total = self.squares = self.weighted = 0.0

    def add(self, x: float) -> bool:
        v = self.v
        v.append(x)
        if not finite(x):
            self.bad += 1
        old = None
        if len(v) > self.p:
            old = v.popleft()
            if not finite(old):
                self.bad -= 1
                old = None
                self.steps = 0
        if self.bad or len(v) < self.p:
            self.steps = 0
            return False
        self.steps -= 1
        if self.steps < 0 or old is None:
            self.total = math.fsum(v)
            self.squares = math.fsum(y * y for y in v)
            self.weighted = math.fsum(k * y for k, y in enumerate(v, 1))
            self.steps = RENEW
        else:
            self.weighted += self.p * x - self.total
            self.total += x - old
            self.squares += x * x - old * old
        return True


def sma(p: int) -> Stream:
    w, out = Window(p), NAN
    while True:
        out = w.total / p if w.add((yield out)) else NAN


def total(p: int) -> Stream:
    w, out = Window(p), NAN
    while True:
        out = w.total if w.add((yield out)) else NAN


def wma(p: int) -> Stream:
    w, out, weights = Window(p), NAN, p * (p + 1) / 2
    while True:
        out = w.weighted / weights if w.add((yield out)) else NAN


def stdev(p: int) -> Stream:
    w, out = Window(p), NAN
    while True:
        if w.add((yield out)):
            mean, square = w.total / p, w.squares / p
            spread = square - mean * mean
            out = 0.0 if spread <= square * 1e-12 else math.sqrt(spread)
        else:
            out = NAN


def exponential(alpha: float) -> Stream:
    """Seeded with the first finite value; others give na and change nothing."""
    state, out = None, NAN
    while True:
        v = yield out
        if finite(v):
            out = state = v if state is None else alpha * v + (1 - alpha) * state
        else:
            out = NAN


def ema(p: int) -> Stream:
    return exponential(2 / (p + 1))


def wilders(p: int) -> Stream:
    return exponential(1 / p)


def stacked(p: int, weights: tuple[float, ...]) -> Stream:
    """A weighted sum of an EMA, the EMA of that, and so on."""
    chain, out = [primed(ema(p)) for _ in weights], NAN
    while True:
        v, parts = (yield out), []
        for link in chain:
            v = link(v)
            parts.append(v)
        out = math.nan if any(x != x for x in parts) else sum(w * x for w, x in zip(weights, parts))


def dema(p: int) -> Stream:
    return stacked(p, (2.0, -1.0))


def tema(p: int) -> Stream:
    return stacked(p, (3.0, -3.0, 1.0))


def tma(p: int) -> Stream:
    inner, outer, out = primed(sma((p + 2) // 2)), primed(sma(p // 2 + 1)), NAN
    while True:
        out = outer(inner((yield out)))


def hull(p: int) -> Stream:
    half, whole, last, out = primed(wma(max(1, p // 2))), primed(wma(p)), primed(wma(max(1, math.floor(math.sqrt(p) + 0.5)))), NAN
    while True:
        v = yield out
        out = last(2 * half(v) - whole(v))


def rsi(p: int) -> Stream:
    out, before, n, up, down = NAN, None, 0, 0.0, 0.0
    while True:
        v = yield out
        out = NAN
        if not finite(v):
            continue
        if before is not None:
            step = v - before
            gain, loss = (step, 0.0) if step > 0 else (0.0, -step)
            n += 1
            if n <= p:
                up, down = up + gain / p, down + loss / p
            else:
                up, down = (up * (p - 1) + gain) / p, (down * (p - 1) + loss) / p
            if n >= p:
                out = 100 - 100 / (1 + up / down) if down else (100.0 if up else 50.0)
        before = v


def extreme(p: int, sign: int, position: bool = False) -> Stream:
    """Greatest (sign 1) or least (-1) of p values, or how many bars back its latest is; NaN poisons, infinities count."""
    out, i, last_nan, best = NAN, -1, -1, deque()
    while True:
        v = yield out
        i += 1
        if v != v:
            last_nan = i
        else:
            while best and best[-1][0] * sign <= v * sign:
                best.pop()
            best.append((v, i))
        while best and best[0][1] <= i - p:
            best.popleft()
        if i < p - 1 or last_nan > i - p or not best:
            out = NAN
        else:
            out = float(i - best[0][1]) if position else best[0][0]


def lagged(p: int) -> Stream:
    held, out = deque(), NAN
    while True:
        held.append((yield out))
        out = held.popleft() if len(held) > p else NAN


def change(p: int) -> Stream:
    held, out = primed(lagged(p)), NAN
    while True:
        v = yield out
        out = v - held(v)


def roc(p: int) -> Stream:
    held, out = primed(lagged(p)), NAN
    while True:
        v = yield out
        base = held(v)
        out = 100 * (v - base) / base if base == base and base else NAN


def linreg(p: int) -> Stream:
    w, out = deque(maxlen=p), NAN
    mean_x = (p - 1) / 2
    xs = [k - mean_x for k in range(p)]
    sxx = sum(x * x for x in xs)
    while True:
        w.append((yield out))
        if len(w) < p or p > 1 and not all(map(finite, w)):
            out = NAN
        elif p == 1:
            out = w[0]
        else:
            out = math.fsum(w) / p + mean_x * math.fsum(x * y for x, y in zip(xs, w)) / sxx


def streak(p: int, sign: int) -> Stream:
    out, before, run = NAN, NAN, 0
    while True:
        v = yield out
        run = run + 1 if (v - before) * sign > 0 else 0
        before, out = v, 1.0 if run >= p else 0.0


def crossing(sign: int) -> Stream:
    """Pairs (a, b): whether sign * (a - b) turned positive since the last call."""
    out, below = NAN, False
    while True:
        a, b = yield out
        out = 1.0 if below and (a > b if sign > 0 else a < b) else 0.0
        below = a <= b if sign > 0 else a >= b


def correlation(p: int) -> Stream:
    w, out = deque(maxlen=p), NAN
    while True:
        w.append((yield out))
        out = NAN
        if len(w) == p and not any(a != a or b != b for a, b in w):
            ma, mb = sum(a for a, _ in w) / p, sum(b for _, b in w) / p
            va, vb = sum(a * a for a, _ in w) / p - ma * ma, sum(b * b for _, b in w) / p - mb * mb
            if va > 0 and vb > 0:
                out = (sum(a * b for a, b in w) / p - ma * mb) / (math.sqrt(va) * math.sqrt(vb))


def percentile(p: int, q: float) -> Stream:
    w, ranked, out = deque(), [], NAN
    rank = min(100.0, max(0.0, q)) / 100 * (p - 1)
    low = int(rank)
    while True:
        v = yield out
        w.append(v)
        if v == v:
            insort(ranked, v)
        if len(w) > p:
            old = w.popleft()
            if old == old:
                del ranked[bisect_left(ranked, old)]
        if len(ranked) < p:
            out = NAN
        elif low + 1 < p and rank > low:
            out = ranked[low] + (ranked[low + 1] - ranked[low]) * (rank - low)
        else:
            out = ranked[low]


def alma(p: int, offset: float, sigma: float) -> Stream:
    w, out = deque(maxlen=p), NAN
    centre, width = offset * (p - 1), p / (sigma if sigma > 0 else 6.0)
    weights = [math.exp(-((k - centre) ** 2) / (2 * width * width)) for k in range(p)]
    norm = sum(weights)
    while True:
        w.append((yield out))
        out = NAN if len(w) < p or any(v != v for v in w) else sum(a * b for a, b in zip(weights, w)) / norm


# -- fed with (high, low, close, volume)


def poison_max(*v: float) -> float:
    best = v[0]
    for x in v:
        if not x <= best:
            if x != x:
                return NAN
            best = x
    return best


def poison_min(*v: float) -> float:
    best = v[0]
    for x in v:
        if not x >= best:
            if x != x:
                return NAN
            best = x
    return best


def true_range() -> Stream:
    out, before = NAN, None
    while True:
        h, l, c, _ = yield out
        out = h - l if before is None else poison_max(h - l, abs(h - before), abs(l - before))
        before = c


def atr(p: int) -> Stream:
    tr, smooth, out = primed(true_range()), primed(wilders(p)), NAN
    while True:
        out = smooth(tr((yield out)))


def range_share(p: int, williams: bool) -> Stream:
    top, bottom, out = primed(extreme(p, 1)), primed(extreme(p, -1)), NAN
    while True:
        h, l, c, _ = yield out
        h, l = top(h), bottom(l)
        out = (-100 * (h - c) / (h - l) if williams else 100 * (c - l) / (h - l)) if h - l > 0 else NAN


def mfi(p: int) -> Stream:
    inflow, outflow, before, out = primed(total(p)), primed(total(p)), NAN, NAN
    while True:
        h, l, c, v = yield out
        typical = (h + l + c) / 3
        up, down = inflow(typical * v if typical > before else 0.0), outflow(typical * v if typical < before else 0.0)
        before = typical
        if up != up or down != down:
            out = NAN
        else:
            out = 100 - 100 / (1 + up / down) if down else (100.0 if up else 50.0)


def obv() -> Stream:
    out, before, sum_ = NAN, NAN, 0.0
    while True:
        _, _, c, v = yield out
        sum_ += v if c > before else -v if c < before else 0.0
        before, out = c, sum_


def vwap() -> Stream:
    out, current, money, volume = NAN, None, 0.0, 0.0
    while True:
        price, v, key = yield out
        if key != current:
            current, money, volume = key, 0.0, 0.0
        if price == price and v == v:
            money, volume = money + price * v, volume + v
        out = money / volume if volume > 0 else NAN


def pivot(left: int, right: int, sign: int) -> Stream:
    w, out = deque(maxlen=left + 1 + right), NAN
    while True:
        w.append((yield out))
        out = NAN
        if len(w) == w.maxlen:
            centre = w[left]
            if centre == centre and all((centre - v) * sign > 0 for k, v in enumerate(w) if k != left):
                out = centre


def directional(p: int, what: str) -> Stream:
    tr, plus, minus, smooth = (primed(wilders(p)) for _ in range(4))
    out, before = NAN, None
    while True:
        h, l, c, _ = yield out
        out = NAN
        if before is not None:
            ph, pl, pc = before
            up, down = h - ph, pl - l
            t = tr(poison_max(h - l, abs(h - pc), abs(l - pc)))
            a, b = plus(up if up > down and up > 0 else 0.0), minus(down if down > up and down > 0 else 0.0)
            if t > 0:
                a, b = 100 * a / t, 100 * b / t
                mean = smooth(100 * abs(a - b) / (a + b) if a + b > 0 else 0.0)
                out = a if what == "diplus" else b if what == "diminus" else mean
        before = h, l, c


def aroon(p: int, sign: int) -> Stream:
    back, out = primed(extreme(p + 1, sign, True)), NAN
    while True:
        h, l, _, _ = yield out
        out = 100 * (p - back(h if sign > 0 else l)) / p


def parabolic(start: float, step: float, most: float) -> Stream:
    out, bars = NAN, []  # the two bars before
    h, l, c, _ = yield out
    bars.append((h, l))
    first = c
    h, l, c, _ = yield out
    long = c >= first
    (h0, l0) = bars[0]
    stop, best = (poison_min(l, l0), poison_max(h, h0)) if long else (poison_max(h, h0), poison_min(l, l0))
    speed = start
    bars.append((h, l))
    while True:
        h, l, _, _ = yield stop
        stop += speed * (best - stop)
        side = 1 if long else -1  # seen from the trend: near is the side of the stop
        near, far = (l, h) if long else (h, l)
        guard = [b[1] if long else b[0] for b in bars]
        stop = poison_min(stop, *guard) if long else poison_max(stop, *guard)
        if (stop - near) * side > 0:
            long, stop, best, speed = not long, best, near, start
        elif (far - best) * side > 0:
            best, speed = far, min(most, speed + step)
        bars = [bars[1], (h, l)]


def supertrend(p: int, mult: float, direction: bool) -> Stream:
    spread, out = primed(atr(p)), NAN
    upper = lower = before = NAN
    trend = 1.0
    while True:
        bar = yield out
        h, l, c, _ = bar
        a = spread(bar)
        if a != a:
            out, before = NAN, c
            continue
        mid = (h + l) / 2
        top, bottom = mid + mult * a, mid - mult * a
        if not (top >= upper and before <= upper) or upper != upper:
            upper = top
        if not (bottom <= lower and before >= lower) or lower != lower:
            lower = bottom
        if trend > 0 and c < lower:
            trend = -1.0
        elif trend < 0 and c > upper:
            trend = 1.0
        before = c
        out = trend if direction else (lower if trend > 0 else upper)


def cci(p: int) -> Stream:
    w, out = deque(maxlen=p), NAN
    while True:
        h, l, c, _ = yield out
        typical = (h + l + c) / 3
        w.append(typical)
        out = NAN
        if len(w) == p and not any(v != v for v in w):
            mean = sum(w) / p
            spread = sum(abs(v - mean) for v in w) / p
            out = (typical - mean) / (0.015 * spread) if spread > 0 else NAN

"""Synthetic tapes: a triangle wave with noise from a multiplicative congruential generator.

The generator's constants, the wave's factors and the tapes' settings are fixed values: recorded results are over these tapes.
"""

import math
from datetime import UTC, datetime


def uniform(seed: int):
    x = seed
    while True:
        x = 16807 * x % 2147483647
        yield x / 2147483647


def wave(n, start, step_ms, seed, base, amp, trend, volume):
    r, out = uniform(seed), []
    for i in range(n):
        share = (i % 40) / 20
        triangle = share * 2 - 1 if share < 1 else 1 - (share - 1) * 2
        shift = (next(r) - 0.5) * amp * 0.5
        middle = base + triangle * amp + i * trend + shift
        spread = amp * 0.15 + next(r) * amp * 0.1
        up = next(r) < 0.5
        o = middle - spread * 0.4 if up else middle + spread * 0.4
        c = middle + spread * 0.4 if up else middle - spread * 0.4
        out.append({"date": start + i * step_ms, "open": o, "high": max(o, c) + spread * 0.3, "low": min(o, c) - spread * 0.3, "close": c, "volume": volume + math.floor(next(r) * 5) * 250})
    return out


def at(*when) -> int:
    return int(datetime(*when, tzinfo=UTC).timestamp() * 1000)


TAPES = {
    "wavy": wave(200, at(2026, 1, 5, 14, 30), 60_000, 12345, 100, 6, 0.02, 1000),
    "trend": wave(100, at(2026, 1, 6, 14, 30), 300_000, 777, 50, 1.5, 0.12, 500),
    "dst": wave(60, at(2026, 3, 7, 12), 3_600_000, 424242, 80, 3, 0, 800),
    "single": wave(1, at(2026, 1, 5, 14, 30), 60_000, 99, 100, 6, 0, 1000),
    "flat": [{"date": at(2026, 1, 7, 14, 30) + i * 60_000, "open": 100, "high": 100, "low": 100, "close": 100, "volume": 1000} for i in range(50)],
    "empty": [],
}

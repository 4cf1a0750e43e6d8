"""Tapes from JSON-like bars."""

from __future__ import annotations

import math

from tapeloom.functions.builtins import Tape

FIELDS = ("date", "open", "high", "low", "close", "volume")


def tape(bars: list) -> Tape:
    """Missing or non-numeric fields are na, a missing volume is 0, anything but a record is left out."""
    read = lambda v, none: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else none
    rows = [[read(b.get(f), 0.0 if f == "volume" else math.nan) for f in FIELDS] for b in bars if isinstance(b, dict)]
    return Tape(*(zip(*rows) if rows else ()))

"""The JSON form of a result: na is null, infinities are words, whole numbers have no point, -0 is 0."""

from __future__ import annotations

import json
import math

from tapeloom.functions.text import PlotRef, Series


def plain(v):
    if isinstance(v, float):
        if v != v:
            return None
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        return int(v) if v == int(v) and abs(v) < 2**53 else v
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (Series, PlotRef)):
        return None
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def encode(result: dict) -> str:
    return json.dumps(plain(result), ensure_ascii=False, allow_nan=False)

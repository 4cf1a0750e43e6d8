"""Recorded results: own cases in tests/recorded, and those of a folder that TAPELOOM_GOLDENS names (one JSON file a case: tape, opts, script, expected)."""

import json
import math
import os
from pathlib import Path

import pytest

from tapeloom.functions.tapes import tape
from tapeloom.functions.wire import plain
from tapeloom.plans.fold import run_tape
from tests.tapes import TAPES

FOLDER = os.environ.get("TAPELOOM_GOLDENS")
FILES = sorted(Path(__file__).with_name("recorded").glob("*.json")) + (sorted(Path(FOLDER).glob("*.json")) if FOLDER else [])


def difference(got, want, at=""):
    """Where two results differ: numbers within 1e-9, keys exactly."""
    if isinstance(want, dict) and isinstance(got, dict):
        if got.keys() != want.keys():
            return f"{at}: keys {sorted(got.keys() ^ want.keys())}"
        return next((d for k in want if (d := difference(got[k], want[k], f"{at}.{k}"))), None)
    if isinstance(want, list) and isinstance(got, list):
        if len(got) != len(want):
            return f"{at}: {len(got)} items, not {len(want)}"
        return next((d for k, (a, b) in enumerate(zip(got, want)) if (d := difference(a, b, f"{at}[{k}]"))), None)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if number(got) and number(want):
        return None if got == want or math.isclose(got, want, rel_tol=1e-9) else f"{at}: {got} is not {want}"
    return None if type(got) is type(want) and got == want else f"{at}: {got!r} is not {want!r}"


@pytest.mark.parametrize("file", FILES, ids=lambda f: f.stem)
def test_recorded(file):
    case = json.loads(file.read_text())
    got, want = plain(run_tape(case["script"], tape(TAPES[case["tape"]]), case["opts"])), case["expected"]
    if case["name"].startswith("err-"):
        assert isinstance(got.pop("error"), str)
        assert isinstance(want.pop("error"), str)
    assert difference(got, want) is None

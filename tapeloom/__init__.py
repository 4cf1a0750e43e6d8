"""Per-bar analytics on Spark: scripts over OHLCV bars, many tapes at once."""

from tapeloom.operators.run import RunOptions, ScriptResult, lang_version, restyled, run_script, run_script_json
from tapeloom.plans.syntax import ScriptError
from tapeloom.sources.bars import bars, bars_from_records, read_bars, resample

__all__ = ["RunOptions", "ScriptError", "ScriptResult", "bars", "bars_from_records", "lang_version", "read_bars", "resample", "restyled", "run_script", "run_script_json"]

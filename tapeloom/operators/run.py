"""run_script: a script over many tapes. Chooses the native tier where it can, the fold tier where it must."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.tapes import tape
from tapeloom.functions.wire import encode
from tapeloom.operators import fold
from tapeloom.plans.fold import run_tape
from tapeloom.plans.native import Compiler, NotNative, compile_native
from tapeloom.plans.syntax import ScriptError, parse

LANG_VERSION = "2.4.0"
MOST_RECURRENCES = 1


@dataclass
class RunOptions:
    """timezone: an IANA name, default America/New_York; session: {'open': 'HH:MM', 'close': 'HH:MM'}; inputs: overrides by key."""

    timezone: str | None = None
    session: dict | None = None
    inputs: dict | None = None

    @classmethod
    def of(cls, options) -> dict:
        if options is None:
            return {}
        if isinstance(options, cls):
            return {k: v for k, v in vars(options).items() if v is not None}
        return {k: v for k, v in dict(options).items() if v is not None}


class ScriptResult:
    """Lazy results of a script over bars; every DataFrame has a symbol column."""

    def __init__(self, bars: DataFrame, source: str, options: dict, exact: bool, windows: bool):
        self.bars, self.source, self.options = bars, source, options
        self.native: Compiler | None = None
        self.why_fold = "exact results asked for"
        parse(source)
        if not exact:
            try:
                made = compile_native(source, bars, options)
                if made.main.recurrences <= MOST_RECURRENCES or windows:
                    self.native = made
                else:
                    self.why_fold = f"{made.main.recurrences} recurrences: one ordered pass is faster than their windows"
            except NotNative as e:
                self.why_fold = str(e)

    @property
    def tier(self) -> str:
        return "native" if self.native is not None else "fold"

    @cached_property
    def declared(self) -> dict:
        """The result of the declaration pass: metadata, inputs and the records with empty values."""
        out = run_tape(self.source, tape([]), self.options)
        if out["error"] is not None:  # it may need a bar, say to index an array
            one = run_tape(self.source, tape([{"date": 0, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}]), self.options)
            out = one if one["error"] is None else out
        return out

    @cached_property
    def columns(self) -> list:
        return fold.wide_columns(self.declared)

    def per_bar(self) -> DataFrame:
        """symbol, bar_index, date and one column per output of the script."""
        if self.native is not None:
            keep = {k: v for k, v in self.native.columns.items() if not k.startswith("panel_")}
            return self.native.frame.df.select("symbol", "bar_index", "date", *[v.alias(k) for k, v in keep.items()])
        out = fold.per_bar(self.bars, self.source, self.options, self.columns)
        return out

    def long_form(self) -> DataFrame:
        """(symbol, bar_index, date, name, value) of numeric outputs that are not na."""
        wide = self.per_bar()
        numbers = [c for c, t in wide.dtypes if t == "double"]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in numbers])).alias("x")
        return wide.select("symbol", "bar_index", "date", cells).select("symbol", "bar_index", "date", "x.name", "x.value").where("value is not null")

    def panel(self) -> DataFrame:
        """(symbol, k, title, value, text, precision): what each info panel shows on the last bar."""
        if self.native is None:
            return self.records("panel").drop("color")
        c = self.native
        shown = [(k, p) for k, p in enumerate(c.out.panel)]
        last = c.frame.df.groupBy("symbol").agg(*[F.max_by(F.struct(c.columns[f"panel_{k}"].alias("v")), "bar_index").getField("v").alias(f"v{k}") for k, _ in shown])
        kinds = dict(last.dtypes)
        cells = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(p["title"]).alias("title"), (F.col(f"v{k}") if kinds[f"v{k}"] == "double" else F.lit(None)).cast("double").alias("value"), (F.col(f"v{k}") if kinds[f"v{k}"] == "string" else F.lit(None)).cast("string").alias("text"), F.lit(p["precision"]).alias("precision")) for k, p in shown]
        return last.select("symbol", F.explode(F.array(*cells)).alias("x")).select("symbol", "x.*")

    @cached_property
    def _every(self) -> DataFrame:
        return fold.every_record(self.bars, self.source, self.options)

    def keep(self) -> ScriptResult:
        """Holds the event records, one row a symbol, so that one pass over the bars serves all kinds that are asked for."""
        self._every.persist()
        return self

    def records(self, what: str) -> DataFrame:
        """Event rows: trades, summary, open, markers, lines, labels, boxes or panel (fold tier)."""
        return fold.records(self._every, what)

    def trades(self) -> DataFrame:
        return self.records("trades")

    def summary(self) -> DataFrame:
        return self.records("summary")

    def json(self) -> DataFrame:
        """(symbol, result): the whole result record as JSON text."""
        return fold.result_json(self.bars, self.source, self.options)


def run_script(bars: DataFrame, source: str, options: RunOptions | dict | None = None, exact: bool = False, windows: bool = False) -> ScriptResult:
    """A script over a bars DataFrame (see sources.bars). exact: bit parity with one ordered pass, hence the fold tier.

    windows: the native tier wherever it can express the script, also where more than MOST_RECURRENCES recurrences (an
    EMA is one, an RSI two) make it slower than the fold.

    Syntax and validation errors raise ScriptError here. An error that depends on data is per symbol, in the fold
    tier's `error` column and result record; the native tier only takes scripts that can't have any.
    """
    return ScriptResult(bars, source, RunOptions.of(options), exact, windows)


def run_script_json(source: str, bars_json: str, options_json: str | None = None) -> str:
    """One tape without Spark: JSON text in, JSON text out."""
    bars = json.loads(bars_json)
    options = json.loads(options_json) if options_json else None
    return encode(run_tape(source, tape(bars if isinstance(bars, list) else []), options or {}))


def lang_version() -> str:
    return LANG_VERSION


def restyled(source: str, spans: list[tuple[list[int] | None, str]]) -> str:
    """The source with style literals replaced: (span in UTF-16 units, new literal text) of each, spans of None left alone."""
    raw = source.encode("utf-16-le")
    for (a, b), new in sorted(((tuple(s), t) for s, t in spans if s is not None), reverse=True):
        raw = raw[: 2 * a] + new.encode("utf-16-le") + raw[2 * b :]
    return raw.decode("utf-16-le")


__all__ = ["RunOptions", "ScriptError", "ScriptResult", "lang_version", "restyled", "run_script", "run_script_json"]

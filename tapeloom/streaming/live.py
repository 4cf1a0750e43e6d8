"""Live bars on Structured Streaming: a script's per-bar outputs as bars arrive.

Per symbol the state is the bars so far (in order) and those still waiting. A bar waits until the watermark (the
latest date seen for its symbol, less `delay_ms`) has passed it, so bars that come late by no more than that are put
in order; later ones are left out and counted in `late`. Each accepted bar gives one output row. State and work are
bounded by `keep` bars a symbol, which is to be named: scripts whose windows and decays fit into `keep` bars give the same
values from the last `keep` bars alone; one that reads all history needs as many as a symbol will ever have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.functions.builtins import Tape
from tapeloom.functions.tapes import tape
from tapeloom.operators import fold
from tapeloom.operators.run import RunOptions
from tapeloom.plans.fold import run_tape
from tapeloom.plans.syntax import parse

FIELDS = ("date", "seq", "open", "high", "low", "close", "volume")
_STATE = "done array<array<double>>, waiting array<array<double>>, before long, late long"


def run_live(stream: DataFrame, source: str, options: RunOptions | dict | None = None, delay_ms: int = 0, *, keep: int) -> DataFrame:
    """Streaming rows (symbol, bar_index, date, outputs..., error, late) from a streaming bars DataFrame; append mode.

    "Latest bar" scalars (barstate.islast, current_datetime and the like) mean the latest bar accepted so far.
    """
    parse(source)
    if keep < 1:
        raise ValueError("keep is the number of bars held for each symbol, 1 at least")
    opts = RunOptions.of(options)
    columns = fold.wide_columns(run_tape(source, tape([]), opts))
    schema = "symbol string, bar_index long, date long, " + "".join(f"`{c}` {t}, " for c, t, _, _ in columns) + "error string, late long"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, waiting, before, late = state.get if state.exists else ([], [], 0, 0)
        done, waiting = [list(b) for b in done], [list(b) for b in waiting]
        for d in batches:
            for row in d[list(FIELDS)].astype(float).itertuples(index=False):
                waiting.append(list(row))
        waiting.sort(key=lambda b: (b[0], b[1]))
        newest = max([b[0] for b in waiting] + [done[-1][0] if done else float("-inf")])
        last = (done[-1][0], done[-1][1]) if done else (float("-inf"), 0.0)
        in_time = [b for b in waiting if (b[0], b[1]) > last]
        late += len(waiting) - len(in_time)
        ready = [b for b in in_time if b[0] <= newest - delay_ms]
        waiting = in_time[len(ready) :]
        start, done = len(done), done + ready
        if ready:
            cols = list(zip(*done))
            nan = float("nan")
            clean = [[0.0 if v != v and k == 6 else v for v in c] if k == 6 else [nan if v is None else v for v in c] for k, c in enumerate(cols)]
            record = run_tape(source, Tape(clean[0], *clean[2:]), opts)
            out = {"symbol": [key[0]] * len(ready), "bar_index": range(before + start, before + len(done)), "date": [int(b[0]) for b in ready]}
            for name, kind, section, k in columns:
                values = fold.column_of(record, name, section, k)
                values = [None] * len(done) if values is None else values
                out[name] = pd.Series(values[start:], dtype=float if kind == "double" else object)
            frame = pd.DataFrame(out)
            frame["error"], frame["late"] = record["error"], late
            if len(done) > keep:
                before, done = before + len(done) - keep, done[-keep:]
            yield frame
        state.update((done, waiting, before, late))

    return stream.groupBy("symbol").applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.NoTimeout)

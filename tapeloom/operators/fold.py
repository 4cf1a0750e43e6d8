"""The fold tier on Spark: one ordered pass per symbol in Python, for scripts that window functions can't express."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.builtins import Tape
from tapeloom.functions.wire import encode
from tapeloom.plans.fold import run_tape

FIELDS = ("date", "open", "high", "low", "close", "volume")


def tape_of(table: pa.Table) -> Tape:
    """A symbol's bars in order (date, seq), NULL as NaN."""
    table = table.sort_by([("date", "ascending"), ("seq", "ascending")])
    return Tape(*[pc.fill_null(table.column(f).cast(pa.float64(), safe=False), 0.0 if f == "volume" else float("nan")).to_pylist() for f in FIELDS])


def result_json(bars: DataFrame, source: str, options: dict | None = None) -> DataFrame:
    """(symbol, result): the whole result record of each symbol as JSON text."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"symbol": [table.column("symbol")[0].as_py()], "result": [encode(run_tape(source, tape_of(table), options))]})

    return bars.groupBy("symbol").applyInArrow(run, "symbol string, result string")


def wide_columns(record: dict) -> list[tuple[str, str, str, int]]:
    """(column, type, section, index) of each per-bar output in a result record."""
    out = [(p["key"], "double", "plots", k) for k, p in enumerate(record["plots"])]
    for k, _ in enumerate(record["shapes"]):
        out.append((f"shape_{k}", "double", "shapes", k))
    for k, t in enumerate(record["trades"]):
        out += [(f"trade_{k}_value", "double", "trades", k), (f"trade_{k}_qty", "double", "trades", k)]
        if "prices" in t:
            out.append((f"trade_{k}_price", "double", "trades", k))
    for k, a in enumerate(record["alerts"]):
        out.append((f"alert_{k}", "double", "alerts", k))
        if "messages" in a:
            out.append((f"alert_{k}_message", "string", "alerts", k))
    out += [(f"bar_color_{k}", "string", "barColors", k) for k, _ in enumerate(record["barColors"])]
    out += [(f"bg_color_{k}", "string", "bgColors", k) for k, _ in enumerate(record["bgColors"])]
    for k, f in enumerate(record["fills"]):
        out += [(f"fill_{k}_a", "double", "fills", k), (f"fill_{k}_b", "double", "fills", k)]
    return out


_PART = {"value": "values", "qty": "qty", "price": "prices", "message": "messages", "a": "a", "b": "b"}


def column_of(record: dict, name: str, section: str, k: int) -> list | None:
    """The per-bar values of one wide column in a result record; None if an error emptied it."""
    rows = record[section]
    values = rows[k] if k < len(rows) else None
    if isinstance(values, dict):
        values = values.get("colors") if section == "bgColors" else values.get(_PART.get(name.rpartition("_")[2], "values"))
    return values


def per_bar(bars: DataFrame, source: str, options: dict | None, columns: list[tuple[str, str, str, int]]) -> DataFrame:
    """One row a bar: symbol, bar_index, date, the given output columns, and the symbol's error if it has one."""
    schema = "symbol string, bar_index long, date long, " + "".join(f"`{c}` {t}, " for c, t, _, _ in columns) + "error string"

    def run(table: pa.Table) -> pa.Table:
        tape = tape_of(table)
        record, n = run_tape(source, tape, options), table.num_rows
        data = {"symbol": pa.array([table.column("symbol")[0].as_py()] * n, pa.string()), "bar_index": pa.array(range(n), pa.int64()), "date": table.column("date").combine_chunks().take(pc.sort_indices(table, [("date", "ascending"), ("seq", "ascending")]))}
        for name, kind, section, k in columns:
            values = column_of(record, name, section, k)
            if kind == "double":
                data[name] = pa.array(values if values is not None else [None] * n, pa.float64(), from_pandas=True)
            else:
                data[name] = pa.array([v if isinstance(v, str) else None for v in values] if values is not None else [None] * n, pa.string())
        data["error"] = pa.array([record["error"]] * n, pa.string())
        return pa.table(data)

    return bars.groupBy("symbol").applyInArrow(run, schema)


_RECORD = {
    "trades": ("side string, entryBar long, entryPrice double, exitBar long, exitPrice double, qty double, pnl double, reason string", lambda r: (r["strategy"] or {}).get("trades", [])),
    "summary": ("realized double, openPnl double, netProfit double, trades double, wins double, losses double, winRate double, grossProfit double, grossLoss double, profitFactor double, maxDrawdown double, initialCapital double, commissions double, endEquity double, returnPct double, cagrPct double, sharpe double, maxDrawdownPct double", lambda r: [r["strategy"]["summary"]] if r["strategy"] else []),
    "open": ("side string, qty double, avgPrice double, entryBar long", lambda r: [r["strategy"]["open"]] if r["strategy"] and r["strategy"]["open"] else []),
    "markers": ("side string, bar long, qty double", lambda r: [{"side": t["side"], "bar": i, "qty": t["qty"][i]} for t in (r["trades"] if r["strategy"] else []) if t["priceSource"] == "close" and t["color"] is None for i, v in enumerate(t["values"]) if v]),
    "lines": ("x1 double, y1 double, x2 double, y2 double, color string, width double, lineStyle string", lambda r: r["lines"]),
    "labels": ("x double, y double, text string, color string, textColor string, style string, size double", lambda r: r["labels"]),
    "boxes": ("x1 double, y1 double, x2 double, y2 double, color string, bgColor string, width double", lambda r: r["boxes"]),
    "panel": ("title string, value double, text string, color string, precision double", lambda r: [p | {"value": p["value"] if isinstance(p["value"], float) else None, "text": p["value"] if isinstance(p["value"], str) else None} for p in r["panel"]]),
}


def every_record(bars: DataFrame, source: str, options: dict | None = None) -> DataFrame:
    """One row a symbol: an array of structs for each kind of event record, all from one pass."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    fields = {what: [f.split() for f in names.split(", ")] for what, (names, _) in _RECORD.items()}
    types = {what: pa.list_(pa.struct([(n, kinds[k]) for n, k in of])) for what, of in fields.items()}
    known = lambda v: None if isinstance(v, float) and v != v else v

    def run(table: pa.Table) -> pa.Table:
        record = run_tape(source, tape_of(table), options)
        rows = {what: [{n: known(r[n]) for n, _ in of} for r in _RECORD[what][1](record)] for what, of in fields.items()}
        return pa.table({"symbol": pa.array([table.column("symbol")[0].as_py()], pa.string()), **{what: pa.array([rows[what]], types[what]) for what in fields}})

    schema = ", ".join(f"{what} array<struct<{', '.join(f'{n}: {k}' for n, k in of)}>>" for what, of in fields.items())
    return bars.groupBy("symbol").applyInArrow(run, f"symbol string, {schema}")


def records(every: DataFrame, what: str) -> DataFrame:
    """Rows of one kind of event record per symbol: trades, summary, open, markers, lines, labels, boxes or panel."""
    return every.select("symbol", F.posexplode(what).alias("k", "x")).select("symbol", F.col("k").cast("long").alias("k"), "x.*")


def long_form(bars: DataFrame, source: str, options: dict | None, columns: list[tuple[str, str, str, int]]) -> DataFrame:
    """(symbol, bar_index, date, name, value) of the numeric per-bar outputs that are not na."""
    wide = per_bar(bars, source, options, columns)
    numbers = [c for c, t, _, _ in columns if t == "double"]
    return wide.select("symbol", "bar_index", "date", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in numbers])).alias("x")).select("symbol", "bar_index", "date", "x.name", "x.value").where("value is not null")

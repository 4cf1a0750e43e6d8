"""Output operators: each draw or declare call owns a record that its per-bar values go to."""

from __future__ import annotations

import math
from collections import deque

from tapeloom.functions import calendar
from tapeloom.functions.builtins import Tape, alert_text, num, truthy
from tapeloom.functions.indicators import NAN, finite
from tapeloom.functions.text import PlotRef, Series, number_text, round_half_up
from tapeloom.operators.strategy import Ledger, order_of
from tapeloom.plans.syntax import Node, ScriptError

#: Default colours and the names that styles may have.
PALETTE = ("#22d3ee", "#f59e0b", "#a78bfa", "#22c55e", "#ec4899", "#38bdf8")
GREY, BLUE, GREEN, RED = "#8f8f98", "#3b82f6", "#22c55e", "#ef4444"
STYLES = ("line", "histogram", "area", "stepline", "circles")
LINE_STYLES = ("solid", "dashed", "dotted")
PRICES = ("open", "high", "low", "close")
POOL = 500
SECTIONS = ("plots", "fills", "shapes", "trades", "panel", "barColors", "bgColors", "alerts", "lines", "labels", "boxes")


def string(v, default=None):
    return v if isinstance(v, str) else default


def number(v, default=None):
    return v if isinstance(v, float) else default


def _unchanged(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a != a and b != b or a == b and math.copysign(1, a) == math.copysign(1, b)
    return type(a) is type(b) and a == b


class Outputs:
    """All records of a run; `declare` is the pass over an empty tape."""

    def __init__(self, tape: Tape, tz, inputs: dict | None):
        self.tape, self.n, self.tz, self.given = tape, len(tape), tz, inputs or {}
        self.title, self.overlay, self.description = None, True, None
        self.plots, self.fills, self.shapes, self.trades, self.panel = [], [], [], [], []
        self.bar_colors, self.bg_colors, self.inputs, self.alerts = [], [], [], []
        self.lines, self.labels, self.boxes = (deque(maxlen=POOL) for _ in range(3))
        self.ledger = Ledger(tape)

    @property
    def declare(self) -> bool:
        return self.n == 0

    def column(self, fill=NAN) -> list:
        return [fill] * self.n

    def drew(self) -> bool:
        return bool(self.plots or self.shapes or self.trades or self.panel or self.bar_colors or self.bg_colors or self.lines or self.labels or self.boxes or self.alerts or self.ledger.used)

    def as_dict(self, error: str | None = None) -> dict:
        out = {"title": self.title, "overlay": self.overlay, "description": self.description}
        if error is not None:
            out |= {s: [] for s in SECTIONS}
        else:
            out |= {
                "plots": self.plots, "fills": self.fills, "shapes": self.shapes, "trades": self.trades + self.ledger.markers(), "panel": self.panel,
                "barColors": self.bar_colors, "bgColors": self.bg_colors, "alerts": self.alerts,
                "lines": list(self.lines), "labels": list(self.labels), "boxes": list(self.boxes),
            }
        return out | {"inputs": self.inputs, "strategy": None if error is not None else self.ledger.result(), "error": error}


class Site:
    """One draw call. call(i, kw, args) runs once per bar; `record` exists after the first."""

    def __init__(self, out: Outputs, node: Node):
        self.out, self.node, self.record, self.held = out, node, None, {}

    def lock(self, what: str, value):
        if what in self.held and not _unchanged(self.held[what], value):
            raise ScriptError(f"{self.node.name} {what} must not change between bars", self.node.line)
        return self.held.setdefault(what, value)

    def fail(self, message: str):
        raise ScriptError(message, self.node.line)

    def freeze(self, kw: dict, rest: list):
        """For calls whose styles are literals: a function of (bar, value) alone. Checks run on the first bar."""

        def push(i, v):
            return self(i, kw, [v, *rest]) if self.record is None else self.put(i, v, kw, rest)

        return push

    def put(self, i, v, kw, rest):
        return self(i, kw, [v, *rest])

    def span(self, n: Node | None):
        return list(n.span) if n is not None and n.kind in ("num", "str") else None

    def argument(self, args: list, k: int):
        return args[k] if len(args) > k else None


class Study(Site):
    def __call__(self, i, kw, args):
        if self.record is None:
            self.record, out = True, self.out
            out.title = kw.get("title", string(self.argument(args, 0), out.title))
            out.overlay = truthy(kw["overlay"]) if "overlay" in kw else out.overlay
            out.description = string(kw.get("description"), out.description)
        return 0.0


class Plot(Site):
    def __call__(self, i, kw, args):
        second = string(self.argument(args, 1))
        painted = second is not None and second.startswith("#")
        color = self.lock("color", kw.get("color", second if painted else None))
        width = self.lock("width", number(kw.get("width"), number(self.argument(args, 2))))
        title = self.lock("title", kw.get("title", None if painted else second))
        style, dash = self.lock("style", kw.get("style", "line")), self.lock("linestyle", kw.get("linestyle", "solid"))
        if style not in STYLES:
            self.fail(f"unknown plot style; use {', '.join(STYLES)}")
        if dash not in LINE_STYLES:
            self.fail(f"unknown linestyle; use {', '.join(LINE_STYLES)}")
        if self.record is None:
            k, n = len(self.out.plots), self.node
            color_at = n.kwargs.get("color") if isinstance(kw.get("color"), str) else n.args[1] if painted else None
            width_at = n.kwargs.get("width") if isinstance(kw.get("width"), float) else n.args[2] if isinstance(self.argument(args, 2), float) else None
            self.record = {"key": f"p{k}", "title": title, "color": PALETTE[k % len(PALETTE)] if color is None else color, "width": 2.0 if width is None else width, "style": style, "lineStyle": dash, "colorSpan": self.span(color_at), "widthSpan": self.span(width_at), "values": self.out.column()}
            self.out.plots.append(self.record)
            self.ref, self.values = PlotRef(k), self.record["values"]
        if i >= 0 and args and isinstance(args[0], float):
            self.values[i] = args[0]
        return self.ref


    def put(self, i, v, kw, rest):
        if i >= 0 and isinstance(v, float):
            self.values[i] = v
        return self.ref


class Level(Site):
    def __call__(self, i, kw, args):
        v = self.lock("value", num(self.argument(args, 0)))
        if self.record is None:
            self.ref = PlotRef(len(self.out.plots))
            self.record = {"key": f"p{self.ref.index}", "title": kw.get("title"), "color": kw.get("color", GREY), "width": number(kw.get("width"), 1.0), "values": self.out.column(v)}
            self.out.plots.append(self.record)
        return self.ref


class Fill(Site):
    def __call__(self, i, kw, args):
        if len(args) < 2:
            self.fail("fill needs two plots or series")
        if self.record is None:
            self.sides = [None if isinstance(a, PlotRef) else self.out.column() for a in args[:2]]
            ends = [self.out.plots[a.index]["values"] if s is None else s for a, s in zip(args, self.sides)]
            self.record = {"a": ends[0], "b": ends[1], "color": kw.get("color", BLUE), "opacity": number(kw.get("opacity"), 0.12)}
            self.out.fills.append(self.record)
        if i >= 0:
            for side, a in zip(self.sides, args):
                if side is not None:
                    side[i] = num(a)
        return 0.0


def signal(v) -> float:
    return v if isinstance(v, float) else 1.0 if truthy(v) else 0.0


class Shape(Site):
    def __call__(self, i, kw, args):
        color = self.lock("color", kw.get("color", GREEN if kw.get("location") == "belowbar" else RED))
        if self.record is None:
            self.record = {"values": self.out.column(0.0), "shape": kw.get("shape", "triangleup"), "location": kw.get("location", "abovebar"), "color": color, "size": number(kw.get("size"), 4.0)}
            self.out.shapes.append(self.record)
        if i >= 0:
            self.record["values"][i] = signal(args[0]) if args else 0.0
        return 0.0


    def put(self, i, v, kw, rest):
        if i >= 0:
            self.record["values"][i] = signal(v)
        return 0.0


class Trade(Site):
    def __call__(self, i, kw, args):
        color, price = self.lock("color", kw.get("color")), kw.get("price", "close")
        kind = price if isinstance(price, str) else "custom"
        if kind != "custom" and kind not in PRICES:
            self.fail(f"{self.node.name} price is open, high, low, close or a number")
        self.lock("price", kind)
        if self.record is None:
            self.record = {"values": self.out.column(0.0), "qty": self.out.column(), "side": self.node.name[4:], "color": color, "priceSource": kind}
            if kind == "custom":
                self.record["prices"] = self.out.column()
            self.out.trades.append(self.record)
        if i >= 0:
            self.record["values"][i] = signal(args[0]) if args else 0.0
            self.record["qty"][i] = num(kw["qty"] if "qty" in kw else args[1] if len(args) > 1 else 1.0)
            if kind == "custom":
                self.record["prices"][i] = num(price)
        return 0.0


class Panel(Site):
    def __call__(self, i, kw, args):
        v = self.argument(args, 0)
        if self.record is None:
            places = number(kw.get("precision"))
            self.record = {"title": kw.get("title", string(self.argument(args, 1), f"Value {len(self.out.panel) + 1}")), "value": NAN, "color": None, "precision": 2.0 if places is None else float(max(0, min(8, round_half_up(places))))}
            self.out.panel.append(self.record)
        self.record["value"] = NAN if isinstance(v, Series) or v is None else v
        self.record["color"] = string(kw.get("color"))
        return 0.0


class Paint(Site):
    def __call__(self, i, kw, args):
        if self.record is None:
            self.record = self.out.column(None)
            if self.node.name == "barcolor":
                self.out.bar_colors.append(self.record)
            else:
                self.out.bg_colors.append({"colors": self.record, "opacity": number(kw.get("opacity"), 0.1)})
        if i >= 0:
            self.record[i] = string(self.argument(args, 0)) if "when" not in kw or truthy(kw["when"]) else None
        return 0.0


class Alert(Site):
    def __call__(self, i, kw, args):
        title, message = self.lock("title", kw.get("title")), self.lock("message", string(kw.get("message")))
        if self.record is None:
            self.record = {"title": f"Alert {len(self.out.alerts) + 1}" if title is None else title, "message": message, "values": self.out.column(0.0)}
            if message is not None and "{{" in message:
                self.record["messages"] = self.out.column(None)
            self.out.alerts.append(self.record)
        if i >= 0 and truthy(self.argument(args, 0)):
            self.record["values"][i] = 1.0
            if "messages" in self.record:
                self.record["messages"][i] = alert_text(message, self.out.tape, i)
        return 0.0


    def put(self, i, v, kw, rest):
        return self(i, kw, [v, *rest]) if truthy(v) else 0.0


class Drawing(Site):
    def __call__(self, i, kw, args):
        label, out = self.node.name == "label.new", self.out
        points = [num(self.argument(args, k)) for k in range(2 if label else 4)]
        if i < 0 or "when" in kw and not truthy(kw["when"]) or not all(map(finite, points)):
            return 0.0
        color, width = string(kw.get("color"), GREY), number(kw.get("width"), 1.0)
        if label:
            t = self.argument(args, 2)
            shown = t if isinstance(t, str) else number_text(t) if isinstance(t, float) else ""
            out.labels.append({"x": points[0], "y": points[1], "text": shown, "color": color, "textColor": string(kw.get("textcolor")), "style": string(kw.get("style"), "down"), "size": number(kw.get("size"), 10.0)})
            return 0.0
        record = dict(zip(("x1", "y1", "x2", "y2"), points)) | {"color": color}
        if self.node.name == "line.new":
            out.lines.append(record | {"width": width, "lineStyle": string(kw.get("style"), "solid")})
        else:
            out.boxes.append(record | {"bgColor": string(kw.get("bgcolor")), "width": width})
        return 0.0


class Trader(Site):
    def __call__(self, i, kw, args):
        ledger = self.out.ledger
        if self.node.name == "strategy.config":
            ledger.configure(kw)
            return 0.0
        ledger.used = True
        if i >= 0:
            try:
                when, order = order_of(args, kw, self.node.name == "strategy.buy")
            except ValueError as e:
                self.fail(str(e))
            if order is not None and truthy(when):
                ledger.place(self.node.uid, order, i)
        return 0.0


class Input(Site):
    """A declared input: resolved on the first bar, constant after."""

    def __call__(self, i, kw, args):
        if self.record is None:
            out, kind = self.out, {"input": "float"}.get(self.node.name, self.node.name.removeprefix("input."))
            label = kw.get("title", string(self.argument(args, 1), f"Input {len(out.inputs) + 1}"))
            taken, key, k = {r["key"] for r in out.inputs}, label, 2
            while key in taken:
                key, k = f"{label} ({k})", k + 1
            default, value, extra = getattr(self, f"_{kind}")(self.argument(args, 0), out.given.get(key), kw)
            self.record = {"key": key, "label": label, "type": kind, "default": default, "value": value, **extra, "tooltip": string(kw.get("tooltip"))}
            out.inputs.append(self.record)
        return self.record["value"]

    def _float(self, default, given, kw, whole=False):
        default = number(default, 0.0)
        v = float(given) if isinstance(given, (int, float)) and not isinstance(given, bool) else default
        v = round_half_up(v) if whole else v
        low, high = number(kw.get("minval")), number(kw.get("maxval"))
        v = v if low is None else NAN if low != low or v != v else max(low, v)
        v = v if high is None else NAN if high != high or v != v else min(high, v)
        return default, v, {k: kw[k] for k in ("minval", "maxval", "step") if k in kw}

    def _int(self, default, given, kw):
        return self._float(default, given, kw, True)

    def _bool(self, default, given, kw):
        default = 1.0 if truthy(default) else 0.0
        return default, (1.0 if truthy(float(given)) else 0.0) if isinstance(given, (bool, int, float)) else default, {}

    def _string(self, default, given, kw):
        default, listed = string(default, ""), string(kw.get("options"))
        options = None if listed is None else [o.strip() for o in listed.split(",") if o.strip()]
        v = string(given, default)
        return default, v if options is None or v in options else default, {"options": options}

    def _time(self, default, given, kw):
        default = string(default, "")
        raw = string(given, default)
        return default, calendar.from_text(raw, self.out.tz), {"text": raw}


SITES = {
    "study": Study, "plot": Plot, "hline": Level, "fill": Fill, "plotshape": Shape, "plotbuy": Trade, "plotsell": Trade, "infopanel": Panel,
    "barcolor": Paint, "bgcolor": Paint, "alertcondition": Alert, "line.new": Drawing, "label.new": Drawing, "box.new": Drawing,
    "strategy.buy": Trader, "strategy.sell": Trader, "strategy.config": Trader,
    **dict.fromkeys(("input", "input.int", "input.float", "input.bool", "input.string", "input.time"), Input),
}

"""The fold tier's code generator: a script becomes one Python function that runs all bars of a tape.

Script variables become locals of that function, user functions are specialised per call path (so each path owns its
indicators), and expressions whose operands are known to be numbers become plain float arithmetic. The generated code
is cached per script; nothing is interpreted per bar.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from tapeloom.functions import builtins as lib, calendar
from tapeloom.functions.text import Series, round_half_up
from tapeloom.operators.outputs import SITES, Outputs
from tapeloom.plans.syntax import Function, Node, Program, ScriptError, blocks, expressions, parse, walk

NAN = math.nan
MAX_LOOPS = 100_000
COLUMNS = ("open", "high", "low", "close", "volume", "time", "hl2", "hlc3", "ohlc4")
NOW = ("current_datetime", "date_today", "market_open", "market_close")
TRADING = tuple(f"strategy.{s}" for s in ("position_size", "avg_price", "open_pnl", "realized_pnl", "equity", "trades", "wins", "losses"))
SCALARS = (*NOW, "pi", "barstate.isfirst", "barstate.islast", *TRADING)
BUILT_IN = frozenset((*COLUMNS, "bar_index", *SCALARS))


# -- run-time helpers that generated code calls


class Unset:
    """A variable that has no value yet."""


UNSET = Unset()


def back(k) -> int:
    """A history offset as bars back; -1 where there is none."""
    if not isinstance(k, float):
        raise ScriptError("a history offset must be a number")
    return -1 if k != k or math.isinf(k) else int(round_half_up(k))


def column_at(column: list, i: int, k):
    k = back(k)
    return column[i - k] if 0 <= k <= i else NAN


def variable_at(history: list, i: int, k, now):
    k = back(k)
    return now if k == 0 else history[i - k] if 0 < k <= i else NAN


def scalar_at(i: int, k, now):
    return now if 0 <= back(k) <= i else NAN


def buffered(held: dict, i: int, now, k):
    held[i] = now
    k = back(k)
    return held.get(i - k, NAN) if 0 <= k <= i else NAN


def pick(test, yes, no):
    return yes if lib.truthy(test) else no


def after(_kwargs, f, *args):
    """Keyword arguments are evaluated first; functions without any ignore them."""
    return f(*args)


def fail(message: str, line: int):
    raise ScriptError(message, line)


def bounds(start, stop, step):
    """Values of a for loop's counter."""
    if not all(isinstance(x, float) for x in (start, stop, step)):
        raise ScriptError("loop bounds must be numbers")
    if step == 0:
        raise ScriptError("a loop step must not be zero")
    while start <= stop if step > 0 else start >= stop:
        yield start
        start += step


def derived(t: lib.Tape) -> dict[str, list]:
    hl = list(zip(t.high, t.low, t.close, t.open))
    return {
        "open": t.open, "high": t.high, "low": t.low, "close": t.close, "volume": t.volume, "time": t.date,
        "hl2": [(h + l) / 2 for h, l, _, _ in hl], "hlc3": [(h + l + c) / 3 for h, l, c, _ in hl], "ohlc4": [(o + h + l + c) / 4 for h, l, c, o in hl],
    }


class Resampled:
    """A call of security: the aggregate tape, and the value of its last closed bar."""

    def __init__(self, run: Run):
        self.run, self.env = run, lib.Env(lib.Tape(), run.env.tz)
        self.columns = {**derived(self.env.tape)}
        self.columns |= {"open": self.env.tape.open, "high": self.env.tape.high, "low": self.env.tape.low, "close": self.env.tape.close, "volume": self.env.tape.volume, "time": self.env.tape.date}
        self.frame, self.open, self.value = None, None, NAN

    def __call__(self, i: int, frame, evaluate):
        if self.frame is None:
            self.key = frame_key(frame, self.run.env.tz)
            self.frame = frame
        elif frame != self.frame:
            raise ScriptError("security: the timeframe must not change between bars")
        if i < 0:
            return NAN
        t = self.run.env.tape
        key = self.key(t.date[i])
        if self.open is not None and key != self.open[0]:
            self._close()
            self.value = evaluate(len(self.env.tape) - 1)
        if self.open is None:
            self.open = [key, t.date[i], t.open[i], t.high[i], t.low[i], t.close[i], t.volume[i]]
        else:
            b = self.open
            b[3], b[4] = (t.high[i] if t.high[i] > b[3] else b[3]), (t.low[i] if t.low[i] < b[4] else b[4])
            b[5], b[6] = t.close[i], b[6] + t.volume[i]
        return self.value

    def _close(self) -> None:
        _, date, o, h, l, c, v = self.open
        for name, x in zip(COLUMNS, (o, h, l, c, v, date, (h + l) / 2, (h + l + c) / 3, (o + h + l + c) / 4)):
            self.columns[name].append(x)
        self.open = None


def frame_key(frame, tz):
    """The bucket of a time under a timeframe."""
    m = re.fullmatch(r"(\d+)([mhdw])", frame) if isinstance(frame, str) else None
    count = int(m[1]) if m else 0
    if not m or count < 1 or m[2] in "dw" and m[1] != "1":
        raise ScriptError("security: the timeframe is like 5m, 4h, 1d or 1w")
    if m[2] in "mh":
        span = count * (60_000.0 if m[2] == "m" else 3_600_000.0)
        return lambda t: t // span
    anchor = "session" if m[2] == "d" else "week"
    return lambda t: calendar.anchor_key(anchor, t, tz)


class Run:
    """What a generated function needs: the tape, outputs and makers of call sites."""

    def __init__(self, tape: lib.Tape, tz, session, inputs):
        self.env, self.n = lib.Env(tape, tz), len(tape)
        self.out = Outputs(tape, tz, inputs)
        self.columns = derived(tape) if self.n else {c: [NAN] for c in COLUMNS}
        self.now = calendar.now_scalars(tape.date[-1] if self.n else NAN, tz, session)
        self.bars = range(self.n) if self.n else (-1,)

    def stateful(self, name: str, env: lib.Env | None = None):
        return lib.STATEFUL[name](env or self.env)

    def zoned(self, name: str):
        f, tz = lib.ZONED[name], self.env.tz
        return lambda *a: f(tz, *a)

    def site(self, node: Node):
        return SITES[node.name](self.out, node)


_RUNTIME = {
    "nan": NAN, "inf": math.inf, "UNSET": UNSET, "column_at": column_at, "variable_at": variable_at, "scalar_at": scalar_at, "buffered": buffered,
    "pick": pick, "after": after, "fail": fail, "bounds": bounds, "truthy": lib.truthy, "plus": lib.plus, "divide": lib.divide, "remainder": lib.remainder,
    "same": lib.same, "num": lib.num, "fixed_send": lib.fixed_send, "Resampled": Resampled, "MAX_LOOPS": MAX_LOOPS, "Series": Series, "float": float, "len": len,
}


class Code(str):
    """Generated expression; `number`: surely a float; `test`: its Python truth form, if there is one; `pure`: no effects."""

    number: bool
    test: str | None
    pure: bool

    def __new__(cls, s: str, number: bool = False, pure: bool = False, test: str | None = None):
        c = super().__new__(cls, s)
        c.number, c.pure, c.test = number, pure, test
        return c

    @property
    def f(self) -> str:
        return str(self) if self.number else f"num({self})"

    @property
    def truth(self) -> str:
        return self.test or f"truthy({self})"


class Scope:
    """Names of a block, function or the script. kinds: plain, var, loop."""

    def __init__(self, parent: Scope | None = None, barrier: bool = False):
        self.parent, self.barrier, self.names = parent, barrier, {}


class Generator:
    def __init__(self, program: Program, dynamic: set[str]):
        self.p, self.dynamic, self.found = program, dynamic, set()  # found: variables that turn out not to be numbers
        self.lines: list[str] = []
        self.setup: list[str] = []
        self.functions: list[str] = []
        self.nodes: list[Node] = []
        self.k, self.indent = 0, 2
        self.script = Scope()
        self.mode: str | None = None  # the security call an expression stands in
        self.history: set[str] = set()
        self.used_columns: set[str] = set()
        self.shared: set[str] = set()  # script variables that functions write
        self.trading = any(x.kind in ("call", "name") and x.name.startswith("strategy.") for e in _everything(program) for x in walk(e))
        self.looping = any(s.kind in ("for", "while") for s in statements(program))
        self.path: list[str] = []

    def fresh(self, prefix: str) -> str:
        self.k += 1
        return f"{prefix}{self.k}"

    def emit(self, line: str) -> None:
        self.lines.append("    " * self.indent + line)

    # -- script

    def source(self) -> str:
        for s in self.p.body:
            self.statement(s, self.script)
        body = self.lines
        head = ["def run(rt):"]
        head += [f"    c_{c} = rt.columns[{c!r}]" for c in sorted(self.used_columns)]
        head += [f"    now_{s} = rt.now[{s!r}]" for s in NOW]
        head += ["    last, ledger = rt.n - 1, rt.out.ledger", "    loops = 0", "    i = 0", f"    {', '.join(_trading(t) for t in TRADING)} = 0.0, nan, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0"]
        head += [f"    h_{v} = []" for v in sorted(self.history)]
        head += [f"    {name} = UNSET" for name in sorted({n for n, _ in self.script.names.values()})]
        loop = ["    for i in rt.bars:"]
        if self.trading:
            loop += ["        if i >= 0:", "            ledger.before(i)", f"            {', '.join(_trading(t) for t in TRADING)} = ledger.sources(i)"]
        if self.looping:
            loop.append("        loops = 0")
        tail = []
        if self.trading:
            tail += ["        if i >= 0:", "            ledger.after(i)"]
        tail += [f"        h_{v}.append(nan if v_{v} is UNSET else v_{v})" for v in sorted(self.history)]
        return "\n".join(head + self.setup + self.functions + loop + (body or ["        pass"]) + tail) + "\n"

    # -- statements

    def block(self, body: list[Node], scope: Scope) -> None:
        self.indent += 1
        if not body:
            self.emit("pass")
        for s in body:
            self.statement(s, scope)
        self.indent -= 1

    def opened(self, scope: Scope, body: list[Node]) -> Scope:
        """A block's scope; names that it declares with = start unset on entry."""
        inner = Scope(scope)
        for name in dict.fromkeys(s.name for s in body if s.kind == "assign"):
            inner.names[name] = (self.fresh("b_"), "local")
            self.emit(f"{inner.names[name][0]} = UNSET")
        return inner

    def statement(self, s: Node, scope: Scope) -> None:
        getattr(self, f"do_{s.kind}")(s, scope)

    def do_expr(self, s, scope):
        self.emit(str(self.expression(s.value, scope)))

    def do_assign(self, s, scope):
        if s.name in BUILT_IN:
            return self.emit(f"fail('{s.name} is built in', {s.line})")
        value = self.expression(s.value, scope)
        if scope is self.script:
            if scope.names.get(s.name, ("", ""))[1] == "var":
                return self.emit(f"fail('{s.name} is a var; use :=', {s.line})")
            scope.names.setdefault(s.name, (f"v_{s.name}".replace(".", "ǀ"), "plain"))
        elif scope.names.get(s.name, ("", ""))[1] == "var":
            return self.emit(f"fail('{s.name} is a var; use :=', {s.line})")
        elif s.name not in scope.names:
            scope.names[s.name] = (self.fresh("b_"), "local")
        self.note(s.name, scope.names[s.name][0], value)
        self.emit(f"{scope.names[s.name][0]} = {value}")

    def do_var(self, s, scope):
        if s.name in BUILT_IN or scope.names.get(s.name, ("", "var"))[1] != "var":
            return self.emit(f"fail('{s.name} is already declared', {s.line})")
        if s.name in scope.names and scope is self.script:
            return self.emit(f"fail('{s.name} is already declared', {s.line})")
        name = f"v_{s.name}".replace(".", "ǀ") if scope is self.script else self.fresh("p_")
        if scope is not self.script:
            self.setup.append(f"    {name} = UNSET")
            self.persistent(name)
        value = self.expression(s.value, scope)
        scope.names[s.name] = (name, "var")
        self.note(s.name, name, value)
        self.emit(f"if {name} is UNSET:")
        self.emit(f"    {name} = {value}")

    def do_update(self, s, scope):
        value = self.expression(s.value, scope)
        targets = self.targets(s.name, scope)
        if not targets:
            return self.emit(f"fail('{s.name} is not declared', {s.line})")
        t = self.fresh("t_") if len(targets) > 1 else None
        if t:
            self.emit(f"{t} = {value}")
        for k, (name, kind) in enumerate(targets):
            self.note(s.name, name, value)
            self.outer(name)
            if len(targets) == 1:
                self.emit(f"{name} = {value}")
            elif k == len(targets) - 1:
                self.emit(f"else: {name} = {t}")
            else:
                self.emit(f"{'el' if k else ''}if {name} is not UNSET: {name} = {t}")

    def targets(self, name: str, scope: Scope) -> list[tuple[str, str]]:
        """Bindings that a name may have here, nearest first, up to the first that surely exists."""
        out: list[tuple[str, str]] = []
        while scope is not None:
            if name in scope.names:
                out.append(scope.names[name])
                if scope.names[name][1] != "local":
                    return out
            loop = getattr(scope, "loop", None)
            if loop and loop[0] == name:
                return [*out, (loop[1], "loop")]
            scope = self.script if scope.barrier else scope.parent
        return out

    def note(self, name: str, at: str, value: Code) -> None:
        if not value.number:
            self.found.add(at)

    def outer(self, name: str) -> None:
        if self.path and not name.startswith("b_") or self.path and name in self.captured[-1]:
            self.writes[-1].add(name)

    def persistent(self, name: str) -> None:
        if self.path:
            self.writes[-1].add(name)

    def do_if(self, s, scope):
        depth = 0
        for test, body in s.arms:
            self.emit(f"if {self.expression(test, scope).truth}:")
            self.indent += 1
            inner = self.opened(scope, body)
            self.indent -= 1
            self.block(body, inner)
            self.emit("else:")
            self.indent += 1
            depth += 1
        if s.other is not None:
            inner = self.opened(scope, s.other)
            self.indent -= 1
            self.block(s.other, inner)
            self.indent += 1
        else:
            self.emit("pass")
        self.indent -= depth

    def count(self, line: int) -> None:
        if self.path:
            self.writes[-1].add("loops")
        self.emit("loops += 1")
        self.emit(f"if loops > MAX_LOOPS: fail('too many loop iterations', {line})")

    def do_for(self, s, scope):
        start, stop = self.expression(s.start, scope), self.expression(s.stop, scope)
        step = self.expression(s.step, scope) if s.step is not None else "1.0"
        inner = self.opened(scope, s.body)
        counter = self.fresh("b_")
        inner.loop = (s.name, counter)
        self.emit(f"for {counter} in bounds({start}, {stop}, {step}):")
        self.indent += 1
        self.count(s.line)
        self.indent -= 1
        self.block(s.body, inner)

    def do_while(self, s, scope):
        self.emit("while True:")
        self.indent += 1
        self.emit(f"if not {self.expression(s.test, scope).truth}: break")
        self.count(s.line)
        inner = self.opened(scope, s.body)
        self.indent -= 1
        self.block(s.body, inner)

    def do_switch(self, s, scope):
        subject = self.fresh("t_")
        self.emit(f"{subject} = {self.expression(s.subject, scope)}")
        depth, default = 0, None
        for test, body in s.arms:
            if test is None:
                default = body
                continue
            self.emit(f"if same({subject}, {self.expression(test, scope)}):")
            self.indent += 1
            inner = self.opened(scope, [body])
            self.indent -= 1
            self.block([body], inner)
            self.emit("else:")
            self.indent += 1
            depth += 1
        if default is not None:
            inner = self.opened(scope, [default])
            self.statement(default, inner)
        else:
            self.emit("pass")
        self.indent -= depth

    def do_break(self, s, scope):
        self.emit("break")

    def do_continue(self, s, scope):
        self.emit("continue")

    # -- expressions

    @property
    def index(self) -> str:
        return "i" if self.mode is None else "j"

    def column(self, name: str) -> str:
        if self.mode is None:
            self.used_columns.add(name)
            return f"c_{name}"
        return f"{self.mode}.columns[{name!r}]"

    def expression(self, e: Node, scope: Scope) -> Code:
        return getattr(self, f"on_{e.kind}")(e, scope)

    def on_num(self, e, scope):
        v = e.value
        return Code("nan" if v != v else "inf" if math.isinf(v) else repr(v), True, True)

    def on_str(self, e, scope):
        return Code(repr(e.value), False, True)

    def on_name(self, e, scope):
        name = e.name
        bound = self.targets(name, scope)
        if bound:
            last, kind = bound[-1]
            number = all(self.is_number(n) for n, _ in bound)
            if kind == "local" or len(bound) > 1 and kind != "loop" and last.startswith("b_"):
                out = f"fail('{name} is not defined', {e.line})" if name not in BUILT_IN else str(self.builtin(name))
                chain = bound
            else:
                out, chain = last, bound[:-1]
            for n, _ in reversed(chain):
                out = f"({n} if {n} is not UNSET else {out})"
            return Code(out, number, True)
        if name in BUILT_IN:
            return self.builtin(name)
        return Code(f"fail('unknown variable {name}', {e.line})")

    def is_number(self, at: str) -> bool:
        return at not in self.dynamic

    def builtin(self, name: str) -> Code:
        if name == "bar_index":
            return Code(f"(float({self.index}) if {self.index} >= 0 else nan)", True, True)
        if name in COLUMNS:
            return Code(f"{self.column(name)}[{self.index}]", True, True)
        return Code({"pi": repr(math.pi), "barstate.isfirst": "(1.0 if i == 0 else 0.0)", "barstate.islast": "(1.0 if i == last and i >= 0 else 0.0)"}.get(name) or (f"now_{name}" if name in NOW else _trading(name)), True, True)

    def on_unary(self, e, scope):
        v = self.expression(e.arg, scope)
        if e.op == "-":
            return Code(f"(-{v.f})", True, v.pure)
        return Code(f"(0.0 if {v.truth} else 1.0)", True, v.pure, f"(not {v.truth})")

    def on_binary(self, e, scope):
        a, b = self.expression(e.left, scope), self.expression(e.right, scope)
        pure, op = a.pure and b.pure, e.op
        if op == "+":
            return Code(f"({a} + {b})", True, pure) if a.number and b.number else Code(f"plus({a}, {b})", False, pure)
        if op in "-*":
            return Code(f"({a.f} {op} {b.f})", True, pure)
        if op in "/%":
            return Code(f"{'divide' if op == '/' else 'remainder'}({a.f}, {b.f})", True, pure)
        if op in ("and", "or"):
            test = f"(({a.truth}) {'&' if op == 'and' else '|'} ({b.truth}))"  # both sides always run
        elif op in ("==", "!="):
            test = f"({a} {op} {b})" if a.number and b.number else f"(same({a}, {b}) {'==' if op == '==' else '!='} 1.0)"
        else:
            test = f"({a.f} {op} {b.f})"
        return Code(f"(1.0 if {test} else 0.0)", True, pure, test)

    def on_pick(self, e, scope):
        test, yes, no = (self.expression(x, scope) for x in (e.test, e.yes, e.no))
        number = yes.number and no.number
        if yes.pure and no.pure:
            return Code(f"({yes} if {test.truth} else {no})", number, test.pure)
        return Code(f"pick({test}, {yes}, {no})", number)

    def on_history(self, e, scope):
        k, of, i = self.expression(e.back, scope), e.of_, self.index
        if of.kind == "name":
            bound = self.targets(of.name, scope)
            if not bound and of.name in COLUMNS:
                if e.back.kind == "num" and e.back.value == e.back.value and 0 <= e.back.value < 1e9:
                    n = int(round_half_up(e.back.value))
                    return Code(f"({self.column(of.name)}[{i} - {n}] if {i} >= {n} else nan)", True, True)
                return Code(f"column_at({self.column(of.name)}, {i}, {k})", True, True)
            if not bound and of.name == "bar_index":
                return Code(f"variable_at(range({i} + 1), {i}, {k}, float({i})) * 1.0", True)
            if not bound and of.name in BUILT_IN:
                return Code(f"scalar_at({i}, {k}, {self.builtin(of.name)})", True)
            if bound and bound[0][0].startswith("v_"):
                name = bound[0][0][2:]
                self.history.add(name)
                return Code(f"variable_at(h_{name}, {i}, {k}, {bound[0][0]})", self.is_number(bound[0][0]))
        value = self.expression(of, scope)
        held = self.fresh("x_")
        self.setup.append(f"    {held} = {{}}")
        return Code(f"buffered({held}, {i}, {value}, {k})", value.number)

    def on_call(self, e, scope):
        name, i = e.name, self.index
        if name in self.p.functions:
            return self.user_call(self.p.functions[name], e, scope)
        if name == "security":
            return self.security(e, scope)
        fast = self.fast_call(e, scope)
        if fast is not None:
            return fast
        kw = "{" + ", ".join(f"{k!r}: {self.expression(v, scope)}" for k, v in e.kwargs.items()) + "}"
        args = [self.expression(a, scope) for a in e.args]
        listed = f"[{', '.join(args)}]"
        if name in SITES:
            self.nodes.append(e)
            site = self.fresh("d_")
            self.setup.append(f"    {site} = rt.site(nodes[{len(self.nodes) - 1}])")
            return Code(f"{site}(i, {kw}, {listed})", name.startswith("input") and name != "input.string" or name not in ("plot", "hline") and not name.startswith("input"))
        if name in lib.STATEFUL:
            site = self.fresh("s_")
            self.setup.append(f"    {site} = rt.stateful({name!r}{'' if self.mode is None else f', {self.mode}.env'})")
            return Code(f"after({kw}, {site}, {i}, {listed})" if e.kwargs else f"{site}({i}, {listed})", name in lib.NUMERIC)
        if name in lib.PURE or name in lib.ZONED:
            f = "f_" + name.replace(".", "_")
            line = f"    {f} = rt.zoned({name!r})" if name in lib.ZONED else f"    {f} = PURE[{name!r}]"
            if line not in self.setup:
                self.setup.append(line)
            number = name in lib.NUMERIC or name == "nz" and all(a.number for a in args) or name == "iff" and all(a.number for a in args[1:])
            if e.kwargs:
                return Code(f"after({kw}, {', '.join([f, *args])})", number)
            return Code(f"{f}({', '.join(args)})", number, all(a.pure for a in args) and not name.startswith("array."))
        return Code(f"fail('unknown function {name}', {e.line})")

    def fast_call(self, e: Node, scope: Scope) -> Code | None:
        """Calls whose settings or styles are literals skip the per-bar checks; inputs are read once."""
        name, literal = e.name, lambda n: n.kind in ("num", "str")
        if name.startswith("input") and name in SITES and self.mode is None and not self.path and all(literal(n) for n in [*e.args, *e.kwargs.values()]):
            self.nodes.append(e)
            site, held = self.fresh("d_"), self.fresh("in_")
            self.setup += [f"    {site} = rt.site(nodes[{len(self.nodes) - 1}])", f"    {held} = UNSET"]
            kw = "{" + ", ".join(f"{k!r}: {self.expression(v, scope)}" for k, v in e.kwargs.items()) + "}"
            args = ", ".join(self.expression(a, scope) for a in e.args)
            return Code(f"({held} if {held} is not UNSET else ({held} := {site}(i, {kw}, [{args}])))", name != "input.string", True)
        if not e.args or not all(literal(n) for n in [*e.args[1:], *e.kwargs.values()]):
            return None
        if name in ("plot", "plotshape", "plotbuy", "plotsell", "alertcondition"):
            self.nodes.append(e)
            push = self.fresh("d_")
            kw = "{" + ", ".join(f"{k!r}: {self.expression(v, scope)}" for k, v in e.kwargs.items()) + "}"
            rest = ", ".join(self.expression(a, scope) for a in e.args[1:])
            self.setup.append(f"    {push} = rt.site(nodes[{len(self.nodes) - 1}]).freeze({kw}, [{rest}])")
            return Code(f"{push}(i, {self.expression(e.args[0], scope)})", name != "plot")
        if name in lib.STATEFUL and not e.kwargs:
            settings = [n.value for n in e.args[1:]]
            if lib.fixed_send(name, settings) is not None:
                send = self.fresh("s_")
                self.setup.append(f"    {send} = fixed_send({name!r}, [{', '.join(str(self.on_num(n, scope)) if n.kind == 'num' else repr(n.value) for n in e.args[1:])}])")
                return Code(f"{send}({self.expression(e.args[0], scope).f})", True)
        return None

    def user_call(self, f: Function, e: Node, scope: Scope) -> Code:
        """A copy of the function for this call path."""
        args = [self.expression(a, scope) for a in e.args]
        name = self.fresh("f_")
        inner = Scope(None, barrier=True)
        params = []
        for p, a in zip(f.params, args):
            at = self.fresh("b_")
            params.append(at)
            inner.names[p] = (at, "param")
            if not a.number:
                self.found.add(at)
                self.dynamic.add(at)
        lines, indent = self.lines, self.indent
        self.lines, self.indent = [], 2
        self.path.append(name)
        self.writes.append(set())
        self.captured.append(set())
        for n in dict.fromkeys(s.name for s in f.body if s.kind == "assign" and s.name not in f.params):
            inner.names[n] = (self.fresh("b_"), "local")
            self.emit(f"{inner.names[n][0]} = UNSET")
        for s in f.body:
            self.statement(s, inner)
        out = self.expression(f.result, inner)
        self.emit(f"return {out}")
        writes = self.writes.pop()
        self.captured.pop()
        self.path.pop()
        body = self.lines
        self.lines, self.indent = lines, indent
        outer = sorted(w for w in writes)
        first = ["j"] if self.mode is not None else []
        self.functions += [f"    def {name}({', '.join(first + params)}):", *([f"        nonlocal {', '.join(outer)}"] if outer else []), *body]
        return Code(f"{name}({', '.join(first + args)})", out.number)

    def security(self, e: Node, scope: Scope) -> Code:
        if len(e.args) < 2:
            return Code(f"fail('security takes a timeframe and an expression', {e.line})")
        frame = self.expression(e.args[0], scope)
        site, name = self.fresh("q_"), self.fresh("e_")
        self.setup.append(f"    {site} = Resampled(rt)")
        self.mode = site
        value = self.expression(e.args[1], scope)
        self.mode = None
        self.functions += [f"    def {name}(j):", f"        return {value}"]
        return Code(f"{site}(i, {frame}, {name})", value.number)

    writes: list[set[str]] = []
    captured: list[set[str]] = []


def _trading(name: str) -> str:
    return name.replace("strategy.", "st_")


def statements(p: Program):
    """All statements of a program, inside blocks and functions too."""
    todo = [*p.body, *(s for f in p.functions.values() for s in f.body)]
    while todo:
        s = todo.pop()
        yield s
        for b in blocks(s):
            todo += b


def _everything(p: Program):
    for s in statements(p):
        for e, _ in expressions(s):
            yield e
    for f in p.functions.values():
        yield f.result


@lru_cache(maxsize=256)
def compiled(source: str):
    """(function of a Run, generated text). Types of variables are found by trying numbers first and widening."""
    program = parse(source)
    dynamic: set[str] = set()
    while True:
        g = Generator(program, set(dynamic))
        g.writes, g.captured = [], []
        try:
            code = g.source()
        except RecursionError:
            raise ScriptError("nested too deeply") from None
        if g.found <= dynamic:
            break
        dynamic |= g.found
    space = dict(_RUNTIME) | {"nodes": g.nodes, "PURE": lib.PURE, "range": range}
    exec(compile(code, "<script>", "exec"), space)  # the text is generated from the syntax tree, never taken from the script
    return space["run"], code


def run_tape(source: str, tape: lib.Tape, options: dict | None = None) -> Outputs | dict:
    """The result record of one tape: all-or-nothing, with the error's text in it."""
    options = options or {}
    run = None
    try:
        run = Run(tape, calendar.zone(options.get("timezone")), options.get("session"), options.get("inputs"))
        compiled(source)[0](run)
        if not run.out.drew():
            raise ScriptError("the script draws nothing")
        return run.out.as_dict()
    except ScriptError as e:
        error = str(e)
    except (NameError, TypeError) as e:
        error = f"a value is used before it is set or has the wrong kind: {e}"
    except RecursionError:
        error = "nested too deeply"
    except (ValueError, ArithmeticError) as e:
        error = f"a value is out of range: {e}"
    out = run.out if run is not None else Outputs(lib.Tape(), None, None)
    return out.as_dict(error)



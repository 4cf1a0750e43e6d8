"""Front end of the script language: tokens, syntax tree and static checks. Pure Python, runs on the driver and in workers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache


class ScriptError(Exception):
    """Any lexical, parse, validation or run-time error of a script."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line else message)


@dataclass(slots=True)
class Token:
    kind: str  # num str id op nl indent dedent end
    value: object
    line: int
    start: int  # UTF-16 offsets in the source
    end: int


@dataclass(slots=True)
class Node:
    """Expression or statement; `kind` says which fields of `of` there are."""

    kind: str
    line: int
    of: dict = field(default_factory=dict)
    uid: int = 0

    def __getattr__(self, name):
        try:
            return self.of[name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass(slots=True)
class Function:
    name: str
    params: list[str]
    body: list[Node]
    result: Node
    line: int


@dataclass(slots=True)
class Program:
    body: list[Node]
    functions: dict[str, Function]


#: Words of the language.
RESERVED = frozenset("var if else for while switch break continue".split())
TOP_ONLY = frozenset("study plot hline fill plotshape plotbuy plotsell infopanel barcolor bgcolor alertcondition line.new label.new box.new strategy.buy strategy.sell strategy.config security input input.int input.float input.bool input.string input.time".split())
MAX_DEPTH = 500
_LEX = re.compile(r"""(?P<skip>[ \t\r]+|//[^\n]*)|(?P<nl>\n)|(?P<num>[0-9][0-9.]*|\.[0-9][0-9.]*)|(?P<str>"[^"]*"|'[^']*')|(?P<id>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>==|!=|<=|>=|:=|=>|[-+*/%<>()\[\],=?:])""")


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, depth, levels, fresh = 0, 1, 0, [0], True
    wide = [0]  # UTF-16 offset of each character
    for ch in source:
        wide.append(wide[-1] + (2 if ord(ch) > 0xFFFF else 1))
    while at < len(source):
        if fresh and depth == 0:
            stop, column = at, 0
            while stop < len(source) and source[stop] in " \t\r":
                column += 4 if source[stop] == "\t" else source[stop] == " "
                stop += 1
            blank = stop >= len(source) or source[stop] == "\n" or source.startswith("//", stop)
            if not blank:
                if column > levels[-1]:
                    levels.append(column)
                    out.append(Token("indent", None, line, wide[stop], wide[stop]))
                while column < levels[-1]:
                    levels.pop()
                    out.append(Token("dedent", None, line, wide[stop], wide[stop]))
                if column != levels[-1]:
                    raise ScriptError("dedent to no enclosing level", line)
            fresh, at = False, stop
            continue
        m = _LEX.match(source, at)
        if not m:
            raise ScriptError("unterminated string" if source[at] in "\"'" else f"unexpected character {source[at]!r}", line)
        kind, text = m.lastgroup, m.group()
        where = (line, wide[at], wide[m.end()])
        if kind == "nl":
            if depth == 0 and out and out[-1].kind not in ("nl", "indent", "dedent"):
                out.append(Token("nl", None, *where))
            line, fresh = line + 1, depth == 0
        elif kind == "num":
            if text.count(".") > 1:
                raise ScriptError(f"malformed number {text}", line)
            out.append(Token("num", float(text), *where))
        elif kind == "str":
            out.append(Token("str", text[1:-1], *where))
            line += text.count("\n")
        elif kind == "id":
            out.append(Token("id", text, *where))
        elif kind == "op":
            depth = max(0, depth + (text in "([") - (text in ")]"))
            out.append(Token("op", text, *where))
        at = m.end()
    end = (line, wide[-1], wide[-1])
    if out and out[-1].kind != "nl":
        out.append(Token("nl", None, *end))
    out += [Token("dedent", None, *end) for _ in levels[1:]]
    out.append(Token("end", None, *end))
    return out


#: Binary operators by rising strength.
LEVELS = (("or",), ("and",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


class Parser:
    def __init__(self, source: str):
        self.t, self.k, self.depth, self.uid = tokens(source), 0, 0, 0
        self.functions: dict[str, Function] = {}

    # -- token helpers
    def peek(self, ahead: int = 0) -> Token:
        return self.t[min(self.k + ahead, len(self.t) - 1)]

    def take(self) -> Token:
        tok = self.peek()
        self.k += 1
        return tok

    def at(self, value: str, ahead: int = 0) -> bool:
        tok = self.peek(ahead)
        return tok.kind in ("op", "id") and tok.value == value

    def need(self, value: str) -> Token:
        if not self.at(value):
            raise ScriptError(f"expected {value!r}", self.peek().line)
        return self.take()

    def name(self) -> str:
        tok = self.take()
        if tok.kind != "id" or tok.value in RESERVED or tok.value in ("and", "or", "not", "true", "false"):
            raise ScriptError("expected a name", tok.line)
        return tok.value

    def node(self, kind: str, line: int, **of) -> Node:
        self.uid += 1
        return Node(kind, line, of, self.uid)

    def end_of_line(self) -> None:
        if self.peek().kind in ("dedent", "end"):
            return
        if self.peek().kind != "nl":
            raise ScriptError("expected the end of the line", self.peek().line)
        while self.peek().kind == "nl":
            self.take()

    # -- statements
    def program(self) -> Program:
        body: list[Node] = []
        while self.peek().kind != "end":
            if self.peek().kind == "nl":
                self.take()
                continue
            if self.peek().kind in ("indent", "dedent"):
                raise ScriptError("unexpected indentation", self.peek().line)
            if self._is_function():
                self._function()
            else:
                body.append(self.statement())
        return Program(body, self.functions)

    def _is_function(self) -> bool:
        if self.peek().kind != "id" or not self.at("(", 1):
            return False
        k, depth = 1, 0
        while self.peek(k).kind not in ("nl", "end"):
            depth += self.at("(", k) - self.at(")", k)
            if depth == 0:
                return self.at("=>", k + 1)
            k += 1
        return False

    def _function(self) -> None:
        line, name = self.peek().line, self.name()
        self.need("(")
        params: list[str] = []
        while not self.at(")"):
            if params:
                self.need(",")
            params.append(self.name())
        self.take()
        self.need("=>")
        if len(set(params)) < len(params):
            raise ScriptError(f"duplicate parameter of {name}", line)
        if name in self.functions:
            raise ScriptError(f"function {name} is defined twice", line)
        if self.peek().kind == "nl":
            body = self.block()
            if not body or body[-1].kind != "expr":
                raise ScriptError(f"the body of {name} must end in an expression", line)
            result = body.pop().value
        else:
            body, result = [], self.expression()
            self.end_of_line()
        self.functions[name] = Function(name, params, body, result, line)

    def block(self) -> list[Node]:
        line = self.peek().line
        self.end_of_line()
        if self.peek().kind != "indent":
            raise ScriptError("expected an indented block", line)
        self.take()
        self._deeper(line)
        body = []
        while self.peek().kind not in ("dedent", "end"):
            if self.peek().kind == "nl":
                self.take()
                continue
            body.append(self.statement())
        if self.peek().kind == "dedent":
            self.take()
        self.depth -= 1
        return body

    def statement(self, arm: bool = False) -> Node:
        tok = self.peek()
        line = tok.line
        word = tok.value if tok.kind == "id" else None
        if word in ("if", "for", "while", "switch") and arm:
            raise ScriptError("an arm holds a one-line statement", line)
        if word == "if":
            self.take()
            arms, other = [(self.expression(), self.block())], None
            while self.at("else"):
                self.take()
                if self.at("if"):
                    self.take()
                    arms.append((self.expression(), self.block()))
                else:
                    other = self.block()
                    break
            return self.node("if", line, arms=arms, other=other)
        if word == "for":
            self.take()
            name = self.name()
            self.need("=")
            start = self.expression()
            self.need("to")
            stop, step = self.expression(), None
            if self.at("by"):
                self.take()
                step = self.expression()
            return self.node("for", line, name=name, start=start, stop=stop, step=step, body=self.block())
        if word == "while":
            self.take()
            return self.node("while", line, test=self.expression(), body=self.block())
        if word == "switch":
            return self._switch()
        if word == "else":
            raise ScriptError("else without if", line)
        if word in ("break", "continue"):
            self.take()
            out = self.node(word, line)
        elif word == "var":
            self.take()
            name = self.name()
            self.need("=")
            out = self.node("var", line, name=name, value=self.expression())
        elif tok.kind == "id" and (self.at("=", 1) or self.at(":=", 1)):
            name = self.name()
            op = self.take().value
            out = self.node("assign" if op == "=" else "update", line, name=name, value=self.expression())
        else:
            out = self.node("expr", line, value=self.expression())
        self.end_of_line()
        return out

    def _switch(self) -> Node:
        line = self.take().line
        subject = self.expression()
        self.end_of_line()
        if self.peek().kind != "indent":
            raise ScriptError("expected the arms of a switch", line)
        self.take()
        arms: list[tuple[Node | None, Node]] = []
        while self.peek().kind not in ("dedent", "end"):
            if self.peek().kind == "nl":
                self.take()
                continue
            test = None if self.at("=>") else self.expression()
            self.need("=>")
            if test is None and any(t is None for t, _ in arms):
                raise ScriptError("two default arms", self.peek().line)
            arms.append((test, self.statement(arm=True)))
        if self.peek().kind == "dedent":
            self.take()
        if not arms:
            raise ScriptError("a switch without arms", line)
        return self.node("switch", line, subject=subject, arms=arms)

    # -- expressions
    def _deeper(self, line: int) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ScriptError("nested too deeply", line)

    def expression(self) -> Node:
        self._deeper(self.peek().line)
        test = self.binary(0)
        if self.at("?"):
            line = self.take().line
            yes = self.expression()
            self.need(":")
            test = self.node("pick", line, test=test, yes=yes, no=self.expression())
        self.depth -= 1
        return test

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while any(self.at(op) for op in LEVELS[level]):
            tok = self.take()
            left = self.node("binary", tok.line, op=tok.value, left=left, right=self.binary(level + 1))
        return left

    def unary(self) -> Node:
        self._deeper(self.peek().line)
        if self.at("-") or self.at("not"):
            tok = self.take()
            out = self.node("unary", tok.line, op=tok.value, arg=self.unary())
        else:
            out = self.primary()
            while self.at("["):
                line = self.take().line
                k = self.expression()
                self.need("]")
                out = self.node("history", line, of_=out, back=k)
        self.depth -= 1
        return out

    def primary(self) -> Node:
        tok = self.take()
        if tok.kind in ("num", "str"):
            return self.node(tok.kind, tok.line, value=tok.value, span=(tok.start, tok.end))
        if tok.kind == "op" and tok.value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if tok.kind != "id":
            raise ScriptError("expected an expression", tok.line)
        word = tok.value
        if word in ("true", "false"):
            return self.node("num", tok.line, value=1.0 if word == "true" else 0.0, span=(tok.start, tok.end))
        if word == "na" and not self.at("("):
            return self.node("num", tok.line, value=float("nan"), span=(tok.start, tok.end))
        if word in RESERVED or word in ("and", "or", "not"):
            raise ScriptError(f"{word!r} is reserved", tok.line)
        if self.at("("):
            self.take()
            args, kwargs = [], {}
            while not self.at(")"):
                if args or kwargs:
                    self.need(",")
                if self.peek().kind == "id" and self.at("=", 1):
                    key = self.take().value
                    self.take()
                    if key in kwargs:
                        raise ScriptError(f"duplicate argument {key}", tok.line)
                    kwargs[key] = self.expression()
                else:
                    args.append(self.expression())
            self.take()
            return self.node("call", tok.line, name=word, args=args, kwargs=kwargs)
        return self.node("name", tok.line, name=word)


# -- static checks


def children(n: Node) -> list[Node]:
    """Expressions directly inside an expression, in order of evaluation."""
    if n.kind == "binary":
        return [n.left, n.right]
    if n.kind == "unary":
        return [n.arg]
    if n.kind == "pick":
        return [n.test, n.yes, n.no]
    if n.kind == "history":
        return [n.of_, n.back]
    if n.kind == "call":
        return [*n.kwargs.values(), *n.args]
    return []


def walk(n: Node):
    todo = [n]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(children(x))


def expressions(s: Node) -> list[tuple[Node, bool]]:
    """Expressions of a statement itself, and whether each runs exactly once when the statement runs."""
    if s.kind in ("expr", "assign", "update", "var"):
        return [(s.value, True)]
    if s.kind == "if":
        return [(t, True) for t, _ in s.arms]
    if s.kind == "for":
        return [(x, True) for x in (s.start, s.stop, s.step) if x is not None]
    if s.kind == "while":
        return [(s.test, False)]
    if s.kind == "switch":
        return [(s.subject, True), *[(t, False) for t, _ in s.arms if t is not None]]
    return []


def blocks(s: Node) -> list[list[Node]]:
    if s.kind == "if":
        return [b for _, b in s.arms] + ([s.other] if s.other is not None else [])
    if s.kind in ("for", "while"):
        return [s.body]
    if s.kind == "switch":
        return [[x] for _, x in s.arms]
    return []


def check(p: Program) -> Program:
    def statements(body: list[Node], top: bool, loop: bool) -> None:
        for s in body:
            if s.kind in ("break", "continue") and not loop:
                raise ScriptError(f"{s.kind} outside a loop", s.line)
            for e, once in expressions(s):
                expression(e, top and once)
            for b in blocks(s):
                statements(b, False, loop or s.kind in ("for", "while"))

    def expression(e: Node, top: bool) -> None:
        for x in walk(e):
            if x.kind != "call":
                continue
            if x.name in TOP_ONLY and x.name not in p.functions and not top:
                raise ScriptError(f"{x.name} must stand in a top-level statement", x.line)
            if x.name == "security" and x.name not in p.functions:
                for inner in [*x.args, *x.kwargs.values()]:
                    for y in walk(inner):
                        if y.kind == "call" and y.name in TOP_ONLY:
                            raise ScriptError(f"{y.name} inside security", y.line)
            f = p.functions.get(x.name)
            if f is not None:
                if x.kwargs:
                    raise ScriptError(f"{x.name} takes positional arguments only", x.line)
                if len(x.args) != len(f.params):
                    raise ScriptError(f"{x.name} takes {len(f.params)} arguments", x.line)

    statements(p.body, True, False)
    for f in p.functions.values():
        statements(f.body, False, False)
        expression(f.result, False)
    calls = {f.name: {x.name for e in _all(f) for x in walk(e) if x.kind == "call" and x.name in p.functions} for f in p.functions.values()}
    left = dict(calls)
    while left:  # functions that call only settled ones settle; what can't is recursive
        done = [n for n, c in left.items() if not c & left.keys()]
        if not done:
            name = next(iter(left))
            raise ScriptError("functions may not be recursive", p.functions[name].line)
        for n in done:
            del left[n]
    return p


def _all(f: Function) -> list[Node]:
    out, todo = [f.result], list(f.body)
    while todo:
        s = todo.pop()
        out += [e for e, _ in expressions(s)]
        for b in blocks(s):
            todo += b
    return out


@lru_cache(maxsize=256)
def parse(source: str) -> Program:
    """The checked program; raises ScriptError."""
    try:
        return check(Parser(source).program())
    except RecursionError:
        raise ScriptError("nested too deeply") from None

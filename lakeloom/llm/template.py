"""A sandboxed template language for chats, compiled to Python closures.

    {{ expression }}   {% for x in expression %} ... {% endfor %}   {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = e %}    {% generation %} ... {% endgeneration %}     {# remark #}

Expressions: strings, integers, true, false, none, names, a.b and a['b'] (keys of mappings, nothing else), + ~ == != < <= > >= in,
not in, and, or, not, x if c else y, and filters: upper, lower, trim, length, escape, default(e). Inside a loop loop.index,
loop.index0 and loop.first are set. `-` inside a tag's edge trims white space there. There are no calls and no attributes, so a
template can reach only what it is given. Missing names and keys are none; none prints as nothing.

Stages: tokens, syntax tree (tuples), constant folding (operators and filters on constants, branches on constant tests, joined
texts), closures. A rendering is a stream of strings and marks; a loop reads its sequence one item at a time, so a conversation
need not fit in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Any


class TemplateError(ValueError):
    """The template can't be compiled or rendered."""


class Mark(Enum):
    """BEGIN and END surround generated text; TURN follows each item of a loop."""

    BEGIN = 1
    END = 2
    TURN = 3


BEGIN, END, TURN = Mark.BEGIN, Mark.END, Mark.TURN

_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?:'[^']*'|\"[^\"]*\"|[^'\"])*?-?\}\}|\{%-?(?:'[^']*'|\"[^\"]*\"|[^'\"])*?-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\]=,]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


def shown(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if value is True or value is False:
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} can't be printed")


def _joined(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    if isinstance(a, str) and isinstance(b, str):
        return a + b
    raise TemplateError("+ takes two strings or two integers")


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": _joined,
    "~": lambda a, b: shown(a) + shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
}


class Escaper:
    """Makes control strings inside texts harmless, and back.

    A control string's first character followed by any number of backslashes and its rest gets one backslash more; undoing takes
    one away. Controls have no backslash, and no control holds the first character of another but at its start.
    """

    def __init__(self, controls: list[str]):
        first = {c[0] for c in controls}
        if any(len(c) < 2 or "\\" in c or first & set(c[1:]) for c in controls):
            raise TemplateError("control strings overlap, are too short or hold a backslash")
        self.controls = controls
        parts = "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in controls)
        self._hide = re.compile(parts)
        self._show = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in controls))

    def hide(self, text: str) -> str:
        return self._hide.sub(lambda m: m[0] + "\\", text)

    def show(self, text: str) -> str:
        return self._show.sub("", text)


class _Expression:
    """Parser of one tag's expression."""

    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> str | None:
        kind, text = self.items[self.at] if self.at < len(self.items) else ("end", "")
        return text if kind in ("op", "name") and text in wanted else None

    def take(self, *wanted: str) -> str | None:
        found = self.peek(*wanted)
        self.at += found is not None
        return found

    def need(self, *wanted: str) -> str:
        if (found := self.take(*wanted)) is None:
            raise TemplateError(f"{' or '.join(wanted)} is missing")
        return found

    def name(self) -> str:
        kind, text = self.items[self.at] if self.at < len(self.items) else ("end", "")
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return text

    def done(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")

    def whole(self) -> tuple:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            value = ("choice", test, value, self.whole())
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.summed()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = ("op", op, left, self.summed())
            elif self.peek("not") and self.items[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = ("op", "not in", left, self.summed())
            else:
                return left

    def summed(self) -> tuple:
        left = self.filtered()
        while op := self.take("+", "~"):
            left = ("op", op, left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.reached()
        while self.take("|"):
            name, argument = self.name(), None
            if self.take("("):
                argument = self.whole()
                self.need(")")
            value = ("filter", name, value, argument)
        return value

    def reached(self) -> tuple:
        value = self.atom()
        while True:
            if self.take("."):
                value = ("key", value, ("const", self.name()))
            elif self.take("["):
                value = ("key", value, self.whole())
                self.need("]")
            else:
                return value

    def atom(self) -> tuple:
        if self.take("("):
            value = self.whole()
            self.need(")")
            return value
        kind, text = self.items[self.at] if self.at < len(self.items) else ("end", "")
        self.at += 1
        if kind == "number":
            return ("const", int(text))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return ("const", constants[text]) if text in constants else ("name", text)
        raise TemplateError("an expression is missing")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        tag = m[0]
        text = text.lstrip() if trim else text
        if not tag.startswith("{#") and tag[2] == "-":
            text = text.rstrip()
        trim = not tag.startswith("{#") and tag[-3] == "-"
        pieces.append(("text", text))
        if not tag.startswith("{#"):
            pieces.append(("print" if tag[1] == "{" else "do", tag[2:-2].removeprefix("-").removesuffix("-")))
        at = m.end()
    rest = source[at:]
    pieces.append(("text", rest.lstrip() if trim else rest))
    if any(kind == "text" and re.search(r"\{[{%#]", text) for kind, text in pieces):
        raise TemplateError("a tag isn't closed")
    position = 0

    def block(*ends: str) -> tuple[list[tuple], str, _Expression | None]:
        nonlocal position
        out: list[tuple] = []
        while position < len(pieces):
            kind, text = pieces[position]
            position += 1
            if kind == "text":
                if text:
                    out.append(("text", text))
                continue
            e = _Expression(text)
            if kind == "print":
                out.append(("print", e.whole()))
                e.done()
                continue
            word = e.name()
            if word in ends:
                return out, word, e
            if word == "for":
                target = e.name()
                e.need("in")
                source_ = e.whole()
                e.done()
                body, _, end = block("endfor")
                end.done()
                out.append(("for", target, source_, body))
            elif word == "if":
                branches, other = [], []
                test = e.whole()
                e.done()
                while True:
                    body, word, e = block("elif", "else", "endif")
                    branches.append((test, body))
                    if word == "elif":
                        test = e.whole()
                        e.done()
                        continue
                    e.done()
                    if word == "else":
                        other, _, e = block("endif")
                        e.done()
                    break
                out.append(("if", branches, other))
            elif word == "set":
                target = e.name()
                e.need("=")
                out.append(("set", target, e.whole()))
                e.done()
            elif word == "generation":
                e.done()
                body, _, end = block("endgeneration")
                end.done()
                out.append(("generation", body))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", None

    return block()[0]


class Template:
    """A compiled template. controls: the strings that the filter `escape` hides."""

    def __init__(self, source: str, controls: list[str] | None = None):
        self.escaper = Escaper(controls) if controls else None
        self.tree = self._folded(parse(source))
        self.run: Callable[[dict], Iterator[str | Mark]] = self._block(self.tree)

    def _filter(self, name: str) -> Callable[[Any, Any], Any]:
        def text(f: Callable[[str], Any]) -> Callable[[Any, Any], Any]:
            return lambda value, _: f(shown(value))

        known = {"upper": text(str.upper), "lower": text(str.lower), "trim": text(str.strip), "length": lambda v, _: len(v or ""), "default": lambda v, d: d if v is None else v}
        if self.escaper:
            known["escape"] = text(self.escaper.hide)
        if name not in known:
            raise TemplateError(f"no filter {name!r}")
        return known[name]

    # constant folding

    def _fold(self, e: tuple) -> tuple:
        kind = e[0]
        if kind in ("const", "name"):
            return e
        if kind == "op":
            left, right = self._fold(e[2]), self._fold(e[3])
            if left[0] == right[0] == "const":
                return ("const", self._apply(lambda: OPERATORS[e[1]](left[1], right[1])))
            return ("op", e[1], left, right)
        if kind == "filter":
            value, argument = self._fold(e[2]), self._fold(e[3]) if e[3] else None
            f = self._filter(e[1])
            if value[0] == "const" and (argument is None or argument[0] == "const"):
                return ("const", self._apply(lambda: f(value[1], argument and argument[1])))
            return ("filter", e[1], value, argument)
        if kind == "not":
            value = self._fold(e[1])
            return ("const", not value[1]) if value[0] == "const" else ("not", value)
        if kind in ("and", "or"):
            left, right = self._fold(e[1]), self._fold(e[2])
            if left[0] == "const":
                return right if bool(left[1]) == (kind == "and") else left
            return (kind, left, right)
        if kind == "choice":
            test = self._fold(e[1])
            if test[0] == "const":
                return self._fold(e[2] if test[1] else e[3])
            return ("choice", test, self._fold(e[2]), self._fold(e[3]))
        return ("key", self._fold(e[1]), self._fold(e[2]))

    @staticmethod
    def _apply(f: Callable[[], Any]) -> Any:
        try:
            return f()
        except TypeError as e:
            raise TemplateError(str(e)) from e

    def _folded(self, nodes: list[tuple]) -> list[tuple]:
        out: list[tuple] = []

        def add(node: tuple) -> None:
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)

        for node in nodes:
            if node[0] == "print":
                value = self._fold(node[1])
                add(("text", shown(value[1])) if value[0] == "const" else ("print", value))
            elif node[0] == "for":
                add(("for", node[1], self._fold(node[2]), self._folded(node[3])))
            elif node[0] == "set":
                add(("set", node[1], self._fold(node[2])))
            elif node[0] == "generation":
                add(("generation", self._folded(node[1])))
            elif node[0] == "if":
                branches, other = [], self._folded(node[2])
                for test, body in node[1]:
                    test = self._fold(test)
                    if test[0] != "const":
                        branches.append((test, self._folded(body)))
                    elif test[1]:
                        other = self._folded(body)
                        break
                if branches:
                    add(("if", branches, other))
                else:
                    for x in other:
                        add(x)
            else:
                add(node)
        return out

    # closures

    def _value(self, e: tuple) -> Callable[[dict], Any]:
        kind = e[0]
        if kind == "const":
            return lambda env, c=e[1]: c
        if kind == "name":
            return lambda env, n=e[1]: env.get(n)
        if kind == "op":
            f, left, right = OPERATORS[e[1]], self._value(e[2]), self._value(e[3])
            return lambda env: self._apply(lambda: f(left(env), right(env)))
        if kind == "filter":
            f, value, argument = self._filter(e[1]), self._value(e[2]), self._value(e[3] or ("const", None))
            return lambda env: f(value(env), argument(env))
        if kind == "not":
            value = self._value(e[1])
            return lambda env: not value(env)
        if kind == "and":
            left, right = self._value(e[1]), self._value(e[2])
            return lambda env: left(env) and right(env)
        if kind == "or":
            left, right = self._value(e[1]), self._value(e[2])
            return lambda env: left(env) or right(env)
        if kind == "choice":
            test, left, right = (self._value(x) for x in e[1:])
            return lambda env: left(env) if test(env) else right(env)
        value, key = self._value(e[1]), self._value(e[2])

        def reach(env: dict) -> Any:
            held = value(env)
            return held.get(key(env)) if isinstance(held, dict) else None

        return reach

    def _block(self, nodes: list[tuple]) -> Callable[[dict], Iterator[str | Mark]]:
        steps = [self._node(n) for n in nodes]

        def run(env: dict) -> Iterator[str | Mark]:
            for step in steps:
                yield from step(env)

        return run

    def _node(self, node: tuple) -> Callable[[dict], Any]:
        kind = node[0]
        if kind == "text":
            held = (node[1],)
            return lambda env: held
        if kind == "print":
            value = self._value(node[1])
            return lambda env: (shown(value(env)),)
        if kind == "set":
            value = self._value(node[2])

            def assign(env: dict) -> tuple:
                env[node[1]] = value(env)
                return ()

            return assign
        if kind == "generation":
            body = self._block(node[1])

            def generation(env: dict) -> Iterator[str | Mark]:
                yield BEGIN
                yield from body(env)
                yield END

            return generation
        if kind == "if":
            branches, other = [(self._value(t), self._block(b)) for t, b in node[1]], self._block(node[2])

            def choose(env: dict) -> Iterator[str | Mark]:
                for test, body in branches:
                    if test(env):
                        return body(env)
                return other(env)

            return choose
        target, items, body = node[1], self._value(node[2]), self._block(node[3])

        def loop(env: dict) -> Iterator[str | Mark]:
            held = items(env)
            if held is None:
                return
            if isinstance(held, (str, int, dict)):
                raise TemplateError("a loop needs a sequence")
            inner = dict(env)
            for i, item in enumerate(held):
                inner[target], inner["loop"] = item, {"index": i + 1, "index0": i, "first": i == 0}
                yield from body(inner)
                yield TURN

        return loop

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans (first and past-the-last code point) of generated text."""
        parts, spans, at, opened, depth = [], [], 0, 0, 0
        for x in self.run(dict(names)):
            if x is BEGIN:
                opened, depth = at if not depth else opened, depth + 1
            elif x is END:
                depth -= 1
                if not depth:
                    spans.append((opened, at))
            elif x is not TURN:
                parts.append(x)
                at += len(x)
        return "".join(parts), spans

"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if %} {% elif %} {% else %} {% endif %}
    {% for x in expression %} {% endfor %}   {% set x = expression %}
    {% generation %} {% endgeneration %}   {# comment #}   a `-` trims white space

Expressions have strings, integers, true, false, none, names, `.key` and `[key]`
on mappings and lists, the listed filters, `not and or in == != < <= > >= + ~`
and `a if c else b`.  There are no calls and no Python attributes, so a template
reaches only what it is given.  A source is parsed into a syntax tree, constant
parts are folded (values, branches, neighbouring texts), and each node becomes a
closure.  Rendering yields (text, under generation markers) lazily, so a loop may
run over a stream of any length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class If:
    arms: tuple[tuple[Any, tuple], ...]  # a test of Const(True) is the else arm


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~|.()\[\]]))""")
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_ORDER: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: show(a) + show(b),
}


def show(value: Any) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if text in texts and kind in ("op", "name"):
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}, found {self.peek()[1]!r}")

    def whole(self) -> Any:
        out = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            return Choice(test, value, self.choice() if self.take("else") else Const(None))
        return value

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self) -> Any:
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = Binary(op, left, self.joined())
        return left

    def joined(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Binary(op, left, self.filtered())
        return left

    def filtered(self) -> Any:
        out = self.atom()
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.choice())
                self.need("]")
            elif self.take("|"):
                out = Filter(out, self.name())
            else:
                return out

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {text!r}")
        self.at += 1
        return text

    def atom(self) -> Any:
        kind, text = self.peek()
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name":
            if text in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[text])
            if text not in _WORDS:
                return Name(text)
        raise TemplateError(f"unexpected {text!r}")


def expression(source: str) -> Any:
    return Expression(source).whole()


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m[1].endswith("-") else text))
        parts.append(({"{{": "out", "{%": "tag", "{#": "note"}[m[1][:2]], m[2].strip()))
        at, trim = m.end(), m[3].startswith("-")
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    body, rest = _body(parts, 0, ())
    if rest < len(parts):
        raise TemplateError(f"unexpected {parts[rest][1]!r}")
    return body


def _body(parts: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[tuple, int]:
    out: list[Any] = []
    while at < len(parts):
        kind, text = parts[at]
        if kind == "text":
            out.append(Out(Const(text)))
        elif kind == "out":
            out.append(Out(expression(text)))
        elif kind == "tag":
            word, _, rest = text.partition(" ")
            if word in until:
                return tuple(out), at
            if word == "if":
                arms, test = [], expression(rest)
                while True:
                    body, at = _body(parts, at + 1, ("elif", "else", "endif"))
                    arms.append((test, body))
                    word, _, rest = (parts[at][1] if at < len(parts) else "").partition(" ")
                    if word == "endif":
                        break
                    if word not in ("elif", "else"):
                        raise TemplateError("if without endif")
                    test = expression(rest) if word == "elif" else Const(True)
                out.append(If(tuple(arms)))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"malformed for: {rest!r}")
                body, at = _closed(parts, at, "endfor")
                out.append(For(m[1], expression(m[2]), body))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"malformed set: {rest!r}")
                out.append(Set(m[1], expression(m[2])))
            elif word == "generation":
                body, at = _closed(parts, at, "endgeneration")
                out.append(Generation(body))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        at += 1
    return tuple(out), at


def _closed(parts: list[tuple[str, str]], at: int, end: str) -> tuple[tuple, int]:
    body, at = _body(parts, at + 1, (end,))
    if at >= len(parts):
        raise TemplateError(f"missing {end}")
    return body, at


def fold(node: Any, filters: dict[str, Callable]) -> Any:
    """The node with constant parts computed; what would fail is left for run time."""
    if isinstance(node, Item):
        node = Item(fold(node.of, filters), fold(node.key, filters))
        constant = isinstance(node.of, Const) and isinstance(node.key, Const)
    elif isinstance(node, Filter):
        node = Filter(fold(node.of, filters), node.name)
        constant = isinstance(node.of, Const)
    elif isinstance(node, Unary):
        node = Unary(fold(node.of, filters))
        constant = isinstance(node.of, Const)
    elif isinstance(node, Binary):
        node = Binary(node.op, fold(node.left, filters), fold(node.right, filters))
        constant = isinstance(node.left, Const) and isinstance(node.right, Const)
    elif isinstance(node, Choice):
        node = Choice(*(fold(x, filters) for x in (node.test, node.yes, node.no)))
        if isinstance(node.test, Const):
            return node.yes if node.test.value else node.no
        constant = False
    else:
        return node
    if constant:
        try:
            return Const(value(node, filters)({}))
        except (TypeError, KeyError, IndexError, TemplateError):
            return node
    return node


def fold_body(body: tuple, filters: dict[str, Callable]) -> tuple:
    out: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Out) and isinstance(node.value, Const):
            text = show(node.value.value)
            if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(out[-1].value.value + text))
            elif text:
                out.append(Out(Const(text)))
        else:
            out.append(node)

    for node in body:
        if isinstance(node, Out):
            add(Out(fold(node.value, filters)))
        elif isinstance(node, Set):
            add(Set(node.name, fold(node.value, filters)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.over, filters), fold_body(node.body, filters)))
        elif isinstance(node, Generation):
            add(Generation(fold_body(node.body, filters)))
        elif isinstance(node, If):
            arms = []
            for test, inner in node.arms:
                test = fold(test, filters)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, fold_body(inner, filters)))
                if isinstance(test, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(If(tuple(arms)))
    return tuple(out)


def value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure that computes an expression from the names given."""
    if isinstance(node, Const):
        constant = node.value
        return lambda env: constant
    if isinstance(node, Name):
        name = node.name

        def lookup(env):
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return lookup
    if isinstance(node, Item):
        of, key = value(node.of, filters), value(node.key, filters)

        def item(env):
            holder = of(env)
            if not isinstance(holder, (dict, list, tuple)):
                raise TemplateError("keys are for mappings and lists only")
            return holder[key(env)]

        return item
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of, apply = value(node.of, filters), filters[node.name]
        return lambda env: apply(of(env))
    if isinstance(node, Unary):
        of = value(node.of, filters)
        return lambda env: not of(env)
    if isinstance(node, Choice):
        test, yes, no = (value(x, filters) for x in (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    left, right = value(node.left, filters), value(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    op = _ORDER[node.op]
    return lambda env: op(left(env), right(env))


Part = tuple[str, bool]


def statement(node: Any, filters: dict[str, Callable], masked: bool) -> Callable[[dict], Iterator[Part]]:
    """A closure that renders one node; whether it stands under generation markers is known when compiling."""
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            part = (show(node.value.value), masked)

            def text(env):
                yield part

            return text
        inner = value(node.value, filters)

        def out(env):
            yield show(inner(env)), masked

        return out
    if isinstance(node, Set):
        inner, name = value(node.value, filters), node.name

        def put(env):
            env[name] = inner(env)
            return iter(())

        return put
    if isinstance(node, If):
        arms = [(value(test, filters), block(body, filters, masked)) for test, body in node.arms]

        def choose(env):
            for test, body in arms:
                if test(env):
                    return body(env)
            return iter(())

        return choose
    if isinstance(node, Generation):
        if masked:
            raise TemplateError("generation inside generation")
        return block(node.body, filters, True)
    over, body, name = value(node.over, filters), block(node.body, filters, masked), node.name

    def loop(env):
        items: Iterable = over(env)
        outer = {k: env[k] for k in (name, "loop") if k in env}
        stream, missing = iter(items), object()
        item, index = next(stream, missing), 0
        while item is not missing:
            after = next(stream, missing)  # one item ahead, for loop.last
            env[name] = item
            env["loop"] = {"first": index == 0, "last": after is missing, "index": index + 1, "index0": index}
            yield from body(env)
            item, index = after, index + 1
        for k in (name, "loop"):
            env.pop(k, None)
        env.update(outer)

    return loop


def block(body: tuple, filters: dict[str, Callable], masked: bool) -> Callable[[dict], Iterator[Part]]:
    steps = [statement(node, filters, masked) for node in body]

    def run(env):
        for step in steps:
            yield from step(env)

    return run


BUILT_IN: dict[str, Callable] = {
    "trim": lambda s: show(s).strip(),
    "upper": lambda s: show(s).upper(),
    "lower": lambda s: show(s).lower(),
    "length": len,
}


class Template:
    """A compiled template: `render` yields (text, under generation markers)."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = BUILT_IN | (filters or {})
        self.tree = fold_body(parse(source), self.filters)
        self.run = block(self.tree, self.filters, False)

    def render(self, **names: Any) -> Iterator[Part]:
        return self.run(dict(names))

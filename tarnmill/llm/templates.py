"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for x in expression %}...{% endfor %}   {% set x = expression %}
    {% if expression %}...{% elif expression %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}        {# comment #}

Expressions: literals, names, a.b and a['b'] (items of mappings and sequences, never Python attributes),
or, and, not, == != < <= > >= in, + - * % and ~ (joins as text), x if c else y, value | filter(argument).
There are no calls but the filters given to compile_template, so a template reaches nothing else.

Compilation: text -> syntax tree -> constant folding -> closures. Rendering is a generator of
(text, trained) chunks: memory is bounded by one chunk, however many messages there are.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

Chunks = Iterator[tuple[str, bool]]


class TemplateError(ValueError):
    """The template is malformed, or it asks for what the sandbox has not."""


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Apply(NamedTuple):
    """A pure function of its arguments."""

    function: Callable
    args: tuple


class Choice(NamedTuple):
    """Short-circuit forms: kind is and, or, if."""

    kind: str
    args: tuple


class Text(NamedTuple):
    text: str


class Output(NamedTuple):
    value: Any


class Branch(NamedTuple):
    test: Any
    then: list
    other: list


class Loop(NamedTuple):
    name: str
    over: Any
    body: list


class Assign(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: list


_LEX = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>().,|\[\]=]))")
_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _numbers(function: Callable) -> Callable:
    """Arithmetic of numbers alone: texts are neither repeated nor formatted, so a template cannot grow what it is given."""

    def of(a: Any, b: Any) -> Any:
        if not all(isinstance(x, (int, float)) and abs(x) < 1 << 64 for x in (a, b)):
            raise TemplateError("arithmetic takes numbers of at most 64 bits")
        return function(a, b)

    return of


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, str) and isinstance(b, str) else _numbers(operator.add)(a, b)


_ARITHMETIC = {"+": _plus, "-": _numbers(operator.sub), "*": _numbers(operator.mul), "%": _numbers(operator.mod)}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _join(a: Any, b: Any) -> str:
    return _text(a) + _text(b)


def _contains(a: Any, b: Any) -> bool:
    return a in b


class _Expression:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        while source[at:].strip():
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def whole(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = Choice("if", (test, value, self.choice() if self.take("else") else Const("")))
        return value

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Choice("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Choice("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Apply(operator.not_, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.added()
        while op := self.take(*_COMPARE, "in"):
            out = Apply(_contains if op == "in" else _COMPARE[op], (out, self.added()))
        return out

    def added(self) -> Any:
        out = self.multiplied()
        while op := self.take("+", "-", "~"):
            out = Apply(_join if op == "~" else _ARITHMETIC[op], (out, self.multiplied()))
        return out

    def multiplied(self) -> Any:
        out = self.filtered()
        while op := self.take("*", "%"):
            out = Apply(_ARITHMETIC[op], (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.single()
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.choice())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), [out]
                if name not in self.filters:
                    raise TemplateError(f"there is no filter {name!r}")
                if self.take("(") and not self.take(")"):
                    args.append(self.choice())
                    while self.take(","):
                        args.append(self.choice())
                    self.need(")")
                out = Apply(self.filters[name], tuple(args))
            else:
                return out

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and not self.tokens[self.at][1].startswith("_"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing (names do not begin with _)")

    def single(self) -> Any:
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        if self.take("-"):
            return Apply(operator.neg, (self.single(),))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, token = self.tokens[self.at]
        if kind == "name" and token in _WORDS:
            self.at += 1
            return Const(_WORDS[token])
        if kind == "name":
            return Name(self.name())
        self.at += 1
        if kind == "number":
            return Const(float(token) if "." in token else int(token))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        raise TemplateError(f"unexpected {token!r}")


def parse(source: str, filters: dict[str, Callable]) -> list:
    """The syntax tree."""
    parts = [p for p in _TAGS.split(source) if p and not p.startswith("{#")]
    at = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Output(_Expression(part[2:-2], filters).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, part[2:-2].strip()
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"malformed for: {rest!r}")
                    out.append(Loop(m[1], _Expression(m[2], filters).whole(), block("endfor")[0]))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                        raise TemplateError(f"malformed set: {rest!r}")
                    out.append(Assign(name.strip(), _Expression(value, filters).whole()))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {word!r}")
            else:
                out.append(Text(part))
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return out, ""

    def branch(test: str) -> Branch:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            other: list = [branch(end[4:])]
        else:
            other = block("endif")[0] if end == "else" else []
        return Branch(_Expression(test, filters).whole(), then, other)

    return block()[0]


def fold(node: Any) -> Any:
    """The node with what is constant worked out."""
    if isinstance(node, Apply):
        args = tuple(fold(a) for a in node.args)
        return Const(node.function(*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Apply(node.function, args)
    if isinstance(node, Choice):
        args = tuple(fold(a) for a in node.args)
        if isinstance(args[0], Const):
            truth = bool(args[0].value)
            return args[1 if truth else 2] if node.kind == "if" else args[1] if truth == (node.kind == "and") else args[0]
        return Choice(node.kind, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    return node


def fold_block(nodes: list) -> list:
    """The block with constants folded, decided branches inlined and neighbouring texts joined."""
    out: list = []

    def put(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not isinstance(node, Text) or node.text:
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = fold(node.value)
            put(Text(_text(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, Branch):
            test, then, other = fold(node.test), fold_block(node.then), fold_block(node.other)
            for n in (then if test.value else other) if isinstance(test, Const) else [Branch(test, then, other)]:
                put(n)
        elif isinstance(node, Loop):
            put(Loop(node.name, fold(node.over), fold_block(node.body)))
        elif isinstance(node, Assign):
            put(Assign(node.name, fold(node.value)))
        elif isinstance(node, Generation):
            put(Generation(fold_block(node.body)))
        else:
            put(node)
    return out


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _item(of(env), key(env))
    args = [_value(a) for a in node.args]
    if isinstance(node, Apply):
        f = node.function
        if len(args) == 1:
            one = args[0]
            return lambda env: f(one(env))
        return lambda env: f(*(a(env) for a in args))
    if node.kind == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    return lambda env: args[0](env) or args[1](env)


def _block(nodes: list, trained: bool) -> Callable[[dict], Chunks]:
    steps = [_step(n, trained) for n in nodes]

    def run(env: dict) -> Chunks:
        for step in steps:
            yield from step(env)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any, trained: bool) -> Callable[[dict], Chunks]:
    if isinstance(node, Text):
        chunk = ((node.text, trained),)
        return lambda env: chunk
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda env: ((_text(value(env)), trained),)
    if isinstance(node, Branch):
        test, then, other = _value(node.test), _block(node.then, trained), _block(node.other, trained)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Generation):
        return _block(node.body, True)
    if isinstance(node, Assign):
        value = _value(node.value)

        def assign(env: dict) -> tuple:
            env[node.name] = value(env)
            return ()

        return assign
    over, body = _value(node.over), _block(node.body, trained)

    def loop(env: dict) -> Chunks:
        for k, x in enumerate(over(env) or ()):
            inner = {**env, node.name: x, "loop": {"index0": k, "index": k + 1, "first": k == 0}}
            yield from body(inner)

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Chunks]:
    """A function from variables to the rendered chunks. Filters must be pure: they are folded over constants."""
    return _block(fold_block(parse(source, {"trim": lambda s: _text(s).strip(), "upper": lambda s: _text(s).upper(), "lower": lambda s: _text(s).lower(), "length": len, **(filters or {})})), False)

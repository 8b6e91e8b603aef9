"""A small formula language, parsed once and compiled to a Column.

``+ - * / %``, signs, parentheses, ``min max round ceil floor abs``, numbers with a decimal comma or dot, and variables
by name without regard to case.  A variable that is missing or not a number is 0.  A comma between digits is a decimal
mark, so ``max(1,2)`` has one argument and ``max(1, 2)`` two.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import to_number

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:[.,]\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>[()+\-*/%,]))", re.ASCII)
_BINDING = {"+": 10, "-": 10, "*": 20, "/": 20, "%": 20}


class FormulaError(ValueError):
    """A formula that cannot be parsed."""


@dataclass(frozen=True)
class Node:
    kind: str  # num, var, neg, call or an operator
    value: object = None
    parts: tuple[Node, ...] = ()


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected character at {at} in {source!r}")
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    """Precedence climbing over the tokens."""

    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, _tokens(source), 0

    def take(self, text: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if token[0] == "end" or (text is not None and token[1] != text):
            raise FormulaError(f"expected {text or 'more'} in {self.source!r}")
        self.at += 1
        return token

    def expression(self, least: int = 0) -> Node:
        left = self.operand()
        while (op := self.tokens[self.at][1]) in _BINDING and _BINDING[op] > least:
            self.take()
            left = Node(op, parts=(left, self.expression(_BINDING[op])))
        return left

    def operand(self) -> Node:
        kind, text = self.take()
        if text in ("+", "-"):
            inner = self.operand()
            return Node("neg", parts=(inner,)) if text == "-" else inner
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "num":
            return Node("num", float(text.replace(",", ".")))
        if kind == "name":
            if self.tokens[self.at][1] != "(":
                return Node("var", text.lower())
            self.take("(")
            args: list[Node] = []
            while self.tokens[self.at][1] != ")":
                if args:
                    self.take(",")
                args.append(self.expression())
            self.take(")")
            if text.lower() not in _CALLS:
                raise FormulaError(f"unknown function {text!r}")
            return Node("call", text.lower(), tuple(args))
        raise FormulaError(f"unexpected {text!r} in {self.source!r}")


def _one(f):
    return lambda *a: f(a[0]) if a else F.lit(None).cast("double")


_CALLS = {
    "min": lambda *a: F.least(*a) if len(a) > 1 else _one(lambda x: x)(*a),
    "max": lambda *a: F.greatest(*a) if len(a) > 1 else _one(lambda x: x)(*a),
    "round": _one(lambda x: F.floor(x + F.lit(0.5)).cast("double")),
    "ceil": _one(lambda x: F.ceil(x).cast("double")),
    "floor": _one(lambda x: F.floor(x).cast("double")),
    "abs": _one(F.abs),
}


def parse(source: str) -> Node:
    parser = _Parser(source or "")
    node = parser.expression()
    if parser.tokens[parser.at][0] != "end":
        raise FormulaError(f"trailing text in {source!r}")
    return node


def is_valid(source: str) -> bool:
    try:
        parse(source)
    except FormulaError:
        return False
    return True


def compile_formula(source: str, variables: Mapping[str, Column]) -> Column:
    """A double; null where the result is not finite or a division by zero occurs."""
    known = {k.lower(): v for k, v in variables.items()}

    def build(n: Node) -> Column:
        if n.kind == "num":
            return F.lit(n.value)
        if n.kind == "var":
            c = known.get(str(n.value))
            return F.lit(0.0) if c is None else F.coalesce(to_number(c), F.lit(0.0))
        parts = [build(p) for p in n.parts]
        if n.kind == "neg":
            return -parts[0]
        if n.kind == "call":
            # a null argument (an error below) must not vanish in least() or greatest()
            ok = F.lit(True)
            for p in parts:
                ok = ok & p.isNotNull()
            return F.when(ok, _CALLS[str(n.value)](*parts))
        a, b = parts
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[n.kind]()

    out = build(parse(source))
    return F.when(~F.isnan(out) & (F.abs(out) != F.lit(float("inf"))), out)


def price(fixed: Column, source: str | None, variables: Mapping[str, Column]) -> Column:
    """The formula's value to cents, or the fixed price where there is no formula, it is invalid or fails on the row."""
    fixed = fixed.cast("double")
    if not source or not is_valid(source):
        return fixed
    return F.coalesce(F.round(compile_formula(source, variables), 2), fixed)

"""A small expression language, compiled to a Column: choice, and/or/not, comparisons, membership, bits, arithmetic, paths,
casts, lists and literals.

Binding powers: `a if c else b` 20, or 30, and 40, not 50, comparisons, `in` and `is` 60, | 70, ^ 80, & 90, shifts 100, + and
- 110, * / // and % 120, unary 130, ** 140, path and index 150; or, and and ** go from the right. Both sides of and and or,
and a choice's condition, count as booleans by the words for true and false. + joins texts and adds numbers; // and % round
down, as in Python; a division by zero is null. `is` holds between nulls; `in` looks into lists, array columns and texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import coerce

_TOKEN = re.compile(r"""\s*(?:(\d+\.\d+|\d+)|("[^"]*"|'[^']*')|([A-Za-z_][\w.]*)|(\*\*|//|<<|>>|<>|<=|>=|==|!=|[<>+\-*/%&|^~()\[\],]))""")
_COMPARED = ("in", "not", "is", "<", "<=", ">", ">=", "==", "!=", "<>")
_POWER = {"if": 20, "or": 30, "and": 40} | dict.fromkeys(_COMPARED, 60) | {"|": 70, "^": 80, "&": 90, "<<": 100, ">>": 100, "+": 110, "-": 110, "*": 120, "/": 120, "//": 120, "%": 120, "**": 140}
_FROM_RIGHT = {"or", "and", "**"}
_CASTS: dict[str, Callable[[Column], Column]] = {
    "int": coerce.to_int,
    "float": coerce.to_float,
    "bool": coerce.to_bool,
    "string": lambda c: c.cast("string"),
}


class ExpressionError(ValueError):
    """The text is no expression."""


class Value:
    """A Column, and whether it is known to be text, number or boolean."""

    def __init__(self, column: Column, kind: str = "any"):
        self.column, self.kind = column, kind

    def truth(self) -> Column:
        return self.column if self.kind == "bool" else coerce.to_bool(self.column)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        kind = ("number", "text", "name", "op")[m.lastindex - 1]
        word = m[m.lastindex]
        out.append(("op" if kind == "name" and word in ("and", "or", "not", "in", "is", "if", "else") else kind, word))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str, resolve: Callable[[str], Column]):
        self.tokens, self.at, self.resolve = tokens(text), 0, resolve

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, word: str) -> None:
        if self.next()[1] != word:
            raise ExpressionError(f"{word!r} is missing")

    def parse(self, power: int = 0) -> Value:
        left = self.prefix()
        while self.tokens[self.at][0] == "op" and _POWER.get(self.tokens[self.at][1], 0) > power:
            op = self.next()[1]
            if op == "if":
                left = self.choice(left)
                continue
            power_of = _POWER[op]
            if op == "not":
                self.expect("in")
                op = "not in"
            elif op == "is" and self.tokens[self.at][1] == "not":
                self.next()
                op = "is not"
            left = self.combine(op, left, self.parse(power_of - 1 if op in _FROM_RIGHT else power_of))
        return left

    def choice(self, yes: Value) -> Value:
        asked = self.parse()
        self.expect("else")
        no = self.parse()
        kind = yes.kind if yes.kind == no.kind else "any"
        a, b = (yes.column, no.column) if kind != "any" else (yes.column.cast("string"), no.column.cast("string"))
        return Value(F.when(F.coalesce(asked.truth(), F.lit(False)), a).otherwise(b), kind)

    def prefix(self) -> Value:
        kind, word = self.next()
        if kind == "number":
            return Value(F.lit(float(word) if "." in word else int(word)), "number")
        if kind == "text":
            return Value(F.lit(word[1:-1]), "text")
        if word == "not":
            return Value(~self.parse(50).truth(), "bool")
        if word in ("-", "+"):
            value = self.parse(130).column.cast("double")
            return Value(-value if word == "-" else value, "number")
        if word == "(":
            inner = self.parse()
            self.expect(")")
            return inner
        if word == "~":
            return Value(F.bitwise_not(self.parse(130).column.cast("long")), "number")
        if word == "[" and kind == "op":
            return self.listed()
        if kind == "name":
            return self.name(word)
        raise ExpressionError(f"unexpected {word!r}")

    def listed(self) -> Value:
        held = []
        while self.tokens[self.at][1] != "]":
            held.append(self.parse().column.cast("string"))
            if self.tokens[self.at][1] != "]":
                self.expect(",")
        self.next()
        return Value(F.array(*held) if held else F.array().cast("array<string>"), "list")

    def name(self, word: str) -> Value:
        if word in ("true", "false"):
            return Value(F.lit(word == "true"), "bool")
        if word in ("null", "none", "None"):
            return Value(F.lit(None).cast("string"))
        if word in ("True", "False"):
            return Value(F.lit(word == "True"), "bool")
        if self.tokens[self.at][1] == "(" and word in _CASTS:
            self.next()
            inner = self.parse()
            self.expect(")")
            return Value(_CASTS[word](inner.column), {"int": "number", "float": "number", "bool": "bool", "string": "text"}[word])
        while self.tokens[self.at][1] == "[":
            self.next()
            word += f"[{self.next()[1]}]"
            self.expect("]")
        return Value(self.resolve(word))

    @staticmethod
    def combine(op: str, a: Value, b: Value) -> Value:
        if op in ("and", "or"):
            return Value(a.truth() & b.truth() if op == "and" else a.truth() | b.truth(), "bool")
        if op in ("+", "-"):
            if op == "+" and "text" in (a.kind, b.kind):
                return Value(F.concat(a.column.cast("string"), b.column.cast("string")), "text")
            return Value(a.column + b.column if op == "+" else a.column - b.column, "number")
        x, y = a.column, b.column
        if op in ("in", "not in"):
            text = x.cast("string")
            found = F.contains(y, text) if b.kind == "text" else F.array_contains(y.cast("array<string>"), text)
            return Value(found if op == "in" else ~found, "bool")
        if op in ("is", "is not"):
            same = x.eqNullSafe(y)
            return Value(same if op == "is" else ~same, "bool")
        if op in ("|", "^", "&", "<<", ">>"):
            i, j = x.cast("long"), y.cast("long")
            shift = lambda name: F.call_function(name, i, j.cast("int"))
            return Value({"|": lambda: i.bitwiseOR(j), "^": lambda: i.bitwiseXOR(j), "&": lambda: i.bitwiseAND(j), "<<": lambda: shift("shiftleft"), ">>": lambda: shift("shiftright")}[op](), "number")
        if op in ("*", "/", "//", "%", "**"):
            whole = a.kind == b.kind == "number"
            i, j = (x, y) if whole else (x.cast("double"), y.cast("double"))
            down = F.floor(F.try_divide(i, j))
            return Value({"*": lambda: i * j, "/": lambda: F.try_divide(i.cast("double"), j), "//": lambda: down, "%": lambda: i - down * j, "**": lambda: F.pow(i.cast("double"), j)}[op](), "number")
        op = "!=" if op == "<>" else op
        return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op], "bool")


def compile_expression(text: str, resolve: Callable[[str], Column] = F.col) -> Column:
    """The Column of an expression; names go to `resolve` with their path."""
    parser = _Parser(text, resolve)
    out = parser.parse()
    if parser.tokens[parser.at][0] != "end":
        raise ExpressionError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return out.column


def scoped(*scopes: Callable[[str], Column]) -> Callable[[str], Column]:
    """Names looked up in several scopes, innermost first; the first that is not null counts."""
    return lambda name: F.coalesce(*[s(name) for s in scopes])

"""Rules and constraints given as text, compiled to columns.

The grammar: numbers, names, 2x and 2(x + 1) as multiples, abs(...) and other named functions,
+ - * /, comparisons, and (& , and), or (| or). Precedence is the usual one, with comparisons below
arithmetic and above the connectives. ``missing_as_zero`` names count 0 where a map lacks them.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_@][\w@#.\-^]*)|(?P<op><=|>=|!=|==|&&|\|\||[-+*/()<>=&|,]))")
_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "==": operator.eq, "!=": operator.ne}
FUNCTIONS: dict[str, Callable[[Column], Column]] = {"abs": F.abs, "sqrt": F.sqrt, "log": F.log}


def register_function(name: str, function: Callable[[Column], Column]) -> None:
    """Make a function of one argument known to the grammar."""
    FUNCTIONS[name] = function


def tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return found


class _Parser:
    def __init__(self, text: str, symbol: Callable[[str], Column]):
        self.tokens, self.at, self.symbol = tokens(text), 0, symbol

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def any_of(self) -> Column:
        left = self.all_of()
        while self.peek() in ("|", "||", "or"):
            self.take()
            left = left | self.all_of()
        return left

    def all_of(self) -> Column:
        left = self.comparison()
        while self.peek() in ("&", "&&", "and", ","):
            self.take()
            left = left & self.comparison()
        return left

    def comparison(self) -> Column:
        left = self.sum()
        while self.peek() in _COMPARE:
            compare = _COMPARE[self.take()[1]]
            left = compare(left, self.sum())
        return left

    def sum(self) -> Column:
        left = self.term()
        while self.peek() in ("+", "-"):
            left = left + self.term() if self.take()[1] == "+" else left - self.term()
        return left

    def term(self) -> Column:
        left = self.factor()
        while self.peek() in ("*", "/"):
            left = left * self.factor() if self.take()[1] == "*" else F.try_divide(left, self.factor())
        return left

    def factor(self) -> Column:
        kind, value = self.take()
        if value == "-":
            return -self.factor()
        if value == "(":
            inner = self.any_of()
            if self.take()[1] != ")":
                raise ValueError("a bracket is not closed")
            return inner
        if kind == "number":
            number = F.lit(float(value) if "." in value else int(value))
            following = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if following[1] == "(" or (following[0] == "name" and following[1] not in ("and", "or")):
                return number * self.factor()
            return number
        if kind == "name":
            if self.peek() == "(" and value in FUNCTIONS:
                return FUNCTIONS[value](self.factor())
            return self.symbol(value)
        raise ValueError(f"{value!r} cannot stand here")


def compile_rule(text: str, symbol: Callable[[str], Column]) -> Column:
    """The column of a rule; ``symbol`` gives the column of a name."""
    parser = _Parser(text, symbol)
    out = parser.any_of()
    if parser.peek() is not None:
        raise ValueError(f"{parser.peek()!r} is left over")
    return out


def in_map(column: Column) -> Callable[[str], Column]:
    """Names looked up in a composition; missing ones count 0."""
    return lambda name: F.coalesce(F.element_at(column, name), F.lit(0))


def range_rule(value: Column, low: float | None, high: float | None, required: bool = True) -> Column:
    """low <= value <= high with open ends; undefined values pass only where not required."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value >= low)
    if high is not None:
        inside = inside & (value <= high)
    return F.coalesce(inside, F.lit(not required))


def ratio_rule(numerator: Column, denominator: Column, least: float, below: float | None = None, required: bool = True) -> Column:
    ratio = F.try_divide(numerator, denominator)
    inside = ratio >= least
    if below is not None:
        inside = inside & (ratio < below)
    return F.coalesce(inside, F.lit(not required))

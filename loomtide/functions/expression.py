"""Arithmetic written as text, as a Column over IEEE-safe functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import math as M

TOKEN = re.compile(r"\s*(?:((?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(&&|\|\||>=|<=|==|!=|[-+*/%^()<>=,]))")

# Operators by how tightly they bind.
LEVELS = [["||"], ["&&"], [">", ">=", "<", "<=", "=", "==", "!="], ["+", "-"], ["*", "/", "%"], ["^"]]

BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": M.divide, "%": M.remainder, "^": lambda a, b: F.pow(a, b),
    "&&": M.both, "||": M.either,
    ">": lambda a, b: _holds(a, b, a > b), ">=": lambda a, b: _holds(a, b, a >= b), "<": lambda a, b: _holds(a, b, a < b), "<=": lambda a, b: _holds(a, b, a <= b),
    "=": lambda a, b: _holds(a, b, a == b), "==": lambda a, b: _holds(a, b, a == b), "!=": lambda a, b: M.negated(_holds(a, b, a == b)),
}


def _holds(a: Column, b: Column, condition: Column) -> Column:
    """No comparison with NaN holds; SQL would put it above all numbers."""
    return M.truth(condition & ~F.isnan(a) & ~F.isnan(b))


FUNCTIONS = {
    "NOT": M.negated, "IF": M.choose, "RAND": lambda: F.rand(), "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan,
    "MAX": M.larger, "MIN": M.smaller, "ABS": F.abs, "LOG": M.log, "ROUND": M.round_half_up, "FLOOR": lambda x: F.floor(x).cast("double"),
    "CEILING": lambda x: F.ceil(x).cast("double"), "SQRT": lambda x: F.when(x < 0, M.NAN).otherwise(F.sqrt(x)),
    "SECONDS": M.seconds, "MINUTES": M.minutes, "HOURS": M.hours, "DAY": M.day, "MONTH": M.month, "YEAR": M.year, "DAYOFWEEK": M.day_of_week,
}


def compiled(text: str, columns: dict[str, Column] | None = None) -> Column:
    """The text as a double Column.

    Names are attributes (``columns``, or the frame's own), PI, TRUE, FALSE and TIME, the column ``time``. ``^`` binds
    tightest, then ``* / %``, ``+ -``, comparisons, ``&&``, ``||``. Chains of ``^`` and of comparisons group from the right, the others
    from the left; a sign belongs to the number or group behind it. Truth is 1.0 and 0.0, division by zero and
    logarithms follow IEEE. Text that does not parse is a ValueError.
    """
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    known = {"PI": F.lit(3.141592653589793), "TRUE": F.lit(1.0), "FALSE": F.lit(0.0)} | (columns or {})
    place = 0

    def peek() -> str | None:
        return tokens[place][2] if place < len(tokens) else None

    def take(symbol: str) -> None:
        nonlocal place
        if peek() != symbol:
            raise ValueError(f"{symbol!r} is missing in {text!r}")
        place += 1

    def level(n: int) -> Column:
        nonlocal place
        if n == len(LEVELS):
            return operand()
        left = level(n + 1)
        while peek() in LEVELS[n]:
            symbol = peek()
            place += 1
            from_right = LEVELS[n][0] in (">", "^")
            left = BINARY[symbol](left, level(n) if from_right else level(n + 1))
        return left

    def operand() -> Column:
        nonlocal place
        if place >= len(tokens):
            raise ValueError(f"{text!r} ends too early")
        number, name, symbol = tokens[place]
        place += 1
        if number:
            return F.lit(float(number))
        if symbol == "-":
            return -operand()
        if symbol == "+":
            return operand()
        if symbol == "(":
            inner = level(0)
            take(")")
            return inner
        if not name:
            raise ValueError(f"{symbol!r} stands in the wrong place in {text!r}")
        if peek() != "(":
            return M.num(known[name] if name in known else F.col("time" if name == "TIME" else name))
        if name.upper() not in FUNCTIONS:
            raise ValueError(f"there is no function {name}")
        take("(")
        given = []
        while peek() != ")":
            given.append(level(0))
            if peek() != ")":
                take(",")
        take(")")
        return M.num(FUNCTIONS[name.upper()](*given))

    out = level(0)
    if place < len(tokens):
        raise ValueError(f"there is more than one expression in {text!r}")
    return out

"""Formulas as trees: one parser for cell formulas and rule formulas.

A tree is a tuple whose first member names its kind: ``num``, ``text``,
``bool``, ``cell`` (row, col, row fixed, col fixed), ``range`` (r0, c0, r1, c1),
``op`` (sign, left, right), ``neg``, ``percent`` or ``call`` (name, arguments).
Formulas are parsed once per distinct text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from quire.schemas import MAX_COL, MAX_ROW

_CELL = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]*"
_TOKEN = re.compile(
    r"""\s*(?:
    (?P<text>"(?:[^"]|"")*"?)
  | (?P<num>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<ref>(?:'(?:[^']|'')*'!|[^\W\d][\w.]*!)?"""
    + _CELL
    + r"(?::"
    + _CELL
    + r""")?(?![\w(.]))
  | (?P<name>[^\W\d][\w.]*)
  | (?P<sign><>|<=|>=|[-+*/^&=<>%(),;])
)""",
    re.X,
)
#: How tightly two-sided signs bind; ``^`` binds to the right.
_BINDS = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}


class FormulaError(ValueError):
    """What is wrong with a formula or its values."""


def _address(text: str) -> tuple[int, int, bool, bool]:
    fixed_col, letters, fixed_row, digits = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)(\d+)", text).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    row = int(digits)
    if row > MAX_ROW + 1 or col > MAX_COL + 1:
        raise FormulaError(f"no such cell: {text}")
    return row - 1, col - 1, bool(fixed_row), bool(fixed_col)


def _reference(text: str) -> tuple:
    first, _, second = text.rpartition("!")[2].partition(":")
    r0, c0, fixed_row, fixed_col = _address(first)
    if not second:
        return ("cell", r0, c0, fixed_row, fixed_col)
    r1, c1, *_ = _address(second)
    return ("range", min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1))


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:].strip()[:1]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out + [("end", "")]


@lru_cache(maxsize=10_000)
def parse(formula: str) -> tuple:
    """The tree of a formula (with or without ``=`` before it)."""
    text = formula.strip().removeprefix("=")
    if not text.strip():
        raise FormulaError("empty formula")
    tokens, at = _tokens(text), 0

    def take(*wanted: str) -> tuple[str, str]:
        nonlocal at
        token = tokens[at]
        if wanted and token[1] not in wanted:
            raise FormulaError(f"expected {' or '.join(wanted)} at {token[1] or 'the end'!r}")
        at += 1
        return token

    def operand() -> tuple:
        kind, text = take()
        if text in ("+", "-") and kind == "sign":
            inner = operand()
            return inner if text == "+" else ("neg", inner)
        if kind == "num":
            tree: tuple = ("num", float(text))
        elif kind == "text":
            tree = ("text", text[1 : -1 if len(text) > 1 and text.endswith('"') else None].replace('""', '"'))
        elif kind == "ref":
            tree = _reference(text)
        elif kind == "name" and text.upper() in ("TRUE", "FALSE"):
            tree = ("bool", text.upper() == "TRUE")
        elif kind == "name":
            take("(")
            arguments = []
            while tokens[at][1] != ")":
                if arguments:
                    take(",", ";")
                arguments.append(expression(1))
            take(")")
            tree = ("call", text.upper(), tuple(arguments))
        elif text == "(":
            tree = expression(1)
            take(")")
        else:
            raise FormulaError(f"unexpected {text or 'end of formula'!r}")
        while tokens[at] == ("sign", "%"):
            take()
            tree = ("percent", tree)
        return tree

    def expression(least: int) -> tuple:
        left = operand()
        compared = False
        while tokens[at][0] == "sign" and _BINDS.get(tokens[at][1], 0) >= least:
            sign = tokens[at][1]
            if _BINDS[sign] == 1 and compared:
                break  # comparisons do not chain
            compared = _BINDS[sign] == 1
            take()
            left = ("op", sign, left, expression(_BINDS[sign] + (sign != "^")))
        return left

    tree = expression(1)
    if tokens[at][0] != "end":
        raise FormulaError(f"unexpected {tokens[at][1]!r}")
    return tree


def references(tree: tuple) -> list[tuple]:
    """The ``cell`` and ``range`` trees in a tree, each once, in order."""
    found: dict[tuple, None] = {}

    def walk(t: tuple) -> None:
        if t[0] in ("cell", "range"):
            found[t] = None
        for x in t[1:]:
            for y in x if isinstance(x, tuple) and x and isinstance(x[0], tuple) else (x,):
                if isinstance(y, tuple) and y:
                    walk(y)

    walk(tree)
    return list(found)

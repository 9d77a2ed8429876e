"""The query line: ``table column op 'value' column QUANTIFIER ['pattern',...]``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.patterns import QueryError
from ..functions.predicates import COMPARE, QUANTIFIERS


@dataclass(frozen=True)
class CountQuery:
    """Count the rows of ``table`` where ``column op value`` and the quantified LIKE on ``like_column`` hold."""

    table: str
    column: str
    op: str
    value: str
    like_column: str
    quantifier: str
    patterns: tuple[str, ...]


_WORD = re.compile(r"\s*(\S+)")
#: A quoted text ends at its quote before white space, a comma, a bracket or the end, so quotes, spaces and commas may stand in it.
_QUOTED = re.compile(r"""\s*(['"`])(.*?)\1(?=\s|,|\]|$)""", re.S)


def parse_query(line: str) -> CountQuery:
    """Read a query line; white space separates, quotes protect.  Raises ``QueryError``."""
    at = 0

    def take(pattern: re.Pattern, what: str) -> str:
        nonlocal at
        m = pattern.match(line, at)
        if not m:
            raise QueryError(f"{what} expected at {line[at:at + 30]!r} of {line!r}")
        at = m.end()
        return m[m.lastindex]

    table, column, op = take(_WORD, "a table"), take(_WORD, "a column"), take(_WORD, "a comparison")
    value, like_column, quantifier = take(_QUOTED, "a quoted value"), take(_WORD, "a column"), take(_WORD, "a quantifier")
    take(re.compile(r"\s*(\[)"), "[")
    patterns = []
    while not re.compile(r"\s*\]\s*$").match(line, at):
        if patterns:
            take(re.compile(r"\s*(,)"), "a comma or ]")
        patterns.append(take(_QUOTED, "a quoted pattern"))
    if op not in COMPARE:
        raise QueryError(f"unknown comparison {op!r} in {line!r}")
    if quantifier not in QUANTIFIERS:
        raise QueryError(f"unknown quantifier {quantifier!r} in {line!r}")
    return CountQuery(table, column, op, value, like_column, quantifier, tuple(patterns))


__all__ = ["CountQuery", "QueryError", "parse_query"]

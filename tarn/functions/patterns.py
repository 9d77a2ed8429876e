"""The LIKE dialect: patterns are classified and rewritten on the driver, once per query.

In the default dialect a character is escaped if the one before it is a backslash, an
inner ``%`` leaves both ends of a pattern open, the empty pattern matches everything,
and ``_`` stands for one byte.  ``compile_pattern`` turns a pattern into its class and
its literal parts; ``functions.predicates`` makes native columns of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import IntEnum

_PERCENT, _WILD = re.compile(r"(?<!\\)%"), re.compile(r"(?<!\\)_")


class QueryError(ValueError):
    """A query that can't be understood, or names what isn't there."""


#: A backslash that nothing escapes, a wildcard, or any other character.
_PIECE = re.compile(r"(?P<drop>(?<!\\)\\)|(?P<wild>(?<!\\)_)|(?P<char>.)", re.S)


class Kind(IntEnum):
    """Pattern classes, the cheapest to test first."""

    ANY = 0
    ANY_FIXED = 1
    CONST = 2
    PREFIX = 3
    SUFFIX = 4
    FIXED = 5
    FULL = 6


#: One byte of any value, within the parts of a pattern.
BYTE = None


@dataclass(frozen=True)
class Pattern:
    """``parts``: literal strings and ``BYTE``, token by token; more than one token only if ``FULL``."""

    kind: Kind
    tokens: tuple[tuple[str | None, ...], ...]

    @property
    def wild(self) -> bool:
        return any(p is BYTE for t in self.tokens for p in t)

    @property
    def literal(self) -> str:
        """The text of a pattern of one token without wildcards."""
        return "".join(p for t in self.tokens for p in t)

    @property
    def like(self) -> str:
        """The same in standard LIKE with the escape ``\\``."""
        inner = ["".join("_" if p is BYTE else re.sub(r"([%_\\])", r"\\\1", p) for p in t) for t in self.tokens]
        if self.kind == Kind.ANY:
            return "%"
        body = "%".join(inner)
        before = "%" if self.kind in (Kind.SUFFIX, Kind.FIXED, Kind.FULL) else ""
        after = "%" if self.kind in (Kind.PREFIX, Kind.FIXED, Kind.FULL) else ""
        return before + body + after


def _parts(text: str, bar: bool) -> tuple[str | None, ...]:
    """Literals and wildcards of a piece of pattern; ``bar``: a ``|`` is a wildcard too."""
    out: list[str | None] = []
    for m in _PIECE.finditer(text):
        if m["drop"]:
            continue
        if m["wild"] or bar and m["char"] == "|":
            out.append(BYTE)
        elif out and out[-1] is not BYTE:
            out[-1] += m["char"]
        else:
            out.append(m["char"])
    return tuple(out)


def _tokens(pattern: str) -> list[str]:
    """The pieces of a pattern of class FULL.

    Percent signs at either end, escaped or not, separate like others do.  Within, one
    is a literal if a single backslash stands before it that is not the first character.
    """
    core = pattern.rstrip("%")
    at = len(pattern) - len(pattern.lstrip("%"))
    cuts = [i for i in range(at, len(core)) if core[i] == "%" and not (i >= 2 and core[i - 1] == "\\" != core[i - 2])]
    edges = [at - 1, *cuts, len(core)]
    return [core[a + 1 : b] for a, b in zip(edges[:-1], edges[1:])]


def compile_pattern(pattern: str, dialect: str = "reference") -> Pattern:
    """Classify a pattern.  ``dialect``: "reference" as above, or "sql" for standard LIKE with the escape ``\\``."""
    if dialect == "sql":
        return _compile_sql(pattern)
    if dialect != "reference":
        raise ValueError(f"unknown dialect {dialect!r}")
    percents, wilds = len(_PERCENT.findall(pattern)), len(_WILD.findall(pattern))
    if percents == len(pattern):
        return Pattern(Kind.ANY, ())
    if wilds == len(pattern):
        return Pattern(Kind.ANY_FIXED, ((BYTE,) * wilds,))
    bar = wilds > 0
    if percents == 0:
        return Pattern(Kind.CONST, (_parts(pattern, bar),))
    if percents == 2 and pattern[0] == pattern[-1] == "%":
        return Pattern(Kind.FIXED, (_parts(pattern[1:-1], bar),))
    if percents == 1 and pattern[0] == "%":
        return Pattern(Kind.SUFFIX, (_parts(pattern[1:], bar),))
    if percents == 1 and pattern[-1] == "%":
        return Pattern(Kind.PREFIX, (_parts(pattern[:-1], bar),))
    return Pattern(Kind.FULL, tuple(t for t in (_parts(x, True) for x in _tokens(pattern)) if t))


def _compile_sql(pattern: str) -> Pattern:
    """Standard LIKE: anchored at both ends, ``\\`` escapes ``%``, ``_`` and itself only."""
    tokens: list[list[str | None]] = [[]]
    chars = iter(pattern)
    for c in chars:
        if c == "\\":
            c = next(chars, "")
            if c not in ("%", "_", "\\"):
                raise QueryError(f"stray escape in LIKE pattern {pattern!r}")
        elif c == "%":
            tokens.append([])
            continue
        elif c == "_":
            tokens[-1].append(BYTE)
            continue
        tokens[-1].append(c)
    made = tuple(tuple(t) for t in tokens)
    inner = [t for t in made if t]
    if len(made) == 1:
        return Pattern(Kind.CONST, made)
    if not inner:
        return Pattern(Kind.ANY, ())
    if len(inner) == 1 and (made[0] or made[-1]):
        if not (made[0] and made[-1]):
            return Pattern(Kind.PREFIX if made[0] else Kind.SUFFIX, tuple(inner))
    if len(inner) == 1:
        return Pattern(Kind.FIXED, tuple(inner))
    return AnchoredPattern(Kind.FULL, tuple(inner), bool(made[0]), bool(made[-1]))


@dataclass(frozen=True)
class AnchoredPattern(Pattern):
    """A standard pattern of several tokens, which may be bound to either end."""

    at_start: bool = False
    at_end: bool = False

    @property
    def like(self) -> str:
        text = super().like
        return text[1 if self.at_start else 0 : -1 if self.at_end else None]

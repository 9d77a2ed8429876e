"""Comparison and quantified LIKE predicates as native columns.

Everything is a built-in expression, so partition filters, pushed filters, column
pruning and code generation come from Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, eq, gt, lt, ne, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BYTE, Kind, Pattern, compile_pattern

COMPARE = {"=": eq, "!=": ne, ">": gt, "<": lt}
QUANTIFIERS = ("ALL_LIKE", "ANY_LIKE", "NONE_LIKE")


def compare(col: Column, op: str, value: str) -> Column:
    """Byte-wise string comparison; ``=``, ``!=``, ``>`` and ``<`` only."""
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}; there are {' '.join(COMPARE)}")
    return COMPARE[op](col, F.lit(value))


def matches(col: Column, pattern: Pattern, by_bytes: bool = True) -> Column:
    """Whether ``col`` (string, not null) matches; ``_`` is a byte, or a character if not ``by_bytes``."""
    if pattern.kind == Kind.ANY or pattern.kind == Kind.FULL and not pattern.tokens:
        return F.lit(True)
    if pattern.kind == Kind.ANY_FIXED:
        return F.octet_length(col) == len(pattern.tokens[0])
    if pattern.wild:
        if not by_bytes:
            return col.like(pattern.like)
        # One character for each byte, on both sides.
        return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1").like(pattern.like.encode().decode("latin-1"))
    if pattern.kind == Kind.CONST:
        return col == pattern.literal
    if pattern.kind == Kind.PREFIX:
        return col.startswith(pattern.literal)
    if pattern.kind == Kind.SUFFIX:
        return col.endswith(pattern.literal)
    if pattern.kind == Kind.FIXED or len(pattern.tokens) == 1:
        return col.contains(pattern.literal)
    return col.like(pattern.like)


def _balanced(f, terms: list[Column]) -> Column:
    """Joined as a balanced tree, so hundreds of patterns don't nest hundreds deep."""
    while len(terms) > 1:
        terms = [reduce(f, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def like_quantified(col: Column, quantifier: str, patterns: Iterable[str], dialect: str = "reference") -> Column:
    """ALL_LIKE, ANY_LIKE or NONE_LIKE of the patterns; of no patterns: true, false, true.

    Each pattern counts once, and a row counts once however many it matches.  Cheap
    classes come first, and what a shorter prefix, suffix or infix already decides is
    left out.
    """
    if quantifier not in QUANTIFIERS:
        raise ValueError(f"unknown quantifier {quantifier!r}; there are {' '.join(QUANTIFIERS)}")
    compiled = sorted({compile_pattern(p, dialect) for p in patterns}, key=lambda p: (p.kind, p.like))
    compiled = subsumed(compiled, keep_longest=quantifier == "ALL_LIKE")
    if not compiled:
        return F.lit(quantifier != "ANY_LIKE")
    if quantifier == "ALL_LIKE":
        return _balanced(and_, [matches(col, p, dialect == "reference") for p in compiled])
    starts = [p.literal if p.kind in (Kind.CONST, Kind.PREFIX) and not p.wild else "" for p in compiled]
    sets, compiled = _in_sets(col, compiled)
    anyone = _balanced(or_, sets + [matches(col, p, dialect == "reference") for p in compiled])
    if not compiled and quantifier == "ANY_LIKE" and all(starts):
        anyone = _within(col, starts) & anyone
    return anyone if quantifier == "ANY_LIKE" else ~anyone


#: Beyond so many constants, prefixes or suffixes, they are looked up by hash instead of one after another.
MANY = 16


def _in_sets(col: Column, patterns: list[Pattern]) -> tuple[list[Column], list[Pattern]]:
    """Set lookups for kinds of which there are many, one for each length; the patterns that are left."""
    terms: list[Column] = []
    for kind in (Kind.CONST, Kind.PREFIX, Kind.SUFFIX):
        own = {p for p in patterns if p.kind == kind and not p.wild and p.literal}
        if len(own) <= MANY:
            continue
        patterns = [p for p in patterns if p not in own]
        by_length: dict[int, list[str]] = {}
        for p in own:
            by_length.setdefault(0 if kind == Kind.CONST else len(p.literal), []).append(p.literal)
        for n, values in sorted(by_length.items()):
            part = col if not n else F.substring(col, 1, n) if kind == Kind.PREFIX else F.substring(col, -n, n)
            # A shorter text's end is the whole text, which has another length than the suffixes.
            terms.append(part.isin(sorted(values)))
    return terms, patterns


def _within(col: Column, starts: list[str]) -> Column:
    """What values beginning with one of these lie between; unlike a set of their beginnings, this can be pushed into a scan."""
    out, last = col >= min(starts), max(starts)
    if last and last[-1] not in ("\ud7ff", "\U0010ffff"):
        out = out & (col < last[:-1] + chr(ord(last[-1]) + 1))
    return out


def subsumed(patterns: list[Pattern], keep_longest: bool) -> list[Pattern]:
    """Without patterns that others make redundant: of prefixes a%, ab% an OR needs the shortest, an AND the longest.

    Sorted neighbours are enough to look at, so this is n log n in the number of patterns.
    """
    out = [p for p in patterns if p.kind not in (Kind.PREFIX, Kind.SUFFIX) or p.wild]
    for kind in (Kind.PREFIX, Kind.SUFFIX):
        own = {(p.literal if kind == Kind.PREFIX else p.literal[::-1]): p for p in patterns if p.kind == kind and not p.wild}
        last = None
        for text in sorted(own, reverse=keep_longest):
            # In reverse order a prefix of the last one kept follows it; in order, an extension does.
            if last is not None and (last.startswith(text) if keep_longest else text.startswith(last)):
                continue
            out.append(own[text])
            last = text
    return sorted(out, key=lambda p: (p.kind, p.like))


__all__ = ["BYTE", "COMPARE", "QUANTIFIERS", "compare", "like_quantified", "matches", "subsumed"]

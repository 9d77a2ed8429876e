"""The pattern compiler, without Spark."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.functions.patterns import Kind, compile_pattern

# pattern, class, standard LIKE with the escape \
TABLE = [
    ("", Kind.ANY, "%"),
    ("%", Kind.ANY, "%"),
    ("%%", Kind.ANY, "%"),
    ("___", Kind.ANY_FIXED, "___"),
    ("abc", Kind.CONST, "abc"),
    (r"a\_b", Kind.CONST, r"a\_b"),
    (r"\x", Kind.CONST, "x"),
    (r"\\%", Kind.CONST, r"\\\%"),
    (r"\\\\", Kind.CONST, r"\\\\\\"),
    (r"a\\", Kind.CONST, r"a\\"),
    (r"\%", Kind.CONST, r"\%"),
    ("abc%", Kind.PREFIX, "abc%"),
    ("a_%", Kind.PREFIX, "a_%"),
    (r"a%\%", Kind.PREFIX, r"a\%%"),
    (r"a%b\%", Kind.PREFIX, r"a\%b%"),
    ("%abc", Kind.SUFFIX, "%abc"),
    ("%_", Kind.SUFFIX, "%_"),
    (r"%\%", Kind.SUFFIX, r"%\%"),
    ("%abc%", Kind.FIXED, "%abc%"),
    (r"%a%\%", Kind.FIXED, r"%a\%%"),
    ("a%b", Kind.FULL, "%a%b%"),
    ("a%b%", Kind.FULL, "%a%b%"),
    ("%a%b", Kind.FULL, "%a%b%"),
    ("%%a", Kind.FULL, "%a%"),
    ("a%%", Kind.FULL, "%a%"),
    ("%a%%", Kind.FULL, "%a%"),
    (r"\%b%c", Kind.FULL, "%b%c%"),
    (r"a\%b%c", Kind.FULL, r"%a\%b%c%"),
    (r"a%\_b", Kind.FULL, r"%a%\_b%"),
]


@pytest.mark.parametrize("pattern, kind, like", TABLE)
def test_table(pattern, kind, like):
    found = compile_pattern(pattern)
    assert (found.kind, found.like) == (kind, like)


def test_bar_is_a_wildcard_with_one_or_between_percents():
    assert compile_pattern("a|b").like == "a|b"
    assert compile_pattern("a|_").like == "a__"
    assert compile_pattern("a|%b").like == "%a_%b%"


def like_matches(like: str, value: bytes) -> bool:
    """Standard LIKE on bytes."""
    out, chars = b"", iter(like)
    for c in chars:
        out += re.escape(next(chars).encode()) if c == "\\" else b".*" if c == "%" else b"." if c == "_" else re.escape(c.encode())
    return re.fullmatch(out, value, re.S) is not None


def matches(pattern: str, value: bytes) -> bool:
    """The dialect for patterns without backslashes and bars, by its definition: tokens one after another."""
    percents = pattern.count("%")
    if percents == len(pattern):
        return True

    def at(token: bytes, i: int) -> bool:
        return i + len(token) <= len(value) and i >= 0 and all(t in (ord("_"), v) for t, v in zip(token, value[i:]))

    tokens = [t.encode() for t in pattern.split("%") if t]
    if percents == 0:
        return len(tokens[0]) == len(value) and at(tokens[0], 0)
    if percents == 1 and pattern[-1] == "%":
        return at(tokens[0], 0)
    if percents == 1 and pattern[0] == "%":
        return at(tokens[0], len(value) - len(tokens[0]))
    i = 0
    for t in tokens:
        while i <= len(value) and not at(t, i):
            i += 1
        if i > len(value):
            return False
        i += len(t)
    return True


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab%_é", max_size=7), st.text(alphabet="abé\n", max_size=8))
def test_rewrite_equals_definition(pattern, value):
    assert like_matches(compile_pattern(pattern).like, value.encode()) == matches(pattern, value.encode())


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab%_\\|", max_size=8))
def test_every_pattern_compiles_to_valid_like(pattern):
    assert re.fullmatch(r"(?:[^\\]|\\[\\%_])*", compile_pattern(pattern).like, re.S)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab%_", max_size=7), st.text(alphabet="ab", max_size=8))
def test_sql_dialect_is_standard_like(pattern, value):
    found = compile_pattern(pattern, "sql")
    assert like_matches(found.like, value.encode()) == like_matches(pattern, value.encode())


def test_sql_dialect_rejects_stray_escapes():
    assert compile_pattern(r"a\%b", "sql").like == r"a\%b"
    for bad in (r"\x", "a\\"):
        with pytest.raises(ValueError):
            compile_pattern(bad, "sql")
    with pytest.raises(ValueError):
        compile_pattern("a", "other")


def spelled_out(pattern):
    """The class and its pieces (a wildcard is None), character by character."""
    free = [c for i, c in enumerate(pattern) if c in "%_" and not (i and pattern[i - 1] == "\\")]
    n, percents, wilds = len(pattern), free.count("%"), free.count("_")

    def clean(text, bar):
        out = []
        for i, c in enumerate(text):
            after_backslash = i > 0 and text[i - 1] == "\\"
            if c == "\\" and not after_backslash:
                continue
            out.append(None if c == "_" and not after_backslash or bar and c == "|" else c)
        return out

    if percents == n:
        return Kind.ANY, []
    if wilds == n:
        return Kind.ANY_FIXED, [[None] * n]
    if percents == 0:
        return Kind.CONST, [clean(pattern, wilds > 0)]
    if percents == 2 and pattern.startswith("%") and pattern.endswith("%"):
        return Kind.FIXED, [clean(pattern[1:-1], wilds > 0)]
    if percents == 1 and pattern.startswith("%"):
        return Kind.SUFFIX, [clean(pattern[1:], wilds > 0)]
    if percents == 1 and pattern.endswith("%"):
        return Kind.PREFIX, [clean(pattern[:-1], wilds > 0)]
    begin, end = 0, n
    while pattern[begin] == "%":
        begin += 1
    while pattern[end - 1] == "%":
        end -= 1
    pieces, piece = [], ""
    for i in range(begin, end):
        single = i > 1 and pattern[i - 1] == "\\" and pattern[i - 2] != "\\"
        if pattern[i] == "%" and not single:
            pieces.append(piece)
            piece = ""
        else:
            piece += pattern[i]
    return Kind.FULL, [x for x in (clean(p, True) for p in [*pieces, piece]) if x]


def test_all_short_patterns_with_backslashes():
    from itertools import product

    for n in range(7):
        for letters in product("a%_|\\" if n < 6 else "a%_\\", repeat=n):
            pattern = "".join(letters)
            found = compile_pattern(pattern)
            parts = [[c for p in t for c in ([None] if p is None else p)] for t in found.tokens]
            kind, pieces = spelled_out(pattern)
            assert (found.kind, [p for p in parts if p]) == (kind, [p for p in pieces if p]), pattern

import pytest

from tarn.plans.query import CountQuery, QueryError, parse_query


def test_fields():
    q = parse_query("t column0 > 'b' column1 ANY_LIKE ['ab%','%yz','%mid%']")
    assert q == CountQuery("t", "column0", ">", "b", "column1", "ANY_LIKE", ("ab%", "%yz", "%mid%"))


@pytest.mark.parametrize(
    "value, patterns, text",
    [
        ("a b", ("x y%",), "'a b' c ALL_LIKE ['x y%']"),
        ("", ("a,b", "c"), "'' c ALL_LIKE ['a,b', 'c']"),
        ("it's", ("'",), "'it's' c ALL_LIKE [''']"),
        ('"', (), "'\"' c ALL_LIKE []"),
        ("v", (r"\%",), r"""  "v"   c ALL_LIKE  [ "\%" ]  """),
        ("]", ("[a]%",), "']' c ALL_LIKE ['[a]%']"),
    ],
)
def test_quotes_protect(value, patterns, text):
    q = parse_query(f"t k = {text}")
    assert (q.value, q.patterns) == (value, patterns)


@pytest.mark.parametrize(
    "line",
    [
        "", "t", "t c = 'a'", "t c >= 'a' d ALL_LIKE ['x']", "t c in 'a' d ALL_LIKE ['x']", "t c = a d ALL_LIKE ['x']", "t c = 'a' d SOME_LIKE ['x']",
        "t c = 'a' d ALL_LIKE ['x'", "t c = 'a' d ALL_LIKE 'x'", "t c = 'a' d ALL_LIKE ['x' 'y']", "t c = 'a' d ALL_LIKE ['x'] more",
    ],
)
def test_errors(line):
    with pytest.raises(QueryError):
        parse_query(line)

"""Lakes of text files: formats, discovery, routes, pruning."""

import pytest

from tarn.operators.engine import Engine, run_files
from tarn.operators.metadata import column_stats, file_counts, partition_values, table_counts
from tarn.plans.query import QueryError
from tarn.sources.lake import discover, read_text, to_parquet


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"a|bb\r\nccc|d\r\n", [("a", "bb"), ("ccc", "d")]),
        (b"a|bb\nccc|d\n", [("a", "bb"), ("ccc", "d")]),
        (b"a|bb\r\nccc|d", [("a", "bb"), ("ccc", "d")]),
        (b"a|\r\n|b\r\n", [("", "b"), ("a", "")]),
        (b"a|b\r\nc\r\n", [("a", "b"), ("c", "")]),
        (b"a|b\r\nc|d|e\r\n", [("a", "b", ""), ("c", "d", "e")]),
        (b"c\rd|e\r\n", [("c\rd", "e")]),
        (b"c|a\r\r\n", [("c", "a\r")]),
        (b'"a|b"\n', [('"a', 'b"')]),
        ("é|你\r\n".encode(), [("é", "你")]),
        (b"", []),
    ],
)
def test_formats(spark, tmp_path, data, expected):
    (tmp_path / "f.csv").write_bytes(data)
    df = read_text(spark, str(tmp_path))
    assert rows(df) == expected
    assert df.columns == [f"column{i}" for i in range(len(expected[0]) if expected else 1)]


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake") / "database"
    for p, q, data in (("9", "x", "a|1\r\nb|2\r\n"), ("9", "y", "ab|3\r\n"), ("10", "x", "b|4\r\nabc|5\r\n"), ("01", "y", "|6\r\n")):
        (folder := root / "t" / f"p={p}" / f"q={q}").mkdir(parents=True)
        (folder / "f.csv").write_bytes(data.encode())
    (root / "flat").mkdir()
    (root / "flat" / "one.csv").write_bytes("red apple|1\nblue|2\n".encode())
    (root / "flat" / "two.csv").write_bytes("red|3\né|4\n".encode())
    (root / "flat" / ".hidden.csv").write_bytes(b"no|0\n")
    (root / ".hidden").mkdir()
    (root / "mixed" / "k=1").mkdir(parents=True)
    (root / "mixed" / "f.csv").write_bytes(b"x\n")
    (root / "file.csv").write_bytes(b"x\n")
    return root


def count(engine, line):
    return engine.count(line).first()["n"]


def test_discovery(spark, lake):
    catalog = discover(spark, str(lake))
    assert list(catalog) == ["flat", "t"] and list(catalog.errors) == ["mixed"]
    assert catalog.tables["t"].keys == ("p", "q")
    assert catalog.table("t").columns == ["column0", "column1", "p", "q"]
    assert {r["p"] for r in catalog.table("t").collect()} == {"9", "10", "01"}  # as written, not as numbers
    with pytest.raises(QueryError, match="both files and folders"):
        catalog.table("mixed")
    with pytest.raises(QueryError, match="no table"):
        catalog.table("absent")


@pytest.mark.parametrize(
    "line, n",
    [
        ("t column0 > 'a' column1 ALL_LIKE ['%']", 4),
        ("t column0 = '' column1 ALL_LIKE ['%']", 1),
        ("t p > '10' column0 ANY_LIKE ['a%']", 2),
        ("t p > '5' column0 ALL_LIKE ['%']", 3),  # strings: '9' > '5' > '10'
        ("t p = 'none' column0 ALL_LIKE ['%']", 0),
        ("t p != '9' column0 NONE_LIKE ['a%']", 2),
        ("t column0 < 'b' p NONE_LIKE ['1%']", 3),
        ("t column0 < 'b' p ANY_LIKE ['1%','0_']", 2),
        ("t p = '9' q ALL_LIKE ['x']", 2),
        ("flat column0 = 'red apple' column1 ALL_LIKE ['1']", 1),  # a space in a value
        ("flat column0 > 'z' column1 ALL_LIKE ['_']", 1),  # unsigned bytes: é sorts after z
        ("flat column0 != '' column0 ALL_LIKE ['__']", 1),  # é is two bytes
    ],
)
def test_routes(spark, lake, line, n):
    assert count(Engine(discover(spark, str(lake))), line) == n


def test_the_head_tells_the_width(spark, tmp_path):
    from tarn.sources import lake as module

    (folder := tmp_path / "database" / "t").mkdir(parents=True)
    (folder / "f.csv").write_bytes(b"a|b\n" * module.HEAD + b"c|d|e\n")
    wide = Engine(discover(spark, str(tmp_path / "database"), {"t": 3}))
    assert count(wide, "t column2 = 'e' column0 ALL_LIKE ['c']") == 1
    found = discover(spark, str(tmp_path / "database"))
    assert found.table("t").columns == ["column0", "column1"]
    with pytest.raises(Exception, match="width must be given"):
        count(Engine(found), "t column1 = 'd' column0 ALL_LIKE ['c']")
    assert read_text(spark, str(folder)).columns == ["column0", "column1", "column2"]


def test_unknown_columns(spark, lake):
    engine = Engine(discover(spark, str(lake)))
    with pytest.raises(QueryError, match="no column"):
        engine.count("t column7 = 'a' column0 ALL_LIKE ['%']")


def test_parquet_lakes_keep_keys_as_written(spark, tmp_path):
    root = tmp_path / "database"
    for k, n in (("01", 1), ("9", 2), ("10", 3), ("1.5", 4), ("x y%", 5)):
        spark.range(n).selectExpr("CAST(id AS STRING) AS c").coalesce(1).write.parquet(str(root / "t" / f"k={k.replace('%', '%25')}" / "q=1"))
        for f in (root / "t" / f"k={k.replace('%', '%25')}" / "q=1").glob("*"):
            if not f.name.endswith(".parquet"):
                f.unlink()
    (root / "t" / "k=00" / "q=1").mkdir(parents=True)  # the first branch is empty
    (root / "t" / "k=9" / "q=1" / "_SUCCESS").touch()
    catalog = discover(spark, str(root))
    assert catalog.tables["t"].keys == ("k", "q") and catalog.tables["t"].format == "parquet" and not catalog.errors
    engine = Engine(catalog)
    assert dict(catalog.table("t").dtypes) == {"c": "string", "k": "string", "q": "string"}
    for condition, n in (("= '01'", 1), ("= '1'", 0), ("> '10'", 2 + 5), ("< '1.5'", 1), ("= '1.5'", 4), ("= 'x y%'", 5), ("!= ''", 15)):
        assert count(engine, f"t k {condition.split()[0]} {condition.split(' ', 1)[1]} c NONE_LIKE []") == n
    text = plan(engine.count("t k > '10' c ANY_LIKE ['1%']"))
    assert "PartitionFilters: [isnotnull(k" in text and "PushedFilters: [IsNotNull(c), StringStartsWith(c,1)]" in text


@pytest.mark.parametrize(
    "files, error",
    [
        (["k=1/f.csv", "j=2/f.csv"], "partitioned by j or k"),
        (["k=1/f.csv", "k=2/j=1/f.csv"], "both files and folders"),
        (["k=1/f.csv", "odd/f.csv"], "named key=value"),
        (["k=1/f.csv", "k=2/f.parquet"], "both Parquet and other files"),
    ],
)
def test_every_branch_is_looked_at(spark, tmp_path, files, error):
    for f in files:
        (at := tmp_path / "database" / "t" / f).parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"a\n")
    assert error in discover(spark, str(tmp_path / "database")).errors["t"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Own

    from tarn.sources.scratch import shared_folder

    folders = []
    session = lambda master: Own(sparkContext=Own(getCheckpointDir=lambda: folders[-1] if folders else None, setCheckpointDir=folders.append, master=master), conf=Own(get=lambda *_: None))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            shared_folder(session(master))
    assert shared_folder(session("local[4]")) == folders[-1]


def test_a_count_may_read_footers_only(spark, tmp_path):
    from tarn.operators.metadata import row_count

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = row_count(spark, str(tmp_path / "t"))
    assert "PushedAggregation: [COUNT(*)]" in plan(df) and df.first()["n_rows"] == 1000


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_partitions_are_pruned(spark, lake):
    engine = Engine(discover(spark, str(lake)))
    text = plan(engine.count("t p > '10' column0 ANY_LIKE ['a%']"))
    assert "PartitionFilters: [isnotnull(p" in text and "> 10" in text
    text = plan(engine.count("t column0 > '' p ANY_LIKE ['1%','%9']"))
    assert "StartsWith(p" in text.split("PartitionFilters")[1]
    # Two conditions on keys read no column at all.
    text = plan(engine.count("t p = '9' q ALL_LIKE ['x%']"))
    assert "ReadSchema: struct<>" in text and "StartsWith(q" in text.split("PartitionFilters")[1]


def test_filters_and_columns_reach_parquet(spark, lake, tmp_path):
    catalog = discover(spark, str(lake))
    as_parquet = to_parquet(catalog.table("t"), str(tmp_path / "t"), ("p", "q"))
    catalog.add("stored", as_parquet, ("p", "q"))
    df = Engine(catalog).count("stored column0 > 'a' column0 ANY_LIKE ['a%','%c']")
    text = plan(df)
    assert "GreaterThan(column0,a)" in text and "StringStartsWith(column0,a)" in text and "ReadSchema: struct<column0:string>" in text
    assert df.first()["n"] == 2 and "Python" not in text
    assert rows(as_parquet) == rows(catalog.table("t"))


def test_files(spark, lake, tmp_path):
    (tmp_path / "params.txt").write_text("t column0 > 'a' column1 ALL_LIKE ['%']\n\nt p = '9' column0 NONE_LIKE ['b%']\nflat column0 = 'red' column1 ANY_LIKE ['3']\n")
    out = tmp_path / "out.txt"
    out.write_text("old and longer than the new one")
    seconds = run_files(spark, str(lake), str(tmp_path / "params.txt"), str(out))
    assert out.read_text() == "4\n2\n1" and set(seconds) == {"build", "search", "total"}
    (tmp_path / "bad.txt").write_text("t column0 > 'a' column1 ALL_LIKE ['%']\nabsent c = '' c ALL_LIKE []\n")
    with pytest.raises(QueryError, match="absent"):
        run_files(spark, str(lake), str(tmp_path / "bad.txt"), str(out))
    assert out.read_text() == "4\n2\n1"


def test_metadata(spark, lake):
    t = discover(spark, str(lake)).table("t")
    assert table_counts(t).first().asDict() == {"n_files": 4, "n_rows": 6}
    assert sorted(r["n_rows"] for r in file_counts(t).collect()) == [1, 1, 2, 2]
    assert rows(partition_values(t, "p")) == [("01", 1), ("10", 2), ("9", 3)]
    found = {r["column_name"]: r for r in column_stats(t).collect()}
    assert tuple(found["column0"])[1:] == ("", "b", 0, 3, 1, False, 6)  # the mean of 8 bytes in 6 rows is cut
    assert tuple(found["column1"])[1:] == ("1", "6", 1, 1, 1, True, 6)
    by_file = [r for r in column_stats(t, ["column0"], by_file=True).collect() if "p=10" in r["file"]]
    assert [(r["min_value"], r["max_value"], r["n_rows"]) for r in by_file] == [("abc", "b", 2)]
    empty = column_stats(t.where("false"), ["column0"]).first()
    assert empty["n_rows"] == 0 and empty["avg_bytes"] is None

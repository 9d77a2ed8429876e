"""The library's queries over the test tables and the same in SQL, by name.

The SQL is written out from the meaning of each query, not made by the pattern compiler.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.engine import Engine
from .operators.engine import run_files
from .operators.metadata import column_stats, partition_values, row_count, table_counts
from .plans.query import parse_query
from .sources.batch import drop_folder, read_queries, write_lines
from .sources.lake import Catalog, LakeTable, discover, read_text, to_parquet, write_text
from .sources.scratch import shared_folder
from .streaming.counts import stream_counts, stream_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
OPS = {"eq": "=", "ne": "!=", "gt": ">", "lt": "<"}
DATE = "strftime(o_orderdate, '%Y-%m-%d')"

_lakes: dict[tuple[str, ...], str] = {}


def _tables(spark: SparkSession, sf_dir: str) -> Engine:
    """The Parquet tables as they are; each is opened when a query asks for it."""
    catalog = Catalog(spark)
    for name in ("part", "customer", "orders", "events", "documents"):
        catalog.tables[name] = LakeTable(name, f"{sf_dir}/{name}.parquet", (), "parquet")
    return Engine(catalog)


def orders_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake of one text table, CRLF rows, in partitions by priority and status; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        rows = orders.select(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"))
        root = f"{shared_folder(spark)}/lake-{abs(hash(key))}/database"
        write_text(rows, f"{root}/orders", ("prio", "status"))
        _lakes[key] = root
    return _lakes[key]


KEYS = {"1-URGENT": "01", "2-HIGH": "9", "3-MEDIUM": "10"}


def parquet_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake of one Parquet table in partitions whose keys look like numbers: 01, 9, 10 and 1.5; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "parquet")
    if key not in _lakes:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        named = F.coalesce(F.create_map(*(F.lit(x) for kv in KEYS.items() for x in kv))[F.col("o_orderpriority")], F.lit("1.5"))
        root = f"{shared_folder(spark)}/lake-{abs(hash(key))}/database"
        to_parquet(orders.select(F.col("o_custkey").cast("string").alias("customer"), "o_orderstatus", named.alias("k")), f"{root}/orders", ("k",))
        _lakes[key] = root
    return _lakes[key]


def _parquet_lake(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(discover(spark, parquet_lake(spark, sf_dir)))


def _lake(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(discover(spark, orders_lake(spark, sf_dir), {"orders": 3}))


def _add(name: str, line: str, sql: str, engine: Callable[[SparkSession, str], Engine] = _tables) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).count(line)
    ORACLE_SQL[name] = sql


def _count(table: str, where: str) -> str:
    return f"SELECT count(*) AS n FROM {table} WHERE {where}"


def _like(column: str, quantifier: str, patterns: list[str]) -> str:
    terms = [f"{column} LIKE '{p}'" for p in patterns]
    return {"all": "(" + " AND ".join(terms) + ")", "any": "(" + " OR ".join(terms) + ")", "none": "NOT (" + " OR ".join(terms) + ")"}[quantifier]


def _matrix() -> None:
    sets = {
        "q1": ("part", "p_brand", "Brand#2", "p_name", "p_brand", "p_name", {"all": ["%i%", "%g%"], "any": ["red%", "%bolt", "%d w%"], "none": ["red%", "%bolt", "_l%"]}, _tables),
        "q2": ("orders", "prio", "3-MEDIUM", "column2", "o_orderpriority", DATE, {"all": ["199%", "%-0_-%"], "any": ["1995%", "%-31", "%-02-%"], "none": ["1995%", "%-31", "%-02-%"]}, _lake),
        "q3": ("orders", "column2", "1997-06-30", "prio", DATE, "o_orderpriority", {"all": ["%E%", "%I%"], "any": ["1%", "%LOW", "%SPEC%"], "none": ["1%", "%LOW", "%SPEC%"]}, _lake),
    }
    for group, (table, column, value, like, sql_column, sql_like, patterns, engine) in sets.items():
        for op, sign in OPS.items():
            for quantifier, own in patterns.items():
                line = f"{table} {column} {sign} '{value}' {like} {quantifier.upper()}_LIKE [{','.join(repr(p) for p in own)}]"
                _add(f"{group}_{op}_{quantifier}", line, _count(table, f"{sql_column} {sign.replace('!=', '<>')} '{value}' AND {_like(sql_like, quantifier, own)}"), engine)
    _add("q4_partition_partition", "orders prio > '2-HIGH' status ANY_LIKE ['F%','%P']", _count("orders", "o_orderpriority > '2-HIGH' AND (o_orderstatus LIKE 'F%' OR o_orderstatus LIKE '%P')"), _lake)


def _patterns() -> None:
    every = "part p_brand != ''"
    for name, pattern, where in (
        ("like_any", "%", "true"),
        ("like_any_fixed", "________", "strlen(p_name) = 8"),
        ("like_const", "red widget", "p_name = 'red widget'"),
        ("like_const_wild", "red _olt", "p_name LIKE 'red _olt'"),
        ("like_prefix", "blue%", "p_name LIKE 'blue%'"),
        ("like_prefix_wild", "_l%", "p_name LIKE '_l%'"),
        ("like_suffix", "%bolt", "p_name LIKE '%bolt'"),
        ("like_suffix_wild", "%b_lt", "p_name LIKE '%b_lt'"),
        ("like_fixed", "%d w%", "p_name LIKE '%d w%'"),
        ("like_fixed_wild", "%e_ _%", "p_name LIKE '%e_ _%'"),
        ("like_full", "r%d%t", "p_name LIKE '%r%d%t%'"),
        ("like_full_wild", "_e% b%", "p_name LIKE '%_e% b%'"),
        ("like_empty_pattern", "", "true"),
        ("like_full_unanchored", "e%i", "p_name LIKE '%e%i%'"),
        ("like_double_percent", "%%ring", "p_name LIKE '%ring%'"),
    ):
        _add(name, f"{every} p_name ALL_LIKE ['{pattern}']", _count("part", f"p_brand <> '' AND {where}"))
    _add("like_escape_percent", r"documents source != '' text ANY_LIKE ['%\%%','%\_%']", _count("documents", r"source <> '' AND (contains(text, '%') OR contains(text, '_'))"))
    _add("like_escape_quirk", r"documents source != '' text ALL_LIKE ['%a%\%']", _count("documents", "source <> '' AND contains(text, 'a%')"))
    # A byte is half of ê, so the wildcard takes its second byte.
    _add("like_byte_length", "documents lang != '' source NONE_LIKE ['_____','___']", _count("documents", "lang <> '' AND strlen(source) NOT IN (5, 3)"))
    _add("like_byte_wildcard", "documents lang != '' text ALL_LIKE ['%ou_ %']", _count("documents", "lang <> '' AND (text LIKE '%ou_ %' AND regexp_matches(text, 'ou[\\x00-\\x7F] ', 's'))"))
    _add("like_bytes_of_character", "documents lang != '' text ALL_LIKE ['% __ %']", _count("documents", "lang <> '' AND regexp_matches(text, ' ([\\x00-\\x7F]{2}|[\\x{80}-\\x{7FF}]) ', 's')"))
    _add("like_json", "events event_type != '' props ANY_LIKE ['%\"k\": 1_%','%\"k\":1_%']", _count("events", "event_type <> '' AND (props LIKE '%\"k\": 1_%' OR props LIKE '%\"k\":1_%')"))
    many = ["red%", "blue%", "old%", "%bolt", "%ring", "%gear", "%d b%"]
    _add("any_multi_hit", f"{every} p_name ANY_LIKE [{','.join(map(repr, many))}]", _count("part", f"p_brand <> '' AND {_like('p_name', 'any', many)}"))
    _add("none_multi_prefix", f"{every} p_name NONE_LIKE ['red%','blue%','old%']", _count("part", f"p_brand <> '' AND {_like('p_name', 'none', many[:3])}"))
    _add("all_nested_prefixes", f"{every} p_name ALL_LIKE ['r%','re%','red%']", _count("part", "p_brand <> '' AND p_name LIKE 'red%'"))
    # Beyond sixteen of a class, they are looked up by hash.
    words = [f"{a}{b}" for a in ("re", "bl", "gr", "ol", "ne") for b in "abcdelrux"]
    for name, shape in (("prefixes", "{}%"), ("suffixes", "%{}"), ("constants", "{} widget")):
        own = [shape.format(w) for w in (*words, "red", "old", "bolt", "gear", "blue")]
        _add(f"any_many_{name}", f"{every} p_name ANY_LIKE [{','.join(map(repr, own))}]", _count("part", f"p_brand <> '' AND {_like('p_name', 'any', own)}"))
    _add("none_many_prefixes", f"{every} p_name NONE_LIKE [{','.join(repr(w + '%') for w in words)}]", _count("part", f"p_brand <> '' AND {_like('p_name', 'none', [w + '%' for w in words])}"))
    # With a wildcard or an inner percent sign, a bar is a wildcard, too.
    _add("like_bar", f"{every} p_name ANY_LIKE ['_e|%','%d|b%t']", _count("part", "p_brand <> '' AND (p_name LIKE '_e_%' OR p_name LIKE '%d_b%t%')"))
    for quantifier, where in (("ALL", "true"), ("ANY", "false"), ("NONE", "true")):
        _add(f"like_no_patterns_{quantifier.lower()}", f"{every} p_name {quantifier}_LIKE []", _count("part", f"p_brand <> '' AND {where}"))
    _add("lex_int_gt", "part p_size > '5' p_name ALL_LIKE ['%']", _count("part", "p_size::VARCHAR > '5'"))
    for op, where in (("=", "= '01'"), (">", "> '10'"), ("<", "< '9'"), ("!=", "<> '1.5'")):
        key = "CASE o_orderpriority " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KEYS.items()) + " ELSE '1.5' END"
        _add(f"parquet_partition_{ {v: k for k, v in OPS.items()}[op]}", f"orders k {op} '{where.split()[1][1:-1]}' o_orderstatus NONE_LIKE ['P%']", _count("orders", f"{key} {where} AND o_orderstatus NOT LIKE 'P%'"), _parquet_lake)
    _add("lex_partition_gt", "orders prio > '10' column1 ALL_LIKE ['1%']", _count("orders", "o_orderpriority > '10' AND o_custkey::VARCHAR LIKE '1%'"), _lake)


STATS = """SELECT {name} AS column_name, min({c}) AS min_value, max({c}) AS max_value, min(strlen({c}))::BIGINT AS min_bytes,
 max(strlen({c}))::BIGINT AS max_bytes, (sum(strlen({c})) // count(*))::BIGINT AS avg_bytes,
 min(strlen({c})) = max(strlen({c})) AS is_fixed, count(*) AS n_rows FROM {t}"""


def _metadata() -> None:
    def stats(table: str, columns: list[str]) -> Query:
        return lambda spark, sf_dir: column_stats(spark.read.parquet(f"{sf_dir}/{table}.parquet"), columns)

    for name, table, columns in (("meta_lengths", "documents", ["text", "lang", "source"]), ("meta_min_max", "part", ["p_name", "p_brand", "p_type"])):
        QUERIES[name] = stats(table, columns)
        ORACLE_SQL[name] = " UNION ALL ".join(STATS.format(name=f"'{c}'", c=c, t=table) for c in columns)
    # Each file of the lake has the rows of one priority and status.
    QUERIES["meta_by_file"] = lambda spark, sf_dir: (
        column_stats(_lake(spark, sf_dir).catalog.table("orders"), ["column2", "prio", "status"], True)
        .groupBy("column_name").agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("n_rows").alias("n_rows"), F.min(F.when(F.col("column_name") == "column2", True).otherwise(F.col("min_value") == F.col("max_value"))).alias("one_value"))
    )
    ORACLE_SQL["meta_by_file"] = " UNION ALL ".join(f"SELECT '{n}' AS column_name, min({c}) AS min_value, max({c}) AS max_value, count(*)::BIGINT AS n_rows, true AS one_value FROM orders" for n, c in (("column2", DATE), ("prio", "o_orderpriority"), ("status", "o_orderstatus")))
    QUERIES["meta_row_count"] = lambda spark, sf_dir: table_counts(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("n_rows")
    ORACLE_SQL["meta_row_count"] = "SELECT count(*)::BIGINT AS n_rows FROM orders"
    # Each test table of this name is one file.
    QUERIES["meta_table_counts"] = lambda spark, sf_dir: table_counts(spark.read.parquet(f"{sf_dir}/part.parquet"))
    ORACLE_SQL["meta_table_counts"] = "SELECT 1::BIGINT AS n_files, count(*)::BIGINT AS n_rows FROM part"
    QUERIES["meta_pushed_count"] = lambda spark, sf_dir: row_count(spark, f"{sf_dir}/documents.parquet")
    ORACLE_SQL["meta_pushed_count"] = "SELECT count(*)::BIGINT AS n_rows FROM documents"
    QUERIES["meta_partition_values"] = lambda spark, sf_dir: partition_values(_lake(spark, sf_dir).catalog.table("orders"), "prio")
    ORACLE_SQL["meta_partition_values"] = "SELECT o_orderpriority AS value, count(*) AS n_rows FROM orders GROUP BY 1"
    QUERIES["scan_text_lake"] = lambda spark, sf_dir: read_text(spark, f"{orders_lake(spark, sf_dir)}/orders", ("prio", "status"))
    ORACLE_SQL["scan_text_lake"] = f"SELECT o_orderkey::VARCHAR AS column0, o_custkey::VARCHAR AS column1, {DATE} AS column2, o_orderpriority AS prio, o_orderstatus AS status FROM orders"


def batch_lines() -> list[str]:
    patterns = {"ALL_LIKE": "['%i%','%g%']", "ANY_LIKE": "['red%','%bolt','%d w%']", "NONE_LIKE": "['red%','%bolt','_l%']"}
    return [f"part p_brand {op} 'Brand#2' p_name {q} {p}" for op in OPS.values() for q, p in patterns.items()]


def _batch() -> None:
    QUERIES["batch_shared_scan"] = lambda spark, sf_dir: _tables(spark, sf_dir).batch(batch_lines())
    ORACLE_SQL["batch_shared_scan"] = " UNION ALL ".join(f"SELECT {i}::INTEGER AS query_no, n FROM ({ORACLE_SQL[f'q1_{op}_{q}']})" for i, (op, q) in enumerate((op, q) for op in OPS for q in ("all", "any", "none")))


def _files_and_streams() -> None:
    lines = ["orders prio = '2-HIGH' column2 ANY_LIKE ['1995%']", "", "orders column1 > '5' status NONE_LIKE ['P']", "orders prio > '10' status ALL_LIKE []"]
    where = ["o_orderpriority = '2-HIGH' AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1995%'", "o_custkey::VARCHAR > '5' AND o_orderstatus NOT LIKE 'P'", "o_orderpriority > '10'"]

    def by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A query file over the text lake, its result file read back."""
        folder = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
        write_lines(spark, f"{folder}/params.txt", lines)
        run_files(spark, orders_lake(spark, sf_dir), f"{folder}/params.txt", f"{folder}/out.txt")
        counts = [(i, int(x)) for i, x in enumerate(read_queries(spark, f"{folder}/out.txt"))]
        drop_folder(spark, folder)
        return spark.createDataFrame(counts, "query_no int, n long")

    QUERIES["batch_files"] = by_files
    ORACLE_SQL["batch_files"] = " UNION ALL ".join(f"SELECT {i}::INTEGER AS query_no, n FROM ({_count('orders', w)})" for i, w in enumerate(where))
    mixed = ["part p_brand = 'Brand#2' p_name ALL_LIKE ['%']", "part p_brand ~ 'x' p_name ALL_LIKE ['%']", "part p_brand = 'x' p_name SOME_LIKE ['%']", "absent a = 'x' a ALL_LIKE []", "part absent = 'x' p_name ALL_LIKE []", "part", "part p_brand != '' p_name NONE_LIKE ['%a%']"]

    def with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines that are wrong have their errors and spoil no other."""
        return spark.createDataFrame([(i, a.count, a.error is not None) for i, a in enumerate(_tables(spark, sf_dir).answers(mixed))], "query_no int, n long, failed boolean")

    QUERIES["batch_errors"] = with_errors
    good = {0: _count("part", "p_brand = 'Brand#2'"), 6: _count("part", "p_brand <> '' AND p_name NOT LIKE '%a%'")}
    ORACLE_SQL["batch_errors"] = " UNION ALL ".join(f"SELECT {i}::INTEGER AS query_no, {f'({good[i]})' if i in good else 'NULL'}::BIGINT AS n, {i not in good} AS failed" for i in range(len(mixed)))

    def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All files that are there, as a stream."""
        path = f"{sf_dir}/part.parquet"
        schema = spark.read.parquet(path).schema
        # A stream reads folders; the glob takes the table's file in its folder.
        counts = stream_counts(stream_parquet(spark, f"{sf_dir}/part.parquet*", schema), [parse_query(mixed[0]), parse_query(mixed[6])])
        name = f"counts_{uuid.uuid4().hex}"
        query = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    QUERIES["stream_counts"] = streamed
    ORACLE_SQL["stream_counts"] = f"SELECT ({good[0]})::BIGINT AS n0, ({good[6]})::BIGINT AS n1"


_matrix()
_patterns()
_metadata()
_batch()
_files_and_streams()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q1_gt_any"](spark, sf_dir)

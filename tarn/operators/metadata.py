"""Statistics of files and columns, each from one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import as_text

FILE = "_metadata.file_path"


def _stats(df: DataFrame, columns: list[str], nulls: bool) -> tuple[list, object]:
    aggregates = [F.count("*").alias("_n")]
    for i, c in enumerate(columns):
        text = as_text(df, c, nulls)
        size = F.octet_length(text)
        aggregates += [f.alias(f"_{k}{i}") for k, f in (("min", F.min(text)), ("max", F.max(text)), ("short", F.min(size)), ("long", F.max(size)), ("sum", F.sum(size)))]
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"_min{i}").alias("min_value"), F.col(f"_max{i}").alias("max_value"),
                F.col(f"_short{i}").cast("long").alias("min_bytes"), F.col(f"_long{i}").cast("long").alias("max_bytes"),
                F.when(F.col("_n") > 0, F.expr(f"_sum{i} div _n")).alias("avg_bytes"),
                (F.col(f"_short{i}") == F.col(f"_long{i}")).alias("is_fixed"), F.col("_n").alias("n_rows"),
            )
            for i, c in enumerate(columns)
        )
    )
    return aggregates, rows


def column_stats(df: DataFrame, columns: list[str] | None = None, by_file: bool = False, nulls: bool = False) -> DataFrame:
    """For each column: smallest and largest value as strings, shortest, longest and (cut to whole) mean bytes, whether all are as long, rows.

    ``by_file``: for each file (``file``) of the table, which must be read from files.
    """
    columns = columns or df.columns
    aggregates, rows = _stats(df, columns, nulls)
    if by_file:
        return df.groupBy(F.col(FILE).alias("file")).agg(*aggregates).select("file", F.inline(rows))
    return df.agg(*aggregates).select(F.inline(rows))


def file_counts(df: DataFrame) -> DataFrame:
    """``file, n_rows``: the rows of each file that has any."""
    return df.groupBy(F.col(FILE).alias("file")).agg(F.count("*").alias("n_rows"))


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """``n_rows`` of a Parquet table from its files' footers alone: the count is pushed into the scan.

    In a session of its own, as the settings that allow this hold for all of a session's scans.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.count("*").alias("n_rows"))


def table_counts(df: DataFrame) -> DataFrame:
    """``n_files, n_rows`` of a table: two levels of counts, so files are never gathered in one place."""
    return file_counts(df).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def partition_values(df: DataFrame, key: str) -> DataFrame:
    """``value, n_rows`` for each value of a partition key (or any column)."""
    return df.groupBy(as_text(df, key).alias("value")).agg(F.count("*").alias("n_rows"))

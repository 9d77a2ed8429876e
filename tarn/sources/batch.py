"""Query files and result files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def read_queries(spark: SparkSession, path: str) -> list[str]:
    """The lines of a query file in order; empty ones are left out."""
    whole = spark.read.text(path, wholetext=True).first()
    return [x for x in (whole[0] if whole else "").splitlines() if x.strip()]


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Lines without an end of line after the last; replaces the file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray("\n".join(lines).encode()))
    finally:
        out.close()


def write_counts(spark: SparkSession, path: str, counts: list[int]) -> None:
    """One count a line in the order of the queries."""
    write_lines(spark, path, list(map(str, counts)))


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

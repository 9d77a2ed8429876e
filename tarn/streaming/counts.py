"""Counting queries over a lake table that files are still added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.engine import predicate
from ..plans.query import CountQuery


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_counts(df: DataFrame, queries: list[CountQuery], dialect: str = "reference") -> DataFrame:
    """The running counts ``n0, n1, ...`` of the queries over a stream, by one aggregate in complete mode; state is one row."""
    return df.agg(*(F.count_if(predicate(df, q, dialect)).alias(f"n{i}") for i, q in enumerate(queries)))

"""Shared plumbing: reading tables, materialising intermediates, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: ASCII white space of the operators' word and line contracts.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(docs: DataFrame, out: list[str]) -> tuple[DataFrame, str]:
    """The columns ``out`` and the text, and the text's name: where it is one of them it goes to the worker once."""
    if "text" in out:
        return docs.select(*out), "text"
    return docs.select(*out, F.col("text").alias("_text")), "_text"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path.

    Unlike a checkpoint it is planned with its real size.  In a loop of joins that
    matters: estimates would be multiplied in every round until they are numbers of
    millions of digits.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unplaced(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` (bigint keys) as if it weren't dealt by the keys it was grouped by.

    A join on them then deals out both sides anew, and only such joins can have their
    hot partitions split at run time.
    """
    return df.withColumns({k: F.bitwise_not(F.bitwise_not(k)) for k in keys})


def small(df: DataFrame, most: int = 10_000):
    """``F.broadcast`` if ``df`` (materialised) has at most ``most`` rows, else nothing: the join then shuffles."""
    return F.broadcast if df.limit(most + 1).count() <= most else lambda x: x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node for every node that has an edge: ``node, component``.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Minima are
    partial aggregates joined back on the node, so a hub of any degree is never
    gathered into one task; each round is written to a table in the shared folder.  Nulls and self loops are
    ignored, repeated edges count once.  An empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, path = stored(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = unplaced(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(unplaced(low, "u"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, (e, path) = path, stored(small.where("u > v").distinct())
        drop_stored(e.sparkSession, last)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.lit(0)), F.count_distinct("v")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

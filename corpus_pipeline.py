"""From raw documents to token ids: the stages of a training corpus.

Each stage takes the session, the documents that the one before it kept, and the folder
of the tables; its result is written as Parquet and read again for the next one.

All stages take any nulls and empty tables, which give empty results, texts of any length,
and tables with other columns, which go.  Null or empty texts have no language and go in
the first stage.  Rows that repeat a doc_id with other texts each go their own way, but as
one document in the near-duplicate stage, where of rows that repeat both one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, langid, lines, minhash, mixing
from tarn.llm.common import checkpointed, drop_stored, small
from tarn.sources.scratch import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Texts whose language scores less are like none that was learned.
LEAST_SCORE = 0.1


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have; those without letters and those like none go.

    Null lang is only not learned from.  Rows that repeat others are judged alike and stay.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model, "_lang", "_score")
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with 80 % of their runs of five words in common, the one of the smallest doc_id stays.

    Of rows that repeat a doc_id and its text one stays, with the smallest of the other
    columns (null first).  Texts that a doc_id has besides are one document with it: they
    stay if it does.  Documents with a null doc_id or without words are compared with none.
    """
    docs = _once(docs.select(*COLUMNS))
    found = minhash.near_duplicates(docs.select("doc_id", "text"), 5, 80, 100)
    return docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def _once(docs: DataFrame) -> DataFrame:
    """Without rows that repeat a doc_id and its text.  Only rows whose doc_id repeats are dealt out."""
    again = checkpointed(docs.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n")).where("_n > 1"))
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    own = small(again)(again)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    repeated = docs.join(own, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_r"))
    return docs.join(own, same, "left_anti").unionByName(repeated.select("doc_id", "text", "_r.*"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in the one of the largest doc_id (a null one is below all); n_chars follows the text.

    A null text becomes ''; rows that repeat a doc_id count as one document.
    """
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens at the target weights; a document is taken once at most.

    Null lang or source is a leaf of its own.  Rows that tie in the seeded order, as those
    of one doc_id or of none do, are taken or left together.
    """
    return mixing.mix(docs, mixing.WEIGHTS, (9, 10), mixing.approx_tokens(), mixing.source_domain(), mixing.SEED, 1).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of what they decode to; a row for each row, null text has no ids."""
    ranks, pattern = bpe.public_vocabulary()
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), ranks, pattern, decoded="decoded")
    return bpe.digests(coded.select("doc_id", "ids", "decoded", "lang", "source"), "lang", "source", "ids")


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("minhash", drop_copies), ("mixing", mix_sources), ("bpe", encode)]

#: The stages that classify and compare have no SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage has read goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if last:
                drop_stored(spark, last)
            last = f"{folder}/{name}"
    return docs

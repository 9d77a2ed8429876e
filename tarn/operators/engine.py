"""Counting queries over a catalog: one at a time, or many in a shared scan."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import compare, like_quantified
from ..plans.query import CountQuery, QueryError, parse_query
from ..sources.batch import read_queries, write_counts
from ..sources.lake import Catalog, as_text, discover

#: Queries in one scan; more make the generated code of the aggregate too large to be compiled.
TOGETHER = 32


def predicate(df: DataFrame, query: CountQuery, dialect: str = "reference", nulls: bool = False) -> Column:
    """The comparison first, as it is cheap, then the LIKE on what it leaves; any mix of data columns and partition keys."""
    first = compare(as_text(df, query.column, nulls), query.op, query.value)
    return first & like_quantified(as_text(df, query.like_column, nulls), query.quantifier, query.patterns, dialect)


@dataclass
class Answer:
    """What a query of a batch gave: its count, or what was wrong with it."""

    count: int | None
    error: str | None = None


class Engine:
    """Answers queries over the tables of a catalog.

    ``nulls``: tables may hold nulls, which are then empty strings as in text files.
    """

    def __init__(self, catalog: Catalog, dialect: str = "reference", nulls: bool = False):
        self.catalog, self.dialect, self.nulls = catalog, dialect, nulls

    def count(self, query: CountQuery | str) -> DataFrame:
        """One row ``n``; nothing runs before it is asked for."""
        q = parse_query(query) if isinstance(query, str) else query
        df = self.catalog.table(q.table)
        return df.where(predicate(df, q, self.dialect, self.nulls)).agg(F.count("*").alias("n"))

    def _groups(self, queries: list[CountQuery]) -> list[list[int]]:
        """Queries that share a scan: of one table, and with the same condition on its partition keys or none.

        A scan of several queries reads what any of them needs, so conditions that prune
        partitions are kept apart.
        """
        found: dict[tuple, list[int]] = {}
        for i, q in enumerate(queries):
            keys = self.catalog.tables[q.table].keys if q.table in self.catalog.tables else ()
            where = (q.column, q.op, q.value) if q.column in keys else None
            like = (q.like_column, q.quantifier, q.patterns) if q.like_column in keys else None
            found.setdefault((q.table, where, like), []).append(i)
        return [own[i : i + TOGETHER] for own in found.values() for i in range(0, len(own), TOGETHER)]

    def _shared(self, queries: list[CountQuery], own: list[int]) -> DataFrame:
        df = self.catalog.table(queries[own[0]].table)
        conditions = [predicate(df, queries[i], self.dialect, self.nulls) for i in own]
        if len(own) == 1:
            counts = df.where(conditions[0]).agg(F.count("*").alias("n0"))
        else:
            q, keys = queries[own[0]], self.catalog.tables[queries[own[0]].table].keys
            if q.column in keys:
                df = df.where(compare(as_text(df, q.column, self.nulls), q.op, q.value))
            if q.like_column in keys:
                df = df.where(like_quantified(as_text(df, q.like_column, self.nulls), q.quantifier, q.patterns, self.dialect))
            counts = df.agg(*(F.count_if(c).alias(f"n{k}") for k, c in enumerate(conditions)))
        pairs = F.array(*(F.struct(F.lit(i).alias("query_no"), F.col(f"n{k}").alias("n")) for k, i in enumerate(own)))
        return counts.select(F.inline(pairs))

    def batch(self, queries: Iterable[CountQuery | str]) -> DataFrame:
        """``query_no, n`` for each query, in as few scans as pruning allows."""
        parsed = [parse_query(q) if isinstance(q, str) else q for q in queries]
        if not parsed:
            return self.catalog.spark.createDataFrame([], "query_no int, n bigint")
        frames = [self._shared(parsed, own) for own in self._groups(parsed)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def answers(self, lines: Iterable[str]) -> list[Answer]:
        """The answer to each line; a line that can't be understood or names what isn't there has its error and spoils no other."""
        lines = list(lines)
        out: list[Answer] = [Answer(None) for _ in lines]
        good: list[tuple[int, CountQuery]] = []
        for i, line in enumerate(lines):
            try:
                q = parse_query(line)
                predicate(self.catalog.table(q.table), q, self.dialect, self.nulls)
                good.append((i, q))
            except ValueError as e:
                out[i] = Answer(None, str(e))
        for r in self.batch([q for _, q in good]).collect() if good else []:
            out[good[r["query_no"]][0]] = Answer(r["n"])
        return out


    def timed(self, queries: Iterable[CountQuery | str]) -> list[tuple[int, float]]:
        """Each query on its own, in order: its count and its seconds."""
        out = []
        for q in queries:
            began = time.time()
            out.append((self.count(q).first()["n"], time.time() - began))
        return out


def run_files(spark: SparkSession, lake: str, query_file: str, out_file: str, dialect: str = "reference") -> dict[str, float]:
    """Answer a file of queries over a lake; gives the seconds of discovery (build), search and both.

    A query that fails ends the run before anything is written, so no partial counts are left.
    """
    began = time.time()
    engine = Engine(discover(spark, lake), dialect)
    built = time.time()
    lines = read_queries(spark, query_file)
    answers = engine.answers(lines)
    if wrong := [f"{line}: {a.error}" for line, a in zip(lines, answers) if a.error]:
        raise QueryError("; ".join(wrong))
    write_counts(spark, out_file, [a.count for a in answers])
    ended = time.time()
    return {"build": built - began, "search": ended - built, "total": ended - began}

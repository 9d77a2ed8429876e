"""Embedding near-dedup (operator 10): sign hashing in several tables, exact cosines, components.

Random hyperplanes give each vector a code of signs for each table; vectors that share a
code are candidates.  Buckets are compared as blocks of a matrix product in double
precision, and a block gives a forest of its links.  Links join components only, so the
links of a component of at most ``WHOLE`` vectors are then counted among all of its pairs;
in a larger one, which may be a long chain, a pair is counted in the first table that it
shares, so its work is that of its buckets.  Pairs are never rows.  Vectors with the very
same components are one row with a count all the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import comparable, in_blocks
from .common import checkpointed, connected_components, table
from .words import U, mix

#: The chance to miss a pair at the threshold, and the vectors of a component within which all pairs are compared.
MISS, WHOLE = 1e-4, 4096
#: Bits of a key (of two codes that give one, only more is compared), and bytes of packed keys that a task looks at together.
KEY, PACKED = 48, 32 << 20


def tables_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a code and number of tables for n vectors: unlike vectors share a code with a chance of about 1 / (8 n)."""
    bits = min(48, ceil(log2(max(n, 2))) + 3)
    p = 1 - acos(threshold) / pi
    return bits, ceil(log(miss) / log(1 - p**bits)) if p < 1 else 1


def finite(vector: Column) -> Column:
    """False for null and empty vectors and those with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def usable(vector: Column) -> Column:
    """Finite and not zero."""
    return finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # very large or small components neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(x: np.ndarray, bits: int, count: int) -> np.ndarray:
    """A row of ``count`` table keys for each vector."""
    planes = np.random.default_rng(10).standard_normal((x.shape[1], bits * count))
    signs = (x @ planes > 0).reshape(len(x), count, bits)
    keys = signs @ (U(1) << np.arange(bits, dtype=U))
    return mix(keys.astype(U) + (np.arange(count, dtype=U) << U(bits)))


def _shared_keys(vectors: DataFrame, keys_of: Callable, pairs: int, count: int) -> DataFrame:
    """key, a: the keys that two or more of ``vectors`` (a, v) have, of ``pairs`` keys in all.

    Most keys are of one vector only, so they travel packed, some thousand in a row.  Of a
    key that several vectors of a task's batch have, one is sent on to tell the other
    batches, so a key of any number of vectors is no burden to the task that looks at it.
    """
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(pairs * 16 / PACKED))

    def packed(key: np.ndarray, a: np.ndarray) -> bytes:
        return key.tobytes() + a.tobytes()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, keys in keys_of(batch, max(64, min(2048, (1 << 20) // count))):
                key, a = keys.reshape(-1), np.repeat(own["a"].to_numpy(), count)
                order = np.lexsort((key, key % parts))
                key, a = key[order], a[order]
                new = np.append(True, key[1:] != key[:-1])
                several = ~new
                several[:-1] |= ~new[1:]
                begin = np.flatnonzero(new)
                word, first, of = key[begin] * 2 + several[begin], a[begin], key[begin] % parts
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                rows = [(int(of[s]), False, packed(word[s:e], first[s:e])) for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)])]
                if several.any():
                    rows.append((int(of[0]), True, packed(key[several], a[several])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["part", "known", "data"])

    def opened(rows: list[bytes]) -> np.ndarray:
        every = [np.frombuffer(x, np.int64).reshape(2, -1) for x in rows]
        return np.concatenate(every, 1) if every else np.zeros((2, 0), np.int64)

    def made(key: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a)], ["key", "a"])

    def look(held: list[bytes]) -> pa.RecordBatch:
        word, a = opened(held)
        order = word.argsort(kind="stable")
        word, a = word[order], a[order]
        new = np.append(True, word[1:] >> 1 != word[:-1] >> 1) if len(word) else np.zeros(0, bool)
        several = ~new
        several[:-1] |= ~new[1:]
        several &= word & 1 == 0  # the others are known
        return made(word[several] >> 1, a[several])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part; a part's are looked at together."""
        part, held = None, []
        for batch in batches:
            for p, known, data in zip(batch["part"].to_pylist(), batch["known"].to_pylist(), batch["data"].to_pylist()):
                if known:
                    yield made(*opened([data]))
                    continue
                if p != part and held:
                    yield look(held)
                    held = []
                part = p
                held.append(data)
        if held:
            yield look(held)

    return vectors.mapInArrow(send, "part int, known boolean, data binary").repartition("part").sortWithinPartitions("part").mapInArrow(receive, "key long, a long")


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    n = len(adjacent)
    label = np.arange(n)
    if n == 0:
        return label
    while True:
        low = np.minimum(np.where(adjacent, label[None, :], n).min(1), label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_vectors(vectors: DataFrame, threshold: float = 0.9, ident: str = "vec_id", vector: str = "embedding", miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors are linked if their cosine in double precision is at least ``threshold``.
    A linked pair at the threshold shares no table with a chance of ``miss``; within a
    component of at most ``WHOLE`` different vectors every pair is compared.  All rows count: n_links has every other row
    linked directly.  Vectors that are null, empty, zero or hold null or non-finite
    components have no links and are kept; so are rows without id, whose component is
    null.  Vectors of different lengths are not linked.  Rows that repeat an id are one
    vector (the largest, if they differ).
    """
    src = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"))
    good = checkpointed(src.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.max("v").alias("v")))
    same = checkpointed(good.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("copies")))
    n = same.count()
    bits, count = tables_for(n, threshold, miss)

    def keys_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        size = pc.list_value_length(batch["v"]).to_numpy()
        for width in np.unique(size).tolist():
            of = batch.filter(pa.array(size == width))
            for at in range(0, len(of), most):
                own = of.slice(at, most)
                yield own, (mix(_codes(_unit(_matrix(own["v"])), bits, count) ^ U(width << 32)) >> U(64 - KEY)).astype(np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, keys in keys_of(batch, 2048):
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * np.int32(count))
                yield pa.RecordBatch.from_arrays([own["a"], own["v"], own["copies"], pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))], ["a", "v", "copies", "keys"])

    keyed = checkpointed(_shared_keys(same.select("a", "v"), keys_of, n * count, count))

    def forest(rows: pa.Table, pairs: Pairs) -> pa.RecordBatch:
        """Links between few rows, of many a forest of them."""
        a = rows["a"].to_numpy()
        if pairs is None:
            own = a[_labels(_near(rows, threshold))]
            a, own = a[a != own], own[a != own]
        else:
            i, j = _near_pairs(rows, threshold, *pairs)
            a, own = a[i], a[j]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(own)], ["a", "b"])

    def count_links(rows: pa.Table, pairs: Pairs) -> pa.RecordBatch:
        copies = rows["copies"].to_numpy().astype(np.float64)
        if pairs is None:
            near = _near(rows, threshold)
            links = (_first_here(rows, near) if "keys" in rows.column_names else near) @ copies
        else:
            i, j = _near_pairs(rows, threshold, *pairs)
            if "keys" in rows.column_names:
                i, j = _pairs_first_here(rows, i, j)
            links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        return pa.RecordBatch.from_arrays([rows["a"].combine_chunks(), pa.array(links.astype(np.int64))], ["a", "links"])

    shared = in_blocks(keyed, same, forest, "a long, b long").distinct()
    parts = connected_components(shared).select(F.col("node").alias("a"), F.col("component").alias("key"))
    large = checkpointed(parts.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > WHOLE).select(F.col("key").alias("_key")))
    schema = "a long, links long"
    links = in_blocks(parts.join(large, F.col("key") == F.col("_key"), "left_anti"), same, count_links, schema)
    if not large.isEmpty():
        some = parts.join(large, F.col("key") == F.col("_key"), "left_semi").select(F.col("a").alias("_a"))
        rows = checkpointed(same.join(some, F.col("a") == F.col("_a"), "left_semi").select("a", "v", "copies").mapInArrow(coded, f"a long, v {same.schema['v'].dataType.simpleString()}, copies long, keys array<long>"))
        links = links.unionByName(in_blocks(keyed.join(some, F.col("a") == F.col("_a"), "left_semi").distinct(), rows, count_links, schema))
    links = links.groupBy("a").agg(F.sum("links").alias("links"))
    found = same.join(links, "a", "left").join(parts, "a", "left")
    found = found.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("key", "a").alias("c"))
    found = good.join(found, "v").select(F.col("id").alias("_id"), "n_links", "c")
    out = src.select("id").join(found, F.col("id") == F.col("_id"), "left")
    out = out.select(F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(ident) == F.col("component_id"), F.lit(True)))


Pairs = tuple[np.ndarray, np.ndarray] | None


def _near(rows: pa.Table, threshold: float) -> np.ndarray:
    """Which rows of a group are linked."""
    v = _unit(_matrix(rows["v"].combine_chunks()))
    return (v @ v.T >= threshold) & comparable(rows)


def _tables(rows: pa.Table) -> np.ndarray:
    """Each row's keys, a column for each table."""
    return rows["keys"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)


def _first_here(rows: pa.Table, near: np.ndarray) -> np.ndarray:
    """The links of a group that share no table before the group's."""
    keys = _tables(rows)
    for table in range(int((keys[0] == rows["key"][0].as_py()).argmax())):
        if not near.any():
            break
        near = near & (keys[:, table, None] != keys[None, :, table])
    return near


def _pairs_first_here(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of rows of several groups."""
    keys = _tables(rows)
    here = (keys == rows["key"].to_numpy()[:, None]).argmax(1)
    first = np.concatenate([(keys[i[s : s + 8192]] == keys[j[s : s + 8192]]).argmax(1) for s in range(0, len(i), 8192)] or [here[:0]]) == here[i]
    return i[first], j[first]


def _near_pairs(rows: pa.Table, threshold: float, i: np.ndarray, j: np.ndarray) -> Pairs:
    """Which of the pairs are linked.  Groups may differ in length: shorter vectors are filled up with zeros."""
    column = rows["v"].combine_chunks()
    size = pc.list_value_length(column).to_numpy()
    v = np.zeros((len(rows), int(size.max(initial=1))))
    v[np.arange(v.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    v = _unit(v)
    near = np.concatenate([np.einsum("ij,ij->i", v[i[s : s + 8192]], v[j[s : s + 8192]]) >= threshold for s in range(0, len(i), 8192)] or [np.zeros(0, bool)])
    return i[near], j[near]


#: The query in DuckDB's SQL, which compares all pairs.
OP10_SQL = """
WITH RECURSIVE
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d JOIN c ON c.vec_id = d.vec_id LEFT JOIN n ON n.vec_id = d.vec_id
"""


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

"""Exact top-k search by inner product (operator 4) over KD-trees.

A coarse tree of median splits, made from a bounded sample, deals all vectors to regions of
space; a region of many vectors is dealt on by hash, so a shard never has much more than
``SHARD``.  Each shard has a KD-tree of its own with tight boxes, which a query goes through
best bound first until no box can reach its k-th score.  Each query first searches the
region with the best bound on its scores; only regions whose box can reach the k-th score
found there get the query at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, table
from .vectors import _matrix, finite

#: Components of a shard's vectors, about; fewer where there would be less than ``SPREAD`` shards; and vectors of a leaf of its tree at most.
SHARD, SPREAD, LEAF = 1 << 24, 64, 64
#: The coarse tree is made from about so many vectors or components, whichever are fewer; it has a region for each four of them at most.
SAMPLE, COMPONENTS = 1 << 14, 1 << 23
SCALE = 1024


@dataclass
class Regions:
    """A coarse KD-tree for each length of vectors; regions are numbered length << 32 | place."""

    #: By length: axis, cut and the two children of each node; a leaf has axis -1 and its region's place as first child.
    trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(sample: list[np.ndarray], size: int) -> Regions:
        """Split at medians, the widest axis first, until a region has at most ``size`` of the sample."""
        trees = {}
        for width in {len(v) for v in sample}:
            points = np.array([v for v in sample if len(v) == width])
            axis, cut, below, regions = [], [], [], 0
            todo = [(np.arange(len(points)), -1, 0)]
            while todo:
                rows, parent, side = todo.pop()
                p = points[rows]
                if parent >= 0:
                    below[parent][side] = len(axis)
                a = int((p.max(0) - p.min(0)).argmax())
                m = float(np.median(p[:, a]))
                left = p[:, a] <= m
                if len(rows) <= size or left.all():
                    axis.append(-1)
                    cut.append(0.0)
                    below.append([regions, 0])
                    regions += 1
                    continue
                axis.append(a)
                cut.append(m)
                below.append([0, 0])
                todo += [(rows[left], len(axis) - 1, 0), (rows[~left], len(axis) - 1, 1)]
            trees[width] = (np.array(axis), np.array(cut), np.array(below))
        return Regions(trees)

    def find(self, points: np.ndarray) -> np.ndarray:
        """The region of each point; of a length that the sample lacks, there is one."""
        n, width = points.shape
        if width not in self.trees:
            return np.full(n, width << 32)
        axis, cut, below = self.trees[width]
        node = np.zeros(n, np.int64)
        while (inner := axis[node] >= 0).any():
            at, own = np.flatnonzero(inner), node[inner]
            node[at] = below[own, (points[at, axis[own]] > cut[own]).astype(int)]
        return below[node, 0] + (width << 32)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
    for width in np.unique(size).tolist():
        yield batch.filter(pa.array(size == width))


class Tree:
    """KD-tree over the rows of ``points``; node 0 is the root."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        #: The two children of a node, or the rows of a leaf.
        self.below: list = []
        todo = [(np.arange(len(points)), -1, 0)] if len(points) else []
        while todo:
            rows, parent, side = todo.pop()
            p = points[rows]
            self.low.append(p.min(0))
            self.high.append(p.max(0))
            self.below.append(rows)
            if parent >= 0:
                self.below[parent][side] = len(self.low) - 1
            if len(rows) > LEAF:
                axis = int((self.high[-1] - self.low[-1]).argmax())
                order = np.argpartition(p[:, axis], len(rows) // 2)
                self.below[-1] = [0, 0]
                todo += [(rows[half], len(self.low) - 1, s) for s, half in enumerate((order[: len(rows) // 2], order[len(rows) // 2 :]))]

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best ids but its own, best first, of those with a score of ``least`` or more; ties to the smaller id."""
        if not len(self.points):
            return
        if len(queries) and (np.abs(queries) @ np.maximum(np.abs(self.low[0]), np.abs(self.high[0]))).max() >= 1 << 53:
            raise ValueError("inner products of 2^53 and more are not exact")
        bounds = np.maximum(queries, 0) @ np.array(self.high).T + np.minimum(queries, 0) @ np.array(self.low).T
        for i, q in enumerate(queries):
            kth, bound = least[i], bounds[i]
            scores, ids = np.zeros(0), np.zeros(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= kth:
                _, node = heappop(heap)
                below = self.below[node]
                if isinstance(below, list):
                    for child in below:
                        if bound[child] >= kth:
                            heappush(heap, (-bound[child], child))
                    continue
                s = self.points[below] @ q
                good = (s >= kth) & (self.ids[below] != own[i])
                if good.any():
                    scores, ids = np.concatenate([scores, s[good]]), np.concatenate([ids, self.ids[below[good]]])
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    if len(ids) == k:
                        kth = max(kth, scores[-1])
            yield i, ids, scores


def _search(rows: DataFrame, k: int) -> DataFrame:
    """rows: region, piece, kind (0 a vector, 1 a query), id, v, least.  A shard's tree stays while its queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, tree = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch[c].to_numpy() for c in ("region", "piece", "kind")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(s, e - s)
                if tuple(key[:2, s]) != shard:
                    shard, points, tree = tuple(key[:2, s]), [], None
                if key[2, s] == 0:
                    points.append((_matrix(part["v"]), part["id"].to_numpy()))
                    continue
                if not points:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate([p for p, _ in points]), np.concatenate([i for _, i in points]))
                own = part["id"].to_numpy()
                found = [(np.full(len(ids), own[i]), ids, scores) for i, ids, scores in tree.search(_matrix(part["v"]), own, part["least"].to_numpy(), k)]
                if found:
                    q, ids, scores = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.int64))], ["query_id", "vec_id", "score"])

    keys = ["region", "piece"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def _boxes(placed: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the regions that have vectors, and the tight boxes of these.

    Tasks send one box for each of their regions, of which there are at most a quarter of
    the coarse tree's sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in _by_length(batch):
                points, region = _matrix(part["v"]), part["region"].to_numpy()
                for r in np.unique(region).tolist():
                    own = points[region == r]
                    low[r] = np.minimum(low.get(r, np.inf), own.min(0))
                    high[r] = np.maximum(high.get(r, -np.inf), own.max(0))
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array([x.tolist() for x in low.values()], pa.list_(pa.float64())), pa.array([x.tolist() for x in high.values()], pa.list_(pa.float64()))], ["region", "low", "high"])

    def join(group: pa.Table) -> pa.Table:
        ends = [f(np.array(group[c].to_pylist()), axis=0).tolist() for c, f in (("low", np.min), ("high", np.max))]
        return pa.table({"region": group["region"][:1], "low": pa.array(ends[:1], pa.list_(pa.float64())), "high": pa.array(ends[1:], pa.list_(pa.float64()))})

    schema = "region long, low array<double>, high array<double>"
    made: dict[int, list] = {}
    for r in placed.where("boxed").mapInArrow(run, schema).groupBy("region").applyInArrow(join, schema).collect():
        made.setdefault(len(r["low"]), []).append(r)
    return {w: tuple(np.array([r[c] for r in own]) for c in ("region", "low", "high")) for w, own in made.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``vectors`` for each of ``queries``.

    Both have ``id`` (long) and ``v`` (array<double> of whole numbers, not empty); the score
    is the inner product, exact under 2^53 and an error from there on.  Vectors of other
    lengths than the query's are no candidates, nor is its own id.  Ties go to the smaller
    id; with fewer candidates than k, all are given.  Ids are taken to be unique; an empty
    side gives no rows.  Other columns are left out.  ``shard``: vectors of a shard, about.
    """
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(ceil(n / (shard or max(1, SHARD // (width or 1)))), min(SPREAD, ceil(n / 1024)), 1)
    sample = max(256, min(SAMPLE, COMPONENTS // max(width or 1, 1)))
    taken = [np.array(r["v"]) for r in vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < sample).select("v").limit(2 * sample).collect()]
    regions = Regions.of(taken, max(4, ceil(len(taken) / shards)))
    shared = vectors.sparkSession.sparkContext.broadcast(regions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                points = _matrix(part["v"])
                boxed = np.full(len(part), points.shape[1] in shared.value.trees)
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array(shared.value.find(points)), pa.array(boxed)], ["id", "v", "region", "boxed"])

    placed = checkpointed(vectors.select("id", "v").mapInArrow(place, "id long, v array<double>, region long, boxed boolean"))
    # A region may hold copies of one vector, which no split of space takes apart: its pieces are dealt by id.
    sizes = placed.groupBy("region").agg(F.ceil(F.count("*") / F.lit(ceil(max(n, 1) / shards) * 2)).cast("int").alias("pieces"))
    sizes = checkpointed(sizes.withColumnRenamed("region", "_region"))
    few = small(sizes)
    data = placed.join(few(sizes), F.col("region") == F.col("_region")).select("region", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.lit(0).alias("kind"), "id", "v", F.lit(float("-inf")).alias("least"))
    boxes = vectors.sparkSession.sparkContext.broadcast(_boxes(placed))

    def asked(best: bool):
        """The regions of each query: the one with the best bound, or all others that can reach its k-th score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    for part in _by_length(batch.slice(at, 512)):
                        q, least = _matrix(part["v"]), part["least"].to_numpy()
                        if q.shape[1] not in boxes.value:
                            row, region = (np.arange(len(q)) if best else np.zeros(0, int)), np.full(len(q) if best else 0, q.shape[1] << 32)
                        else:
                            names, low, high = boxes.value[q.shape[1]]
                            bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                            first = bound.argmax(1)
                            reach = bound >= least[:, None]
                            reach[np.arange(len(q)), first] = False
                            row, at_ = (np.arange(len(q)), first) if best else np.nonzero(reach)
                            region = names[at_]
                        own = part.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([pa.array(region), own["id"], own["v"], own["least"]], ["region", "id", "v", "least"])

        return run

    def search(rows: DataFrame, best: bool) -> DataFrame:
        rows = rows.mapInArrow(asked(best), "region long, id long, v array<double>, least double")
        rows = rows.join(few(sizes), F.col("region") == F.col("_region")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        return _search(data.unionByName(rows.select("region", "piece", F.lit(1).alias("kind"), "id", "v", "least")), k)

    none = F.lit(float("-inf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = checkpointed(search(queries.select("id", "v", none.alias("least")), True))
    kth = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").cast("double").alias("s"))
    rest = queries.select("id", "v").join(kth, F.col("id") == F.col("_id"), "left").select("id", "v", F.coalesce("s", none).alias("least"))
    return first.unionByName(search(rest, False)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, empty or hold a null or non-finite component take no part; of the rows of an id the largest vector counts; vectors of other lengths are no candidates."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("v")))
    rows = checkpointed(rows.groupBy("id").agg(F.max("v").alias("v")).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v")))
    return top_k(rows, rows.where(F.col("id") % 100 == 0))


OP4_SQL = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM g q, g c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

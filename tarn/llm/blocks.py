"""All pairs within the groups of a key, compared in blocks of rows and never made rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, unplaced

#: Rows of a block, and of a group that is compared together with others.
BLOCK, FEW = 512, 24
#: Some groups' rows, and which of them to compare; None: all rows are one group.
Compare = Callable[[pa.Table, tuple[np.ndarray, np.ndarray] | None], pa.RecordBatch]


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    """``keyed`` with its number of ``blocks``, its ``own`` one, and from which to which its blocks need not be compared (``lo``, ``hi``)."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    if "c" not in keyed.columns:
        held = keyed.join(unplaced(sizes, "key"), "key").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        return held.withColumns({"own": F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"), "lo": F.lit(0), "hi": F.lit(0)})
    # Parts of more than a block have blocks of their own, behind those of all other rows.
    large = checkpointed(keyed.groupBy("key", "c").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("k", F.ceil(F.col("n") / block).cast("int")))
    if large.isEmpty():
        return _dealt(keyed.drop("c"), block)
    before = Window.partitionBy("key").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    sums = large.groupBy("key").agg(F.sum("n").alias("in_large"), F.sum("k").alias("of_large"))
    sizes = sizes.join(sums, "key", "left").select("key", F.ceil((F.col("size") - F.coalesce("in_large", F.lit(0))) / block).cast("int").alias("rest"), F.coalesce("of_large", F.lit(0)).cast("int").alias("of_large"))
    large = large.select(F.col("key").alias("_k"), F.col("c").alias("_c"), "k", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("int").alias("skip"))
    held = keyed.join(unplaced(sizes, "key"), "key").join(large, (F.col("key") == F.col("_k")) & (F.col("c") == F.col("_c")), "left")
    one, own = F.col("k").isNotNull(), F.xxhash64("a")
    lo = F.when(one, F.col("rest") + F.col("skip")).otherwise(0)
    held = held.withColumns({"blocks": F.col("rest") + F.col("of_large"), "lo": lo, "hi": F.when(one, lo + F.col("k")).otherwise(0)})
    return held.withColumn("own", F.when(one, F.col("lo") + F.pmod(own, F.col("k"))).otherwise(F.pmod(own, F.greatest(F.col("rest"), F.lit(1)))).cast("int"))


def in_blocks(keyed: DataFrame, rows: DataFrame, f: Compare, schema: str, block: int = BLOCK) -> DataFrame:
    """f for each pair of blocks of every key that two or more rows of ``keyed`` (a, key) share.

    With a column ``c`` in ``keyed``, only rows of different c are of interest: what of a
    key has one c and is more than a block is dealt out to other blocks than its own only.

    ``rows`` has what f needs of each ``a``; f also gets ``key``, the block numbers
    ``x`` <= ``y`` and each row's ``own`` one.  A key of b blocks is dealt to b (b + 1) / 2
    groups, so no task holds more than about two blocks of a key at once; two different
    blocks are only compared with each other, a block with itself where x = y.  Most
    groups are a few rows: those of an Arrow batch are given to f together.
    """
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    held = _dealt(keyed, block).withColumn("with", F.explode(F.filter(every, lambda x: (x < F.col("lo")) | (x >= F.col("hi")))))
    held = held.select("a", "key", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    names = ["key", "x", "y"]

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        group = np.stack([rows[c].to_numpy() for c in names])
        start = np.append(0, np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1)
        size = np.diff(np.append(start, len(rows)))
        for s, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
            yield f(rows.slice(s, n).combine_chunks(), None)
        few = np.repeat(size <= FEW, size)
        if few.any():
            rows, size = rows.filter(pa.array(few)).combine_chunks(), size[size <= FEW]
            left = np.repeat(size, size) - 1 - (np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size))  # rows of the group that follow
            i = np.repeat(np.arange(len(rows)), left)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
            own, across = rows["own"].to_numpy(), (rows["x"].to_numpy() != rows["y"].to_numpy())[i]
            good = ~across | (own[i] != own[j])
            yield f(rows, (i[good], j[good]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; the last group of a batch waits for what may follow."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            group = np.stack([batch[c].to_numpy() for c in names])
            cut = int(np.flatnonzero((group != group[:, -1:]).any(0)).max(initial=-1)) + 1
            if held and (cut or [held[-1][c][0].as_py() for c in names] != group[:, 0].tolist()):
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from compare(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from compare(pa.Table.from_batches(held))

    dealt = held.join(rows, "a").repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(meet, schema)


def comparable(rows: pa.Table) -> np.ndarray:
    """Which rows of one group are to be compared, as a symmetric matrix."""
    own = rows["own"].to_numpy()
    pairs = own[:, None] != own[None, :] if rows["x"][0] != rows["y"][0] else np.ones((len(own), len(own)), bool)
    np.fill_diagonal(pairs, False)
    return pairs

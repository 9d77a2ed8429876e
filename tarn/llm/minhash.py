"""MinHash near-dedup (operator 2) with sequential Bayesian verification.

Documents with equal shingle sets are one class.  Classes that share a band of their
signatures are candidates: first each class with the member of its bucket that meets
most others (as many pairs as rows, however large a bucket is), then, among those not
connected yet, the different components within a bucket, compared in blocks.  Signatures
are compared in batches, and a candidate is given up once the posterior probability of a
similarity at or over the threshold falls under ``miss``; survivors are verified on their
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import comparable, in_blocks
from .common import checkpointed, connected_components, table, unplaced
from .words import STRONG, U, Words, alone, chunks, exact_sets, inverse, mix, powers, runs, words, _Q

#: Signature values compared before each decision.
BATCH = 30
#: Pairs compared at a time.
PAIRS = 1 << 17


def rows_per_band(threshold: float, bands: int, miss: float) -> int:
    """As many rows as keep the chance to miss a pair at the threshold within ``miss``."""
    r = 1
    while (1 - threshold ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def least_matches(threshold: float, n: int, miss: float) -> list[int]:
    """For 0 to n compared values, the least matches at which P(similarity >= threshold) >= miss, from a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for k in range(n + 1):
        tail, m = 0.0, -1
        while tail < miss and m < k:
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def _shingles(w: Words, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row the places of its distinct shingles in the order of their hashes, and the hashes by place.

    Two shingles are the same if their words are; equal hashes of different words are
    told apart.  A row of fewer than k words has one shingle, at its first word.
    """
    h, _ = runs(w, k)
    h, out = np.append(h, np.zeros(len(w.number) - len(h), U)), []
    for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - s < k:
            if e > s:
                h[s] = mix(np.array([(w.hash[s:e] * powers(_Q, e - s)[: e - s]).sum(dtype=U) + U(e - s)], U))[0]
            out.append(np.arange(s, min(e, s + 1)))
            continue
        own = h[s : e - k + 1]
        order = own.argsort()
        at = np.flatnonzero(own[order[1:]] == own[order[:-1]])
        if len(at):
            one, two = s + order[at], s + order[at + 1]
            if any((w.number[one + j] != w.number[two + j]).any() for j in range(k)):
                lanes = [w.digests[w.number[s + j : e - k + 1 + j], i] for j in range(k - 1, -1, -1) for i in (1, 0)]
                order = np.lexsort((*lanes, own))
                same = np.all([x[order[1:]] == x[order[:-1]] for x in lanes], 0)
            else:
                same = own[order[1:]] == own[order[:-1]]
            order = order[np.append(True, ~same)]
        out.append(s + order)
    return out, h


def _fingerprint(w: Words, places: np.ndarray, k: int, row: int) -> bytes:
    """128 bits of a set: BLAKE2b over the digests of its shingles' words."""
    size = min(k, int(w.first[row + 1] - w.first[row]))
    return blake2b(w.digests[w.number[places[:, None] + np.arange(size)]].tobytes() + bytes([size]), digest_size=16).digest()


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, a 128-bit fingerprint of the set (f1, f2), band keys and the low byte of each minimum."""
    r = np.random.default_rng(2)
    factors = r.integers(0, 1 << 31, bands * rows, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = r.integers(0, 1 << 32, bands * rows, np.int64).astype(np.uint32)
    names = ["doc_id", "tag", "n_shingles", "f1", "f2", "bands", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", 2 << 20):
                w = words(part["_text"], fold=True, digest=STRONG)
                sets, h = _shingles(w, k)
                n = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(n)
                every = h[np.concatenate(sets)] if sets else h
                starts = (np.cumsum(n) - n)[full]
                prints = np.zeros((len(sets), 2), np.int64)
                mins = np.zeros((bands * rows, len(sets)), np.uint32)
                if len(full):
                    prints[full] = np.frombuffer(b"".join([_fingerprint(w, sets[r], k, r) for r in full.tolist()]), np.int64).reshape(-1, 2)
                    x = (every >> U(32)).astype(np.uint32)
                    h = np.empty_like(x)
                    for i in range(bands * rows):
                        np.multiply(x, factors[i], out=h)
                        h += shifts[i]
                        mins[i, full] = np.minimum.reduceat(h, starts)
                keys = np.zeros((len(sets), bands), U)
                for b in range(bands):
                    at = np.full(len(sets), b + 1, U)
                    for i in range(b * rows, b * rows + rows):
                        at = at * U(inverse(_Q)) + mins[i]
                    keys[:, b] = mix(at)
                low = np.ascontiguousarray(mins.T.astype(np.uint8))
                to = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                width = low.shape[1]
                sig = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(np.arange(len(sets) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(low)])
                ends = np.arange(len(sets) + 1, dtype=np.int32) * np.int32(bands)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["tag"], pa.array(n), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), to(ends, keys.reshape(-1).view(np.int64)), sig], names)

    schema = "doc_id long, tag long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"
    return docs.select(*_named(docs)).mapInArrow(alone(run, "minhash"), schema)


def _named(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").alias("_text")]


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and the text of a document of the class, for the classes given (id, doc_id, tag)."""
    some = docs.select(*_named(docs)).join(classes.select("id", F.col("doc_id").alias("_d"), F.col("tag").alias("_t")), (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t")))
    return some.select("id", F.col("_text").cast("binary").alias("text")).dropDuplicates(["id"])


def _survivors(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int, enough: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (x[i], y[j]) of signatures of sets of n[i] and m[j], those that may be similar, and all matches."""
    a, b = n[i], m[j]
    fit = np.flatnonzero(np.minimum(a, b) * den >= np.maximum(a, b) * num)
    same, out = np.zeros(len(i), np.int64), []
    for s in range(0, len(fit), PAIRS):
        alive = fit[s : s + PAIRS]
        for at in range(0, x.shape[1], BATCH):
            to = min(x.shape[1], at + BATCH)
            same[alive] += (x[i[alive], at:to] == y[j[alive], at:to]).sum(1)
            alive = alive[same[alive] >= enough[to]]
        out.append(alive)
    return np.concatenate(out) if out else fit, same


def _signature(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int, size: int, miss: float) -> DataFrame:
    """Pairs whose signatures leave a similarity at the threshold possible."""
    enough = least_matches(num / den, size, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(len(batch))
            alive, _ = _survivors(every, every, _signature(batch["x"], size), _signature(batch["y"], size), batch["n"].to_numpy(), batch["m"].to_numpy(), num, den, enough)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(alive)), batch["b"].take(pa.array(alive))], ["a", "b"])

    one = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("sig").alias("x"))
    two = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("sig").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


Pairs = tuple[np.ndarray, np.ndarray] | None


def _apart(t: pa.Table, pairs: Pairs, num: int, den: int, enough: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in different components whose first shared band this is and that may be similar; their matches."""
    c = t["own_c"].to_numpy()
    i, j = np.nonzero(np.triu(comparable(t))) if pairs is None else pairs
    other = c[i] != c[j]
    i, j = i[other], j[other]
    n, sig = t["n_shingles"].to_numpy(), _signature(t["sig"], len(enough) - 1)
    alive, same = _survivors(i, j, sig, sig, n, n, num, den, enough)
    i, j, same = i[alive], j[alive], same[alive]
    keys = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(c), -1)
    here = (keys == t["key"].to_numpy()[:, None]).argmax(1)
    first = (keys[i] == keys[j]).argmax(1) == here[i]
    return i[first], j[first], same[first]


def _rows_with_survivors(t: pa.Table, pairs: Pairs, num: int, den: int, enough: list[int]) -> pa.RecordBatch:
    i, j, _ = _apart(t, pairs, num, den, enough)
    some = pa.array(np.unique(np.concatenate([i, j])))
    return pa.RecordBatch.from_arrays([t[x].combine_chunks().take(some) for x in ("key", "a", "own_c")], ["key", "a", "c"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _links(t: pa.Table, pairs: Pairs, k: int, num: int, den: int, enough: list[int]) -> pa.RecordBatch:
    """Verified links that join components, the most similar tried first; within the group, joined ones are one."""
    i, j, same = _apart(t, pairs, num, den, enough)
    order = np.argsort(-same, kind="stable")
    a, some = t["a"].to_numpy(), np.unique(np.concatenate([i, j]))
    sets = dict(zip(some.tolist(), exact_sets(t["text"].combine_chunks().take(pa.array(some)).to_pylist(), k)))
    c = t["own_c"].to_pylist()
    up = {x: x for x in c}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out: list[tuple[int, int]] = []
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        one, two = top(c[p]), top(c[q])
        if one != two:
            common = _common(sets[p], sets[q])
            if den * common >= num * (len(sets[p]) + len(sets[q]) - common):
                up[two] = one
                out.append((min(a[p], a[q]), max(a[p], a[q])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs with den * intersection >= num * union of their whole sets, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in chunks(batch, "x", 4 << 20):
                for part in chunks(half, "y", 4 << 20):
                    a, b = part["a"].to_numpy(), part["b"].to_numpy()
                    ids, at = np.unique(np.concatenate([a, b]), return_index=True)
                    sets = exact_sets([part["x"][p].as_py() if p < len(a) else part["y"][p - len(a)].as_py() for p in at.tolist()], k)
                    keep = []
                    for p, q in zip(np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist()):
                        common = _common(sets[p], sets[q])
                        keep.append(den * common >= num * (len(sets[p]) + len(sets[q]) - common))
                    keep = pa.array(keep, pa.bool_())
                    yield pa.RecordBatch.from_arrays([part["a"].filter(keep), part["b"].filter(keep)], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 30, miss: float = 7e-6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    A document's set is its distinct runs of ``k`` words, A-Z as a-z; with fewer words
    the whole sequence; without any it is empty and linked with nothing.  Documents
    with den * |intersection| >= num * |union| are linked; a component is named by its
    smallest doc_id, which alone has ``kept``.

    ``bands`` and ``miss`` set the rows of a band: a pair at the threshold shares no
    band with a chance of ``miss`` at most.  No bucket or partner is left out.

    Links and equal sets are decided on the words themselves, or for equal sets on a
    BLAKE2b digest of all their words; hashes only say what is compared.

    A null doc_id takes no part: component_id null, kept true.  Rows that repeat a
    doc_id are one document with the links of all its texts, and each get its component;
    a row without words stays alone all the same.  Other columns are left out.
    """
    rows = rows_per_band(num / den, bands, miss)
    made = checkpointed(_signatures(docs, k, bands, rows))
    sets_of = ["f1", "f2", "n_shingles"]
    usable = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is known by its set; its number is fixed by the checkpoint.
    first = usable.groupBy(*sets_of).agg(F.min("doc_id").alias("name"))
    first = checkpointed(first.withColumn("cls", F.monotonically_increasing_id()))
    by_set = first.select(*sets_of, "name", "cls").transform(unplaced, "f1", "f2")
    classes = usable.join(by_set, sets_of).where("doc_id = name").select(F.col("cls").alias("id"), "doc_id", "tag", "n_shingles", "bands", "sig")
    # Repeated rows have the same set, so any of them will do; of texts that differ all the same, one is looked up by its tag.
    classes = checkpointed(classes.dropDuplicates(["id"]))
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    held = checkpointed(keys.join(unplaced(shared, "key"), "key"))
    texts = checkpointed(_texts(docs, classes.join(held.select("id").distinct(), "id", "left_semi")))

    # Each class with the member of its bucket that meets most others anywhere.
    weight = held.groupBy("id").agg(F.sum(F.col("size") - 1).alias("weight"))
    hubs = held.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
    stars = held.join(hubs.select("key", (-F.col("top.minus")).alias("hub")).transform(unplaced, "key"), "key").where("id <> hub").select(*_ordered("id", "hub")).distinct()
    found = checkpointed(_verified(_likely(stars, classes, num, den, bands * rows, miss), texts, k, num, den))
    parts = connected_components(found.unionByName(_same_document(usable, by_set, sets_of)))

    # What shares a bucket and is still apart: compared by signatures, then the rows that had survivors by whole sets.
    at = held.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", F.col("id").alias("a"), F.coalesce("component", "id").alias("c"))
    open_keys = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    apart = checkpointed(at.join(unplaced(open_keys, "key"), "key"))
    component = apart.groupBy("a").agg(F.min("c").alias("c"))
    rows_of = checkpointed(component.join(classes.select(F.col("id").alias("a"), "n_shingles", "bands", "sig"), "a"))
    enough = least_matches(num / den, bands * rows, miss)
    rows_of = rows_of.withColumnRenamed("c", "own_c")
    near = in_blocks(apart.select("key", "a", "c"), rows_of, lambda t, pairs: _rows_with_survivors(t, pairs, num, den, enough), "key long, a long, c long", 1024).distinct()
    rows_of = rows_of.join(texts.withColumnRenamed("id", "a"), "a")
    late = checkpointed(in_blocks(checkpointed(near), rows_of, lambda t, pairs: _links(t, pairs, k, num, den, enough), "a long, b long", 512).distinct())
    node = parts.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    ends = late.join(node, late["a"] == node["_n"], "left").select(F.coalesce("_c", "a").alias("a"), "b").join(node, F.col("b") == node["_n"], "left").select("a", F.coalesce("_c", "b").alias("b"))
    above = connected_components(ends).select(F.col("node").alias("_p"), F.col("component").alias("_q"))
    top = first.join(node, first["cls"] == node["_n"], "left").select(*sets_of, "name", F.coalesce("_c", "cls").alias("_c"))
    top = checkpointed(top.join(above, F.col("_c") == F.col("_p"), "left").select(*sets_of, "name", F.coalesce("_q", "_c").alias("_c")))
    names = top.groupBy("_c").agg(F.min("name").alias("_component"))
    top = top.join(unplaced(names, "_c"), "_c").select(*sets_of, "_component")
    out = made.select("doc_id", *sets_of).join(unplaced(top, "f1", "f2"), sets_of, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_document(usable: DataFrame, by_set: DataFrame, sets_of: list[str]) -> DataFrame:
    """a, b: classes that have texts of one doc_id, each with the first of them."""
    several = usable.groupBy("doc_id").agg(F.min(F.struct(*sets_of)).alias("one"), F.max(F.struct(*sets_of)).alias("two")).where("one <> two").select("doc_id")
    classes = usable.select("doc_id", *sets_of).join(several, "doc_id", "left_semi").join(by_set, sets_of).select("doc_id", "cls").distinct()
    least = classes.groupBy("doc_id").agg(F.min("cls").alias("a"))
    return classes.join(unplaced(least, "doc_id"), "doc_id").select("a", F.col("cls").alias("b")).where("a < b")


#: The query in DuckDB's SQL, which joins documents on all their shingles.
OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ways AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM both_ways c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 100)

"""Substring dedup (operator 6): seed and extend over winnowed anchors.

Every window of ``length`` words has an anchor, the smallest hash of the k-word seeds in
it, so equal windows have equal anchors (winnowing).  A first pass finds out which
anchors documents share; only around these, in a second pass, the words themselves
travel, one row for each run of windows with one anchor.  Where rows meet on an anchor, a
match is extended to both sides by comparing words, and the windows that are equal are put
together to maximal repeats.  Hashes say who meets, words what is equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, stored, table, unplaced
from .words import QUICK, U, Words, chunks, exact_runs, release, runs, words

#: An anchor of more rows is crowded: its windows are counted one by one, before and after the shuffle.
CROWD = 1024
#: Bytes of text whose windows are compared before anything is shuffled.
PART = 4 << 20


def _firsts(w: Words, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows at word positions ``at`` the index of the first equal one, and whether there is another; ``h`` are their hashes."""
    _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    later = np.flatnonzero(first[back] != np.arange(len(at)))
    if len(later):
        one, two = at[later], at[first[back[later]]]
        # A window that goes on where the one before it was equal has one more word to compare.
        on = np.append(False, (np.diff(one) == 1) & (np.diff(two) == 1))
        same = (w.number[one + length - 1] == w.number[two + length - 1]).all()
        one, two = one[~on], two[~on]
        if not (same and all((w.number[one + j] == w.number[two + j]).all() for j in range(length))):
            _, first, back, count = np.unique(exact_runs(w.number, length)[at], return_index=True, return_inverse=True, return_counts=True)
    return first[back], count[back] > 1


def _window_runs(column: pa.Array, length: int, seed: int):
    """Distinct windows of the rows in runs with one anchor, and the windows that occur twice or more in these rows.

    Gives the words, the positions of first occurrences, their anchors, where their runs
    begin, and the positions of all windows that occur twice or more.
    """
    w = words(column, digest=QUICK)
    h, inside = runs(w, length)
    at = np.flatnonzero(inside)
    low, _ = runs(w, seed)
    span, wide = length - seed + 1, 1
    while wide < span:
        step = min(wide, span - wide)
        low = np.minimum(low[: max(0, len(low) - step)], low[step:])
        wide += step
    first, several = _firsts(w, at, h[at], length)
    kept = at[first == np.arange(len(at))]
    anchor = low[kept]
    new = np.ones(len(kept), bool)
    new[1:] = (np.diff(kept) != 1) | (anchor[1:] != anchor[:-1]) | (np.diff(w.row[kept]) != 0 if len(kept) else False)
    return w, kept, anchor, new, at[several]


def _spans(at: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First members and sizes of runs of consecutive positions in one row."""
    row = w.row[at] if len(at) else at
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (np.diff(at) != 1) | (np.diff(row) != 0)]))
    return begin, np.diff(np.append(begin, len(at)))


def row_id() -> Column:
    """128 bits of a row's doc_id and text, by SHA-256; null is no id and no text."""
    own = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return F.substring(F.unhex(F.sha2(own.cast("binary"), 256)), 1, 16)


def _marks(src: DataFrame, length: int, seed: int) -> DataFrame:
    """rid, key, start, n: the anchors of a row (start and n null), and the windows that its part of the table has twice (key null)."""
    names = ["rid", "key", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", PART):
                w, kept, anchor, new, twice = _window_runs(part["_text"], length, seed)
                row, key = w.row[kept[new]] if len(kept) else kept, anchor[new]
                yield pa.RecordBatch.from_arrays([part["rid"].take(pa.array(row)), pa.array(key.view(np.int64)), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.int32())], names)
                begin, size = _spans(twice, w)
                row = w.row[twice[begin]] if len(begin) else begin
                start = twice[begin] - w.first[row]
                yield pa.RecordBatch.from_arrays([part["rid"].take(pa.array(row)), pa.nulls(len(row), pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names)
        release()

    return src.select("rid", "_text").mapInArrow(run, "rid binary, key long, start int, n int")


def _around(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """key, rid, start, n, words: what is around the anchors listed for a row (``few``, ``many``).

    The words of a run of n windows; or, n = 0, the digest of a single window of a
    crowded anchor (its key only deals it out); or no words, if the windows are known to
    occur twice.
    """
    names = ["key", "rid", "start", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.filter(batch["rid"].is_valid()), "_text", PART):
                w, kept, anchor, new, twice = _window_runs(part["_text"], length, seed)
                begin = np.flatnonzero(new)
                size, row, key = np.diff(np.append(begin, len(kept))), w.row[kept[begin]] if len(kept) else begin, anchor[begin]
                few, many = (_listed(part[c], row, key) for c in ("few", "many"))
                at, n, key = kept[begin], size, key.view(np.int64)
                text = [b" ".join(w.tokens[s:e]) for s, e in zip(at[few].tolist(), (at + n + length - 1)[few].tolist())]
                yield _rows(part, [key[few], row[few], (at - w.first[row])[few], n[few]], text)
                which = np.repeat(np.flatnonzero(many), n[many])
                one = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                text = [blake2b(b" ".join(w.tokens[s : s + length]), digest_size=16).digest() for s in one.tolist()]
                spread = np.frombuffer(b"".join([x[:8] for x in part["rid"].to_pylist()]), np.int64)
                yield _rows(part, [spread[row[which]] + one, row[which], one - w.first[row[which]], np.zeros(len(one), np.int64)], text)
                begin, size = _spans(twice, w)
                row = w.row[twice[begin]] if len(begin) else begin
                yield _rows(part, [spread[row], row, twice[begin] - w.first[row], size], [None] * len(row))
        release()

    def _rows(part: pa.RecordBatch, values: list[np.ndarray], text: list[bytes | None]) -> pa.RecordBatch:
        key, row, start, n = values
        return pa.RecordBatch.from_arrays([pa.array(key), part["rid"].take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary())], names)

    return keyed.mapInArrow(run, "key long, rid binary, start int, n int, words binary")


def _listed(lists: pa.Array, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys are in their row's list."""
    own = lists.flatten().to_numpy().view(U)
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    # Equal keys have equal numbers, so a pair of row and key is one integer.
    _, number = np.unique(np.concatenate([own, key]), return_inverse=True)
    pair = number * len(lists) + np.concatenate([of, row])
    return np.isin(pair[len(own) :], pair[: len(own)])


def _extend(rows: pa.Table, length: int) -> pa.RecordBatch:
    """rid, start, n of the windows that occur twice in rows of whole anchors, by their words."""
    rows = rows.filter(pc.or_(rows["words"].is_null(), pc.greater(rows["n"], 0))).combine_chunks()
    known = rows["words"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    w = words(rows["words"].combine_chunks())
    value = exact_runs(w.number, length)
    at = np.flatnonzero(w.row[: len(value)] == w.row[length - 1 :]) if len(value) else np.zeros(0, np.int64)
    _, back, count = np.unique(value[at], return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    begin, n = _spans(at, w)
    row = w.row[at[begin]] if len(begin) else begin
    start, size = rows["start"].to_numpy(), rows["n"].to_numpy()
    place = np.concatenate([start[row] + at[begin] - w.first[row], start[known]])
    return pa.RecordBatch.from_arrays([rows["rid"].combine_chunks().take(pa.array(np.concatenate([row, np.flatnonzero(known)]))), pa.array(place.astype(np.int32)), pa.array(np.concatenate([n, size[known]]).astype(np.int32))], ["rid", "start", "n"])


def repeated_spans(docs: DataFrame, length: int = 50, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_rid`` and ``_text``, and the spans: rid, start, n.

    Words start .. start + n + length - 2 of the rows with that id are n windows that occur anywhere else.
    """
    seed = seed or max(1, length * 2 // 5)
    keyed = docs.select("*", row_id().alias("_rid"), F.col("text").alias("_text")).drop("text")
    marks, _ = stored(_marks(keyed.select(F.col("_rid").alias("rid"), "_text"), length, seed))
    anchors = marks.where("key IS NOT NULL").select("key", "rid")
    again = checkpointed(anchors.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    listed = anchors.join(unplaced(again, "key"), "key").groupBy("rid").agg(*(F.collect_set(F.when(c, F.col("key"))).alias(n) for n, c in (("few", F.col("size") <= CROWD), ("many", F.col("size") > CROWD))))
    # All columns go along and both joins keep all rows, so the texts are dealt out once for this join and for the last one.
    around = _around(keyed.join(listed, F.col("_rid") == F.col("rid"), "left"), length, seed).repartition("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key; a key's rows are kept until the next key begins."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch["key"].to_numpy()
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held and held[-1]["key"][-1].as_py() != key[0]:
                yield _extend(pa.Table.from_batches([*held, batch.slice(0, cut)]), length)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _extend(pa.Table.from_batches(held), length)

    spans = around.sortWithinPartitions("key").mapInArrow(meet, "rid binary, start int, n int").unionByName(marks.where("key IS NULL").drop("key"))
    if not again.where(F.col("size") > CROWD).isEmpty():

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = batch.filter(pc.equal(batch["n"], 0))
                yield pa.RecordBatch.from_arrays([some["words"], some["rid"], some["start"]], ["digest", "rid", "start"])

        windows = around.mapInArrow(single, "digest binary, rid binary, start int")
        several = windows.groupBy("digest").agg(F.count("*").alias("_n")).where("_n > 1").select(F.concat("digest", F.lit(b"")).alias("_digest"))
        spans = spans.unionByName(windows.join(several, F.col("digest") == F.col("_digest")).select("rid", "start", F.lit(1).alias("n")))
    return keyed, spans


def drop_repeats(docs: DataFrame, length: int = 50, seed: int | None = None, out: str = "kept") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (longs) and the words left joined by one space (``out``).

    A word is a run of bytes other than ASCII white space.  A word goes if a window of
    ``length`` words over it also starts anywhere else, the same document included.
    Windows are judged on the input, and compared by their words; those of anchors with
    more than ``CROWD`` rows by a BLAKE2b digest of their words.  Null or short texts have
    no windows; null text has no words.  Repeated rows are occurrences of each other and
    lose all their windows; a null doc_id is an id like others.  Other columns pass through.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", out)]
    keyed, spans = repeated_spans(docs.select(*names), length, seed)
    found = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    joined = keyed.join(found, F.col("_rid") == F.col("rid"), "left").drop("rid")
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(out, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", PART):
                n, gone, kept = [], [], []
                for text, spans in zip(part["_text"], part["_spans"]):
                    own = (text.as_py() or "").encode().split()
                    n.append(len(own))
                    if spans.is_valid:
                        change = np.zeros(len(own) + 1, np.int64)
                        s = spans.values.field("start").to_numpy()
                        np.add.at(change, s, 1)
                        np.add.at(change, s + spans.values.field("n").to_numpy() + (length - 1), -1)
                        stay = np.cumsum(change[:-1]) == 0
                        own = list(compress(own, stay.tolist()))
                    gone.append(n[-1] - len(own))
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([*(part["_text" if c == "text" else c] for c in names), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)


#: The query in DuckDB's SQL, which groups all windows by their words.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d),
x AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS words FROM p),
twice AS (SELECT words FROM x GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM x JOIN twice USING (words)),
every AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT e.r, count(*) AS n, count(g.j) AS gone, string_agg(word, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL) AS kept
      FROM every e LEFT JOIN gone g ON g.r = e.r AND g.j = e.j GROUP BY e.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs, 35).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

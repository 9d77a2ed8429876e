"""Byte-level BPE encoding and decoding (operator 3).

Two tiers: a minimal perfect hash finds pre-tokens that are vocabulary entries as a
whole; all others are merged by a heap of ranked pairs over a linked list of bytes.
What a pre-token gives is remembered in a bounded table, as words repeat.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import source, table
from .words import alone, chunks, kept

_M = (1 << 64) - 1


def _mix(h: int, d: int) -> int:
    x = (h + d * 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _M
    return x >> 29


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): as many slots as keys.

    Keys fall into buckets; from the largest bucket on, a displacement is looked for
    that puts all its keys into free slots.  Buckets of one key name their slot.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.keys, n = keys, len(keys)
        self.disp = [0] * max(1, n // 2)
        self.slots = [-1] * n
        buckets: list[list[tuple[int, int]]] = [[] for _ in self.disp]
        for i, k in enumerate(keys):
            h = self.hash(k)
            buckets[h % len(self.disp)].append((h, i))
        free = 0
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) > 1:
                d = 1
                while len(at := {_mix(h, d) % n for h, _ in own}) < len(own) or any(self.slots[s] >= 0 for s in at):
                    d += 1
                self.disp[b] = d
                for h, i in own:
                    self.slots[_mix(h, d) % n] = i
            elif own:
                while self.slots[free] >= 0:
                    free += 1
                self.disp[b] = -free - 1
                self.slots[free] = own[0][1]

    def find(self, key: bytes) -> int:
        """The key's index, -1 if it isn't one."""
        if not self.keys:
            return -1
        h = self.hash(key)
        d = self.disp[h % len(self.disp)]
        i = self.slots[-d - 1 if d < 0 else _mix(h, d) % len(self.keys)]
        return i if self.keys[i] == key else -1


# Letters and numbers of Unicode 17 and later, which the rank files' library does not know yet.
_LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


class Coder(dict):
    """Maps pre-tokens to tuples of ids; itself the table of those seen lately.

    At ``most`` entries it becomes the elder table, from which those still in use come
    back, so there are twice as many at most and frequent ones are never lost.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 150_000):
        import regex

        super().__init__()
        self.ranks, self.most = ranks, most
        self.elder: dict[str, tuple[int, ...]] = {}
        self.single = [bytes([i]) for i in range(256)]
        self.whole = PerfectHash(list(ranks))
        self.ids = list(ranks.values())
        self.bytes = {i: b for b, i in ranks.items()}
        # The rank files' library takes \s as Unicode's White_Space.
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.usual = regex.compile(pattern, regex.V0).findall
        for kind in ("L", "N"):
            pattern = pattern.replace(f"\\p{{{kind}}}", f"[\\p{{{kind}}}--[{_LATER}]]")
        self.careful, self.later = regex.compile(pattern, regex.V1).findall, regex.compile(f"[{_LATER}]").search

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.elder.get(piece)
        if found is None:
            raw = piece.encode()
            i = self.whole.find(raw)
            found = (self.ids[i],) if i >= 0 else self.merge(raw)
            if len(raw) > 64:
                return found
        self[piece] = found
        return found

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, the leftmost first, until no pair is an entry."""
        n, rank = len(raw), self.ranks.get
        parts: list[bytes | None] = list(map(self.single.__getitem__, raw))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            if (left := parts[i]) is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
                continue  # one of the pair has been merged meanwhile
            parts[i] = left = left + parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(left + parts[k])) is not None:
                    heappush(heap, (r, i, size + len(parts[k])))
            if (h := before[i]) >= 0 and (r := rank(parts[h] + left)) is not None:
                heappush(heap, (r, h, len(parts[h]) + size))
        return tuple([rank(p) for p in parts if p is not None])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later(text):
                return self.careful(text)
        return self.usual(text)

    def encode(self, text: str) -> list[int]:
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_coders: dict[str, Coder] = kept("bpe", {})


def _coder(name: str, shared, pattern: str) -> Coder:
    """One for each worker process and vocabulary; its table of pre-tokens stays for the tasks of this operator that follow."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(shared.value, pattern)
    return _coders[name]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` (array<int>), and what these decode to (binary) if ``decoded`` names a column.

    ``ranks`` (bounded by the vocabulary, not by the data) goes to the workers as a
    broadcast variable.  Each match of ``pattern`` is encoded on its own; special
    tokens are ordinary text.  Null or empty text: no ids, empty bytes.  Texts are
    never cut.  Other columns pass through; of the same name, they are replaced.
    """
    out = [c for c in docs.columns if c not in (ids, decoded)]
    src, text = source(docs, out)
    schema = T.StructType([*docs.select(*out).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared, pattern)
        for batch in batches:
            for part in chunks(batch, text, 4 << 20):
                found = [coder.encode(t or "") for t in part[text].to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                columns = [part[c] for c in out] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([coder.decode(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return src.mapInArrow(alone(run, "bpe"), schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; null ids give empty bytes, unknown ids fail."""
    out = [c for c in df.columns if c != decoded]
    schema = T.StructType([*df.select(*out).schema.fields, T.StructField(decoded, T.BinaryType(), False)])
    shared = df.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            found = [b"".join(map(words.__getitem__, x or ())) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in out), pa.array(found, pa.binary())], [f.name for f in schema])

    return df.select(*out).mapInArrow(run, schema)


def public_vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the query; ``path`` is another rank file for the same pattern."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def digests(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = public_vocabulary()
    return digests(encode(docs, ranks, pattern, decoded="decoded").drop("text"))

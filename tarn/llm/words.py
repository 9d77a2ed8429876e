"""Words, their hashes and exact numbers, for whole Arrow batches at a time.

A word is a run of bytes other than ASCII white space.  Each distinct word of a batch gets a
number in a table, by which words are compared, and a hash, by which they meet: a quick one
where the words are compared afterwards, a BLAKE2b digest where they are not, so that no
text can be made up whose words are taken for others.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: What a worker process keeps from task to task, by operator.
_tables: dict[str, dict] = {}
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give memory that a task no longer needs back to the system; idle workers stay for a while beside the next stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def kept(operator: str, table: dict) -> dict:
    """A table that stays in a worker for the tasks that follow, until one of another operator begins."""
    _tables[operator] = table
    return table


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, without the tables that other operators left in its worker; its memory goes back once it has ended.

    Operators go by name, as what a closure holds is copied on its way to the worker.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(operator)
        yield from run(batches)  # ended, it has let go of its last batch
        release()

    return whole


def forget(but: str) -> None:
    """Empty the kept tables of all other operators."""
    full = [table for operator, table in _tables.items() if operator != but and table]
    for table in full:
        table.clear()
    if full:
        gc.collect()


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd number modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets; a null row is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), ends


def chunks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each, one row at least."""
    _, ends = text_buffers(batch[column])
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Numbers(dict):
    """Words by number: equal bytes have equal numbers, others others."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Digests(dict):
    """Words' BLAKE2b digests; those of short words met first are kept, as words repeat."""

    def __missing__(self, word: bytes) -> bytes:
        digest = blake2b(word, digest_size=16).digest()
        if len(self) < 100_000 and len(word) <= 32:
            self[word] = digest
        return digest


_digests = kept("minhash", Digests())
#: Ways to get 128 bits of a word.
STRONG, QUICK = _digests.__getitem__, xxhash.xxh3_128_digest


@dataclass
class Words:
    """Words of some rows: ``tokens``, their exact ``number`` and ``hash``, ``row`` (ascending); ``first[r]:first[r+1]`` are those of row r.

    ``digests``: two 64-bit lanes for each number; they and ``hash`` are empty if no way to get them was given.
    """

    tokens: list[bytes]
    row: np.ndarray
    number: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    digests: np.ndarray


def words(column: pa.Array, fold: bool = False, digest: Callable[[bytes], bytes] | None = None) -> Words:
    """``fold``: take A-Z as a-z; ``digest``: ``STRONG`` or ``QUICK``."""
    data, ends = text_buffers(column)
    raw, cuts = memoryview(data), ends.tolist()
    tokens: list[bytes] = []
    first = np.zeros(len(column) + 1, np.int64)
    for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        own = bytes(raw[s:e])
        tokens += (own.lower() if fold else own).split()
        first[r + 1] = len(tokens)
    table = Numbers()
    number = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
    digests = np.frombuffer(b"".join(map(digest, table)) if digest else b"", U).reshape(-1, 2)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(tokens, row, number, digests[number, 0] if digest else digests[:, 0], first, digests)


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words, by the index of the first one, and which of them lie within one row."""
    m = len(w.hash) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    sums = np.zeros(len(w.hash) + 1, U)
    np.cumsum(w.hash * powers(_Q, len(w.hash) + 1)[: len(w.hash)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * powers(inverse(_Q), len(w.hash) + 1)[:m]
    return mix(h + U(k)), w.row[: m] == w.row[k - 1 :]


def exact_runs(number: np.ndarray, k: int) -> np.ndarray:
    """An int64 for all k consecutive numbers, by the first one: equal runs have equal values, others others.

    Runs of twice the length are pairs of runs, and k is covered by two that overlap.
    """
    m = len(number) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    value, most, have = number, int(number.max()) + 1, 1
    while have < k:
        step = min(have, k - have)
        if most * most >= 1 << 63:  # number the values anew, so that they stay small
            _, value = np.unique(value, return_inverse=True)
            most = int(value.max()) + 1
        value = value[:-step] * most + value[step:]
        most *= most
        have += step
    return value


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set of runs of k words, A-Z as a-z, as sorted numbers; of fewer words the whole sequence.  No hashes: equal numbers are equal words."""
    w = words(pa.array(texts, pa.large_binary()), fold=True)
    value, short, out = exact_runs(w.number, k), Numbers(), []
    for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - s >= k:
            out.append(np.unique(value[s : e - k + 1]))
        else:
            out.append(np.array([-1 - short[w.number[s:e].tobytes()]] if e > s else [], np.int64))
    return out

"""Language ID (operator 7) by string kernels.

The kernel of two texts is the number of byte n-grams, of all lengths up to ``order``,
present in both, over the geometric mean of what each has (blended spectrum, presence).
One-versus-rest kernel ridge regression is fitted in the space that landmark texts span
(Nystrom).  With presence rows phi, f(x) = k(x, L) A = phi(x) (phi(L)' A), so a text is
scored by the weights of its n-grams, whatever the landmarks' number; only n-grams that a
landmark has weigh anything.  A long text is the mean of its pieces, so that it keeps the
n-grams' frequencies to some degree instead of having all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import source, table
from .words import alone, chunks

ORDER, BITS = 4, 20
#: Characters of a piece of a text.
PIECE = 16_384
#: Bounds of the sample: texts of a language, of all languages, and the characters taken of each; landmarks of a language and of all, which is also the most languages.
PER_LANGUAGE, TEXTS, SAMPLED = 400, 6000, 4096
LANDMARKS, MOST_LANDMARKS = 64, 512
RIDGE = 1e-3
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09)
#: Letters count, whatever their case; runs of anything else in ASCII are one kind of gap.
_GAPS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(texts: list[str], order: int = ORDER, bits: int = BITS) -> list[np.ndarray]:
    """The different n-grams of 1 to ``order`` bytes of each text, as hashes of ``bits`` bits."""
    raw = [t.lower().encode("utf-8", "replace").translate(_GAPS) for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    gram, columns = np.zeros(len(data), np.uint32), []
    for n in range(1, order + 1):
        gram = (gram[: max(0, len(data) - n + 1)] << np.uint32(8)) | data[n - 1 :]
        at = ((gram * np.uint32(_FACTORS[n - 1])) ^ (gram >> np.uint32(15))) * np.uint32(_FACTORS[-n])
        columns.append((at >> np.uint32(32 - bits)).astype(np.int32))
    last, out, start = np.zeros(1 << bits, np.int32), [], 0
    for x in raw:
        own = np.concatenate([c[start : start + max(0, len(x) - n)] for n, c in enumerate(columns)])
        # Of equal hashes the last one stays.
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place
        out.append(own[last[own] == place])
        start += len(x)
    return out


def pieces(text: str, size: int = PIECE) -> list[str]:
    """A text in parts of nearly equal length, of ``size`` characters at most."""
    n = -(-len(text) // size)
    return [text] if n < 2 else [text[i * len(text) // n : (i + 1) * len(text) // n] for i in range(n)]


@dataclass
class Model:
    languages: list[str]
    #: The landmarks' n-grams, ascending, and a row of weights for each: its presence in the landmarks times the dual weights.
    columns: np.ndarray
    weights: np.ndarray
    bits: int = BITS
    _row: np.ndarray | None = field(default=None, repr=False)

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of the regression's values for each text."""
        if self._row is None:
            self._row = np.full(1 << self.bits, len(self.columns), np.int32)
            self._row[self.columns] = np.arange(len(self.columns))
            self._padded = np.concatenate([self.weights, np.zeros((1, len(self.languages)), self.weights.dtype)])
        parts = [pieces(t) for t in texts]
        found = grams([x for own in parts for x in own], bits=self.bits)
        value = np.array([self._padded[self._row[g]].sum(0) / max(len(g), 1) ** 0.5 for g in found], float).reshape(len(found), -1)
        out, at = np.zeros((len(texts), len(self.languages))), 0
        for i, own in enumerate(parts):
            out[i] = value[at : at + len(own)].mean(0)
            at += len(own)
        return out


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, bits: int = BITS) -> Model:
    """Nystrom kernel ridge regression; the first ``landmarks`` texts of each language span the space."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), bits)
    place = {a: i for i, a in enumerate(languages)}
    y = np.zeros((len(langs), len(languages)))
    y[np.arange(len(langs)), [place[a] for a in langs]] = 1
    seen: dict[str, int] = {}
    at = [i for i, a in enumerate(langs) if seen.setdefault(a, 0) < landmarks and not seen.update({a: seen[a] + 1})]
    own = [g for s in range(0, len(texts), 64) for g in grams(texts[s : s + 64], bits=bits)]
    norm = np.sqrt([max(len(g), 1) for g in own])
    columns = np.unique(np.concatenate([own[i] for i in at]))
    # Entries of the presence matrix by column: dense for some columns at a time.
    text = np.repeat(np.arange(len(own)), [len(g) for g in own])
    column = np.concatenate(own)
    known = np.isin(column, columns)
    text, column = text[known], np.searchsorted(columns, column[known])
    order = column.argsort(kind="stable")
    text, column = text[order], column[order]

    def dense() -> Iterator[tuple[slice, np.ndarray]]:
        for s in range(0, len(columns), 2048):
            lo, hi = np.searchsorted(column, (s, s + 2048))
            x = np.zeros((len(own), min(2048, len(columns) - s)), np.float32)
            x[text[lo:hi], column[lo:hi] - s] = 1
            yield slice(s, s + 2048), x

    nm = np.zeros((len(own), len(at)))
    for _, x in dense():
        nm += x @ x[at].T
    nm /= norm[:, None] * norm[at]
    dual = np.linalg.lstsq(nm.T @ nm + ridge * len(texts) * nm[at] + 1e-9 * len(texts) * np.eye(len(at)), nm.T @ y, rcond=None)[0]
    weights = np.zeros((len(columns), len(languages)), np.float32)
    for s, x in dense():
        weights[s] = x[at].T @ (dual / norm[at][:, None])
    return Model(languages, columns, weights, bits)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int | None = None) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` (doc_id, text, lang) that are not held out.

    The sample has at most ``per_language`` texts of each lang value and about ``TEXTS`` in
    all, those of the smallest hash of doc_id and text, and of each ``SAMPLED`` characters
    from a place that the hash tells.  Rows without text, lang or doc_id are not learned
    from.  All lang values are learned, of more than ``MOST_LANDMARKS`` it is an error.
    ``languages``: learn only so many, the most frequent.
    """
    rows = docs.where((remainder(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)).alias("h"))
    found = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min("h").alias("least")).orderBy(F.desc("count"), "lang").limit(languages or MOST_LANDMARKS + 1).collect()
    if not found:
        return fit([], [])
    if len(found) > MOST_LANDMARKS:
        raise ValueError(f"more than {MOST_LANDMARKS} values of lang")
    per_language = max(1, min(per_language, TEXTS // len(found)))
    # At least the row of the smallest hash, so that every language is learned.
    share = [(r["lang"], max(r["least"] + 1, min(1 << 31, int(1.5 * per_language / r["count"] * (1 << 31)) + 1))) for r in found]
    share = docs.sparkSession.createDataFrame(share, "lang string, share long")
    rows = rows.join(F.broadcast(share), "lang").where(F.col("h") < F.col("share"))
    part = F.substring("text", (F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLED, F.lit(0)) + 1) + 1).cast("int"), F.lit(SAMPLED))
    rows = rows.select("lang", "h", part.alias("text")).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("nth") <= per_language)
    kept = sorted((r["lang"], r["h"], r["text"]) for r in rows.collect())
    return fit([t for _, _, t in kept], [k for k, _, _ in kept], max(1, min(LANDMARKS, MOST_LANDMARKS // len(found))))


def _letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of ``text`` and a score from 0 to 1.

    ``und`` with score 0 for null texts, texts without letters, and if nothing was
    learned.  The score is the regression's value, cut to 0 to 1: near 1 for texts like
    those learned from, near 0 for a text unlike all.  Ties go to the first language by
    name.  Texts are scored whole, long ones as the mean of their pieces.  Other columns
    pass through.
    """
    out = [c for c in docs.columns if c not in (pred, score)]
    schema = T.StructType([*docs.select(*out).schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src, text = source(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for wide in chunks(batch, text, 1 << 20):
                for at in range(0, len(wide), 256):
                    part = wide.slice(at, 256)
                    texts = part[text].to_pylist()
                    best, value = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
                    if known := [i for i, t in enumerate(texts) if m.languages and _letters(t)]:
                        f = m.scores([texts[i] for i in known])
                        best[known] = f.argmax(1)
                        value[known] = np.clip(f.max(1), 0, 1)
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in out), pa.array(names[best], pa.string()), pa.array(value)], schema.names)

    return src.mapInArrow(alone(run, "langid"), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")

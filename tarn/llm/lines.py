"""Line dedup (operator 8): drop lines that many documents share.

DataFrame functions only.  Normalised lines are exploded and hashed to 128 bits, the
distinct documents of each hash are counted, and the doomed positions are put
together by document and cut from its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, checkpointed, table, unplaced


def _lines(text: Column) -> Column:
    """Pieces between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` deduplicated, plus ``n_lines`` and ``n_dropped`` (longs).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs`` distinct
    doc_ids lose all their lines except those in the largest doc_id that holds them.

    Null or empty text: one empty line, kept; null text becomes ''.  A null doc_id
    counts as one document below all others.  Rows with the same doc_id are one
    document for counting; each row keeps its own text.  Other columns pass through.
    """
    keyed = docs.select("*", F.xxhash64("text").alias("_t"))
    # Only the keys' hashes leave the scan: 128 bits of their SHA-256, for which no two lines can be made up.
    lines = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), F.posexplode(_lines(F.col("text"))).alias("_p", "_line"))
    lines = lines.where(F.length("_line") >= min_chars).select("_d", "_t", "_p", F.btrim("_line", F.lit(SPACES)).alias("_k"))
    lines = lines.where(F.length("_k") >= min_chars).select("_d", "_t", "_p", F.sha2(ascii_lower(F.col("_k")), 256).alias("_k"))
    lines = lines.select("_d", "_t", "_p", F.xxhash64("_k").alias("_h1"), F.xxhash64(F.lit(8), "_k").alias("_h2"))
    lines = checkpointed(lines)  # read twice, and far smaller than the texts
    # One row per key and document first, so a line in a third of all documents is counted in parts.
    held = lines.groupBy("_h1", "_h2", "_d").agg(F.lit(1).alias("_one"))
    common = held.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_d").alias("_last")).where(F.col("_n") >= min_docs)
    doomed = lines.join(unplaced(common, "_h1", "_h2"), ["_h1", "_h2"]).where(~F.col("_d").eqNullSafe(F.col("_last")))
    # Repeated rows give the same positions more than once: a set, bounded by the text's own lines.
    doomed = doomed.groupBy("_d", "_t").agg(F.collect_set("_p").alias("_drop"))
    joined = keyed.join(doomed, keyed["doc_id"].eqNullSafe(doomed["_d"]) & (keyed["_t"] == doomed["_t"]), "left")
    joined = joined.select(*(keyed[c] for c in docs.columns), "_drop", _lines(F.col("text")).alias("_every"))
    every, drop = F.col("_every"), F.col("_drop")
    # array_except hashes, so a text of many lines is not searched once for each of them.
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), drop)
    kept = F.when(drop.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.select(*names, kept.alias("text"), F.size(every).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

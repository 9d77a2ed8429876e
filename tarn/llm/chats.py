"""Chat formatting (operator 1): collapse cumulative snapshots, then render.

A log that saves a conversation after every turn holds all its prefixes.  Each turn gets
a hash of its place, role and text; the running XOR of these, on two 64-bit lanes, names
every turn prefix.  Whole conversations whose name is that of a proper prefix of another
are anti-joined away, and equal ones become one, before any text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Turn numbers per piece of a conversation; a long one is counted and hashed piece by piece.
PIECE = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    """One turn in chat markup; ``<|`` within a role or text is set apart so that it can't end the turn."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, and for every turn its place ``pos`` (from 1) and the names ``px, py`` of the prefix that it ends.

    turns: conv, turn, role, key.  Pieces of a conversation are counted and hashed on
    their own and moved by what the pieces before them have, so no task needs to have
    all turns of a conversation.
    """
    t = checkpointed(turns.withColumn("piece", F.floor(F.coalesce("turn", F.lit(-1)) / PIECE)))
    of = Window.partitionBy("conv", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)

    def back(pieces: DataFrame, *columns: str) -> DataFrame:
        return pieces.select(F.col("conv").alias("_c"), F.col("piece").alias("_p"), *columns)

    same = [F.col("conv").eqNullSafe(F.col("_c")), F.col("piece") == F.col("_p")]
    counts = t.groupBy("conv", "piece").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    t = t.withColumn("at", F.row_number().over(of)).join(back(counts, "skip"), same).withColumn("pos", F.col("skip") + F.col("at"))
    t = checkpointed(t.select("conv", "piece", "pos", F.xxhash64("pos", "role", "key").alias("hx"), F.xxhash64(F.lit(1), "key", "role", "pos").alias("hy")))
    xors = t.groupBy("conv", "piece").agg(F.bit_xor("hx").alias("x"), F.bit_xor("hy").alias("y"))
    xors = xors.withColumn("bx", F.coalesce(F.bit_xor("x").over(before), F.lit(0))).withColumn("by", F.coalesce(F.bit_xor("y").over(before), F.lit(0)))
    within = Window.partitionBy("conv", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("x", F.bit_xor("hx").over(within)).withColumn("y", F.bit_xor("hy").over(within)).join(back(xors, "bx", "by"), same)
    return t.select("conv", "pos", F.col("x").bitwiseXOR(F.col("bx")).alias("px"), F.col("y").bitwiseXOR(F.col("by")).alias("py"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered``: a row for each maximal conversation.

    Turns are ordered by turn (null first), then role and the md5 of the text; rows
    that repeat another in all of these are one turn.  Null roles and texts are empty
    strings; rows with a null conv_id are one conversation.  A conversation goes if its
    turns are the first turns of a longer one; of equal ones the smallest conv_id stays
    (null before all), and ``n_copies`` counts them.  Other columns are left out.

    Texts are only hashed until it is known which conversations stay; they are shuffled
    once, to be put together.
    """
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.md5("text"))
    t = checkpointed(_prefixes(rows.select("conv", "turn", "role", F.unhex("key").alias("key")).distinct()))
    ends = checkpointed(t.groupBy("conv").agg(F.max(F.struct("pos", "px", "py")).alias("e")).select("conv", "e.*"))
    whole = ends.groupBy("pos", "px", "py").agg(F.min(F.struct("conv")).alias("c"), F.count("*").alias("n_copies")).select("pos", "px", "py", "c.conv", "n_copies")
    # A prefix is proper if the same conversation goes on after it.
    longest = ends.select(F.col("conv").alias("_c"), F.col("pos").alias("_n"))
    inner = t.join(longest, F.col("conv").eqNullSafe(F.col("_c"))).where(F.col("pos") < F.col("_n")).select("pos", "px", "py").distinct()
    # Joined and grouped by the same two columns without nulls, so the texts are dealt out once.
    named = [F.col("conv").isNull().alias("none"), F.coalesce("conv", F.lit(0).cast(rows.schema["conv"].dataType)).alias("c")]
    kept = whole.join(inner, ["pos", "px", "py"], "left_anti").select(*named, F.col("pos").alias("n_turns"), "n_copies")
    lines = rows.select(*named, F.struct("turn", "role", "key", render_turn(F.col("role"), F.col("text")).alias("line")).alias("l"))
    lines = lines.join(checkpointed(kept), ["none", "c"])
    shown = lines.groupBy("none", "c").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_set("l")).alias("l"))
    return shown.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("l.line"), "").alias("rendered"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP1_SQL = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        '{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10) AS line,
        sha256(role || chr(0) || text) AS h
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
p AS (SELECT *, string_agg(line, '') OVER w AS shown, string_agg(h, '') OVER w AS prefix
      FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY conv_id NULLS FIRST) AS nth,
        count(*) OVER (PARTITION BY prefix) AS n_copies FROM p WHERE pos = n)
SELECT conv_id, n AS n_turns, n_copies, shown AS rendered FROM e
WHERE nth = 1 AND prefix NOT IN (SELECT prefix FROM p WHERE pos < n)
"""

"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes every text to two slots of a fixed bit space and finds the slots hit more than once.
Pass 2 looks every text up: one whose slots were both hit again is possibly repeated, and only these
rows are shuffled and grouped by their full digest; all others are unique and pass straight through.
A filter that fills up lets more rows into the shuffle, never fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import UPPER, ascii_lower, lookup, table
from barloom.session import cut

# The broadcast has at most SLOTS / 64 rows of two numbers (2**25 slots: 524,288 rows, 8 MB).
SLOTS = 2**25


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256`` of the normalised text; null counts as empty."""
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


def repeated_slots(hashed: DataFrame) -> DataFrame:
    """Pass 1: the slots that more than one hash fell on, 64 to a row as a bit mask."""
    slots = hashed.select(F.explode(F.array("p1", "p2")).alias("slot"))
    again = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.groupBy(F.expr("slot div 64").alias("chunk")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("mask"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Equal: identical after lower-casing A-Z; null and empty texts are equal.  The largest id of a group stays; a null
    id stays only in a group without any other.  Rows that repeat an id and text are the same document and share its
    verdict.  Other columns are not read; an empty table gives no rows.
    """
    # One pass over the texts; what follows reads ids and digests only.
    hashed = cut(digests(docs, id_col, text_col))
    hashed = hashed.withColumn("p1", F.pmod(F.xxhash64("text_sha256"), F.lit(slots))).withColumn("p2", F.pmod(F.xxhash64(F.lit(1), "text_sha256"), F.lit(slots)))
    bits = repeated_slots(hashed)
    first = F.broadcast(bits.select(F.col("chunk").alias("c1"), F.col("mask").alias("m1")))
    second = F.broadcast(bits.select(F.col("chunk").alias("c2"), F.col("mask").alias("m2")))
    probed = hashed.join(first, F.expr("p1 div 64 = c1"), "left").join(second, F.expr("p2 div 64 = c2"), "left")
    hit = F.expr("coalesce(getbit(m1, cast(p1 % 64 AS int)) = 1 AND getbit(m2, cast(p2 % 64 AS int)) = 1, false)")
    probed = probed.select("doc_id", "text_sha256", hit.alias("hit"))
    maybe = probed.where("hit").select("doc_id", "text_sha256")
    groups = lookup(maybe, ["text_sha256"], F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = maybe.join(groups, "text_sha256")
    alone = probed.where("NOT hit").select("text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    return grouped.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(COALESCE(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

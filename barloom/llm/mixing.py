"""Mixing of sources to target weights by systematic sampling.

Within a source every document expects ``target / source_size`` copies.  Documents are put in order of
size, the expected copies are summed up in that order, one random offset is added for the source, and a
document is taken once for each integer boundary that its sum crosses.  Since neighbours in the order
have like sizes, the words taken differ from the target by about one large document at most.  Where a
source is small that is still much, so OFFSETS offsets are drawn and the one whose words come nearest is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scale import global_rank
from barloom.llm.common import hex_number, lookup, table, words_expr

# Fixed by the task: weights by rank of the source, repeating, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
OFFSETS = 32


def source_key(col: Column) -> Column:
    """Sources as non-null keys, null last in code point order."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), col))


def id_key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def drawn(key: Column, seed: str, k: int | Column) -> Column:
    """The k-th random offset of a source, from 0 to 1."""
    number = F.lit(str(k)) if isinstance(k, int) else k.cast("string")
    return hex_number(F.md5(F.concat(F.lit(f"{seed}/"), number, F.lit("/"), key)), 1, 13) / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``key, n_docs, source_size`` with ``target``: shares by weight, stopped at ``most`` times the size.

    Sources whose limit is reached first come first when they are in order of limit / weight; the first one
    (and all after it) that stays below its limit gets its share by weight of what the ones before it leave.
    One row for each source: windows over this small table hold no documents.
    """
    by_key = Window.partitionBy(F.lit(0)).orderBy("key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("first", F.sum("n_docs").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(most))
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "key")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    filled = weighed.withColumn("level", left / F.sum("weight").over(onward))
    filled = filled.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("key"), F.col("level")))).over(everything)
    filled = filled.withColumn("open", level)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("open.level") * F.col("weight"))
    return filled.select("key", F.coalesce("first", F.lit(0)).alias("first"), "source_size", target.alias("target"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, with_key: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` for every row; with ``with_key`` also ``id, key``, its never null keys.

    A null text has size 0; a null source is a source of its own, last in order; equal rows take ranks in any
    order, which gives the same rows; an empty table gives no rows; other columns are not read.  Ranks come from
    a range partitioning on (source, size, id), so a source with a third of all rows is spread over many tasks.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), source_key(F.col(f"`{source_col}`")).alias("key"), words_expr(F.col(f"`{text_col}`")).alias("size")
    )
    ranked = global_rank(rows, [F.col("key"), F.col("size"), F.col("doc_id")], "rank")
    sizes = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    joined = ranked.join(targets(sizes), "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("rank") - F.col("first")

    def copies_at(offset: Column) -> Column:
        return F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset)

    # Sums of a source for every offset, one row for each source.
    tried = lookup(
        joined, ["key"], F.first("target").alias("wanted"), *[F.sum(F.col("size") * copies_at(drawn(F.col("key"), seed, k))).alias(f"taken{k}") for k in range(OFFSETS)]
    )
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("wanted")).alias("far"), F.lit(k).alias("k")) for k in range(OFFSETS)]))["k"]
    joined = joined.join(tried.select("key", drawn(F.col("key"), seed, nearest).alias("offset")), "key")
    copies = copies_at(F.col("offset"))
    keys = [id_key(F.col("doc_id")).alias("id"), F.col("key")] if with_key else []
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("bigint").alias("copies"), *keys)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    counts = mix_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS key,
         CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT key, CAST(SUM(size) AS BIGINT) AS source_size,
         [5.0E0, 2.0E0, 1.0E0][(ROW_NUMBER() OVER (ORDER BY key) - 1) % 3 + 1] AS weight
  FROM d GROUP BY key),
f AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY {MOST} * source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT key, source_size,
         CASE WHEN {MOST} * source_size <= level * weight THEN CAST({MOST} * source_size AS DOUBLE)
              ELSE weight * (SELECT MIN_BY(g.level, ({MOST} * g.source_size / g.weight, g.key)) FROM f AS g WHERE {MOST} * g.source_size > g.level * g.weight) END AS target
  FROM f),
r AS (
  SELECT d.key, d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0E0 END AS rate,
         ROW_NUMBER() OVER (PARTITION BY d.key ORDER BY d.size, d.doc_id NULLS FIRST) AS i
  FROM d JOIN t USING (key)),
o AS (SELECT key, k, CAST('0x' || substr(md5('{SEED}/' || k || '/' || key), 1, 13) AS BIGINT) / {float(16**13)!r}::DOUBLE AS u FROM s, range({OFFSETS}) AS n(k)),
b AS (
  SELECT key, ARG_MIN(u, (far, k)) AS u FROM (
    SELECT key, k, u, ABS(SUM(size * (FLOOR(rate * i + u) - FLOOR(rate * (i - 1) + u))) - MAX(target)) AS far FROM r JOIN o USING (key) GROUP BY key, k, u)
  GROUP BY key),
c AS (SELECT *, CAST(FLOOR(rate * i + u) - FLOOR(rate * (i - 1) + u) AS BIGINT) AS copies FROM r JOIN b USING (key))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as the mix takes it (0 to 3 times).

    Rows that agree in id, source and size share the copies that were counted for them evenly.
    """
    counts = mix_counts(docs, id_col, text_col, source_col, seed, with_key=True)
    shared = counts.groupBy("id", "key", "size").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_key(F.col(f"`{id_col}`")).alias("id"),
        source_key(F.col(f"`{source_col}`")).alias("key"), words_expr(F.col(f"`{text_col}`")).alias("size"),
    )
    same = Window.partitionBy("id", "key", "size").orderBy(F.lit(0))
    taken = rows.withColumn("j", F.row_number().over(same)).join(shared, ["id", "key", "size"])
    copies = F.expr("cast((total * j) div n - (total * (j - 1)) div n as int)")
    return taken.withColumn("copies", copies).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")

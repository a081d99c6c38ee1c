"""Exact building blocks for work that must not meet in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut

# Values that hold more than 1/FREQUENT of all rows; there are fewer than FREQUENT of them.
FREQUENT = 1000


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank over the whole table without a single-task sort.

    Rows are range partitioned on the full order, so ties on a hot score still split by the
    trailing id.  The ranges are fixed by a checkpoint; offsets are one row per partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    # ``offsets`` has one row per shuffle partition.
    ranked = placed.withColumn("_rn", inside).join(F.broadcast(offsets), "_pid")
    return ranked.withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_pid", "_off", "_rn")


def value_counts(rows: DataFrame, keys: Sequence[str], total: Column | int) -> DataFrame:
    """Add ``n_same``: how many rows share ``keys``.

    The few frequent keys (each above total/1000, so fewer than 1000 of them per unit of
    total) come back by broadcast; the long tail by a hash join that has no hot key left.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"))
    limit = (F.lit(total) if isinstance(total, int) else total) / F.lit(FREQUENT)
    frequent = counts.where(F.col("n_same") > limit)
    marked = rows.join(F.broadcast(frequent), list(keys), "left")
    hot = marked.where(F.col("n_same").isNotNull())
    cold = marked.where(F.col("n_same").isNull()).drop("n_same")
    tail = cold.join(counts.where(F.col("n_same") <= limit), list(keys))
    return hot.unionByName(tail)


def tiles(
    df: DataFrame,
    group: Sequence[str],
    block_of: Column,
    blocks: int,
    fn: Callable,
    schema: str,
    split: Sequence[str] = (),
) -> DataFrame:
    """All-pairs work as block tiles: ``fn`` sees one block against another, never a row against all.

    A row of block b is sent to the tiles (i, b) as ``_side`` 'r' and (b, j) as 'l' with i <= j,
    so each unordered block pair meets once and a tile holds two blocks.
    """
    df = df.withColumn("_b", block_of)
    sides = F.concat(
        F.transform(F.sequence(F.col("_b"), F.lit(blocks - 1)), lambda j: F.struct(F.col("_b").alias("_i"), j.alias("_j"), F.lit("l").alias("_side"))),
        F.transform(F.sequence(F.lit(0), F.col("_b")), lambda i: F.struct(i.alias("_i"), F.col("_b").alias("_j"), F.lit("r").alias("_side"))),
    )
    spread = df.select(*[c for c in df.columns if c != "_b"], F.inline(sides))
    return spread.groupBy(*group, *split, "_i", "_j").applyInPandas(fn, schema)

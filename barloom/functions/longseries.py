"""Running windows for series of any length: buckets plus a carry tree.

A bar series is bounded by its calendar, so plain windows serve it.  Ticks and event logs are
not: one key may own a third of all rows.  Here the window is partitioned by (key, bucket) and
each bucket receives what came before it from a summary with one row per bucket, so the long series
is spread over as many tasks as it has buckets.  The summary of a hot key is long in turn; it is cut
into blocks of buckets in the same way, so no task holds more rows of a summary than the square root of the buckets.

The width of a bucket follows from the span of positions and the number of shuffle partitions, so a key that
owns everything still fills all partitions alike.  The big side keeps one hash partitioning on (key, bucket): the local
window, the summary and the join with the carries all reuse it; only the summaries move again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, BLOCK = "_bucket", "_block"
# Buckets of the longest key for each shuffle partition: enough for the hash of (key, bucket) to deal them evenly.
PER_PARTITION = 64
# Narrower buckets would cost more in summaries than they spread.
LEAST_WIDTH = 32


def with_bucket(df: DataFrame, position: Column, width: int | None = None) -> DataFrame:
    """Add the bucket of each row and the block of the bucket; ``position`` is the numeric order of a row (sequence number, epoch seconds).

    Without ``width`` one aggregate over the positions finds their span, and the width from it.
    """
    span = df.agg(F.min(position).alias("low"), F.max(position).alias("high")).first()
    low, high = (span["low"] or 0), (span["high"] or 0)
    if width is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        width = max(LEAST_WIDTH, math.ceil((high - low + 1) / (PER_PARTITION * partitions)))
    fan = max(2, math.isqrt(int((high - low) // width) + 1))
    bucket = F.floor((position - F.lit(low)) / F.lit(width)).cast("bigint")
    return df.withColumn(BUCKET, bucket).withColumn(BLOCK, F.floor(F.col(BUCKET) / F.lit(fan)).cast("bigint"))


def plain(df: DataFrame) -> DataFrame:
    """Without the columns of ``with_bucket``."""
    return df.drop(BUCKET, BLOCK)


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "last":
        # newest present value of the bucket
        return F.max_by(value, F.when(value.isNotNull(), order))
    if kind == "prev":
        # value of the newest row, null or not
        return F.max_by(value, order)
    raise ValueError(f"unsupported running aggregate: {kind}")


def _over(kind: str, value: Column, w, whole) -> Column:
    if kind == "prev":
        return F.lag(value).over(whole)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max}[kind](value).over(w)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "prev":
        return F.when(F.col("_first"), carry).otherwise(local)
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def _carries(totals: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """What came before each bucket: along the buckets of its block, and for the block along the blocks."""
    blocks = totals.groupBy(*keys, BLOCK).agg(*[_total(kind, F.col(f"_t_{n}"), F.col(BUCKET)).alias(f"_b_{n}") for n, kind in wanted.items()])
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, BLOCK, *[_over(kind, F.col(f"_b_{n}"), earlier, by_block).alias(f"_o_{n}") for n, kind in wanted.items()])
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(BUCKET)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumns(
        {
            "_first": F.row_number().over(in_block) == 1,
            **{f"_i_{n}": _over(kind, F.col(f"_t_{n}"), before, in_block) for n, kind in wanted.items()},
        }
    )
    met = inner.join(blocks, [*keys, BLOCK])
    return met.select(*keys, BUCKET, *[_combine(kind, F.col(f"_i_{n}"), F.col(f"_o_{n}")).alias(f"_c_{n}") for n, kind in wanted.items()])


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``, ``max``, ``last`` (newest non-null) or ``prev`` (row before) columns.

    ``inclusive=False`` stops at the row before.  A null key is a key like any other only if it is
    replaced before, as the carries are joined by equality.
    """
    k = list(keys)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    end = Window.currentRow if inclusive else -1
    in_bucket = Window.partitionBy(*k, BUCKET).orderBy(*order)
    local_w = in_bucket.rowsBetween(Window.unboundedPreceding, end)
    values = df.withColumns({f"_v_{n}": v for n, (_, v) in wanted.items()})
    totals = values.groupBy(*k, BUCKET).agg(
        F.first(BLOCK).alias(BLOCK), *[_total(kind, F.col(f"_v_{n}"), position).alias(f"_t_{n}") for n, (kind, _) in wanted.items()]
    )
    carries = _carries(totals, k, {n: kind for n, (kind, _) in wanted.items()})
    local = values.withColumns(
        {
            "_first": F.lag(F.lit(1)).over(in_bucket).isNull(),
            **{f"_l_{n}": _over(kind, F.col(f"_v_{n}"), local_w, in_bucket) for n, (kind, _) in wanted.items()},
        }
    )
    out = local.join(carries, [*k, BUCKET]).withColumns(
        {n: _combine(kind, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (kind, _) in wanted.items()}
    )
    return out.drop("_first", *[f"_{p}_{n}" for p in "vlc" for n in wanted])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``prev_<column>`` of the row before, nulls included; null on the first row of a key."""
    return running(df, keys, order, {f"prev_{c}": ("prev", F.col(c)) for c in columns})

"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table (offset and skip from its name).
Shards take turns; in its turn a shard claims the first free slot of its permutation.  The full table
is broadcast, so that a row is placed by one hash and one lookup.  A shard that joins or leaves moves
few slots besides its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import hex_number, md5_number, table, without

SHARDS = 64
# Prime, and over 100 slots a shard, so that shares differ by about one percent at most.
TABLE_SIZE = 8191


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot. ``size`` is a prime, not below the number of shards."""
    if not names or not is_prime(size) or len(names) > size:
        raise ValueError("the table needs a prime size and one to that many shards")
    if len(set(names)) != len(names):
        raise ValueError("shard names repeat")
    position = [md5_number(f"{name}/offset") % size for name in names]
    skip = [md5_number(f"{name}/skip") % (size - 1) + 1 for name in names] if size > 2 else [1] * len(names)
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(names)
        while owner[position[shard]] >= 0:
            position[shard] = (position[shard] + skip[shard]) % size
        owner[position[shard]] = shard
    return owner


def shard_names(shards: int) -> list[str]:
    return [f"shard-{k}" for k in range(shards)]


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key; a null key is placed like an empty one."""
    return F.pmod(hex_number(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), F.lit(size))


def place(df: DataFrame, key: str = "doc_id", names: Sequence[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (the index in ``names``) for every row.

    The broadcast holds ``size`` rows whatever the input.  Rows with equal keys share a shard; null keys
    count as empty; input columns named ``slot`` or ``shard`` are replaced; an empty table stays empty.
    """
    names = shard_names(SHARDS) if names is None else names
    owners = df.sparkSession.createDataFrame(list(enumerate(lookup_table(names, size))), "slot bigint, shard bigint")
    placed = df.withColumn("slot", slot_of(F.col(f"`{key}`"), size)) if key != "slot" else df.withColumn("slot", slot_of(F.col("slot"), size))
    return without(placed, ["shard"]).join(F.broadcast(owners), "slot")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", names: Sequence[str] | None = None, size: int = TABLE_SIZE) -> None:
    """Write one folder ``shard=k`` for each shard.

    Rows are dealt by (shard, hash of the row), in as many parts as the session shuffles, so that a shard is
    written by many tasks and no task holds a shard.
    """
    placed = place(df, key, names, size)
    parts = F.pmod(F.xxhash64(*[c for c in placed.columns if not dict(placed.dtypes)[c].startswith("map")]), F.lit(16))
    placed.repartition(F.col("shard"), parts).write.mode("overwrite").partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    docs = table(spark, sf_dir, "documents")
    return place(docs.select("doc_id")).select("doc_id", "slot", "shard")


OP3_SQL = f"""
WITH RECURSIVE prefs AS (
  SELECT list(CAST('0x' || substr(md5('shard-' || j || '/offset'), 1, 15) AS BIGINT) % {TABLE_SIZE} ORDER BY j) AS offs,
         list(CAST('0x' || substr(md5('shard-' || j || '/skip'), 1, 15) AS BIGINT) % {TABLE_SIZE - 1} + 1 ORDER BY j) AS skips
  FROM range({SHARDS}) AS r(j)),
fill(turn, free, slot) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({TABLE_SIZE}), lambda x: true), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(free[1:pick], [false]), free[pick + 2:]), pick
  FROM (SELECT turn, free,
          list_filter(list_transform(range({TABLE_SIZE}), lambda k: (offs[turn % {SHARDS} + 1] + k * skips[turn % {SHARDS} + 1]) % {TABLE_SIZE}),
            lambda p: free[p + 1])[1] AS pick
        FROM fill, prefs WHERE turn < {TABLE_SIZE})),
owners AS (SELECT slot, (turn - 1) % {SHARDS} AS shard FROM fill WHERE turn > 0)
SELECT doc_id, slot, shard FROM (
  SELECT doc_id, CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
JOIN owners USING (slot)
"""

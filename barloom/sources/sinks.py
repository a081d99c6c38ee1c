"""Write-once, upsert and member tables on Parquet (SNK1-SNK3)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import row_hash, row_json
from barloom.session import cut


def payload_conflicts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK1: incoming rows whose key is stored with another payload, or given twice with two payloads.

    Nulls are values like any other, in keys and in payloads.
    """
    h = row_hash([c for c in incoming.columns if c not in keys])
    old = existing.select(*[F.col(k).alias(f"_k_{k}") for k in keys], h.alias("_old"))
    new = incoming.select(*keys, h.alias("_new"))
    stored = new.join(old, same_key(keys)).where(F.col("_new") != F.col("_old")).select(*keys)
    twice = new.groupBy(*keys).agg(F.count_distinct("_new").alias("_n")).where("_n > 1").select(*keys)
    return stored.unionByName(twice).distinct()


def same_key(keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` with the same keys under ``_k_`` names."""
    return functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK1: rows to append; a row that is stored already is a no-op."""
    old = existing.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    return incoming.dropDuplicates(list(keys)).join(old, same_key(keys), "left_anti")


def append_once(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str]) -> None:
    """SNK1: append to a write-once table; a payload conflict raises before anything is written."""
    existing = spark.read.schema(incoming.schema).parquet(path) if _exists(spark, path) else incoming.limit(0)
    bad = payload_conflicts(existing, incoming, keys).take(1)
    if bad:
        raise ValueError(f"immutable record exists with another payload: {bad[0].asDict()}")
    new_rows(existing, incoming, keys).write.mode("append").parquet(path)


def latest(incoming: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """The row of each key with the greatest ``version``; among equal ones, and without a version, the greatest row.

    An aggregate, so rows of a key are combined before the shuffle.
    """
    first = [F.col(version)] if version else []
    whole = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(first)], row_json(incoming.columns).alias("_json"), F.struct("*").alias("_row"))
    return (
        incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys], whole.alias("_w"))
        .groupBy(*[f"_k_{k}" for k in keys])
        .agg(F.max_by("_w._row", F.struct(*[f"_w._o{k}" for k in range(len(first))], "_w._json")).alias("_row"))
        .select("_row.*")
    )


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """SNK2: incoming rows replace stored ones with the same key; of several for one key the latest counts."""
    new = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    return existing.join(new, same_key(keys), "left_anti").unionByName(latest(incoming, keys, version))


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str, version: str | None = None) -> None:
    """SNK2: rewrite the partitions that incoming rows go to and those that hold their keys now.

    A key that moves to another partition therefore leaves its old one.  The new partitions are written beside
    the table first; a lost executor repeats tasks of that write.
    """
    if not _exists(spark, path):
        latest(incoming, keys, version).write.partitionBy(partition).parquet(path)
        return
    table = spark.read.schema(incoming.schema).parquet(path)
    new = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    held = table.join(new, same_key(keys), "left_semi").select(partition)
    # One row for each partition of the table.
    touched = held.unionByName(incoming.select(partition)).distinct().select(F.col(partition).alias("_p"))
    before = table.join(touched, F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
    merged = cut(upserted(before, incoming, keys, version))
    # A partition all of whose rows moved away is not in the merged rows and has to be emptied.
    left = {r["_p"] for r in touched.join(merged.select(partition).distinct(), F.col("_p").eqNullSafe(F.col(partition)), "left_anti").toLocalIterator()}
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in left:
        _drop_partition(spark, path, partition, value)


def _drop_partition(spark: SparkSession, path: str, partition: str, value: object) -> None:
    """Remove the folder of one partition value."""
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    folder = jvm.org.apache.hadoop.fs.Path(path, escape(partition, None if value is None else str(value)))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def member_rows(portfolios: DataFrame) -> DataFrame:
    """SNK3: portfolios(portfolio_id, members array<struct<strategy_id, weight>>) to ranked rows."""
    return portfolios.select("portfolio_id", F.posexplode("members").alias("rank", "m")).select(
        "portfolio_id", "m.strategy_id", "m.weight", F.col("rank")
    )


def frozen_portfolios(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """SNK3: changed portfolios that already have a run and may not be replaced."""
    return changes.select("portfolio_id").distinct().join(runs.select("portfolio_id"), "portfolio_id", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

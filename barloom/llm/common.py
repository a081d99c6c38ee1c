"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; any path that Spark's Parquet reader opens will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def hex_number(text: Column, first: int, digits: int) -> Column:
    """``digits`` hexadecimal digits of ``text`` from position ``first`` (1-based) as a bigint."""
    return F.conv(F.substring(text, first, digits), 16, 10).cast("bigint")


def md5_number(text: str, digits: int = 15) -> int:
    """The Python twin of ``hex_number(md5(text), 1, digits)``."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:digits], 16)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns whose names an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def words_expr(col: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("bigint")


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def lookup(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row for each key, to be joined back on it.

    The groups carry a hash of their key while they are formed, so they do not lie where a join on the key wants them:
    that join shuffles both sides, and adaptive execution can split a hot key on the other one.
    """
    return df.groupBy(*keys, F.hash(*keys).alias("_spread")).agg(*aggregates).drop("_spread")

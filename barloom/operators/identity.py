"""Content identities and provenance assertions (FP1-FP6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import digest_of, digest_parts, reasons
from barloom.sources.schemas import BAR_COLUMNS

SCHEMA_VERSION = "ohlcv.v1"


def dataset_identity(bars: DataFrame, length: int = 16) -> DataFrame:
    """FP1: version, rows, start and end per symbol."""
    agg = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        *digest_parts(["ts", *BAR_COLUMNS]),
    )
    return agg.select(
        "symbol", F.substring(digest_of(F.col("rows")), 1, length).alias("version"), "rows", "start", "end"
    )


def bundle_identity(
    identities: DataFrame, dataset_id: str, *, source: str = "unspecified", timeframe: str = "1d",
    schema_version: str = SCHEMA_VERSION, length: int = 16,
) -> DataFrame:
    """FP2: one identity over all symbols and the provenance triple."""
    for name, value in (("dataset_id", dataset_id), ("source", source), ("timeframe", timeframe), ("schema_version", schema_version)):
        if not value.strip():
            raise ValueError(f"{name} cannot be empty")
    agg = identities.agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("rows").cast("bigint").alias("rows"),
        F.min("start").alias("start"), F.max("end").alias("end"), *digest_parts(["symbol", "version"]),
    )
    head = [F.lit(v.strip()) for v in (source, timeframe, schema_version)]
    return agg.select(
        F.lit(dataset_id).alias("dataset_id"), F.substring(digest_of(*head, F.col("symbols")), 1, length).alias("version"),
        "symbols", "rows", "start", "end", F.lit(source.strip()).alias("source"),
        F.lit(timeframe.strip()).alias("timeframe"), F.lit(schema_version.strip()).alias("schema_version"),
    )


def frame_fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FP3: fingerprint of values and column types."""
    shape = F.lit(df.schema.json())
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *digest_parts(df.columns))
    return agg.select(*keys, "rows", digest_of(shape, F.col("rows")).alias("fingerprint"))


def changed(stored: DataFrame, actual: DataFrame, key: str = "symbol", value: str = "version") -> DataFrame:
    """Stored against recomputed identity; a missing side never matches."""
    s = stored.select(key, F.col(value).alias("stored"))
    a = actual.select(key, F.col(value).alias("actual"))
    return s.join(a, key, "full_outer").withColumn(
        "matches", F.coalesce(F.col("stored") == F.col("actual"), F.lit(False))
    )


def assertion_problems(asserted: DataFrame, declared: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """FP5: asserted provenance values (null = not asserted) must equal the declared ones."""
    d = declared.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    df = asserted.join(d, key, "left")
    why = reasons(
        *[
            (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_d_{f}")), f"{f} does not match the declared value")
            for f in fields
        ]
    )
    return df.select(key, why.alias("reasons")).where(F.size("reasons") > 0)


def missing(required: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FP6: required rows without a registered counterpart."""
    return required.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")

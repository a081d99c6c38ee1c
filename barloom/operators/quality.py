"""Data-quality rules as one aggregate per table (DQ1-DQ13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import longseries as ls
from barloom.functions.columns import finite, reasons
from barloom.sources.schemas import BAR_COLUMNS


def schema_problems(bars: DataFrame) -> list[str]:
    """DQ1 and DQ5 from the schema alone, so no job runs."""
    out = [f"missing required columns: {c}" for c in BAR_COLUMNS if c not in bars.columns]
    ts = [f for f in bars.schema.fields if f.name == "ts"]
    if not ts or not isinstance(ts[0].dataType, T.TimestampNTZType):
        out.append("market data index must be timezone-naive")
    return out


def table_problems(bars: DataFrame) -> DataFrame:
    """DQ1, DQ2, DQ5 as rows (problem): what the schema lacks, and a table without rows."""
    spark = bars.sparkSession
    found = [(p,) for p in schema_problems(bars)]
    empty = bars.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("market data cannot be empty").alias("problem"))
    return spark.createDataFrame(found, "problem string").unionByName(empty)


def cast_numeric(bars: DataFrame) -> DataFrame:
    """DQ6: try-cast the bar columns and drop the others; ``bad_cast`` counts lost values."""
    bad = sum(
        (F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).cast("int")
        for c in BAR_COLUMNS
    )
    return bars.select(
        "symbol",
        "ts",
        *[F.col(c).cast("string").try_cast("double").alias(c) for c in BAR_COLUMNS],
        bad.alias("bad_cast"),
    )


def _count(test: Column, name: str) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("bigint").alias(name)


def dq_report(bars: DataFrame) -> DataFrame:
    """DQ2, DQ4, DQ7-DQ11 per symbol in two partial aggregations.

    The first level is (symbol, ts), which spreads a hot symbol over its
    timestamps; the second level only adds up counters.
    """
    flags = bars.select(
        "symbol",
        "ts",
        (~F.forall(F.array(*BAR_COLUMNS), finite)).cast("int").alias("not_finite"),
        F.coalesce(F.col("volume") < 0, F.lit(False)).cast("int").alias("neg_volume"),
        F.coalesce(F.col("low") > F.least("open", "close", "high"), F.lit(False)).cast("int").alias("bad_low"),
        F.coalesce(F.col("high") < F.greatest("open", "close", "low"), F.lit(False)).cast("int").alias("bad_high"),
        (~(finite("close") & (F.col("close") > 0))).cast("int").alias("bad_close"),
    )
    per_ts = flags.groupBy("symbol", "ts").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("not_finite", "neg_volume", "bad_low", "bad_high", "bad_close")],
    )
    return per_ts.groupBy("symbol").agg(
        F.sum("n").cast("bigint").alias("rows"),
        _count(F.col("n") > 1, "duplicate_ts"),
        *[
            F.sum(c).cast("bigint").alias(c)
            for c in ("not_finite", "neg_volume", "bad_low", "bad_high", "bad_close")
        ],
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )


def dq_failures(report: DataFrame) -> DataFrame:
    """Symbols whose report breaks a rule, with the rule's message."""
    r = reasons(
        (F.col("duplicate_ts") > 0, "market data index must not contain duplicates"),
        (F.col("not_finite") > 0, "market data contains non-finite values"),
        (F.col("neg_volume") > 0, "volume cannot be negative"),
        (F.col("bad_low") > 0, "low must not exceed OHLC values"),
        (F.col("bad_high") > 0, "high must not be below OHLC values"),
    )
    return report.select("symbol", r.alias("reasons")).where(F.size("reasons") > 0)


def require_valid(bars: DataFrame) -> DataFrame:
    """Fail closed before a run: DQ1-DQ10 must hold for every symbol and the table not be empty."""
    problems = schema_problems(bars)
    if problems:
        raise ValueError("; ".join(problems))
    report = dq_report(bars)
    worst = dq_failures(report).limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0]['symbol']}: {'; '.join(worst[0]['reasons'])}")
    if report.limit(1).count() == 0:
        raise ValueError("market data cannot be empty")
    return bars.select("symbol", "ts", *BAR_COLUMNS)


def out_of_order(rows: DataFrame, position: str = "ingest_pos", width: int | None = None) -> DataFrame:
    """DQ3: rows whose timestamp is before the one ingested just earlier.

    Ingested rows are not bars yet, so nothing bounds a symbol: the lag runs over buckets.
    """
    df = ls.previous(ls.with_bucket(rows, F.col(position), width), ["symbol"], [position], ["ts"])
    return ls.plain(df.where(F.col("ts") < F.col("prev_ts")))


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """DQ12: keys present on one side only; empty means the sets are equal."""
    a = left.select(key).distinct()
    b = right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(
        b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left"))
    )


def ragged_timestamps(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """DQ13: timestamps that some series lack.  One row of totals is joined back."""
    total = bars.agg(F.count_distinct(key).alias("n_series")).withColumn("_one", F.lit(1))
    per_ts = bars.select("ts", key).distinct().groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    # The right side is a single aggregate row, so its size is proven.
    both = per_ts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return both.where(F.col("n") < F.col("n_series")).select("ts", "n", "n_series")

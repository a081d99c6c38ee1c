"""Bars from files, from request lists and from the warehouse tables.

Bars derived from row-level tables are built with ``min_by``/``max_by`` on one
number that packs the order of the rows inside a bar.  A number, unlike a struct,
keeps the aggregation hash based and combines on the map side, so a supplier that
owns a third of all line items costs one partial row per task and day.  A derived
series then has at most one row per symbol and calendar step, which bounds every
later per-series window by the calendar and not by the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.sources.schemas import BAR_COLUMNS, BARS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(*parts: tuple[Column, int]) -> Column:
    """One decimal that orders like the tuple of non-negative integers; each part has a digit budget.

    A value beyond its budget raises an overflow error instead of mixing up the order.
    """
    total = sum(digits for _, digits in parts)
    if total > 38:
        raise ValueError("at most 38 digits can be packed")
    out, below = None, total
    for value, digits in parts:
        below -= digits
        term = value.cast(f"decimal({digits},0)") * F.lit(f"1e{below}").cast(f"decimal({below + 1},0)")
        out = term if out is None else out + term
    return out.cast("decimal(38,0)")


def ohlcv(rows: DataFrame, symbol: Column, ts: Column, price: Column, quantity: Column, position: Column) -> DataFrame:
    """Fold row-level prices to one bar per (symbol, ts); ``position`` orders rows inside a bar."""
    staged = rows.select(
        symbol.alias("symbol"), ts.alias("ts"), price.alias("px"), quantity.alias("qty"), position.alias("pos")
    )
    return staged.groupBy("symbol", "ts").agg(
        F.min_by("px", "pos").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "pos").alias("close"),
        F.sum("qty").alias("volume"),
    )


# Rows of a task that sorts whole series.
TASK_ROWS = 500_000


def in_tasks(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """``rows``, of which there are at most ``most``, dealt by ``keys`` over so many tasks that one has about TASK_ROWS.

    Left to itself Spark sizes a task by its compressed bytes, and a few narrow columns of bars shrink to a small part of what they
    take in the sorts of the indicators.
    """
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-most // TASK_ROWS)), *keys)


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier from line items, ordered inside a day by order, line, part and price.

    The series lie in tasks of a bounded number of bars, so the sorts of the windows over them do not grow with the table.
    """
    items = table(spark, sf_dir, "lineitem")
    bars = ohlcv(
        items,
        F.col("l_suppkey").cast("string"),
        F.col("l_shipdate"),
        F.lit(100.0) + F.col("l_extendedprice") / F.lit(50000.0),
        F.col("l_quantity"),
        packed(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber"), 16),
            (F.col("l_partkey"), 12),
            (F.round(F.col("l_extendedprice") * 100).cast("bigint"), 10),
        ),
    )
    return in_tasks(bars, items.count(), "symbol")


def bars_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority: few, long series."""
    return ohlcv(
        table(spark, sf_dir, "orders"),
        F.col("o_orderpriority"),
        F.col("o_orderdate"),
        F.lit(100.0) + F.col("o_totalprice") / F.lit(100000.0),
        F.lit(1.0),
        F.col("o_orderkey"),
    )


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type, ordered inside an hour by time and id."""
    return ohlcv(
        table(spark, sf_dir, "events"),
        F.col("event_type"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"),
        F.lit(100.0) + F.col("value") / F.lit(100.0),
        F.lit(1.0),
        packed((F.unix_micros(F.col("ts").cast("timestamp")), 18), (F.col("event_id"), 19)),
    )


def read_csv_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """SRC1: CSV whose first column is the date index; explicit types, no inference pass."""
    raw = spark.read.option("header", True).csv(path)
    index = raw.columns[0]
    return raw.select(
        F.lit(symbol).alias("symbol"),
        F.col(index).cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in BAR_COLUMNS],
    )


def read_bars(
    spark: SparkSession, path: str, symbol: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """SRC2: half-open range ``[start, end)`` of one symbol; both filters reach the scan."""
    return clip_range(spark.read.schema(BARS).parquet(path).where(F.col("symbol") == symbol), start, end)


def clip_range(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return bars


def select_requests(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """SRC10: bars named by ``requests(symbol, start, end)``, each with its own half-open range."""
    r = requests.select("symbol", F.col("start").alias("req_start"), F.col("end").alias("req_end"))
    return (
        bars.join(r, "symbol")
        .where(
            (F.col("req_start").isNull() | (F.col("ts") >= F.col("req_start")))
            & (F.col("req_end").isNull() | (F.col("ts") < F.col("req_end")))
        )
        .select(*bars.columns)
    )


def next_bars(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (symbol, start, end) with ``next_ts``: the first bar of the symbol at or after ``start`` (any, if it is null).

    Bars and requests of a symbol are merged in falling order of time, and each request takes the newest bar time that the
    running window has met.  The windows run over buckets of time, so neither the bars nor the requests of a frequent symbol
    meet in one task, and no request is multiplied by bars.
    """
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"
    span = bars.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(F.expr(micros.format("low")).alias("low"), F.expr(micros.format("high")).alias("high")).first()
    if span["low"] is None:
        return requests.withColumn("next_ts", F.lit(None).cast("timestamp_ntz"))
    columns = F.struct(*[F.col(c) for c in requests.columns])
    # Starts outside the bars move to their edge, so buckets need to span no more than the bars.
    start = F.least(F.greatest(F.coalesce(F.expr(micros.format("start")), F.lit(span["low"])), F.lit(span["low"])), F.lit(span["high"] + 1))
    asked = requests.select("symbol", (-start).alias("_at"), F.lit(1).alias("_role"), F.lit(None).cast("timestamp_ntz").alias("_bar"), columns.alias("_row"))
    there = bars.select("symbol", (-F.expr(micros.format("ts"))).alias("_at"), F.lit(0).alias("_role"), F.col("ts").alias("_bar"), F.lit(None).cast(requests.select(columns.alias("r")).schema["r"].dataType).alias("_row"))
    merged = ls.with_bucket(there.unionByName(asked), F.col("_at"))
    met = ls.running(merged, ["symbol"], ["_at", "_role"], {"next_ts": ("last", F.col("_bar"))})
    return met.where("_role = 1").select("_row.*", "next_ts")


def answered(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``found``: whether a bar lies in the half-open range."""
    inside = F.col("next_ts").isNotNull() & (F.col("end").isNull() | (F.col("next_ts") < F.col("end")))
    return next_bars(bars, requests).withColumn("found", inside).drop("next_ts")


def request_problems(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """SRC10 checks: a symbol asked for twice, and one of which no request is answered by a bar."""
    twice = (
        requests.groupBy("symbol").count().where("count > 1")
        .select("symbol", F.lit("duplicate request symbol").alias("reason"))
    )
    empty = answered(bars, requests).groupBy("symbol").agg(F.bool_or("found").alias("found")).where("NOT found")
    return twice.unionByName(empty.select("symbol", F.lit("requested market-data range is empty").alias("reason")))


def load_problems(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """SRC2 checks: (request_id, reason) of requests(request_id, symbol, start, end) that cannot be loaded.

    A symbol without any bar is unknown; one whose half-open range holds none is an empty range.
    """
    seen = bars.groupBy("symbol").agg(F.lit(True).alias("known"))
    r = answered(bars, requests.select("request_id", "symbol", "start", "end"))
    reason = F.when(F.col("known").isNull(), F.concat(F.lit("unknown symbol: "), "symbol")).when(
        ~F.col("found"), F.lit("requested market-data range is empty")
    )
    return r.join(seen, "symbol", "left").select("request_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def inclusive_end(requests: DataFrame, timeframe: str = "1d") -> DataFrame:
    """SRC11: turn an inclusive end into the exclusive one by adding one bar."""
    step = {
        "1m": "INTERVAL 1 MINUTE", "5m": "INTERVAL 5 MINUTES", "15m": "INTERVAL 15 MINUTES",
        "1h": "INTERVAL 1 HOUR", "4h": "INTERVAL 4 HOURS", "1d": "INTERVAL 1 DAY",
    }[timeframe]
    return requests.withColumn("end", F.expr(f"`end` + {step}"))

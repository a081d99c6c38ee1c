"""Normalisers for landed provider payloads (SRC3-SRC9, SRC12).

Input tables hold one landed document per row, so many documents parse in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import digest_of, digest_parts, first_reason
from barloom.sources.bars import clip_range

BAR_STRUCT = "struct<timestamp:string,open:double,high:double,low:double,close:double,volume:double>"
CHART = (
    "chart struct<error:string,result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<"
    "open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>"
)


def daily_csv(raw: DataFrame, symbol: Column, start: str | None = None, end: str | None = None) -> DataFrame:
    """SRC3: headers to lower case, ``date`` to ts, a missing volume to 0, half-open range."""
    df = raw.toDF(*[c.lower() for c in raw.columns])
    if "date" not in df.columns:
        raise ValueError("response contains no date column")
    volume = F.col("volume").cast("double") if "volume" in df.columns else F.lit(0.0)
    bars = df.select(
        symbol.alias("symbol"), F.col("date").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(volume, F.lit(0.0)).alias("volume"),
    )
    return clip_range(bars, start, end)


def chart_json(docs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """SRC4: docs(symbol, payload) with parallel arrays to bars; rows without OHLC are dropped."""
    p = docs.select("symbol", F.from_json("payload", CHART).alias("p"))
    first = p.select("symbol", F.get("p.chart.result", F.lit(0)).alias("r")).select(
        "symbol", F.col("r.timestamp").alias("t"), F.get("r.indicators.quote", F.lit(0)).alias("q")
    )
    rows = first.select("symbol", F.inline(F.arrays_zip("t", "q.open", "q.high", "q.low", "q.close", "q.volume")))
    bars = rows.select(
        "symbol", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume"
    ).dropna(subset=["open", "high", "low", "close"])
    return clip_range(bars, start, end)


def chart_problems(docs: DataFrame) -> DataFrame:
    """Documents that carry an error or no observations."""
    p = docs.select("symbol", F.from_json("payload", CHART).alias("p"))
    r = F.get("p.chart.result", F.lit(0))
    problem = first_reason(
        (F.col("p.chart.error").isNotNull(), F.concat(F.lit("chart error: "), "p.chart.error")),
        (r.isNull(), "response contains no chart data"),
        ((F.coalesce(F.size(r["timestamp"]), F.lit(0)) <= 0) | F.get(r["indicators"]["quote"], F.lit(0)).isNull(),
         "response contains no OHLCV observations"),
    )
    return p.select("symbol", problem.alias("problem")).where(F.col("problem").isNotNull())


# Fixed field names of the daily-series payload.
DAILY_FIELDS = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
SERIES_KEY = "Time Series (Daily)"


def daily_series_json(docs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """SRC5: docs(symbol, payload) with a map date -> fields."""
    doc = F.from_json("payload", f"`{SERIES_KEY}` map<string,map<string,string>>")
    rows = docs.select("symbol", F.explode(doc[SERIES_KEY]).alias("day", "v"))
    bars = rows.select(
        "symbol", F.col("day").cast("timestamp_ntz").alias("ts"),
        *[F.col("v")[k].cast("double").alias(c) for c, k in DAILY_FIELDS.items()],
    )
    return clip_range(bars, start, end)


def daily_series_problems(docs: DataFrame) -> DataFrame:
    """SRC5: documents with an error key or without a series."""
    d = docs.select("symbol", F.from_json("payload", "map<string,string>").alias("m"))
    problem = first_reason(
        (F.col("m")["Error Message"].isNotNull(), F.concat(F.lit("provider error: "), F.col("m")["Error Message"])),
        (F.col("m")["Note"].isNotNull(), F.concat(F.lit("provider rate limit: "), F.col("m")["Note"])),
        (F.col("m")[SERIES_KEY].isNull(), "response contains no daily time series"),
    )
    return d.select("symbol", problem.alias("problem")).where(F.col("problem").isNotNull())


def macro_csv(raw: DataFrame, series_id: str) -> DataFrame:
    """SRC6: ``observation_date`` and the series column; '' and '.' mean missing."""
    if "observation_date" not in raw.columns or series_id not in raw.columns:
        raise ValueError("response does not match the requested series")
    v = F.trim(F.col(series_id).cast("string"))
    return raw.select(
        F.lit(series_id).alias("series_id"), F.col("observation_date").cast("date").alias("date"),
        F.when(~v.isin("", "."), v.cast("double")).alias("value"),
    )


def pad_cik(cik: str | Column) -> Column:
    c = F.col(cik) if isinstance(cik, str) else cik
    return F.lpad(F.regexp_replace(c.cast("string"), r"\D", ""), 10, "0")


def company_facts(docs: DataFrame) -> DataFrame:
    """SRC7: docs(cik, payload): facts tree flattened to one row per reported value."""
    unit = "struct<end:string,val:double,fy:int,fp:string,form:string,filed:string>"
    schema = f"entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<{unit}>>>>>"
    d = docs.select(pad_cik("cik").alias("cik"), F.from_json("payload", schema).alias("p"))
    d = d.select("cik", F.col("p.entityName").alias("entity"), F.explode("p.facts").alias("taxonomy", "concepts"))
    d = d.select("cik", "entity", "taxonomy", F.explode("concepts").alias("concept", "c"))
    d = d.select("cik", "entity", "taxonomy", "concept", F.explode("c.units").alias("unit", "vals"))
    return d.select("cik", "entity", "taxonomy", "concept", "unit", F.inline("vals"))


def news_feed(docs: DataFrame, limit: int = 50) -> DataFrame:
    """SRC8: the first ``limit`` items of every feed, in feed order."""
    if limit < 1 or limit > 200:
        raise ValueError("limit must be between 1 and 200")
    item = "struct<title:string,url:string,time_published:string,overall_sentiment_score:double>"
    d = docs.select("feed_id", F.from_json("payload", f"feed array<{item}>").alias("p"))
    return d.select("feed_id", F.posexplode(F.slice("p.feed", 1, limit)).alias("position", "i")).select(
        "feed_id", "position", "i.*"
    )


def posted_bars(docs: DataFrame) -> DataFrame:
    """SRC9: docs(payload) mapping a strategy id to an array of bars; a missing volume is 0."""
    d = docs.select(F.explode(F.from_json("payload", f"map<string,array<{BAR_STRUCT}>>")).alias("symbol", "bars"))
    d = d.select("symbol", F.inline("bars"))
    return d.select(
        "symbol", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close",
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )


def envelope(df: DataFrame, source: str, dataset: str, payload: Column, fetched_at: Column) -> DataFrame:
    """One row per external document with a content fingerprint."""
    out = df.select(
        F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), fetched_at.cast("string").alias("fetched_at"),
        payload.cast("string").alias("payload"),
    )
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "source", "dataset", "payload"), 256))


def snapshot_manifest(envelopes: DataFrame, group: str) -> DataFrame:
    """SRC12: one fingerprint per snapshot over the distinct fingerprints of its components.

    The digest does not depend on order, so a snapshot of any size is a plain aggregate.
    """
    agg = envelopes.select(group, "dataset", "fingerprint").distinct().groupBy(group).agg(
        F.count(F.lit(1)).alias("components"),
        F.sum(F.when(F.col("dataset") == "daily_ohlcv", 1).otherwise(0)).alias("markets"),
        *digest_parts(["dataset", "fingerprint"]),
    )
    return agg.select(
        group, "components", "markets", digest_of("components").alias("snapshot_fingerprint"), (F.col("markets") >= 1).alias("valid"),
    )

"""Registered queries: bars, quality, indicators, rules, backtests and metrics."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import indicators as ind
from barloom.operators import metrics, quality, rules
from barloom.operators.specs import demo_records
from barloom.session import checkpoint_dir
from barloom.sources import bars as src

KEYS = ["strategy_id", "symbol"]
TREND = demo_records()[0]


def snap(c: str | Column, digits: int) -> Column:
    """Cut to ``digits`` decimals away from decimal ties, where two engines may round apart."""
    scale = 10.0**digits
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value * F.lit(scale) + F.lit(0.4142135)) / F.lit(scale)


def r6(c: str | Column) -> Column:
    return snap(c, 6)


def r2(c: str | Column) -> Column:
    """Money: two digits."""
    return snap(c, 2)


def stamp(c: str | Column = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def trend_backtest(bars: DataFrame, record: dict = TREND) -> DataFrame:
    flags = rules.compiled_signals(bars, [record])
    held = flags.withColumn("signal", rules.hold_state("entry", "exit", KEYS))
    return bt.backtest_bars(held, KEYS)


def sma_cross_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = bt.summary(trend_backtest(src.bars_supplier(spark, sf)), KEYS)
    return s.select(
        "symbol", "bars", "entries", r6("total_return").alias("total_return"),
        r6("max_drawdown").alias("max_drawdown"), r6("sharpe").alias("sharpe"), r6("cagr").alias("cagr"),
    )


def bars_query(maker):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return maker(spark, sf).select(
            "symbol", stamp().alias("ts"), *src.BAR_COLUMNS
        )

    return run


def dq_report(spark: SparkSession, sf: str) -> DataFrame:
    rep = quality.dq_report(src.bars_supplier(spark, sf))
    return rep.withColumns({"start": stamp("start"), "end": stamp("end")})


def dq_raw_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The same rules over line items read as bars: duplicates and broken ranges are expected."""
    rows = src.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("open"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("high"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("low"), F.col("l_extendedprice").alias("close"),
        F.col("l_quantity").alias("volume"),
    )
    fails = quality.dq_failures(quality.dq_report(rows))
    return fails.select("symbol", F.array_join("reasons", "; ").alias("reasons"))


def table_problems(spark: SparkSession, sf: str) -> DataFrame:
    """DQ1, DQ2, DQ5: a good table, one without volume, one with zoned time, one without rows."""
    good = src.bars_event(spark, sf)
    cases = {
        "good": good, "narrow": good.drop("volume", "high"), "zoned": good.withColumn("ts", F.col("ts").cast("timestamp")),
        "empty": good.where(F.col("volume") < 0),
    }
    parts = [quality.table_problems(df).select(F.lit(name).alias("case"), "problem") for name, df in cases.items()]
    sizes = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("case"), F.concat(F.lit("rows: "), F.col("n").cast("string")).alias("problem")) for name, df in cases.items()]
    return functools.reduce(DataFrame.unionByName, parts + sizes)


def config_problems(spark: SparkSession, sf: str) -> DataFrame:
    """BT10 over configurations read from parts."""
    configs = src.table(spark, sf, "part").select(
        F.col("p_partkey").alias("config"), (F.col("p_retailprice") - 1200.0).alias("initial_cash"),
        (F.col("p_size") - 3.0).alias("commission_bps"), (F.col("p_size") % 7 - 1.0).alias("slippage_bps"),
    )
    return bt.config_problems(configs).select("config", F.array_join("reasons", "; ").alias("reasons"))


def stored_bars(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1 and SRC2: bars written as CSV and Parquet and read back, whole and for a range of one symbol."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    bars = src.bars_priority(spark, sf)
    bars.write.parquet(f"{folder}/parquet")
    rows = spark.read.schema(src.BARS).parquet(f"{folder}/parquet")
    urgent = rows.where(F.col("symbol") == "1-URGENT").drop("symbol")
    urgent.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), *src.BAR_COLUMNS).write.option("header", True).csv(f"{folder}/csv")
    loaded = {
        "csv": src.read_csv_bars(spark, f"{folder}/csv", "1-URGENT"),
        "range": src.read_bars(spark, f"{folder}/parquet", "2-HIGH", "1995-01-01", "1996-01-01"),
        "open range": src.read_bars(spark, f"{folder}/parquet", "5-LOW", "1997-06-01"),
    }
    parts = [
        df.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("bars"), r2(F.sum("close")).alias("close_sum"), r2(F.sum("volume")).alias("volume_sum"),
            stamp(F.min("ts")).alias("first_ts"), stamp(F.max("ts")).alias("last_ts"),
        ).withColumn("source", F.lit(name))
        for name, df in loaded.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def load_problems(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2 checks: one request for each customer, some for unknown symbols or empty ranges."""
    k = F.col("c_custkey")
    start = F.when(k % 5 == 0, F.lit("2030-01-01")).when(k % 3 == 0, F.lit("1995-01-01")).cast("timestamp_ntz")
    suppliers = src.table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    requests = src.table(spark, sf, "customer").join(F.broadcast(suppliers), F.lit(True)).select(  # one row
        k.alias("request_id"), (k % (F.col("n") + 20)).cast("string").alias("symbol"), start.alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"),
    )
    return src.load_problems(src.bars_supplier(spark, sf), requests)


def ema_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = src.bars_priority(spark, sf)
    for p in (2, 10, 30):
        b = ind.with_ema(b, ["symbol"], "close", p, f"ema{p}")
    return b.select("symbol", stamp().alias("ts"), *[r6(f"ema{p}").alias(f"ema{p}") for p in (2, 10, 30)])


def rsi_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = src.bars_priority(spark, sf)
    for p in (5, 14):
        b = ind.with_rsi(b, ["symbol"], "close", p, f"rsi{p}")
    return b.select("symbol", stamp().alias("ts"), r6("rsi5").alias("rsi5"), r6("rsi14").alias("rsi14"))


def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    b = src.bars_supplier(spark, sf)
    return b.select(
        "symbol", stamp().alias("ts"),
        r6(ind.sma("close", ["symbol"], 5)).alias("sma5"),
        r6(ind.sma("close", ["symbol"], 20)).alias("sma20"),
        r6(ind.rolling_std("close", ["symbol"], 20)).alias("std20"),
    )


def rule_record(comparator: str, right) -> dict:
    from barloom.operators.specs import spec

    return spec(comparator, [("mean", "sma", 5)], [("close", comparator, right)], [("close", "<", 0.0)])


def signal_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All seven comparators against an average, plus constants and an ALL/ANY mix."""
    from barloom.operators.specs import spec

    records = [rule_record(c, "mean") for c in (">", ">=", "<", "<=", "==", "crosses_above", "crosses_below")]
    records += [
        spec("const_above", [], [("close", "crosses_above", 100.5)], [("close", "crosses_below", 100.5)]),
        spec("mixed", [("mean", "sma", 5)], [("close", ">", "mean")], [("close", "<", "open")],
             entry_any=[("volume", ">=", 2.0), ("high", ">", 101.0)]),
    ]
    flags = rules.compiled_signals(src.bars_event(spark, sf), records)
    return flags.groupBy("strategy_id", "symbol").agg(
        F.sum(F.when(F.col("entry"), 1).otherwise(0)).cast("bigint").alias("entries"),
        F.sum(F.when(F.col("exit"), 1).otherwise(0)).cast("bigint").alias("exits"),
        F.count(F.lit(1)).alias("bars"),
    )


def held_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Entry above 100.4, exit below 100.6: both flags are set inside the band."""
    b = src.bars_event(spark, sf)
    return b.select(
        "symbol", "ts", (F.col("close") > 100.4).alias("entry"), (F.col("close") < 100.6).alias("exit")
    )


def hold_positions(spark: SparkSession, sf: str) -> DataFrame:
    f = held_flags(spark, sf)
    return f.select("symbol", stamp().alias("ts"), rules.hold_state("entry", "exit", ["symbol"]).alias("held"))


def toggle_positions(spark: SparkSession, sf: str) -> DataFrame:
    f = rules.toggle_state(held_flags(spark, sf), ["symbol"])
    return f.select("symbol", stamp().alias("ts"), "held")


def backtest_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = trend_backtest(src.bars_supplier(spark, sf))
    return b.select(
        "symbol", stamp().alias("ts"), "target", r6("net_ret").alias("net_ret"),
        r2("equity").alias("equity"), r6("drawdown").alias("drawdown"),
    )


def trend_moves(spark: SparkSession, sf: str) -> DataFrame:
    flags = rules.compiled_signals(src.bars_supplier(spark, sf), [TREND])
    held = flags.withColumn("signal", rules.hold_state("entry", "exit", KEYS))
    return bt.with_moves(held, KEYS)


def trade_events(spark: SparkSession, sf: str) -> DataFrame:
    return bt.trade_events(trend_moves(spark, sf), KEYS).select("symbol", stamp().alias("ts"), "action")


def backtest_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = bt.closed_trades(trend_moves(spark, sf), KEYS)
    return t.select(
        "symbol", "trade_id", stamp("entry_ts").alias("entry_ts"), stamp("exit_ts").alias("exit_ts"),
        r6("entry_px").alias("entry_px"), r6("exit_px").alias("exit_px"), r6("trade_return").alias("trade_return"),
    )


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    r = bt.reconcile(trend_backtest(src.bars_supplier(spark, sf)), KEYS)
    return r.select("symbol", "passed", F.array_join("reasons", "; ").alias("reasons"))


def equity_validation(spark: SparkSession, sf: str) -> DataFrame:
    """MT4 and MT5 for a losing and a winning rule."""
    flags = rules.compiled_signals(src.bars_supplier(spark, sf), [TREND, demo_records()[4]])
    held = flags.withColumn("signal", rules.hold_state("entry", "exit", KEYS))
    s = bt.summary(bt.backtest_bars(held, KEYS), KEYS)
    v = metrics.fitness(metrics.validation(s))
    return v.select(
        "strategy_id", "symbol", r6("sharpe").alias("sharpe"), r6("max_drawdown").alias("max_drawdown"),
        "valid", F.array_join("valid_reasons", "; ").alias("reasons"), r6("fitness").alias("fitness"), "eligible",
    )


def monthly_equity(spark: SparkSession, sf: str) -> DataFrame:
    """Equity of the losing rule cut into months: (symbol, month, ts, equity)."""
    b = trend_backtest(src.bars_supplier(spark, sf))
    return b.select("symbol", F.date_format("ts", "yyyy-MM").alias("month"), "ts", "equity")


def degradation(spark: SparkSession, sf: str) -> DataFrame:
    b = trend_backtest(src.bars_supplier(spark, sf)).select("symbol", "ts", "equity")
    d = metrics.feedback_decision(metrics.degradation(b, ["symbol"], min_return=-0.08))
    return d.select(
        "symbol", "observations", r6("total_return").alias("total_return"),
        r6("max_drawdown").alias("max_drawdown"), r6("volatility").alias("volatility"),
        "degraded", "state", "action", "reason",
    )


def paper_qualification(spark: SparkSession, sf: str) -> DataFrame:
    flags = rules.compiled_signals(src.bars_supplier(spark, sf), [TREND, demo_records()[4]])
    held = flags.withColumn("signal", rules.hold_state("entry", "exit", KEYS))
    b = bt.backtest_bars(held, KEYS)
    stages = b.select(*KEYS).distinct().withColumn(
        "stage", F.when(F.col("symbol").endswith("7"), "research").otherwise("paper")
    )
    q = metrics.qualification(b.select(*KEYS, "ts", "equity"), stages, KEYS)
    return q.select(
        *KEYS, "observations", r6("total_return").alias("total_return"), "decision",
        F.array_join("reasons", "; ").alias("reasons"),
    )


def ingest_order(spark: SparkSession, sf: str) -> DataFrame:
    """DQ3 on orders in key order, per priority: one symbol may own most of them."""
    rows = src.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ingest_pos")
    )
    late = quality.out_of_order(rows)
    return late.select("symbol", "ingest_pos", stamp("ts").alias("ts"), stamp("prev_ts").alias("prev_ts"))


def numeric_cast(spark: SparkSession, sf: str) -> DataFrame:
    """DQ6 on text prices, some of which are not numbers."""
    k = F.col("o_orderkey")
    text = F.when(k % 50 == 3, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    rows = src.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), text.alias("open"), text.alias("high"),
        F.col("o_totalprice").alias("low"), F.when(k % 70 == 1, "").otherwise("1.5").alias("close"), F.lit(1).alias("volume"), "o_custkey",
    )
    c = quality.cast_numeric(rows)
    return c.groupBy("symbol").agg(
        F.sum("bad_cast").cast("bigint").alias("bad_cast"), F.count("open").alias("opens"), F.max("close").alias("close")
    )


def ragged_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    r = quality.ragged_timestamps(src.bars_event(spark, sf))
    return r.select(stamp("ts").alias("ts"), "n", "n_series")


def key_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """DQ12: customers against the customers that have a high-priority order."""
    a = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    b = src.table(spark, sf, "orders").where(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_custkey").alias("key"))
    return quality.key_mismatch(a, b, "key")


QUERIES = {
    "sma_cross_summary": sma_cross_summary,
    "bars_supplier": bars_query(src.bars_supplier),
    "bars_priority": bars_query(src.bars_priority),
    "bars_event": bars_query(src.bars_event),
    "dq_report": dq_report,
    "table_problems": table_problems,
    "config_problems": config_problems,
    "stored_bars": stored_bars,
    "load_problems": load_problems,
    "dq_raw_prices": dq_raw_prices,
    "ingest_order": ingest_order,
    "numeric_cast": numeric_cast,
    "ragged_timestamps": ragged_timestamps,
    "key_mismatch": key_mismatch,
    "rolling_stats": rolling_stats,
    "ema_bars": ema_bars,
    "rsi_bars": rsi_bars,
    "signal_rules": signal_rules,
    "hold_positions": hold_positions,
    "toggle_positions": toggle_positions,
    "backtest_bars": backtest_bars,
    "trade_events": trade_events,
    "backtest_trades": backtest_trades,
    "reconcile": reconcile,
    "equity_validation": equity_validation,
    "degradation": degradation,
    "paper_qualification": paper_qualification,
}

"""Back-test of tick series whose length nothing bounds (W6-W8, BT1-BT6 on buckets)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.operators.backtest import CASH, COMMISSION_BPS, SLIPPAGE_BPS, check_config, friction_rate


def tick_backtest(
    ticks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    max_position: float = 0.25,
    cash: float = CASH,
    commission_bps: float = COMMISSION_BPS,
    slippage_bps: float = SLIPPAGE_BPS,
) -> DataFrame:
    """Hold state, next-tick position, net return, equity and drawdown of bucketed ticks.

    ``ticks``: keys, order columns, close, entry, exit and the bucket column.
    """
    check_config(cash, commission_bps, slippage_bps)
    event = F.when(F.col("entry"), True).when(F.col("exit"), False)
    df = ls.running(ticks, keys, order, {"signal": ("last", event)})
    df = df.withColumn("signal", F.coalesce("signal", F.lit(False)))
    df = ls.previous(df, keys, order, ["signal", "close"])
    df = df.withColumn("target", F.coalesce("prev_signal", F.lit(False)))
    df = ls.previous(df, keys, order, ["target"])
    df = df.withColumn("prev_target", F.coalesce("prev_target", F.lit(False)))
    position = F.when(F.col("target"), F.lit(max_position)).otherwise(0.0)
    before = F.when(F.col("prev_target"), F.lit(max_position)).otherwise(0.0)
    move = F.coalesce(F.col("close") / F.col("prev_close") - 1.0, F.lit(0.0))
    rate = friction_rate(commission_bps, slippage_bps)
    df = df.withColumn("net_ret", move * position - F.abs(position - before) * F.lit(rate))
    df = ls.running(df, keys, order, {"_log": ("sum", F.log1p("net_ret"))})
    df = df.withColumn("equity", F.lit(cash) * F.exp("_log")).drop("_log")
    df = ls.running(df, keys, order, {"peak": ("max", F.col("equity"))})
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)

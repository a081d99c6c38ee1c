"""Long-only backtest as window expressions over run keys (BT1-BT11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import finite, reasons, running, series

CASH = 100_000.0
COMMISSION_BPS = 1.0
SLIPPAGE_BPS = 2.0


def check_config(cash: float, commission_bps: float, slippage_bps: float) -> None:
    """BT10: argument rules."""
    if cash <= 0:
        raise ValueError("initial_cash must be positive")
    if commission_bps < 0 or slippage_bps < 0:
        raise ValueError("transaction costs cannot be negative")


def config_problems(configs: DataFrame) -> DataFrame:
    """BT10 over a table of configurations (initial_cash, commission_bps, slippage_bps): all columns and ``reasons``."""
    why = reasons(
        (F.col("initial_cash") <= 0, "initial_cash must be positive"),
        ((F.col("commission_bps") < 0) | (F.col("slippage_bps") < 0), "transaction costs cannot be negative"),
    )
    return configs.withColumn("reasons", why).where(F.size("reasons") > 0)


def with_moves(df: DataFrame, keys: Sequence[str], signal: str = "signal", order: str = "ts") -> DataFrame:
    """BT1-BT4: next-bar target, its predecessor, gross return and turnover.

    ``target`` is the signal of the bar before and ``prev_target`` of the bar before
    that, so all of them come from one pass over one sort.
    """
    w = series(keys, order)
    df = df.withColumns(
        {
            "target": F.coalesce(F.lag(signal, 1).over(w), F.lit(False)),
            "prev_target": F.coalesce(F.lag(signal, 2).over(w), F.lit(False)),
            "prev_close": F.lag("close").over(w),
        }
    )
    position = F.when(F.col("target"), F.col("max_position")).otherwise(0.0)
    before = F.when(F.col("prev_target"), F.col("max_position")).otherwise(0.0)
    move = F.coalesce(F.col("close") / F.col("prev_close") - 1.0, F.lit(0.0))
    return df.withColumns(
        {"position": position, "gross_ret": move * position, "turnover": F.abs(position - before)}
    )


def friction_rate(commission_bps: float, slippage_bps: float) -> float:
    return (commission_bps + slippage_bps) / 10_000.0


def backtest_bars(
    df: DataFrame,
    keys: Sequence[str],
    signal: str = "signal",
    *,
    cash: float = CASH,
    commission_bps: float = COMMISSION_BPS,
    slippage_bps: float = SLIPPAGE_BPS,
    order: str = "ts",
) -> DataFrame:
    """BT5, BT6: per-bar net return, equity and drawdown."""
    check_config(cash, commission_bps, slippage_bps)
    df = with_moves(df, keys, signal, order)
    df = df.withColumn("friction", F.col("turnover") * F.lit(friction_rate(commission_bps, slippage_bps)))
    df = df.withColumn("net_ret", F.col("gross_ret") - F.col("friction"))
    return with_equity(df, keys, "net_ret", cash=cash, order=order)


def with_equity(
    df: DataFrame, keys: Sequence[str], ret: str, *, cash: float = 1.0, order: str = "ts"
) -> DataFrame:
    """W6, W7: running product, running peak and drawdown."""
    w = running(keys, order)
    df = df.withColumn("equity", F.lit(cash) * F.exp(F.sum(F.log1p(ret)).over(w)))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1.0)


def side_by_side(
    flags: DataFrame, caps: Sequence[float], keys: Sequence[str], *, hold: bool = True, equity: bool = True, cash: float = CASH,
    commission_bps: float = COMMISSION_BPS, slippage_bps: float = SLIPPAGE_BPS, order: str = "ts",
) -> DataFrame:
    """BT1-BT6 for a short list of specs: one row per bar, the columns of the n-th spec end in ``_n``.

    ``flags`` as by ``rules.compiled_flags``; ``caps`` are the specs' largest positions.  All specs share the sort that served the
    indicators, so no row is copied for a spec nor shuffled again.  Without ``hold`` the entry flag alone is the position.
    """
    from barloom.operators.rules import hold_state

    check_config(cash, commission_bps, slippage_bps)
    every = range(len(caps))
    w, until = series(keys, order), running(keys, order)

    def state(n: int, back: int) -> Column:
        if hold:
            return hold_state(f"entry_{n}", f"exit_{n}", keys, order, back)
        return F.coalesce(F.lag(f"entry_{n}", back).over(w), F.lit(False)) if back else F.col(f"entry_{n}")

    # The state of a bar before is the hold state of a shorter frame, so signal, target and its predecessor come from one pass.
    states = {f"{name}_{n}": state(n, k) for n in every for k, name in enumerate(("signal", "target", "prev_target"))}
    df = flags.withColumns({"prev_close": F.lag("close").over(w), **states})
    df = df.drop(*[f"{side}_{n}" for n in every for side in ("entry", "exit")])
    move = F.coalesce(F.col("close") / F.col("prev_close") - 1.0, F.lit(0.0))
    rate = F.lit(friction_rate(commission_bps, slippage_bps))
    own: dict[str, Column] = {}
    for n, cap in enumerate(caps):
        position = F.when(F.col(f"target_{n}"), F.lit(cap)).otherwise(0.0)
        before = F.when(F.col(f"prev_target_{n}"), F.lit(cap)).otherwise(0.0)
        gross, turnover = move * position, F.abs(position - before)
        own |= {f"position_{n}": position, f"gross_ret_{n}": gross, f"turnover_{n}": turnover, f"friction_{n}": turnover * rate, f"net_ret_{n}": gross - turnover * rate}
    if equity:
        # Only flags and logarithms pass through the windows of the curve; the highest equity is that of the highest logarithm.
        df = df.withColumns({f"log_equity_{n}": F.sum(F.log1p(own[f"net_ret_{n}"])).over(until) for n in every})
        df = df.withColumns({f"log_peak_{n}": F.max(f"log_equity_{n}").over(until) for n in every})
        for n in every:
            now, peak = (F.lit(cash) * F.exp(f"log_{c}_{n}") for c in ("equity", "peak"))
            own |= {f"equity_{n}": now, f"drawdown_{n}": now / peak - 1.0}
    return df.withColumns(own)


def one_under_another(wide: DataFrame, names: Sequence[str], caps: Sequence[float], shared: Sequence[str]) -> DataFrame:
    """Rows (strategy_id, ``shared``, max_position and the columns of a spec) of ``side_by_side``."""
    own = [c.removesuffix("_0") for c in wide.columns if c.endswith("_0")]
    rows = [
        F.struct(F.lit(name).alias("strategy_id"), F.lit(cap).alias("max_position"), *[F.col(f"{c}_{n}").alias(c) for c in own])
        for n, (name, cap) in enumerate(zip(names, caps, strict=True))
    ]
    return wide.select(*shared, F.inline(F.array(*rows)))


def trade_events(moves: DataFrame, keys: Sequence[str], order: str = "ts") -> DataFrame:
    """BT7: a buy or a sell wherever the target changes."""
    return moves.where(F.col("target") != F.col("prev_target")).select(
        *keys, order, F.when(F.col("target"), "buy").otherwise("sell").alias("action"), "close"
    )


def closed_trades(
    moves: DataFrame,
    keys: Sequence[str],
    *,
    commission_bps: float = COMMISSION_BPS,
    slippage_bps: float = SLIPPAGE_BPS,
    order: str = "ts",
) -> DataFrame:
    """BT8: one row per closed trade; the round-trip cost is not scaled by position."""
    w = running(keys, order)
    opened = F.col("target") & ~F.col("prev_target")
    df = moves.withColumns(
        {
            "entry": F.last(
                F.when(opened, F.struct(F.col(order).alias("ts"), F.col("close").alias("px"))), True
            ).over(w),
            "trade_id": F.sum(F.when(opened, 1).otherwise(0)).over(w),
        }
    )
    cost = 2.0 * friction_rate(commission_bps, slippage_bps)
    return df.where(~F.col("target") & F.col("prev_target")).select(
        *keys,
        "trade_id",
        F.col("entry.ts").alias("entry_ts"),
        F.col(order).alias("exit_ts"),
        F.col("entry.px").alias("entry_px"),
        F.col("close").alias("exit_px"),
        ((F.col("close") / F.col("entry.px") - 1.0) * F.col("max_position") - F.lit(cost)).alias(
            "trade_return"
        ),
    )


def summary(bars: DataFrame, keys: Sequence[str], *, cash: float = CASH, order: str = "ts") -> DataFrame:
    """BT9 and MT1-MT3 in one aggregate over backtest rows.

    The window exchange already clusters by ``keys``, so no further shuffle is needed.
    """
    from barloom.operators.metrics import equity_metrics

    return equity_metrics(bars, keys, cash=cash, order=order)


def reconcile(
    bars: DataFrame, keys: Sequence[str], *, tolerance: float = 1e-9, order: str = "ts"
) -> DataFrame:
    """BT11: rebuild equity from returns and compare.

    The rebuilt curve multiplies the returns directly (``product``), the stored one
    sums logarithms, so the tolerance is relative.
    """
    w = running(keys, order)
    first = F.first("equity").over(w)
    rebuilt = bars.withColumn("rebuilt", F.product(F.lit(1.0) + F.col("net_ret")).over(w) * first)
    error = F.abs(F.col("rebuilt") / F.col("equity") - 1.0)
    agg = rebuilt.groupBy(*keys).agg(
        F.max(error).alias("max_error"),
        F.bool_and(finite("equity")).alias("finite_equity"),
        F.bool_and(finite("net_ret")).alias("finite_returns"),
        F.bool_and(F.col("equity") > 0).alias("positive"),
        F.bool_and(F.col("net_ret") > -1).alias("bounded"),
    )
    why = reasons(
        (~F.col("finite_equity"), "equity must contain only finite values"),
        (~F.col("finite_returns"), "returns must contain only finite values"),
        (~F.col("positive"), "equity must remain positive"),
        (~F.col("bounded"), "simple returns must be greater than -100%"),
        (F.col("max_error") > tolerance, "equity reconciliation error exceeds tolerance"),
    )
    return agg.select(*keys, "max_error", why.alias("reasons")).withColumn(
        "passed", F.size("reasons") == 0
    )


def scenario_rates(commission_bps: float = COMMISSION_BPS, slippage_bps: float = SLIPPAGE_BPS) -> dict[str, float]:
    """RB1: cost scenarios as per-unit-turnover rates."""
    return {
        "baseline": friction_rate(commission_bps, slippage_bps),
        "cost_2x": friction_rate(2 * commission_bps, slippage_bps),
        "slippage_2x": friction_rate(commission_bps, 2 * slippage_bps),
        "cost_slippage_2x": friction_rate(2 * commission_bps, 2 * slippage_bps),
    }


def final_equity(rate: float, cash: float = CASH, gross: str = "gross_ret", turnover: str = "turnover") -> Column:
    """Final equity under one cost rate as an aggregate over ``with_moves`` rows."""
    return F.lit(cash) * F.exp(F.sum(F.log1p(F.col(gross) - F.col(turnover) * F.lit(rate))))

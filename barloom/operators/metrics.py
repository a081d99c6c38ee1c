"""Equity metrics, validation, fitness, degradation and qualification (MT1-MT9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import finite, ratio, reasons, running, series

PERIODS = 252


def returns_of(equity: DataFrame, keys: Sequence[str], order: str = "ts") -> DataFrame:
    """W4: simple returns of an equity column, null on the first row."""
    return equity.withColumn(
        "ret", ratio(F.col("equity"), F.lag("equity").over(series(keys, order))) - 1.0
    )


def sharpe(ret: str | Column) -> Column:
    """MT2 as an aggregate over the non-null returns."""
    sd = F.stddev_samp(ret)
    return F.when((F.count(ret) < 2) | (sd == 0), F.lit(0.0)).otherwise(
        F.lit(float(PERIODS) ** 0.5) * F.avg(ret) / F.when(sd != 0, sd)
    )


def equity_metrics(
    bars: DataFrame, keys: Sequence[str], *, cash: float | None = None, order: str = "ts"
) -> DataFrame:
    """MT1-MT3 and BT9 from backtest rows (net_ret, equity, drawdown).

    The first net return is dropped as ``pct_change`` would: it is marked by the
    missing previous close.
    """
    ret = F.when(F.col("prev_close").isNotNull(), F.col("net_ret"))
    agg = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by("equity", order).alias("first_equity"),
        F.max_by("equity", order).alias("last_equity"),
        F.min("drawdown").alias("max_drawdown"),
        sharpe(ret).alias("sharpe"),
        F.coalesce(F.stddev_samp(ret), F.lit(0.0)).alias("volatility"),
        F.sum(F.when(F.col("target") & ~F.col("prev_target"), 1).otherwise(0)).cast("bigint").alias("entries"),
    )
    base = F.lit(cash) if cash is not None else F.col("first_equity")
    years = (F.col("bars") - 1) / F.lit(float(PERIODS))
    return agg.withColumns(
        {
            "total_return": F.col("last_equity") / base - 1.0,
            "cagr": F.when((F.col("bars") < 2) | (F.col("first_equity") <= 0), F.lit(0.0)).otherwise(
                F.pow(F.col("last_equity") / F.col("first_equity"), ratio(F.lit(1.0), years)) - 1.0
            ),
        }
    )


def validation(metrics: DataFrame, min_sharpe: float = 0.5, max_drawdown: float = 0.25) -> DataFrame:
    """MT4: gates on Sharpe and absolute drawdown, with reasons; fails closed."""
    dd = F.abs("max_drawdown")
    why = reasons(
        (~finite("sharpe"), "sharpe is non-finite"),
        (
            finite("sharpe") & (F.col("sharpe") < min_sharpe),
            F.format_string(f"sharpe %.3f below minimum {min_sharpe:.3f}", "sharpe"),
        ),
        (~finite(dd), "drawdown is non-finite"),
        (
            finite(dd) & (dd > max_drawdown),
            F.format_string(f"drawdown %.3f above maximum {max_drawdown:.3f}", dd),
        ),
    )
    return metrics.withColumn("valid_reasons", why).withColumn("valid", F.size("valid_reasons") == 0)


def fitness_score(
    sharpe_: Column,
    drawdown: Column,
    min_sharpe: float = 0.5,
    max_drawdown: float = 0.25,
    sharpe_weight: float = 0.7,
    drawdown_weight: float = 0.3,
) -> Column:
    """MT5: weighted score of normalised Sharpe and drawdown head-room."""
    if sharpe_weight < 0 or drawdown_weight < 0:
        raise ValueError("fitness weights must be non-negative")
    if sharpe_weight + drawdown_weight <= 0:
        raise ValueError("at least one fitness weight must be positive")
    s = F.greatest(sharpe_, F.lit(0.0)) / F.lit(max(min_sharpe, 1e-12))
    d = F.greatest(F.lit(1.0) - drawdown / F.lit(max(max_drawdown, 1e-12)), F.lit(0.0))
    return (F.lit(sharpe_weight) * s + F.lit(drawdown_weight) * d) / F.lit(sharpe_weight + drawdown_weight)


def fitness(metrics: DataFrame, min_sharpe: float = 0.5, max_drawdown: float = 0.25) -> DataFrame:
    dd = F.abs("max_drawdown")
    why = reasons(
        (F.col("sharpe") < min_sharpe,
         F.format_string(f"sharpe %.3f below minimum {min_sharpe:.3f}", "sharpe")),
        (dd > max_drawdown,
         F.format_string(f"drawdown %.3f above maximum {max_drawdown:.3f}", dd)),
    )
    return metrics.withColumns(
        {"fitness": fitness_score(F.col("sharpe"), dd, min_sharpe, max_drawdown), "fit_reasons": why}
    ).withColumn("eligible", F.size("fit_reasons") == 0)


def degradation(
    equity: DataFrame,
    keys: Sequence[str],
    *,
    max_drawdown: float = 0.20,
    min_return: float = -0.10,
    max_volatility: float = 0.10,
    min_observations: int = 20,
    order: str = "ts",
) -> DataFrame:
    """MT6: health report of equity rows (keys, ts, equity); bad input is its own reason."""
    r = returns_of(equity, keys, order)
    peak = F.max("equity").over(running(keys, order))
    r = r.withColumn("dd", ratio(F.col("equity"), peak) - 1.0)
    agg = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        (ratio(F.max_by("equity", order), F.min_by("equity", order)) - 1.0).alias("total_return"),
        F.min("dd").alias("max_drawdown"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("volatility"),
        F.bool_and(finite("equity")).alias("is_finite"),
        F.bool_and(F.col("equity") > 0).alias("is_positive"),
    )
    invalid = F.when(F.col("observations") < min_observations, F.lit("insufficient observations")).when(
        ~F.col("is_finite"), F.lit("equity must contain only finite values")
    ).when(~F.col("is_positive"), F.lit("equity must remain positive"))
    why = reasons(
        (F.col("max_drawdown") < -max_drawdown, "maximum drawdown breached"),
        (F.col("total_return") < min_return, "minimum return breached"),
        (F.col("volatility") > max_volatility, "volatility ceiling breached"),
    )
    return agg.select(
        *keys, "observations", "total_return", "max_drawdown", "volatility",
        invalid.alias("invalid"),
        F.when(invalid.isNull(), why).otherwise(F.array().cast("array<string>")).alias("reasons"),
    ).withColumn("degraded", F.size("reasons") > 0)


def qualification(
    equity: DataFrame,
    stages: DataFrame,
    keys: Sequence[str],
    *,
    min_observations: int = 60,
    min_total_return: float = 0.0,
    max_drawdown: float = 0.15,
    max_volatility: float = 0.08,
) -> DataFrame:
    """MT7: paper evidence against stricter limits; ``stages`` has (keys, stage)."""
    rep = degradation(
        equity, keys, max_drawdown=max_drawdown, min_return=min_total_return,
        max_volatility=max_volatility, min_observations=min_observations,
    ).join(stages, list(keys), "left")
    own = reasons(
        (F.coalesce(F.col("stage") != "paper", F.lit(True)), "strategy must remain in PAPER lifecycle stage"),
        (F.col("invalid").isNotNull(), F.concat(F.lit("paper evidence invalid: "), "invalid")),
    )
    extra = reasons(
        (F.col("invalid").isNull() & (F.col("total_return") < min_total_return),
         "paper total return is below qualification threshold"),
        (F.col("invalid").isNull() & (F.col("observations") < min_observations),
         "paper observation count is below qualification threshold"),
    )
    rep = rep.withColumn("why", F.array_distinct(F.concat(own, "reasons", extra)))
    return rep.select(
        *keys, "observations", "total_return", "max_drawdown", "volatility",
        F.when(F.size("why") == 0, "eligible_for_live_review").otherwise("reject").alias("decision"),
        F.lit(False).alias("execution_authority"),
        F.col("why").alias("reasons"),
    )


def feedback_decision(report: DataFrame) -> DataFrame:
    """MT8: state, action and reason text of a degradation report."""
    return report.withColumns(
        {
            "state": F.when(F.col("degraded"), "degraded").otherwise("active"),
            "action": F.when(F.col("degraded"), "retire_from_paper").otherwise("remain_in_paper"),
            "reason": F.when(F.col("degraded"), F.array_join("reasons", "; ")).otherwise(
                "health within policy"
            ),
        }
    )

"""Walk-forward evaluation, discovery and fold validation (SP3-SP6, SP8)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import finite, reasons, series, whole
from barloom.operators import backtest as bt
from barloom.operators import metrics, rules
from barloom.operators.indicators import rolling_std

Signals = Callable[[DataFrame, Sequence[str]], DataFrame]
SLICE = ("symbol", "window_id", "segment")
RUN = ("strategy_id", *SLICE)
CANDIDATE = ("strategy_id", "symbol")


@dataclass(frozen=True)
class Compiled:
    """Signals of a short list of specs."""

    records: Sequence[dict]

    def __call__(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rules.compiled_signals(df, self.records, keys)

    @property
    def names(self) -> list[str]:
        return [r["name"] for r in self.records]

    @property
    def caps(self) -> list[float]:
        return [r["position_sizing"]["max_position"] for r in self.records]

    def wide(self, df: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("close",), **options: float | bool) -> DataFrame:
        """Back-test of all specs side by side, on the sort of their indicators."""
        return bt.side_by_side(rules.compiled_flags(df, self.records, keys, keep=keep), self.caps, keys, **options)

    def inlined(self, wide: DataFrame, shared: Sequence[str], own: Sequence[str]) -> DataFrame:
        """Rows (strategy_id, ``shared``, ``own``) of columns of which those in ``own`` end in the number of the spec."""
        rows = [F.struct(F.lit(s).alias("strategy_id"), *[F.col(f"{c}_{n}").alias(c) for c in own]) for n, s in enumerate(self.names)]
        return wide.select(*shared, F.inline(F.array(*rows)))

    def runs(self, df: DataFrame, keys: Sequence[str], **options: float | bool) -> DataFrame:
        """The same as rows of one spec each."""
        return bt.one_under_another(self.wide(df, keys, **options), self.names, self.caps, [*keys, "ts", "close", "prev_close"])


def compiled(records: Sequence[dict]) -> Signals:
    return Compiled(records)


def from_table(specs: DataFrame) -> Signals:
    return lambda df, keys: rules.table_signals(df, specs, keys)


def held(flags: DataFrame, keys: Sequence[str], spread: bool = True) -> DataFrame:
    """Hold state per run.  ``spread`` shuffles the narrow flag rows on the run keys first: without
    it all strategies of a symbol would stay in the task that computed its indicators."""
    if spread:
        flags = flags.repartition(int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return flags.withColumn("signal", rules.hold_state("entry", "exit", keys)).drop("entry", "exit")


def segment_runs(segmented: DataFrame, signals: Signals, **costs: float) -> DataFrame:
    """SP3: every segment on its own slice, so indicator warm-up restarts in it.

    The flags are computed before the shuffle on run keys, which then serves the
    hold state, the lags and the equity curve of all segments.  The specs of a short list stay side by side and need no such shuffle.
    """
    if isinstance(signals, Compiled):
        return signals.runs(segmented, SLICE, **costs)
    flags = signals(segmented, SLICE)
    return bt.backtest_bars(held(flags, RUN), RUN, **costs)


def segment_metrics(runs: DataFrame, cash: float = bt.CASH) -> DataFrame:
    m = metrics.equity_metrics(runs, RUN, cash=cash)
    return metrics.fitness(metrics.validation(m))


def oos_rows(runs: DataFrame, overlapping: bool = True) -> DataFrame:
    """SP4: test-segment returns stitched by time; on a shared timestamp the first window wins."""
    test = runs.where(F.col("segment") == "test")
    if overlapping:
        test = test.groupBy(*CANDIDATE, "ts").agg(
            F.min_by("net_ret", "window_id").alias("net_ret"),
            F.min_by("close", "window_id").alias("close"),
        )
    return test.select(*CANDIDATE, "ts", "net_ret", "close")


def oos_metrics(rows: DataFrame) -> DataFrame:
    """OOS return, Sharpe and drawdown per candidate with the default validation gates."""
    df = bt.with_equity(rows, CANDIDATE, "net_ret")
    later = F.lag("ts").over(series(CANDIDATE)).isNotNull()
    df = df.withColumn("ret", F.when(later, F.col("net_ret")))
    m = df.groupBy(*CANDIDATE).agg(
        (F.max_by("equity", "ts") - 1.0).alias("oos_return"),
        metrics.sharpe("ret").alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(F.lit(1)).alias("oos_bars"),
    )
    return judged_oos(m)


def judged_oos(m: DataFrame) -> DataFrame:
    """OOS figures with the default validation gates, from (oos_return, sharpe, max_drawdown, oos_bars) of each candidate."""
    v = metrics.validation(m)
    return v.select(
        *CANDIDATE, "oos_return", F.col("sharpe").alias("oos_sharpe"),
        F.abs("max_drawdown").alias("oos_drawdown"), "oos_bars", F.col("valid").alias("oos_valid"),
    )


def walk_forward(runs: DataFrame, overlapping: bool = True) -> DataFrame:
    """SP4 and SP5: stitched OOS figures plus the all-segments pass flag."""
    seg = segment_metrics(runs)
    passed = seg.groupBy(*CANDIDATE).agg(
        F.bool_and("eligible").alias("segments_passed"),
        F.count_distinct("window_id").alias("windows"),
        F.min_by(
            F.col("max_drawdown"), F.when(F.col("segment") == "train", F.col("window_id"))
        ).alias("train_drawdown"),
    )
    return oos_metrics(oos_rows(runs, overlapping)).join(passed, list(CANDIDATE)).withColumn(
        "wf_passed", F.col("segments_passed") & F.col("oos_valid")
    )


def oos_trades(runs: DataFrame, **costs: float) -> DataFrame:
    return bt.closed_trades(runs.where(F.col("segment") == "test"), RUN, **costs)


def fold_validation(folds: DataFrame, signals: Signals) -> DataFrame:
    """SP6: indicators on train + test context, entry flag alone as position, back-test on the test part."""
    flags = signals(folds, ("symbol", "window_id"))
    test = flags.where(F.col("segment") == "test").withColumn("signal", F.col("entry"))
    keys = ("strategy_id", "symbol", "window_id")
    m = metrics.validation(metrics.equity_metrics(bt.backtest_bars(test, keys), keys, cash=bt.CASH))
    return m.select(*keys, "bars", "total_return", "sharpe", "max_drawdown", "valid", "valid_reasons")


def fold_summary(folds: DataFrame) -> DataFrame:
    """SP6 result: candidate passes when all folds pass; one reason per failed fold."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("valid"), F.col("window_id"))))
    return folds.groupBy(*CANDIDATE).agg(
        F.bool_and("valid").alias("passed"),
        F.count(F.lit(1)).alias("folds"),
        F.transform(
            failed, lambda k: F.concat(F.lit("fold "), k.cast("string"), F.lit(" failed validation"))
        ).alias("reasons"),
    )


def discovery(bars: DataFrame, signals: Signals) -> DataFrame:
    """SP8: back-test the bare entry flag of every candidate on the whole series and validate."""
    if isinstance(signals, Compiled):
        rows = signals.runs(bars, ("symbol",), hold=False)
    else:
        rows = bt.backtest_bars(signals(bars, ("symbol",)).withColumn("signal", F.col("entry")), CANDIDATE)
    m = metrics.equity_metrics(rows, CANDIDATE, cash=bt.CASH)
    return metrics.validation(m).withColumnRenamed("valid", "accepted")


def regime_labels(benchmark: DataFrame, window: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """RB4: rising / high-volatility flags of a benchmark; warm-up rows count as low volatility.

    The median is an exact percentile of the rolling deviation per series.
    """
    if window <= 1:
        raise ValueError("volatility_window must be greater than one")
    w = series(keys)
    b = benchmark.select(*keys, "ts", "close").withColumn(
        "bench_ret", F.coalesce(F.col("close") / F.lag("close").over(w) - 1.0, F.lit(0.0))
    )
    b = b.withColumn("vol", rolling_std("bench_ret", keys, window))
    mid = b.groupBy(*keys).agg(F.percentile("vol", F.lit(0.5)).alias("mid_vol"))
    b = b.join(mid, list(keys))
    return b.select(
        *keys, "ts",
        (F.col("bench_ret") >= 0).alias("rising"),
        F.coalesce(F.col("vol") >= F.col("mid_vol"), F.lit(False)).alias("high_vol"),
    )


def with_regimes(bars: DataFrame, window: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``bars`` with the flags of ``regime_labels`` of their own series, from passes over one sort."""
    if window <= 1:
        raise ValueError("volatility_window must be greater than one")
    b = bars.withColumn("_ret", F.coalesce(F.col("close") / F.lag("close").over(series(keys)) - 1.0, F.lit(0.0)))
    b = b.withColumn("_vol", rolling_std("_ret", keys, window))
    b = b.withColumn("_mid", F.percentile("_vol", F.lit(0.5)).over(whole(keys)))
    return b.withColumns({"rising": F.col("_ret") >= 0, "high_vol": F.coalesce(F.col("_vol") >= F.col("_mid"), F.lit(False))}).drop("_ret", "_vol", "_mid")


REGIMES = ["rising", "falling", "high_volatility", "low_volatility"]


def regime_means(ret: str) -> dict[str, Column]:
    """Mean finite return for each regime, as aggregates."""
    r = F.when(finite(ret), F.col(ret))
    tests = (F.col("rising"), ~F.col("rising"), F.col("high_vol"), ~F.col("high_vol"))
    return {name: F.avg(F.when(test, r)) for name, test in zip(REGIMES, tests, strict=True)}


def regime_score(agg: DataFrame) -> DataFrame:
    """Weakest minus strongest regime, if the benchmark covers all bars (``uncovered`` is zero)."""
    agg = agg.withColumns({c: F.when(F.col("uncovered") == 0, F.col(c)) for c in REGIMES})
    return agg.withColumn("regime_score", F.least(*REGIMES) - F.greatest(*REGIMES))


def regime_stability(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """RB5: mean OOS return per regime; score is the weakest minus the strongest covered regime.

    ``uncovered`` counts the OOS bars that the benchmark does not cover; with any of them nothing is scored, so the
    candidate lacks its regime evidence.
    """
    labels = labels.withColumn("_label", F.lit(True))
    agg = rows.join(labels, ["symbol", "ts"], "left").groupBy(*CANDIDATE).agg(
        F.sum(F.when(F.col("_label").isNull(), 1).otherwise(0)).cast("bigint").alias("uncovered"),
        *[mean.alias(name) for name, mean in regime_means("net_ret").items()],
    )
    return regime_score(agg)


def cost_scenarios(moves: DataFrame, min_equity_ratio: float = 0.90, cash: float = bt.CASH,
                   keys: Sequence[str] = CANDIDATE, rates: dict[str, float] | None = None) -> DataFrame:
    """RB1, RB2, RB7: final equity under every cost scenario in one aggregate.

    Scenarios share positions, so they are extra aggregate columns and not copies of the rows.
    """
    rates = rates or bt.scenario_rates()
    agg = moves.groupBy(*keys).agg(*[bt.final_equity(r, cash).alias(f"eq_{s}") for s, r in rates.items()])
    return judged_scenarios(agg, min_equity_ratio, rates)


def judged_scenarios(agg: DataFrame, min_equity_ratio: float = 0.90, rates: dict[str, float] | None = None) -> DataFrame:
    """Robustness verdict from the final equities ``eq_<scenario>``."""
    if not 0 < min_equity_ratio <= 1:
        raise ValueError("min_equity_ratio must be in (0, 1]")
    rates = rates or bt.scenario_rates()
    if not rates:
        raise ValueError("scenarios cannot be empty")
    base = "baseline" if "baseline" in rates else next(iter(rates))
    b = F.col(f"eq_{base}")
    why = reasons(
        ((b <= 0) | ~finite(b), "baseline equity is non-positive or non-finite"),
        *[
            (~finite(f"eq_{s}"), f"{s} equity is non-finite")
            for s in rates
        ],
        *[
            (finite(f"eq_{s}") & (F.col(f"eq_{s}") < b * min_equity_ratio),
             f"{s} equity fell below robustness threshold")
            for s in rates
        ],
    )
    finite_eq = [F.when(finite(f"eq_{s}"), F.col(f"eq_{s}")) for s in rates]
    worst = F.array_min(F.filter(F.array(*finite_eq), lambda x: x.isNotNull()))
    return agg.withColumns(
        {
            "rob_reasons": why,
            "rob_ratio": F.when((b > 0) & finite(b), F.coalesce(worst / b, F.lit(0.0))).otherwise(F.lit(0.0)),
        }
    ).withColumn("rob_passed", F.size("rob_reasons") == 0)


def scenario_rows(scenarios: DataFrame, keys: Sequence[str] = CANDIDATE,
                  rates: dict[str, float] | None = None) -> DataFrame:
    """Long form: one row per scenario."""
    rates = rates or bt.scenario_rates()
    items = [F.struct(F.lit(s).alias("scenario"), F.col(f"eq_{s}").alias("final_equity")) for s in rates]
    return scenarios.select(*keys, "rob_passed", F.inline(F.array(*items)))


# Draws and outcomes that a task of the bootstrap holds at once.
DRAWS = 1 << 22


def resampled(batches: Iterator[pd.DataFrame], seed: int, simulations: int, lower: float, least: float) -> Iterator[pd.DataFrame]:
    """Figures of the bootstrap for rows with the log returns ``logs`` of the trades of one candidate each.

    A draw depends on seed, path and position only, so each is made once for a task (see ``columns.draw``) and serves all candidates.
    """
    step = max(1, DRAWS // simulations)
    made = np.empty((0, simulations), np.uint32)

    def drawn(first: int, last: int) -> np.ndarray:
        return np.array([[int(hashlib.md5(f"{seed}:{k}:{d}".encode()).hexdigest()[:8], 16) for k in range(simulations)] for d in range(first, last)], np.uint32)

    for pdf in batches:
        count = pdf["logs"].map(len).to_numpy(dtype=int)
        figures = np.full((len(pdf), 4), np.nan)
        for n in np.unique(count):
            rows = np.flatnonzero(count == n)
            # Candidates with the same number of trades share the drawn positions and are taken together.
            few = max(1, DRAWS // (max(n, 1) * simulations))
            for at in range(0, len(rows), few):
                some = rows[at : at + few]
                logs = np.stack([np.asarray(pdf["logs"].iloc[k], float) for k in some])
                total = np.zeros((len(some), simulations))
                for first in range(0, n, step):
                    last = min(n, first + step)
                    if first == 0 and last > len(made):
                        made = np.vstack([made, drawn(len(made), last)])
                    # Summed over the positions in order, as a loop would.
                    total += logs[:, (made[:last] if first == 0 else drawn(first, last)) % n].sum(axis=1)
                paths = np.exp(total) - 1.0
                figures[some, 3] = (paths >= least).mean(axis=1)
                clean = ~np.isnan(paths).any(axis=1)
                if clean.any():
                    known = paths[clean]
                    figures[some[clean], :3] = np.column_stack([np.percentile(known, 50, axis=1), known.min(axis=1), np.percentile(known, lower, axis=1)])
                for k in np.flatnonzero(~clean):
                    known = paths[k][~np.isnan(paths[k])]
                    if len(known):
                        figures[some[k], :3] = np.percentile(known, 50), known.min(), np.percentile(known, lower)
        out = pd.DataFrame(figures, columns=["mc_median", "mc_worst", "mc_lower", "mc_pass_rate"], index=pdf.index)
        out.insert(0, "mc_simulations", simulations)
        yield pd.concat([pdf.drop(columns="logs"), out], axis=1)


def bootstrap(
    trades: DataFrame,
    keys: Sequence[str] = CANDIDATE,
    *,
    simulations: int = 1000,
    seed: int = 0,
    lower_percentile: float = 5.0,
    min_return: float = 0.0,
    chunks: int = 20,
    order: Sequence[str] = ("window_id", "trade_id"),
) -> DataFrame:
    """RB3: resample closed trades with replacement, ``simulations`` paths per candidate.

    Trades are bounded by the bars of one series, so they travel as one array per candidate.  A task draws its random numbers
    once and takes every path of a candidate from them, so a path is neither a row nor hashed again.  ``chunks`` is
    kept for callers that set it; the result never depended on it.
    """
    if simulations <= 0:
        raise ValueError("simulations must be positive")
    if not 0 <= lower_percentile <= 100:
        raise ValueError("lower_percentile must be between 0 and 100")
    packed = trades.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(*order, "trade_return"))), lambda t: F.log1p(t["trade_return"])
        ).alias("logs")
    )
    schema = packed.select(*keys).schema
    for name, kind in (("mc_simulations", "long"), ("mc_median", "double"), ("mc_worst", "double"), ("mc_lower", "double"), ("mc_pass_rate", "double")):
        schema = schema.add(name, kind)
    return packed.mapInPandas(lambda batches: resampled(batches, seed, simulations, lower_percentile, min_return), schema)


def bootstrap_or_fail(candidates: DataFrame, mc: DataFrame, keys: Sequence[str] = CANDIDATE) -> DataFrame:
    """Candidates without a closed OOS trade get the fixed failing row."""
    none = {"mc_simulations": 0, "mc_median": -1.0, "mc_worst": -1.0, "mc_lower": -1.0, "mc_pass_rate": 0.0}
    return candidates.select(*keys).join(mc, list(keys), "left").select(
        *keys, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in none.items()]
    )

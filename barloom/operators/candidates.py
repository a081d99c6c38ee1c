"""Evidence of candidates: walk-forward, scenarios, bootstrap, regimes and perturbations in one row each (GT8, RB6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import finite, series
from barloom.operators import backtest as bt
from barloom.operators import evaluation as ev
from barloom.operators import metrics, rules, splits, sweeps
from barloom.session import cut
from barloom.sources.bars import in_tasks

CAND = list(ev.CANDIDATE)


def moves(bars: DataFrame, signals: ev.Signals) -> DataFrame:
    """Whole-series positions of every candidate."""
    if isinstance(signals, ev.Compiled):
        return signals.runs(bars, ("symbol",), equity=False)
    return bt.with_moves(ev.held(signals(bars, ("symbol",)), CAND), CAND)


def evidence(
    bars: DataFrame, signals: ev.Signals, *, seed: int = 0, simulations: int = 1000,
    perturbations: DataFrame | None = None,
) -> DataFrame:
    """GT8 without the gate: one row per candidate with every evidence column.

    The segmented runs feed the segment metrics, the OOS rows and the trades, so they are written
    once; back-testing them again in every branch would cost a window sort each.  Everything joined
    here is one row per candidate.  A short list of specs is evaluated side by side instead (``listed_figures``).
    """
    if isinstance(signals, ev.Compiled):
        wf, mc, regime, rob = listed_figures(bars, signals, seed=seed, simulations=simulations)
    else:
        wf, mc, regime, rob = table_figures(bars, signals, seed=seed, simulations=simulations)
    out = (
        wf.join(ev.bootstrap_or_fail(wf, mc), CAND)
        .join(regime, CAND, "left")
        .join(rob, CAND, "left")
    )
    if perturbations is not None:
        out = out.join(perturbations, CAND, "left")
    else:
        out = out.withColumn("pert_pass_rate", F.lit(None).cast("double"))
    return out.withColumn("fitness", F.col("oos_sharpe"))


def table_figures(bars: DataFrame, signals: ev.Signals, *, seed: int, simulations: int) -> tuple[DataFrame, ...]:
    """Walk-forward, bootstrap, regime and cost figures of each candidate, from rows of one candidate each."""
    windows = splits.default_windows(bars)
    runs = ev.segment_runs(windows, signals)
    # Only what the branches read is written.
    runs = cut(runs.select(*ev.RUN, "ts", "close", "prev_close", "max_position", "target", "prev_target", "net_ret", "equity", "drawdown"))
    oos = ev.oos_rows(runs, overlapping=False)
    wf = ev.walk_forward(runs, overlapping=False)
    mc = ev.bootstrap(ev.oos_trades(runs), simulations=simulations, seed=seed)
    labels = ev.regime_labels(windows.where(F.col("segment") == "test"))
    regime = ev.regime_stability(oos, labels).select(*CAND, "regime_score")
    return wf, mc, regime, ev.cost_scenarios(moves(bars, signals))


def listed_figures(bars: DataFrame, signals: ev.Compiled, *, seed: int, simulations: int) -> tuple[DataFrame, ...]:
    """The same for a short list of specs, from wide rows that are folded to one row per series before a spec gets rows of its own.

    The training part comes first, so its runs are the beginning of the whole series' runs: only the validation and the test
    part are back-tested apart.  The narrow bars are written once, and of the back-test rows only those of the test part.
    """
    every, rates = range(len(signals.names)), bt.scenario_rates()
    read = rules.used_columns(signals.records)
    placed = cut(splits.default_segments(bars.select("symbol", "ts", *read)).select("symbol", "ts", *read, "segment"))
    most = placed.count()

    # Whole series (with the training part) and validation part: metrics and final equities.
    validation = F.col("segment") == "validation"
    runs = placed.withColumn("run", F.explode(F.when(validation, F.array(F.lit("train"), F.lit("validation"))).otherwise(F.array(F.lit("train")))))
    runs = runs.withColumn("counted", F.coalesce(F.col("run") == F.col("segment"), F.lit(False)))
    wide = signals.wide(in_tasks(runs, most, "symbol"), ("symbol", "run"), keep=("close", "counted"))
    # Without a turnover all scenarios give the same return.
    wide = wide.withColumns({f"log_gross_{n}": F.log1p(f"gross_ret_{n}") for n in every})
    figures = []
    for n in every:
        ret = F.when(F.col("counted") & F.col("prev_close").isNotNull(), F.col(f"net_ret_{n}"))
        figures += [metrics.sharpe(ret).alias(f"sharpe_{n}"), F.min(F.when(F.col("counted"), F.col(f"drawdown_{n}"))).alias(f"max_drawdown_{n}")]
        still = F.col(f"turnover_{n}") == 0
        for s, rate in rates.items():
            logs = F.when(still, F.col(f"log_gross_{n}")).otherwise(F.log1p(F.col(f"gross_ret_{n}") - F.col(f"turnover_{n}") * F.lit(rate)))
            figures.append((F.lit(bt.CASH) * F.exp(F.sum(logs))).alias(f"eq_{s}_{n}"))
    equities = [f"eq_{s}" for s in rates]
    before = signals.inlined(wide.groupBy("symbol", "run").agg(*figures), ("symbol", "run"), ("sharpe", "max_drawdown", *equities))
    train = F.col("run") == "train"
    before = metrics.fitness(before).groupBy(*CAND).agg(
        F.bool_and("eligible").alias("before_passed"), F.max(F.when(train, F.col("max_drawdown"))).alias("train_drawdown"),
        *[F.max(F.when(train, F.col(e))).alias(e) for e in equities],
    )
    before = cut(before)

    # Test part: metrics, regimes and trades.
    test = ev.with_regimes(in_tasks(placed.where(F.col("segment") == "test"), most, "symbol"))
    test = test.withColumn("later", F.lag("ts").over(series(("symbol",))).isNotNull())
    wide = signals.wide(test, ("symbol",), keep=(*read, "later", "rising", "high_vol"))
    kept = ("net_ret", "log_equity", "log_peak", "target", "prev_target")
    wide = cut(wide.select("symbol", "ts", "close", "prev_close", "later", "rising", "high_vol", *[f"{c}_{n}" for n in every for c in kept]))
    figures = [F.count(F.lit(1)).alias("oos_bars"), F.sum(F.when(F.col("ts").isNull(), 1).otherwise(0)).cast("bigint").alias("uncovered")]
    for n in every:
        ret, now, peak = F.col(f"net_ret_{n}"), F.exp(f"log_equity_{n}"), F.exp(f"log_peak_{n}")
        own = {
            "oos_return": F.exp(F.max_by(f"log_equity_{n}", "ts")) - 1.0,
            "oos_sharpe": metrics.sharpe(F.when(F.col("later"), ret)),
            "oos_drawdown": F.min(now / peak - 1.0),
            "sharpe": metrics.sharpe(F.when(F.col("prev_close").isNotNull(), ret)),
            "max_drawdown": F.min(F.lit(bt.CASH) * now / (F.lit(bt.CASH) * peak) - 1.0),
            **ev.regime_means(f"net_ret_{n}"),
        }
        figures += [c.alias(f"{name}_{n}") for name, c in own.items()]
    after = cut(signals.inlined(wide.groupBy("symbol").agg(*figures), ("symbol", "oos_bars", "uncovered"), list(own)))
    segment = metrics.fitness(after.select(*CAND, "sharpe", "max_drawdown")).select(*CAND, "eligible")
    oos = ev.judged_oos(after.select(*CAND, "oos_return", F.col("oos_sharpe").alias("sharpe"), F.col("oos_drawdown").alias("max_drawdown"), "oos_bars"))
    wf = oos.join(segment, CAND).join(before.select(*CAND, "before_passed", "train_drawdown"), CAND)
    wf = wf.withColumns({"segments_passed": F.col("before_passed") & F.col("eligible"), "windows": F.lit(1).cast("bigint")})
    wf = wf.withColumn("wf_passed", F.col("segments_passed") & F.col("oos_valid")).select(
        *CAND, "oos_return", "oos_sharpe", "oos_drawdown", "oos_bars", "oos_valid", "segments_passed", "windows", "train_drawdown", "wf_passed"
    )
    # A trade needs only the bars at which the target changes.
    rows = [F.struct(F.lit(s).alias("strategy_id"), F.lit(c).alias("max_position"), F.col(f"target_{n}").alias("target"), F.col(f"prev_target_{n}").alias("prev_target"))
            for n, (s, c) in enumerate(zip(signals.names, signals.caps, strict=True))]
    changes = wide.select("symbol", "ts", "close", F.inline(F.filter(F.array(*rows), lambda r: r["target"] != r["prev_target"])))
    mc = ev.bootstrap(bt.closed_trades(changes, CAND), simulations=simulations, seed=seed, order=("trade_id",))
    regime = ev.regime_score(after.select(*CAND, "uncovered", *ev.REGIMES)).select(*CAND, "regime_score")
    return wf, mc, regime, ev.judged_scenarios(before.select(*CAND, *equities))


def perturbation_scores(
    bars: DataFrame, specs: DataFrame, samples: int = 20, seed: int = 0, key: str = "strategy_id"
) -> DataFrame:
    """RB6: OOS Sharpe of sampled neighbours; equal variants are evaluated once.

    Only the test slice is evaluated, since the score reads nothing else.
    """
    variants = sweeps.sampled_variants(specs, samples, seed, (sweeps.PERIOD, sweeps.THRESHOLD), key)
    names = variants.select(F.col("parent_id"), "sample", "strategy_id")
    distinct = variants.dropDuplicates(["strategy_id"])
    test = splits.default_windows(bars).where(F.col("segment") == "test")
    runs = ev.segment_runs(test, ev.from_table(distinct))
    score = ev.oos_metrics(ev.oos_rows(runs, overlapping=False)).select(*CAND, "oos_sharpe")
    per_sample = names.join(score, "strategy_id")
    ok = finite("oos_sharpe")
    return per_sample.groupBy(F.col("parent_id").alias("strategy_id"), "symbol").agg(
        F.count(F.lit(1)).alias("pert_samples"),
        F.avg(F.when(ok & (F.col("oos_sharpe") >= 0), 1.0).otherwise(0.0)).alias("pert_pass_rate"),
        F.min(F.when(ok, F.col("oos_sharpe"))).alias("pert_worst"),
        F.percentile(F.when(ok, F.col("oos_sharpe")), F.lit(0.5)).alias("pert_median"),
    )

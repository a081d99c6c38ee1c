"""Candidate evidence: walk-forward, scenarios, bootstrap, regimes, perturbations and the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import finite
from barloom.operators import backtest as bt
from barloom.operators import evaluation as ev
from barloom.operators import gates, rules, splits, sweeps
from barloom.operators.candidates import evidence, moves, perturbation_scores
from barloom.operators.specs import demo_records, spec_table
from barloom.plans.core import r2, r6, stamp
from barloom.session import cut
from barloom.sources import bars as src

CAND = list(ev.CANDIDATE)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# --- registered queries ----------------------------------------------------
DEMO = demo_records()


def priority_segments(spark: SparkSession, sf: str) -> DataFrame:
    return splits.default_windows(src.bars_priority(spark, sf))


def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    s = splits.chronological_split(src.bars_supplier(spark, sf))
    return s.groupBy("symbol", "segment").agg(
        F.count(F.lit(1)).alias("bars"), stamp(F.min("ts")).alias("first_ts"), stamp(F.max("ts")).alias("last_ts")
    )


def walk_forward_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = splits.walk_forward_windows(src.bars_supplier(spark, sf), 120, 40, 40, 40)
    return w.groupBy("symbol", "window_id", "segment").agg(
        F.count(F.lit(1)).alias("bars"), stamp(F.min("ts")).alias("first_ts"), stamp(F.max("ts")).alias("last_ts")
    )


def walk_forward_oos(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling windows whose tests overlap (step 20 < test 40), stitched by time."""
    w = splits.walk_forward_windows(src.bars_priority(spark, sf), 300, 100, 40, 20)
    wf = ev.walk_forward(ev.segment_runs(w, ev.compiled([DEMO[0], DEMO[4]])))
    return wf.select(
        *CAND, "windows", "oos_bars", r6("oos_return").alias("oos_return"), r6("oos_sharpe").alias("oos_sharpe"),
        r6("oos_drawdown").alias("oos_drawdown"), "wf_passed",
    )


def fold_validation(spark: SparkSession, sf: str) -> DataFrame:
    f = splits.fold_rows(src.bars_priority(spark, sf), 400, 150)
    v = ev.fold_validation(f, ev.compiled([DEMO[0], DEMO[4]]))
    return v.select(
        *CAND, "window_id", "bars", r6("total_return").alias("total_return"), r6("sharpe").alias("sharpe"),
        r6("max_drawdown").alias("max_drawdown"), "valid",
    )


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = splits.fold_rows(src.bars_priority(spark, sf), 400, 150)
    s = ev.fold_summary(ev.fold_validation(f, ev.compiled([DEMO[0], DEMO[4]])))
    return s.select(*CAND, "passed", "folds", F.array_join("reasons", "; ").alias("reasons"))


def discovery(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.discovery(src.bars_supplier(spark, sf), ev.compiled(DEMO))
    return d.select(*CAND, r6("total_return").alias("total_return"), r6("sharpe").alias("sharpe"), "accepted")


def table_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The spec-table route over a sweep: every period neighbour of the demo specs on every priority series."""
    specs = spec_table(spark, [{**r, "universe": PRIORITIES} for r in DEMO])
    both = specs.unionByName(sweeps.neighbours(specs, sweeps.PERIOD).select(*specs.columns)).dropDuplicates(["strategy_id"])
    flags = rules.table_signals(src.bars_priority(spark, sf), both)
    named = flags.join(both.select("strategy_id", "name", F.transform("indicators", lambda i: i["period"].cast("string")).alias("p")), "strategy_id")
    return named.groupBy("symbol", "name", F.array_join("p", ",").alias("periods")).agg(
        F.sum(F.when(F.col("entry"), 1).otherwise(0)).cast("bigint").alias("entries"),
        F.sum(F.when(F.col("exit"), 1).otherwise(0)).cast("bigint").alias("exits"),
    )


def cost_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.cost_scenarios(moves(src.bars_supplier(spark, sf), ev.compiled(DEMO)))
    rows = ev.scenario_rows(s)
    return rows.select(*CAND, "scenario", r2("final_equity").alias("final_equity"), "rob_passed")


def robustness_ratio(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.cost_scenarios(moves(src.bars_supplier(spark, sf), ev.compiled(DEMO)), 0.98)
    return s.select(*CAND, r6("rob_ratio").alias("rob_ratio"), "rob_passed", F.array_join("rob_reasons", "; ").alias("reasons"))


def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    runs = ev.segment_runs(priority_segments(spark, sf), ev.compiled([DEMO[0], DEMO[4]]))
    mc = ev.bootstrap(ev.oos_trades(runs), simulations=500, seed=7)
    return mc.select(
        *CAND, "mc_simulations",
        *[r6(c).alias(c) for c in ("mc_median", "mc_worst", "mc_lower", "mc_pass_rate")],
    )


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    seg = priority_segments(spark, sf)
    runs = ev.segment_runs(seg, ev.compiled([DEMO[0], DEMO[4]]))
    labels = ev.regime_labels(seg.where(F.col("segment") == "test"))
    r = ev.regime_stability(ev.oos_rows(runs, False), labels)
    scale = 1e3  # mean daily returns are small; more digits survive the cut
    return r.select(
        *CAND,
        *[r6(F.col(c) * scale).alias(c) for c in ("rising", "falling", "high_volatility", "low_volatility", "regime_score")],
    )


def perturbations(spark: SparkSession, sf: str) -> DataFrame:
    specs = spec_table(spark, [{**r, "universe": PRIORITIES} for r in DEMO])
    p = perturbation_scores(src.bars_priority(spark, sf), specs, samples=20, seed=1, key="name")
    named = p.join(specs.select("strategy_id", "name"), "strategy_id")
    return named.select(
        F.col("name").alias("strategy_id"), "symbol", "pert_samples", r6("pert_pass_rate").alias("pert_pass_rate"),
        r6("pert_worst").alias("pert_worst"), r6("pert_median").alias("pert_median"),
    )


def segment_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    runs = ev.segment_runs(splits.default_windows(src.bars_supplier(spark, sf)), ev.compiled(DEMO))
    m = ev.segment_metrics(runs)
    return m.select(
        *CAND, "segment", "bars", r6("total_return").alias("total_return"), r6("sharpe").alias("sharpe"),
        r6("max_drawdown").alias("max_drawdown"), r6("fitness").alias("fitness"), "eligible",
    )


def supplier_evidence(spark: SparkSession, sf: str, simulations: int = 200) -> DataFrame:
    """Evidence of the demo specs on every supplier series; without perturbation evidence nothing passes the gate."""
    e = evidence(src.bars_supplier(spark, sf), ev.compiled(DEMO), simulations=simulations, seed=3)
    return gates.promotion(e)


def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    g = supplier_evidence(spark, sf)
    return g.select(
        *CAND, r6("oos_sharpe").alias("oos_sharpe"), r6("oos_drawdown").alias("oos_drawdown"), "wf_passed",
        r6("mc_pass_rate").alias("mc_pass_rate"), r6("rob_ratio").alias("rob_ratio"), "stage", "promotion_eligible",
        F.array_join("promotion_reasons", "; ").alias("reasons"),
    )


def candidate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """GT8: the full evidence chain with perturbations on the priority series."""
    bars = src.bars_priority(spark, sf)
    specs = spec_table(spark, [{**r, "universe": PRIORITIES} for r in DEMO])
    pert = perturbation_scores(bars, specs, samples=20, seed=1, key="name")
    e = evidence(bars, ev.from_table(specs), seed=1, simulations=500, perturbations=pert)
    g = gates.promotion(e).join(specs.select("strategy_id", "name"), "strategy_id")
    return g.select(
        F.col("name").alias("strategy_id"), "symbol", r6("oos_return").alias("oos_return"),
        r6("oos_sharpe").alias("oos_sharpe"), r6("oos_drawdown").alias("oos_drawdown"), "wf_passed",
        r6("mc_pass_rate").alias("mc_pass_rate"), r6("mc_lower").alias("mc_lower"),
        r6("pert_pass_rate").alias("pert_pass_rate"), r6(F.col("regime_score") * 1e3).alias("regime_score"),
        r6("rob_ratio").alias("rob_ratio"), "rob_passed", "stage", "promotion_eligible",
        F.array_join("promotion_reasons", "; ").alias("reasons"),
    )


QUERIES = {
    "chronological_split": chronological_split,
    "walk_forward_windows": walk_forward_windows,
    "walk_forward_oos": walk_forward_oos,
    "segment_evaluation": segment_evaluation,
    "fold_validation": fold_validation,
    "fold_summary": fold_summary,
    "discovery": discovery,
    "table_signals": table_signals,
    "cost_scenarios": cost_scenarios,
    "robustness_ratio": robustness_ratio,
    "bootstrap": bootstrap,
    "regimes": regimes,
    "perturbations": perturbations,
    "promotion_gate": promotion_gate,
    "candidate_evidence": candidate_evidence,
}

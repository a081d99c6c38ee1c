"""Promotion gate, eligibility, reviews, admissions (GT1-GT10).

Reason texts and default limits are fixed values: they are part of the results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import content_id, false_if_null, finite, first_reason, reasons


def promotion(
    evidence: DataFrame,
    *,
    min_oos_sharpe: float = 0.5,
    max_oos_drawdown: float = 0.25,
    min_mc_pass_rate: float = 0.95,
    min_mc_lower: float = -0.10,
    min_pert_pass_rate: float = 0.80,
    min_regime_score: float = -0.05,
    min_equity_ratio: float = 0.90,
    require_walk_forward: bool = True,
    require_robustness: bool = True,
) -> DataFrame:
    """GT1: stage, eligible and reasons.  A null evidence column means missing evidence, which fails."""
    if not 0 < min_equity_ratio <= 1:
        raise ValueError("min_robustness_equity_ratio must be in (0, 1]")
    core = [finite(c) for c in ("oos_sharpe", "oos_drawdown", "mc_pass_rate", "mc_lower")]
    all_finite = core[0] & core[1] & core[2] & core[3]
    has_pert, has_regime, has_rob = (
        F.col(c).isNotNull() for c in ("pert_pass_rate", "regime_score", "rob_passed")
    )
    why = reasons(
        (~all_finite, "non-finite promotion metric detected"),
        (F.lit(require_walk_forward) & ~F.coalesce("wf_passed", F.lit(False)), "walk-forward/OOS evaluation failed"),
        (F.col("oos_sharpe") < min_oos_sharpe, "OOS Sharpe is below the promotion minimum"),
        (F.col("oos_drawdown") > max_oos_drawdown, "OOS drawdown exceeds the promotion maximum"),
        (F.col("mc_pass_rate") < min_mc_pass_rate, "Monte Carlo pass rate is below the promotion minimum"),
        (F.col("mc_lower") < min_mc_lower, "Monte Carlo lower-percentile return is too weak"),
        (~has_pert, "parameter perturbation evidence is required"),
        (
            has_pert & (~finite("pert_pass_rate") | (F.col("pert_pass_rate") < min_pert_pass_rate)),
            "parameter perturbation stability is below the promotion minimum",
        ),
        (~has_regime, "regime stability evidence is required"),
        (
            has_regime & (~finite("regime_score") | (F.col("regime_score") < min_regime_score)),
            "regime stability is below the promotion minimum",
        ),
        (F.lit(require_robustness) & ~has_rob, "execution robustness evidence is required"),
    )
    failed_rob = F.when(
        has_rob & ~F.col("rob_passed"), F.col("rob_reasons")
    ).otherwise(F.array().cast("array<string>"))
    ratio_low = reasons(
        (
            F.lit(require_robustness) & F.col("rob_passed") & (F.col("rob_ratio") < min_equity_ratio),
            "robustness equity ratio is below the promotion minimum",
        )
    )
    return (
        evidence.withColumn("promotion_reasons", F.concat(why, failed_rob, ratio_low))
        .withColumn("promotion_eligible", F.size("promotion_reasons") == 0)
        .withColumn("stage", F.when(F.col("promotion_eligible"), "paper").otherwise("research"))
    )


def selection_eligible(
    *,
    require_promotion: bool = True,
    max_drawdown: float = 1.0,
    min_ratio: float = 0.0,
    min_mc_pass_rate: float = 0.0,
    drawdown: str = "signed",
) -> Column:
    """GT2 as a predicate.  The signed drawdown (<= 0) never exceeds a positive limit; that is the
    default rule, ``drawdown="magnitude"`` compares its size instead."""
    dd = F.col("train_drawdown") if drawdown == "signed" else F.abs("train_drawdown")
    return false_if_null(
        (F.lit(not require_promotion) | F.col("promotion_eligible"))
        & F.col("wf_passed")
        & (dd <= max_drawdown)
        & (F.col("rob_ratio") >= min_ratio)
        & (F.col("mc_pass_rate") >= min_mc_pass_rate)
        & finite("fitness")
    )


def catalog(experiments: DataFrame, evidence: DataFrame, limit: int | None = None,
            dataset_id: str | None = None) -> DataFrame:
    """GT5: experiments that passed the gate, by score then id; ``limit`` is the report's top-k."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    rows = experiments.where((F.col("status") == "paper") & F.col("score").isNotNull())
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    ready = evidence.where(
        F.get_json_object("evidence", "$.promotion.eligible") == "true"
    ).select("experiment_id", "evidence")
    out = rows.join(ready, "experiment_id").orderBy(F.desc("score"), "experiment_id")
    return out if limit is None else out.limit(limit)


def robustness_review(
    candidates: DataFrame, provenance: DataFrame, schedule: DataFrame
) -> DataFrame:
    """GT3: candidate evidence against its stored provenance and the schedule of its generation."""
    p = provenance.select(
        "strategy_id",
        F.col("generation").alias("p_generation"),
        F.col("seed").alias("p_seed"),
        F.col("genome_digest").alias("p_genome"),
        F.col("evaluation_digest").alias("p_evaluation"),
    )
    s = schedule.select(
        F.col("generation").alias("p_generation"), F.col("action").alias("s_action"),
        F.col("execution_authority").alias("s_authority"),
    )
    df = candidates.join(p, "strategy_id", "left").join(s, "p_generation", "left")
    why = reasons(
        (F.col("p_genome").isNull(), "provenance strategy_id does not match candidate"),
        (F.col("p_generation") < 0, "provenance generation is invalid"),
        (F.col("p_seed") < 0, "provenance research seed is invalid"),
        (F.col("p_genome") != F.col("genome_digest"), "provenance genome digest does not match candidate"),
        (F.col("p_evaluation") != F.col("evaluation_digest"), "provenance evaluation digest does not match evidence"),
        (F.coalesce(F.col("s_action") != "ready_for_robustness_review", F.lit(True)),
         "research scheduler has not authorized robustness review"),
        (F.col("s_authority"), "research scheduler incorrectly carries execution authority"),
        (~F.coalesce("wf_passed", F.lit(False)), "candidate validation did not pass"),
        (~F.coalesce("promotion_eligible", F.lit(False)), "candidate is not promotion-eligible"),
        (~F.coalesce("rob_passed", F.lit(False)), "robustness stress scenarios did not pass"),
        (~finite("oos_sharpe"), "oos_sharpe is non-finite"),
        (~finite("fitness"), "fitness_score is non-finite"),
        (~finite("mc_pass_rate"), "monte_carlo_pass_rate is non-finite"),
        (~finite("eq_baseline"), "robustness baseline final equity is non-finite"),
    )
    return df.select(
        *candidates.columns, F.col("p_generation").alias("generation"), why.alias("review_reasons")
    ).withColumns(
        {
            "decision": F.when(F.size("review_reasons") == 0, "admit").otherwise("reject"),
            "execution_authority": F.lit(False),
        }
    )


def successor_admission(
    candidates: DataFrame, evaluations: DataFrame, existing: DataFrame, generation: int
) -> DataFrame:
    """GT4: candidates(strategy_id, lineage_generation, parent_ids) judged by their evaluations.

    ``error`` names a broken precondition; otherwise ``admitted`` follows the promotion gate.
    """
    if generation < 0:
        raise ValueError("generation must be nonnegative")
    known = existing.select("strategy_id").distinct().withColumn("known", F.lit(True))
    df = candidates.join(
        evaluations.select(
            "strategy_id", "promotion_eligible", "stage", "promotion_reasons", "fitness", "oos_sharpe",
            "oos_drawdown",
        ),
        "strategy_id", "left",
    ).join(known, "strategy_id", "left")
    ok = F.coalesce("promotion_eligible", F.lit(False))
    all_finite = finite("fitness") & finite("oos_sharpe") & finite("oos_drawdown")
    error = first_reason(
        (F.col("promotion_eligible").isNull(), "candidate and evaluation identities must match"),
        (F.col("known"), "successor already exists"),
        (F.coalesce(F.size("parent_ids"), F.lit(0)) <= 0, "successor requires at least one parent"),
        (F.col("lineage_generation") > generation, "lineage generation cannot exceed admission generation"),
        (ok & ~all_finite, "eligible successor contains non-finite evaluation metrics"),
    )
    return df.select(
        "strategy_id", "parent_ids", F.lit(generation).alias("generation"),
        (ok & error.isNull()).alias("admitted"), "stage",
        F.when(ok, F.array().cast("array<string>")).otherwise(F.col("promotion_reasons")).alias("reasons"),
        error.alias("error"),
    )


def paper_admission(admissions: DataFrame, runs: DataFrame, certificates: DataFrame) -> DataFrame:
    """GT6: admissions(run_id, strategy_id, source_stage) checked against run and certificate tables."""
    r = runs.select("run_id", "halted").withColumn("has_run", F.lit(True))
    c = certificates.select(
        "run_id", "certificate_id", "verified", "dataset_version", "data_bundle_version", "execution_fingerprint"
    ).withColumn("has_cert", F.lit(True))
    df = admissions.join(r, "run_id", "left").join(c, "run_id", "left")
    has_cert = F.col("has_cert").isNotNull()

    def blank(name: str) -> Column:
        return has_cert & (F.coalesce(name, F.lit("")) == "")

    why = reasons(
        (F.col("source_stage") != "promoted", "strategy must be in promoted lifecycle stage"),
        (F.col("has_run").isNull(), "portfolio execution provenance is missing"),
        (F.col("halted"), "portfolio execution is halted"),
        (~has_cert, "verified reproducibility certificate is missing"),
        (has_cert & ~F.coalesce("verified", F.lit(False)), "reproducibility certificate is not verified"),
        (blank("certificate_id"), "certificate identity is missing"),
        *[
            (blank(f), f"certificate {f} is missing")
            for f in ("dataset_version", "data_bundle_version", "execution_fingerprint")
        ],
    )
    return df.select(*admissions.columns, "certificate_id", why.alias("reasons")).withColumn(
        "admitted", F.size("reasons") == 0
    )


ADMISSION = ["run_id", "strategy_id", "source_stage", "target_stage", "certificate_id"]


def admission_digest() -> Column:
    """Digest that is stored with an admission record."""
    return content_id(ADMISSION, 32)


def paper_replay(requests: DataFrame, admissions: DataFrame, runs: DataFrame, certificates: DataFrame) -> DataFrame:
    """GT6: stored admissions(ADMISSION columns, record_digest) of requests(run_id) checked again, failing closed.

    ``runs`` has (run_id, halted), ``certificates`` (run_id, valid, reason, certificate_id) as verified now.
    """
    a = admissions.select(*ADMISSION, "record_digest").withColumn("intact", F.col("record_digest") == admission_digest()).withColumn("stored", F.lit(True))
    r = runs.select("run_id", F.col("halted").alias("r_halted")).withColumn("has_run", F.lit(True))
    c = certificates.select("run_id", F.col("valid").alias("c_ok"), F.col("reason").alias("c_reason"), F.col("certificate_id").alias("c_id"))
    df = requests.select("run_id").join(a, "run_id", "left").join(r, "run_id", "left").join(c, "run_id", "left")
    there = F.col("stored").isNotNull()
    valid = F.coalesce("c_ok", F.lit(False))
    why = reasons(
        (~there, "paper admission is missing"),
        (there & ~F.col("source_stage").eqNullSafe(F.lit("promoted")), "admission source stage is not promoted"),
        (there & ~F.col("target_stage").eqNullSafe(F.lit("paper")), "admission target stage is not paper"),
        (there & F.col("has_run").isNull(), "portfolio execution run is missing"),
        (there & F.col("r_halted"), "portfolio execution run is halted"),
        (there & ~valid, F.concat(F.lit("reproducibility certificate is invalid: "), F.coalesce("c_reason", F.lit("missing")))),
        (there & valid & ~F.col("c_id").eqNullSafe(F.col("certificate_id")), "admission certificate identity does not match persisted certificate"),
        (there & ~F.coalesce("intact", F.lit(False)), "durable paper admission verification failed"),
    )
    return df.select("run_id", "strategy_id", why.alias("reasons")).withColumn("valid", F.size("reasons") == 0)


def successor_handoff(
    requests: DataFrame, lifecycle: DataFrame, runs: DataFrame, members: DataFrame,
    experiments: DataFrame, evidence: DataFrame, verification: DataFrame, certificates: DataFrame,
) -> DataFrame:
    """GT7: requests(strategy_id, run_id) against seven tables by left joins on their keys.

    ``certificates`` has the stored ``certificate_id`` and the recomputed ``integrity_id``.  A missing run or portfolio ends the check, so later rules are guarded by it.
    """
    life = lifecycle.select("strategy_id", F.col("stage").alias("life_stage"))
    run = runs.select("run_id", "portfolio_id", "halted")
    known = members.select("portfolio_id").distinct().withColumn("has_portfolio", F.lit(True))
    member = members.select("portfolio_id", "strategy_id", "experiment_id").withColumn("is_member", F.lit(True))
    exp = experiments.select("experiment_id", F.col("strategy_id").alias("exp_strategy"))
    ev = evidence.select(
        "experiment_id", F.get_json_object("evidence", "$.promotion.eligible").alias("ev_eligible")
    ).withColumn("has_evidence", F.lit(True))
    check = verification.select("run_id", F.col("valid").alias("v_ok"), F.col("reason").alias("v_reason"))
    cert = certificates.select(
        "run_id", F.col("valid").alias("c_ok"), F.col("reason").alias("c_reason"), F.col("certificate_id").alias("c_stored"), F.col("integrity_id").alias("c_found")
    )
    df = (
        requests.join(life, "strategy_id", "left").join(run, "run_id", "left")
        .join(known, "portfolio_id", "left").join(member, ["portfolio_id", "strategy_id"], "left")
        .join(exp, "experiment_id", "left").join(ev, "experiment_id", "left")
        .join(check, "run_id", "left").join(cert, "run_id", "left")
    )
    has_run = F.col("portfolio_id").isNotNull()
    go = has_run & F.col("has_portfolio").isNotNull()
    has_exp = go & F.col("experiment_id").isNotNull()
    first = reasons(
        (F.col("life_stage").isNull(), "successor lifecycle state is missing"),
        (F.col("life_stage") != "promoted", "successor must be in promoted lifecycle stage"),
        (~has_run, "portfolio execution run is missing"),
        (F.col("halted"), "portfolio execution run is halted"),
        (has_run & ~go, "portfolio provenance is missing"),
        (go & F.col("is_member").isNull(), "successor is not a member of the persisted portfolio"),
        (go & F.col("experiment_id").isNull(), "successor experiment provenance is missing"),
        (has_exp & F.col("exp_strategy").isNull(), "successor experiment is missing"),
        (has_exp & (F.col("exp_strategy") != F.col("strategy_id")), "successor experiment identity does not match strategy"),
        (has_exp & F.col("has_evidence").isNull(), "successor evaluation evidence is missing"),
        (
            has_exp & F.col("has_evidence").isNotNull() & F.coalesce(F.col("ev_eligible") != "true", F.lit(True)),
            "successor promotion evidence is not eligible",
        ),
    )
    df = df.withColumn("_first", first)
    later = reasons(
        (
            go & (F.size("_first") == 0) & ~F.coalesce("v_ok", F.lit(False)),
            F.concat(F.lit("paper run verification failed: "), F.coalesce("v_reason", F.lit("not verified"))),
        ),
        (
            go & ~F.coalesce("c_ok", F.lit(False)),
            F.concat(F.lit("reproducibility certificate is invalid: "), F.coalesce("c_reason", F.lit("missing"))),
        ),
        (
            go & F.coalesce("c_ok", F.lit(False)) & ~F.coalesce(F.col("c_stored") == F.col("c_found"), F.lit(False)),
            "persisted reproducibility certificate identity is inconsistent",
        ),
    )
    return df.select(
        "strategy_id", "run_id", F.array_distinct(F.concat("_first", later)).alias("reasons")
    ).withColumn("handed_off", F.size("reasons") == 0)


def lifecycle_sync(current: DataFrame, evaluations: DataFrame, prefix: str = "candidate evaluation") -> DataFrame:
    """GT9: lifecycle events implied by an evaluation, numbered per strategy.

    ``current`` has (strategy_id, stage); a strategy without a stage starts in research.
    """
    df = evaluations.join(current.select("strategy_id", F.col("stage").alias("at")), "strategy_id", "left")

    def step(source: str | None, target: str, text: str) -> Column:
        return F.struct(
            F.lit(source).cast("string").alias("source_stage"), F.lit(target).alias("target_stage"),
            F.lit(f"{prefix}: {text}").alias("reason"),
        )

    new = F.col("at").isNull()
    research = new | (F.col("at") == "research")
    ok = F.coalesce("wf_passed", F.lit(False))
    promote = F.coalesce("promotion_eligible", F.lit(False))
    validated = (research & ok) | (F.col("at") == "validated")
    steps = F.filter(
        F.array(
            F.when(new, step(None, "research", "admitted")),
            F.when(research & ~ok, step("research", "degraded", "validation failed")),
            F.when(research & ok, step("research", "validated", "validation passed")),
            F.when(validated & promote, step("validated", "promoted", "promotion gates passed")),
        ),
        lambda s: s.isNotNull(),
    )
    return df.select("strategy_id", F.posexplode(steps).alias("seq", "s")).select("strategy_id", "seq", "s.*")


def replacement_evaluation(evaluated: DataFrame) -> DataFrame:
    """GT10: the same gates, but a replacement that is not eligible is rejected outright."""
    return evaluated.withColumn(
        "stage", F.when(F.col("promotion_eligible"), F.col("stage")).otherwise("reject")
    )


def experiment_rows(evaluated: DataFrame, dataset_id: str, dataset_version: str, seed: int,
                    key: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Experiment and evidence JSON of evaluated candidates."""
    df = evaluated.withColumns(
        {"dataset_id": F.lit(dataset_id), "dataset_version": F.lit(dataset_version), "seed": F.lit(seed)}
    )
    df = df.withColumn("experiment_id", content_id([*key, "dataset_id", "dataset_version", "seed"]))
    return df.select(
        "experiment_id", *key, "dataset_id", "dataset_version", "seed",
        F.col("stage").alias("status"), F.col("oos_sharpe").alias("score"),
        F.when(F.size("promotion_reasons") > 0, F.array_join("promotion_reasons", "; ")).alias("reason"),
        F.to_json(
            F.struct(
                F.struct(
                    F.col("promotion_eligible").alias("eligible"), F.col("promotion_reasons").alias("reasons"),
                    F.col("stage"),
                ).alias("promotion")
            )
        ).alias("evidence"),
    )

"""Research analytics: signals, priorities, budget, history, health (RS1-RS14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip01, finite, ratio, reasons, whole
from barloom.operators.ranking import distance_extremes, mean_distance

SIGNAL = ["strategy_id", "reason", "fitness", "robustness", "novelty", "uncertainty", "capacity_gap"]
# Fixed weights of the priority score.
WEIGHTS = {"fitness": 0.20, "robustness": 0.15, "novelty": 0.25, "uncertainty": 0.25, "capacity_gap": 0.15}


def _failed() -> Column:
    return ~(F.coalesce("wf_passed", F.lit(False)) & F.coalesce("promotion_eligible", F.lit(False)))


def feedback_signals(evaluated: DataFrame, novelty: DataFrame) -> DataFrame:
    """RS1: one signal per evaluation; ``novelty`` (strategy_id, novelty) may miss candidates."""
    df = evaluated.join(novelty, "strategy_id", "left")
    eligible = F.coalesce("promotion_eligible", F.lit(False))
    reason = F.when(_failed(), "degraded").when(F.col("mc_simulations") <= 0, "halted").otherwise("capacity")
    fit = F.when(finite("fitness"), clip01(F.col("fitness"))).otherwise(0.0)
    unsure = F.when(F.col("mc_simulations") <= 0, 1.0).when(
        finite("mc_pass_rate"), clip01(F.lit(1.0) - F.col("mc_pass_rate"))
    ).otherwise(1.0)
    return df.select(
        "strategy_id", reason.alias("reason"), fit.alias("fitness"),
        F.when(F.coalesce("rob_passed", F.lit(False)), 1.0).otherwise(0.0).alias("robustness"),
        clip01(F.coalesce("novelty", F.lit(0.0))).alias("novelty"),
        unsure.alias("uncertainty"), F.when(eligible, 1.0).otherwise(0.0).alias("capacity_gap"),
    )


def plan_signals(evaluated: DataFrame, population_novelty: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """RS2: signals of a plan; a candidate outside the population leaves a capacity gap.

    ``extra`` adds the portfolio signals.
    """
    df = evaluated.join(population_novelty.withColumn("known", F.lit(True)), "strategy_id", "left")
    novelty = F.coalesce("novelty", F.lit(0.0))
    reason = (
        F.when(_failed(), "degraded").when(F.col("mc_simulations") == 0, "halted")
        .when(novelty < 0.25, "diversification").otherwise("capacity")
    )
    unsure = F.when(finite("mc_pass_rate"), F.lit(1.0) - F.col("mc_pass_rate")).otherwise(1.0)
    out = df.select(
        "strategy_id", reason.alias("reason"),
        F.when(finite("fitness"), F.greatest("fitness", F.lit(0.0))).otherwise(0.0).alias("fitness"),
        F.when(F.coalesce("rob_passed", F.lit(False)), 1.0).otherwise(0.0).alias("robustness"),
        F.greatest(novelty, F.lit(0.0)).alias("novelty"), clip01(unsure).alias("uncertainty"),
        F.when(F.col("known").isNull(), 1.0).otherwise(0.0).alias("capacity_gap"),
    )
    return out if extra is None else out.unionByName(extra.select(*SIGNAL))


def prioritize(signals: DataFrame, max_requests: int = 3, weights: dict[str, float] | None = None) -> DataFrame:
    """RS3: best signal per (strategy, reason), the ``max_requests`` highest scores as requests."""
    w = weights or WEIGHTS
    if any(v < 0 for v in w.values()) or sum(w.values()) <= 0:
        raise ValueError("research weights must be finite and non-negative, not all zero")
    if max_requests <= 0:
        raise ValueError("max_requests must be positive")
    score = sum((F.lit(v) * F.col(c) for c, v in w.items()), F.lit(0.0)) / F.lit(sum(w.values()))
    scored = signals.withColumn("score", score)
    best = scored.groupBy("strategy_id", "reason").agg(
        F.max("score").alias("score"),
        F.max_by(F.struct(*w), F.struct("score", *w)).alias("s"),
    )
    top = best.orderBy(F.desc("score"), "reason", F.coalesce("strategy_id", F.lit(""))).limit(max_requests)
    rank = F.greatest(F.lit(0), F.bround((F.lit(1.0) - clip01(F.col("score"))) * 1000).cast("int"))
    return top.select(
        F.concat(F.lit("research:"), "reason", F.lit(":"), F.coalesce("strategy_id", F.lit("global"))).alias("request_id"),
        F.col("strategy_id").alias("source_strategy_id"), "reason", rank.alias("priority"), "score", "s.*",
    )


def allocate_budget(
    requests: DataFrame, *, total: int = 100, minimum: int = 1, maximum: int = 60, plan: str = "plan_id"
) -> DataFrame:
    """RS4: integer units per request, proportional to the score, exact to the total where possible.

    Taking units away one by one removes the smallest score/units values first, giving them adds to
    the largest, so both are a rank over (request, unit) rows; a plan has few requests.
    """
    if total <= 0 or minimum <= 0 or maximum < minimum:
        raise ValueError("budget policy is not valid")
    w = whole([plan])
    raw = F.col("fitness") + F.col("robustness") + F.col("novelty") + F.col("uncertainty") + F.col("capacity_gap")
    df = requests.withColumn("raw", raw)
    df = df.withColumn("score", F.when(F.sum("raw").over(w) <= 0, F.lit(1.0)).otherwise(F.col("raw")))
    share = F.lit(float(total)) * F.col("score") / F.sum("score").over(w)
    df = df.withColumn("u0", F.greatest(F.lit(minimum), F.least(F.lit(maximum), F.floor(share).cast("int"))))
    df = df.withColumn("gap", F.sum("u0").over(w) - F.lit(total))
    steps = F.when(
        (F.col("gap") > 0) & (F.col("u0") > minimum), F.sequence(F.lit(minimum + 1), F.col("u0"))
    ).when((F.col("gap") < 0) & (F.col("u0") < maximum), F.sequence(F.col("u0"), F.lit(maximum - 1)))
    units = df.where(steps.isNotNull()).withColumn("u", F.explode(steps))
    value = F.col("score") / F.greatest("u", F.lit(1))
    take = F.row_number().over(Window.partitionBy(plan).orderBy(value.asc(), F.asc("request_id"), F.desc("u")))
    give = F.row_number().over(Window.partitionBy(plan).orderBy(value.desc(), F.asc("position"), F.asc("u")))
    moved = units.withColumn("r", F.when(F.col("gap") > 0, take).otherwise(give)).where(
        F.col("r") <= F.abs("gap")
    ).groupBy(plan, "request_id").agg(F.sum(F.when(F.col("gap") > 0, -1).otherwise(1)).alias("moved"))
    return df.join(moved, [plan, "request_id"], "left").select(
        plan, "request_id", (F.col("u0") + F.coalesce("moved", F.lit(0))).cast("bigint").alias("units"), "score"
    )


def work_items(requests: DataFrame, allocations: DataFrame) -> DataFrame:
    """RS5: request and budget; ``error`` marks a request without a positive budget."""
    df = requests.join(allocations.select("request_id", "units"), "request_id", "left")
    error = F.when(F.col("units").isNull(), F.concat(F.lit("missing allocation for research request: "), "request_id")).when(
        F.col("units") <= 0, "research work must have positive budget"
    )
    return df.withColumn("error", error).withColumnRenamed("units", "budget_units")


def pending(queue: DataFrame) -> DataFrame:
    """RS6: lowest priority number per request id, the earliest entry on a tie (``enqueued`` order)."""
    rest = [c for c in queue.columns if c != "request_id"]
    best = queue.where((F.col("request_id") != "") & (F.col("priority") >= 0)).groupBy("request_id").agg(
        F.min_by(F.struct(*rest), F.struct("priority", "enqueued")).alias("r")
    )
    return best.select("request_id", "r.*").orderBy("priority", "request_id")


def generation_metrics(evaluated: DataFrame) -> DataFrame:
    """RS7: counts and fitness per generation; ``selected`` and ``promotion_eligible`` are flags."""
    return evaluated.groupBy("generation").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.sum(F.when(F.col("promotion_eligible"), 1).otherwise(0)).cast("bigint").alias("eligible_count"),
        F.sum(F.when(F.col("selected"), 1).otherwise(0)).cast("bigint").alias("selected_count"),
        F.max("fitness").alias("best_fitness"), F.avg("fitness").alias("mean_fitness"),
    )


def generation_history(
    evaluated: DataFrame, specs: DataFrame, *, epsilon: float = 0.0
) -> DataFrame:
    """RS8: metrics, genome distances, new ids, best id and generations without improvement.

    ``evaluated``: (generation, strategy_id, fitness, selected, promotion_eligible);
    ``specs``: (generation, strategy_id, spec columns).
    """
    base = generation_metrics(evaluated)
    best = evaluated.groupBy("generation").agg(
        F.max(F.struct("fitness", "strategy_id")).alias("b")
    ).select("generation", F.col("b.strategy_id").alias("best_strategy_id"))
    first = evaluated.groupBy("strategy_id").agg(F.min("generation").alias("generation"))
    new = first.groupBy("generation").agg(F.count(F.lit(1)).alias("new_strategy_count"))
    unique = evaluated.groupBy("generation").agg(F.count_distinct("strategy_id").alias("unique_strategy_count"))
    dist = mean_distance(specs, ["generation"]).drop("members").join(
        distance_extremes(specs, ["generation"]), "generation"
    )
    df = base.join(best, "generation").join(new, "generation", "left").join(unique, "generation").join(dist, "generation")
    df = df.withColumn("new_strategy_count", F.coalesce("new_strategy_count", F.lit(0)))
    # One row per generation is left here.
    w = Window.partitionBy(F.lit(1)).orderBy("generation")
    past = F.max("best_fitness").over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = past.isNull() | (F.col("best_fitness") > past + F.lit(epsilon))
    df = df.withColumn("_island", F.sum(F.when(better, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy("_island").orderBy("generation")) - 1
    return df.withColumn("generations_without_improvement", streak.cast("bigint")).drop("_island")


def research_health(
    history: DataFrame, *, min_unique: float = 0.75, min_novel: float = 0.10, min_distance: float = 0.05,
    max_stagnation: int = 3, min_eligible: float = 0.05, mutation_rate: float = 0.5, crossover_rate: float = 0.5,
    mutation_saturation: float = 0.90, crossover_floor: float = 0.10,
) -> DataFrame:
    """RS9: ratios, flags, status and decision per generation."""
    n = F.col("candidate_count")
    df = history.withColumns(
        {
            "unique_ratio": ratio("unique_strategy_count", n), "novel_ratio": ratio("new_strategy_count", n),
            "eligible_ratio": ratio("eligible_count", n),
        }
    )
    collapsed = F.col("mean_distance") < min_distance
    exhausted = F.col("novel_ratio") < min_novel
    stagnating = F.col("generations_without_improvement") >= max_stagnation
    no_promotion = F.col("eligible_ratio") < min_eligible
    saturated = F.lit(mutation_rate >= mutation_saturation and crossover_rate <= crossover_floor)
    why = reasons(
        (F.col("unique_ratio") < min_unique, "strategy uniqueness is below threshold"),
        (collapsed, "genome diversity is below threshold"),
        (exhausted, "strategy novelty is below threshold"),
        (stagnating, "fitness improvement has stagnated"),
        (no_promotion, "promotion eligibility is below threshold"),
        (saturated, "adaptive exploration pressure is saturated"),
    )
    critical = (collapsed & exhausted) | stagnating | no_promotion
    warn = F.size("reasons") > 0
    return df.withColumn("reasons", why).withColumns(
        {
            "status": F.when(critical, "critical").when(warn, "warning").otherwise("healthy"),
            "decision": F.when(critical, "pause_research").when(warn, "increase_exploration").otherwise("continue"),
            "execution_authority": F.lit(False),
        }
    )


def next_action(health: DataFrame, *, min_generations: int = 1, require_candidate: bool = True) -> DataFrame:
    """RS10: action and reasons."""
    none = F.array().cast("array<string>")
    waiting = F.col("generation") + 1 < min_generations
    empty = F.lit(require_candidate) & (F.col("eligible_count") <= 0)
    action = (
        F.when(F.col("decision") == "pause_research", "pause_research")
        .when(F.col("decision") == "increase_exploration", "increase_exploration")
        .when(waiting | empty, "continue_research").otherwise("ready_for_robustness_review")
    )
    extra = (
        F.when(F.col("decision") != "continue", none)
        .when(waiting, F.array(F.lit("minimum research generations have not been completed")))
        .when(empty, F.array(F.lit("no promotion-eligible candidate is available for robustness review")))
        .otherwise(F.array(F.lit("research health is healthy and review prerequisites are satisfied")))
    )
    return health.withColumns({"action": action, "schedule_reasons": F.concat("reasons", extra)})


def replacement_work(requests: DataFrame, stages: DataFrame, cycles: DataFrame, limit: int = 10) -> DataFrame:
    """RS11: degraded requests whose source exists - completed if a cycle ran, ready if still degraded."""
    if limit < 1:
        raise ValueError("limit must be positive")
    s = stages.select(F.col("strategy_id").alias("source_strategy_id"), F.col("stage").alias("src_stage"))
    c = cycles.select("request_id").distinct().withColumn("done", F.lit(True))
    df = requests.where(F.col("reason") == "degraded").join(s, "source_strategy_id").join(c, "request_id", "left")
    status = F.when(F.col("done"), "completed").when(F.col("src_stage") == "degraded", "ready")
    df = df.withColumn("status", status).where(F.col("status").isNotNull())
    return df.orderBy("priority", "request_id").limit(limit).select(
        "request_id", F.col("source_strategy_id").alias("strategy_id"), "reason", "status"
    )


def operator_summary(experiments: DataFrame, cycles: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """RS12: one row of counts and latest ids; promoted experiments are counted from their evidence."""
    e = experiments.agg(
        F.count(F.lit(1)).alias("experiment_count"),
        F.sum(F.when(F.col("status") == "eligible", 1).otherwise(0)).cast("bigint").alias("ranked_experiment_count"),
        F.sum(F.when(F.get_json_object("evidence", "$.promotion.eligible") == "true", 1).otherwise(0)).cast("bigint").alias("promotion_eligible_count"),
    ).withColumn("one", F.lit(1))
    newest = F.struct("generation", "cycle_id")
    c = cycles.agg(
        F.count(F.lit(1)).alias("cycle_count"), F.max(newest).alias("latest"),
    ).select(F.lit(1).alias("one"), "cycle_count", F.col("latest.cycle_id").alias("latest_cycle_id"), F.col("latest.generation").alias("latest_generation"))
    k = checkpoints.agg(F.max("next_generation").alias("checkpoint_generation")).withColumn("one", F.lit(1))
    # Three single-row aggregates side by side.
    return e.join(c, "one").join(k, "one").drop("one").withColumn(
        "checkpoint_present", F.col("checkpoint_generation").isNotNull()
    )


def payload_digest(df: DataFrame, columns: list[str], out: str = "payload_digest") -> DataFrame:
    """RS13, RS14: SHA-256 of the canonical JSON of nested columns."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return df.withColumn(out, F.sha2(body, 256))


def generation_provenance(evaluated: DataFrame, specs: DataFrame, evidence: list[str], seed: int = 0) -> DataFrame:
    """RS14: genome and evaluation digests of every candidate."""
    from barloom.sources.schemas import SPEC_FIELDS

    genome = payload_digest(specs, list(SPEC_FIELDS), "genome_digest").select("strategy_id", "genome_digest")
    ev = payload_digest(evaluated, evidence, "evaluation_digest")
    return ev.join(genome, "strategy_id").withColumn("seed", F.lit(seed))

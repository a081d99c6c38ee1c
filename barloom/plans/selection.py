"""Registered queries: specs, sweeps, genome distances, ranking and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import gates, ranking, sweeps
from barloom.operators.specs import spec_problems, with_strategy_id
from barloom.plans import fixtures as fx
from barloom.plans.core import r6
from barloom.session import cut
from barloom.sources import bars as src
from barloom.sources.schemas import SPEC_FIELDS


def spec_checks(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_part_specs(spark, sf)
    keyed = raw.withColumn("strategy_id", F.col("part").cast("string"))
    p = spec_problems(keyed)
    return p.select(F.col("strategy_id").alias("part"), F.array_join("reasons", "; ").alias("reasons"))


def seed_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """RK9: distinct content ids against rows, per brand."""
    s = with_strategy_id(fx.raw_part_specs(spark, sf).select("part", *SPEC_FIELDS))
    return s.groupBy("name").agg(
        F.count(F.lit(1)).alias("specs"), F.count_distinct("strategy_id").alias("seeds")
    )


def genome_novelty(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.part_specs(spark, sf)
    n = ranking.novelty(s).join(s, "strategy_id")
    ind = F.col("indicators")[0]
    return n.groupBy("name", F.col("universe")[0].alias("symbol"), ind["kind"].alias("kind"), ind["period"].alias("period")).agg(
        r6(F.max("novelty")).alias("novelty")
    )


def genome_distances(spark: SparkSession, sf: str) -> DataFrame:
    """RS8 part: mean, smallest and largest distance inside each brand's population."""
    s = fx.part_specs(spark, sf)
    ext = ranking.distance_extremes(s, ["name"])
    return ranking.mean_distance(s, ["name"]).join(ext, "name").select(
        "name", "members", r6("mean_distance").alias("mean_distance"),
        r6("min_distance").alias("min_distance"), r6("max_distance").alias("max_distance"),
    )


def sweep_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    n = sweeps.neighbours(fx.part_specs(spark, sf))
    return n.groupBy("name", "operator").agg(
        F.count(F.lit(1)).alias("variants"),
        F.sum(F.col("indicators")[0]["period"]).cast("bigint").alias("period_sum"),
        r6(F.sum(F.coalesce(F.col("entry.all")[0]["right_num"], F.lit(0.0)))).alias("threshold_sum"),
        F.sum(F.when(F.col("entry.all")[0]["comparator"] == "crosses_above", 1).otherwise(0)).cast("bigint").alias("crosses"),
        r6(F.sum("position_sizing.value")).alias("value_sum"),
    )


def crossover_children(spark: SparkSession, sf: str) -> DataFrame:
    """SW6 over hash-ordered pairs; checked by the rules every child must keep."""
    s = fx.part_specs(spark, sf)
    kids = sweeps.crossover(sweeps.hash_pairs(s, seed=5, rounds=1), s, seed=5)
    a = s.select(F.col("strategy_id").alias("a_id"), F.struct(*SPEC_FIELDS).alias("pa"))
    b = s.select(F.col("strategy_id").alias("b_id"), F.struct(*SPEC_FIELDS).alias("pb"))
    j = kids.join(a, "a_id").join(b, "b_id")
    return j.agg(
        F.count(F.lit(1)).alias("children"),
        F.bool_and((F.col("universe") == F.col("pa.universe")) | (F.col("universe") == F.col("pb.universe"))).alias("universe_ok"),
        F.bool_and((F.col("position_sizing") == F.col("pa.position_sizing")) | (F.col("position_sizing") == F.col("pb.position_sizing"))).alias("sizing_ok"),
        F.bool_and((F.size("entry.all") == 1) & (F.size("entry.any") == 0)).alias("one_condition"),
        F.bool_and(F.col("version") == F.greatest("pa.version", "pb.version") + 1).alias("version_ok"),
        F.bool_and(F.col("metadata")["evolution_operator"] == "crossover").alias("marked"),
    )


def next_population(spark: SparkSession, sf: str) -> DataFrame:
    """SW7: next generation of the part population; the pool is in order of name and period."""
    s = fx.part_specs(spark, sf).withColumn("place", F.format_string("%s/%06d", "name", F.col("indicators")[0]["period"]))
    lineage = s.select("strategy_id", F.lit(0).alias("generation"))
    kids = sweeps.evolve(s, lineage, 200, seed=11, crossover_rate=0.25, elite=20, pool_rank="place")
    kind = F.when(F.col("operator").isin("elite", "crossover"), F.col("operator")).otherwise("mutation")
    elite = F.when(F.col("operator") == "elite", F.format_string("%s/%06d", "name", F.col("indicators")[0]["period"]))
    return kids.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("strategy_id").alias("unique_ids"),
        F.min("generation").alias("min_generation"), F.max("generation").alias("max_generation"),
        F.max(F.size("parent_ids")).alias("parents"), F.min(elite).alias("first_elite"), F.max(elite).alias("last_elite"),
    )


def replacement_templates(spark: SparkSession, sf: str) -> DataFrame:
    """SW1: one request per losing supplier; every fourth one only allows trend templates."""
    req = src.table(spark, sf, "supplier").select(
        F.concat(F.lit("req-"), F.col("s_suppkey").cast("string")).alias("request_id"),
        F.col("s_suppkey").cast("string").alias("source_strategy_id"),
        F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("trend_only"))).otherwise(F.array(F.lit("avoid_known_failure"))).alias("constraints"),
    )
    t = sweeps.replacement_templates(spark, req, ["X"])
    return t.select(
        "request_id", "parent_strategy_id", "mutation", "name",
        F.col("indicators")[0]["kind"].alias("kind"), F.col("indicators")[0]["period"].cast("bigint").alias("fast"),
        F.col("indicators")[1]["period"].cast("bigint").alias("slow"),
    )


def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    g = fx.evidence(spark, sf).select(
        "candidate_id", (F.col("fitness") > -1.0).alias("eligible"), "fitness",
        F.col("rob_ratio").alias("robustness"), F.col("mc_pass_rate").alias("diversity"),
    )
    r = ranking.rank_candidates(g)
    return r.select("candidate_id", "rank", r6("final_score").alias("final_score"))


OBJECTIVES = ["fitness", "neg_drawdown", "mc_pass_rate", "rob_ratio", "regime_score"]


def with_objectives(df: DataFrame) -> DataFrame:
    """The drawdown is signed, so its negative rewards a deeper one; that is the kept rule."""
    return df.withColumn("neg_drawdown", -F.col("train_drawdown"))


def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    s = with_objectives(fx.evidence(spark, sf))
    return ranking.pareto_front(s, OBJECTIVES).select("candidate_id", r6("fitness").alias("fitness"))


def part_pareto(spark: SparkSession, sf: str) -> DataFrame:
    """The same operator on line items: cheap, large, recent; with heavy ties."""
    r = src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("q"), (-F.col("l_extendedprice")).alias("p"), F.col("l_discount").alias("d"),
    )
    return ranking.pareto_front(r, ["q", "p", "d"]).select("l_orderkey", "l_linenumber", "l_partkey")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """GT5: promotion-ready experiments, the best 50."""
    e = cut(gates.experiment_rows(fx.gated(spark, sf), "bars_supplier", "v1", 3, key=("candidate_id",)))
    top = gates.catalog(e.drop("evidence"), e.select("experiment_id", "evidence"), limit=50)
    return top.select("candidate_id", "dataset_id", r6("score").alias("score"))


def rank_experiments(spark: SparkSession, sf: str) -> DataFrame:
    e = gates.experiment_rows(fx.gated(spark, sf), "bars_supplier", "v1", 3, key=("candidate_id",))
    return ranking.rank_experiments(e, "bars_supplier", 25, status="research").select(
        "candidate_id", r6("score").alias("score"), "status", "reason"
    )


def selection_eligible(spark: SparkSession, sf: str) -> DataFrame:
    g = fx.gated(spark, sf)
    signed = gates.selection_eligible(max_drawdown=0.05, min_ratio=0.9)
    size = gates.selection_eligible(max_drawdown=0.05, min_ratio=0.9, drawdown="magnitude")
    return g.select("candidate_id", signed.alias("eligible"), size.alias("eligible_by_size"))


def selected_population(spark: SparkSession, sf: str) -> DataFrame:
    """RK7 without the diversity step: the Pareto front first, then by rank, 60 candidates."""
    s = with_objectives(fx.evidence(spark, sf))
    p = ranking.select_population(s, None, 60, preserve_diversity=False, objectives=OBJECTIVES)
    return p.select("candidate_id", F.col("tier").cast("bigint").alias("tier"))


def diverse_population(spark: SparkSession, sf: str) -> DataFrame:
    """RK6/RK7: max-min diverse part specs; fitness read from the period, ties settled by a draw over the genes."""
    s = fx.part_specs(spark, sf)
    first, second = F.col("indicators")[0], F.get("indicators", 1)
    level = F.coalesce(second["period"].cast("string"), F.format_string("%.0f", F.get("entry.all", 0)["right_num"]))
    genes = F.concat_ws(
        "|", "name", F.col("universe")[0], first["kind"], first["period"].cast("string"), level, F.format_string("%.2f", "position_sizing.max_position"),
    )
    e = s.select(
        F.col("strategy_id").alias("candidate_id"), (first["period"] / 50.0).alias("fitness"),
        (F.conv(F.substring(F.md5(genes), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)).alias("mc_pass_rate"), F.lit(1.0).alias("rob_ratio"), F.lit(0.0).alias("regime_score"),
    )
    p = ranking.select_population(e, s, 12, minimum_distance=0.2)
    return p.groupBy("tier").agg(F.count(F.lit(1)).alias("members"), r6(F.max("fitness")).alias("best"), r6(F.sum("mc_pass_rate")).alias("draws"))


QUERIES = {
    "spec_checks": spec_checks,
    "seed_dedupe": seed_dedupe,
    "genome_novelty": genome_novelty,
    "genome_distances": genome_distances,
    "sweep_neighbours": sweep_neighbours,
    "crossover_children": crossover_children,
    "next_population": next_population,
    "replacement_templates": replacement_templates,
    "rank_candidates": rank_candidates,
    "pareto_front": pareto_front,
    "part_pareto": part_pareto,
    "catalog": catalog,
    "rank_experiments": rank_experiments,
    "selection_eligible": selection_eligible,
    "selected_population": selected_population,
    "diverse_population": diverse_population,
}

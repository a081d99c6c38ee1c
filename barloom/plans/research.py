"""Registered queries: research signals, budget, generations, gates on records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import digest_of, digest_parts
from barloom.operators import gates, ranking
from barloom.operators import research as rs
from barloom.operators.specs import demo_records, spec_table
from barloom.plans import fixtures as fx
from barloom.plans.core import r6
from barloom.session import cut
from barloom.sources import bars as src
from barloom.sources.schemas import SPEC_FIELDS


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Gated scores keyed by candidate."""
    return fx.gated(spark, sf).drop("strategy_id").withColumnRenamed("candidate_id", "strategy_id")


def peers(evaluated: DataFrame) -> DataFrame:
    """Novelty of all candidates: mean distance of a genome (the spec with its symbol as universe) to all others."""
    specs = spec_table(evaluated.sparkSession, demo_records()).drop("strategy_id", "universe")
    genomes = evaluated.select("strategy_id", F.split("strategy_id", r"\|")[0].alias("name"), F.array("symbol").alias("universe")).join(F.broadcast(specs), "name")
    return ranking.novelty(genomes)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "strategy_id", "reason", *[r6(c).alias(c) for c in rs.SIGNAL if c not in ("strategy_id", "reason")]
    )


def research_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = judged(spark, sf)
    return rounded(rs.feedback_signals(e, peers(e)))


def plan_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = judged(spark, sf)
    return rounded(rs.plan_signals(e, peers(e)))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = judged(spark, sf)
    return rs.prioritize(rs.plan_signals(e, peers(e)), 40)


def research_priority(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf)
    return r.select("request_id", "source_strategy_id", "reason", F.col("priority").cast("bigint").alias("priority"), r6("score").alias("score"))


def planned(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of one plan per reason, in priority order."""
    w = Window.partitionBy("plan_id").orderBy(F.desc("score"), "request_id")
    r = requests(spark, sf).withColumn("plan_id", F.col("reason"))
    return r.withColumn("position", F.row_number().over(w))


def research_budget(spark: SparkSession, sf: str) -> DataFrame:
    b = rs.allocate_budget(planned(spark, sf), total=100, minimum=1, maximum=60)
    return b.select("plan_id", "request_id", "units", r6("score").alias("score"))


def work_items(spark: SparkSession, sf: str) -> DataFrame:
    p = cut(planned(spark, sf))
    w = rs.work_items(p, rs.allocate_budget(p).where(~F.col("request_id").endswith("7")))
    return w.select("request_id", F.col("budget_units").cast("double").alias("budget_units"), "error")


def research_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = src.table(spark, sf, "events").select(
        F.concat(F.lit("req-"), (F.col("user_id") % 97).cast("string")).alias("request_id"),
        F.floor("value").cast("bigint").alias("priority"), F.col("event_id").alias("enqueued"), F.col("event_type").alias("reason"),
    )
    return rs.pending(q)


def generations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Part specs by brand generation; even periods survive into the next one."""
    s = fx.part_specs(spark, sf)
    period = F.col("indicators")[0]["period"]
    level = F.coalesce(F.get("indicators", F.lit(1))["period"].cast("int"), F.col("entry.all")[0]["right_num"].cast("int"))
    text = F.concat_ws(
        "|", "name", F.col("universe")[0], F.col("indicators")[0]["kind"], period.cast("string"), level.cast("string"),
    )
    own = F.substring("name", 7, 3).cast("int")
    s = s.withColumn("strategy_id", text).withColumn(
        "generation", F.explode(F.when(period % 2 == 0, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    fit = ((period * 37 + F.col("generation") * 13) % 101) / F.lit(50.0) - 1.0
    e = s.select(
        "generation", "strategy_id", fit.alias("fitness"), (fit > 0).alias("selected"), (fit > 0.9).alias("promotion_eligible")
    )
    return e, s.select("generation", "strategy_id", *SPEC_FIELDS)


def history(spark: SparkSession, sf: str) -> DataFrame:
    e, s = generations(spark, sf)
    return rs.generation_history(cut(e), cut(s))


def generation_history(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return h.select(
        "generation", "candidate_count", "eligible_count", "selected_count", "unique_strategy_count", "new_strategy_count",
        "best_strategy_id", "generations_without_improvement",
        *[r6(c).alias(c) for c in ("best_fitness", "mean_fitness", "mean_distance", "min_distance", "max_distance")],
    )


def research_health(spark: SparkSession, sf: str) -> DataFrame:
    h = rs.next_action(rs.research_health(history(spark, sf), min_novel=0.5, max_stagnation=4), min_generations=3)
    return h.select(
        "generation", "status", "decision", "action", F.array_join("schedule_reasons", "; ").alias("reasons")
    )


def replacement_work(spark: SparkSession, sf: str) -> DataFrame:
    s = src.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    req = s.select(
        F.concat(F.lit("req-"), key.cast("string")).alias("request_id"), key.cast("string").alias("source_strategy_id"),
        F.when(key % 5 == 0, "capacity").otherwise("degraded").alias("reason"), (key % 4).alias("priority"),
    )
    stages = s.where(F.col("s_acctbal") >= 0).select(key.cast("string").alias("strategy_id"), F.when(key % 3 == 0, "paper").otherwise("degraded").alias("stage"))
    cycles = s.where(F.col("s_acctbal") > 8000).select(F.concat(F.lit("req-"), key.cast("string")).alias("request_id"))
    return rs.replacement_work(req, stages, cycles, limit=30)


def operator_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = gates.experiment_rows(fx.gated(spark, sf), "bars_supplier", "v1", 3, key=("candidate_id",))
    o = src.table(spark, sf, "orders")
    cycles = o.select(F.col("o_orderkey").cast("string").alias("cycle_id"), F.col("o_orderkey").alias("generation"))
    checkpoints = o.where(F.col("o_orderstatus") == "F").select((F.col("o_orderkey") + 1).alias("next_generation"))
    return rs.operator_summary(e, cycles, checkpoints)


def provenance_digests(spark: SparkSession, sf: str) -> DataFrame:
    """RS13/RS14: equal specs share a genome digest, and each evaluation digest follows its evidence."""
    e, s = generations(spark, sf)
    first = s.dropDuplicates(["strategy_id"]).drop("generation")
    p = rs.generation_provenance(e, first, ["fitness", "selected", "promotion_eligible"], seed=3)
    digests = p.groupBy("generation").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("evaluation_digest").alias("evaluations"),
        *digest_parts(["strategy_id", "genome_digest", "evaluation_digest"]),
    )
    return digests.select("generation", "records", "evaluations", digest_of("records").alias("digest"))


def robustness_review(spark: SparkSession, sf: str) -> DataFrame:
    e = judged(spark, sf).withColumns(
        {"genome_digest": F.sha2("strategy_id", 256), "evaluation_digest": F.sha2(F.col("symbol"), 256)}
    )
    prov = e.where(~F.col("symbol").endswith("4")).select(
        "strategy_id", (F.length("symbol")).alias("generation"), F.lit(3).alias("seed"),
        F.when(F.col("symbol").endswith("5"), F.lit("x")).otherwise(F.col("genome_digest")).alias("genome_digest"), "evaluation_digest",
    )
    sched = prov.select("generation").distinct().select(
        "generation", F.when(F.col("generation") == 1, "pause_research").otherwise("ready_for_robustness_review").alias("action"),
        F.lit(False).alias("execution_authority"),
    )
    r = gates.robustness_review(cut(e), prov, sched)
    return r.select("strategy_id", "decision", F.array_join("review_reasons", "; ").alias("reasons"))


def successor_admission(spark: SparkSession, sf: str) -> DataFrame:
    e = cut(judged(spark, sf))
    none = F.array().cast("array<string>")
    cand = e.select(
        "strategy_id", F.length("symbol").alias("lineage_generation"),
        F.when(F.col("symbol").endswith("1"), none).otherwise(F.array("symbol")).alias("parent_ids"),
    )
    existing = e.where(F.col("symbol").endswith("2")).select("strategy_id")
    a = gates.successor_admission(cand, e, existing, generation=1)
    return a.select("strategy_id", "admitted", "stage", F.array_join("reasons", "; ").alias("reasons"), "error")


def lifecycle_sync(spark: SparkSession, sf: str) -> DataFrame:
    e = cut(judged(spark, sf))
    at = e.where(F.col("symbol").endswith("8")).select("strategy_id", F.lit("validated").alias("stage")).unionByName(
        e.where(F.col("symbol").endswith("9")).select("strategy_id", F.lit("paper").alias("stage"))
    )
    return gates.lifecycle_sync(at, e).select(
        "strategy_id", F.col("seq").cast("bigint").alias("seq"), "source_stage", "target_stage", "reason"
    )


def replacement_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    e = gates.replacement_evaluation(judged(spark, sf))
    return e.groupBy("stage").agg(F.count(F.lit(1)).alias("candidates"))


def paper_admission(spark: SparkSession, sf: str) -> DataFrame:
    """GT6: customers ask for admission with their orders as runs and line items as certificates."""
    o = src.table(spark, sf, "orders")
    adm = o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("strategy_id"),
        F.when(F.col("o_custkey") % 6 == 0, "research").otherwise("promoted").alias("source_stage"),
    )
    runs = o.where(F.col("o_orderpriority") != "5-LOW").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("halted"))
    cert = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum("l_linenumber").alias("n")).select(
        "run_id", F.concat(F.lit("c"), F.col("run_id").cast("string")).alias("certificate_id"), (F.col("n") % 5 != 0).alias("verified"),
        F.when(F.col("n") % 7 == 0, "").otherwise("v1").alias("dataset_version"), F.lit("b1").alias("data_bundle_version"), F.lit("e1").alias("execution_fingerprint"),
    )
    a = gates.paper_admission(adm, runs, cert)
    return a.groupBy(F.array_join("reasons", "; ").alias("reasons"), "admitted").agg(F.count(F.lit(1)).alias("admissions"))


def successor_handoff(spark: SparkSession, sf: str) -> DataFrame:
    """GT7 over orders as requests; every rule is broken by some rows."""
    o = src.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = c.cast("string")
    req = o.select(text.alias("strategy_id"), k.alias("run_id"))
    life = src.table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").cast("string").alias("strategy_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "paper").otherwise("promoted").alias("stage"),
    )
    runs = o.where(F.col("o_orderpriority") != "5-LOW").select(k.alias("run_id"), (k % 50).alias("portfolio_id"), (k % 8 == 0).alias("halted"))
    members = o.where(F.col("o_orderstatus") != "P").select((k % 50).alias("portfolio_id"), text.alias("strategy_id"), text.alias("experiment_id")).distinct()
    exp = members.select("experiment_id", "strategy_id").distinct()
    ev = exp.select("experiment_id", F.when(F.col("experiment_id").endswith("3"), '{"promotion":{"eligible":false}}').otherwise('{"promotion":{"eligible":true}}').alias("evidence"))
    ver = runs.select("run_id", (F.col("run_id") % 6 != 0).alias("valid"), F.lit("ledger fingerprint mismatch").alias("reason"))
    cert = o.where(F.col("o_orderpriority") != "3-MEDIUM").select(
        k.alias("run_id"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"), k.cast("string").alias("certificate_id"),
        F.when(k % 11 != 0, k.cast("string")).otherwise("other").alias("integrity_id"),
    )
    h = gates.successor_handoff(req, life, runs, members, exp, ev, ver, cert)
    return h.groupBy(F.array_join("reasons", "; ").alias("reasons"), "handed_off").agg(F.count(F.lit(1)).alias("requests"))


def paper_replay(spark: SparkSession, sf: str) -> DataFrame:
    """GT6: stored admissions of all orders replayed; some are missing, altered or lack their run or certificate."""
    o = src.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    stored = o.where(F.col("o_orderstatus") != "P").select(
        k.alias("run_id"), F.col("o_custkey").cast("string").alias("strategy_id"), F.when(k % 9 == 0, "paper").otherwise("promoted").alias("source_stage"),
        F.when(k % 10 == 0, "live").otherwise("paper").alias("target_stage"), F.concat(F.lit("c"), (k % 1000).cast("string")).alias("certificate_id"),
    )
    stored = stored.withColumn("record_digest", gates.admission_digest())
    stored = stored.withColumn("strategy_id", F.when(F.col("run_id") % 13 == 0, F.lit("changed later")).otherwise(F.col("strategy_id")))
    runs = o.where(F.col("o_orderpriority") != "5-LOW").select(k.alias("run_id"), (k % 8 == 0).alias("halted"))
    cert = o.where(F.col("o_orderpriority") != "3-MEDIUM").select(
        k.alias("run_id"), (k % 6 != 0).alias("valid"), F.when(k % 6 == 0, "dataset version mismatch").alias("reason"),
        F.when(k % 7 == 0, F.lit("c?")).otherwise(F.concat(F.lit("c"), (k % 1000).cast("string"))).alias("certificate_id"),
    )
    r = gates.paper_replay(o.select(k.alias("run_id")), stored, runs, cert)
    return r.groupBy(F.array_join("reasons", "; ").alias("reasons"), "valid").agg(F.count(F.lit(1)).alias("runs"))


QUERIES = {
    "paper_replay": paper_replay,
    "research_signals": research_signals,
    "plan_signals": plan_signals,
    "research_priority": research_priority,
    "research_budget": research_budget,
    "work_items": work_items,
    "research_queue": research_queue,
    "generation_history": generation_history,
    "research_health": research_health,
    "replacement_work": replacement_work,
    "operator_summary": operator_summary,
    "provenance_digests": provenance_digests,
    "robustness_review": robustness_review,
    "successor_admission": successor_admission,
    "lifecycle_sync": lifecycle_sync,
    "replacement_evaluation": replacement_evaluation,
    "paper_admission": paper_admission,
    "successor_handoff": successor_handoff,
}

"""Registered queries: paper ledger, audit and run verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import evaluation as ev
from barloom.operators import identity, ledger
from barloom.operators import portfolio as pf
from barloom.operators.specs import demo_records
from barloom.plans.core import r2, r6, stamp
from barloom.session import cut
from barloom.sources import bars as src

G = "portfolio_id"
KEYS = [G, "strategy_id"]
LIMIT = 0.012
WEIGHT = 0.15


def event_flags(spark: SparkSession, sf: str) -> DataFrame:
    """One paper portfolio per event type; the demo specs are its sleeves."""
    flags = ev.compiled(demo_records())(src.bars_event(spark, sf), ("symbol",))
    return flags.withColumnRenamed("symbol", G)


def event_weights(flags: DataFrame) -> DataFrame:
    members = flags.select(*KEYS).distinct().withColumn("weight", F.lit(WEIGHT))
    return members.withColumn(
        "member_rank", F.row_number().over(Window.partitionBy(G).orderBy("strategy_id"))
    )


def paper(spark: SparkSession, sf: str, limit: float | None = LIMIT) -> dict[str, DataFrame]:
    flags = cut(event_flags(spark, sf))
    weights = event_weights(flags)
    out = ledger.paper_portfolio(flags, weights, max_drawdown=limit)
    return {**out, "weights": weights, "flags": flags}


def paper_fills(spark: SparkSession, sf: str) -> DataFrame:
    f = paper(spark, sf, None)["fills"]
    return f.select(
        *KEYS, stamp().alias("ts"), "action", F.col("phase").cast("bigint").alias("phase"), r6("quantity").alias("quantity"),
        r6("price").alias("price"), r6("fee").alias("fee"),
    )


def paper_equity(spark: SparkSession, sf: str) -> DataFrame:
    s = paper(spark, sf, None)["snapshots"]
    return s.select(G, stamp().alias("ts"), r2("equity").alias("equity"), r2("reserve").alias("reserve"))


def paper_halt(spark: SparkSession, sf: str) -> DataFrame:
    p = paper(spark, sf)
    fills = p["fills"].groupBy(G).agg(F.count(F.lit(1)).alias("fills"))
    return p["result"].join(fills, G).select(
        G, "halted", "halt_reason", stamp("end_ts").alias("end_ts"), r2("final_equity").alias("final_equity"), "fills"
    )


def paper_strategy(spark: SparkSession, sf: str) -> DataFrame:
    flags = event_flags(spark, sf).withColumn(
        "max_drawdown", F.when(F.col("strategy_id") == "rsi_14", F.lit(None).cast("double")).otherwise(F.lit(0.02))
    )
    s = ledger.paper_strategy(flags, KEYS)
    return s.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("snapshots"), r2(F.max_by("equity", "ts")).alias("final_equity"),
        F.bool_or("halted").alias("halted"), F.max("error").alias("error"),
    )


def sleeve_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """LG7 returns through PF10."""
    flags = cut(event_flags(spark, sf))
    r = cut(ledger.sleeve_returns(flags, KEYS))
    a = pf.attribution(r, event_weights(flags))
    return a.select(
        *KEYS, r6("return_contribution").alias("return_contribution"), r6(F.col("risk_contribution") * 1e3).alias("risk_permille")
    )


def audited(spark: SparkSession, sf: str, limit: float | None = LIMIT) -> dict[str, DataFrame]:
    p = paper(spark, sf, limit)
    p["events"] = cut(ledger.audit_events(p["fills"], p["weights"]))
    p["manifest"] = ledger.manifest(p["events"])
    p["cash"] = p["weights"].select(*KEYS, (F.lit(ledger.CASH) * F.col("weight")).alias("start_cash"))
    p["finals"] = p["result"].join(
        p["weights"].groupBy(G).agg((F.lit(ledger.CASH) * (1 - F.sum("weight"))).alias("reserve")), G
    ).select(G, (F.col("final_equity") - F.col("reserve")).alias("final_equity"))
    return p


def audit_manifest(spark: SparkSession, sf: str) -> DataFrame:
    p = audited(spark, sf, None)
    m = p["manifest"]
    return m.select(G, "event_count", F.col("error").isNull().alias("valid"), (F.length("ledger_fingerprint") == 16).alias("has_fingerprint"))


def fill_reasons(spark: SparkSession, sf: str) -> DataFrame:
    f = ledger.fill_reasons(audited(spark, sf, None)["events"])
    return f.groupBy(G, "strategy_id", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("fills"))


def halted_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """LG10 on the halted runs: sells before the halt bar have no authorising decision."""
    f = ledger.fill_reasons(audited(spark, sf)["events"])
    return f.groupBy(G, F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("fills"))


def ledger_replay(spark: SparkSession, sf: str) -> DataFrame:
    p = audited(spark, sf, None)
    r = ledger.replay(p["events"], p["cash"], p["finals"])
    return r.select(G, "valid", r2("ending_cash").alias("ending_cash"), "error")


def tampered_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The replay must name the right rule for each way of breaking the ledger."""
    p = audited(spark, sf, None)
    e = p["events"]
    edit = (
        e.withColumn("quantity", F.when((F.col(G) == "click") & (F.col("sequence") == 2), F.col("quantity") * 50).otherwise(F.col("quantity")))
        .withColumn("fee", F.when((F.col(G) == "error") & (F.col("sequence") == 1), F.lit(0.0)).otherwise(F.col("fee")))
        .withColumn("action", F.when((F.col(G) == "purchase") & (F.col("sequence") == 0), F.lit("hold")).otherwise(F.col("action")))
        .withColumn("fee", F.when((F.col(G) == "view") & (F.col("sequence") == 3), F.col("fee") * 2 + 1).otherwise(F.col("fee")))
    )
    r = ledger.replay(edit, p["cash"], p["finals"])
    return r.select(G, "valid", "error")


def verified_runs(p: dict[str, DataFrame]) -> DataFrame:
    """LG12 for the audited tables: stored commitments against recomputed ones; the ledger of the run ``view`` is altered."""
    m = p["manifest"].select(G, "event_count", "ledger_fingerprint")
    base = m.select(
        G, "event_count", F.when(F.col(G) == "view", F.lit("0" * 16)).otherwise(F.col("ledger_fingerprint")).alias("ledger_fingerprint"),
        F.lit(ledger.CASH).alias("initial_cash"), F.lit(1.0).alias("commission_bps"), F.lit("v1").alias("dataset_version"),
    )
    stored = ledger.run_identity(base)
    stored = stored.withColumns({"expected_run_id": F.col("run_id"), "expected_fingerprint": F.col("execution_fingerprint")})
    return ledger.verify_runs(stored, p["manifest"], ledger.replay(p["events"], p["cash"], p["finals"]), ledger.fill_reasons(p["events"]))


def run_verification(spark: SparkSession, sf: str) -> DataFrame:
    v = verified_runs(audited(spark, sf, None))
    return v.select(G, "event_count", "valid", "reason")


def payload_problems(spark: SparkSession, sf: str) -> DataFrame:
    """LG13 with two members removed from the definition."""
    p = audited(spark, sf, None)
    a = pf.attribution(cut(ledger.sleeve_returns(p["flags"], KEYS)), p["weights"])
    members = p["weights"].where(~F.col("strategy_id").isin("rsi_14") | (F.col(G) != "click")).where(
        ~F.col("strategy_id").isin("sma_5_20") | (F.col(G) != "view")
    )
    return ledger.payload_problems(a, p["events"], members)


def dataset_identity(spark: SparkSession, sf: str) -> DataFrame:
    d = identity.dataset_identity(src.bars_priority(spark, sf))
    return d.select("symbol", "rows", stamp("start").alias("start"), stamp("end").alias("end"), "version")


def bundle_identity(spark: SparkSession, sf: str) -> DataFrame:
    b = identity.bundle_identity(
        identity.dataset_identity(src.bars_supplier(spark, sf)), "suppliers", source="lineitem", timeframe="1d"
    )
    return b.select("dataset_id", "version", "rows", F.col("symbols").alias("symbols"), stamp("start").alias("start"), stamp("end").alias("end"))


def tamper_test(spark: SparkSession, sf: str) -> DataFrame:
    """FP3: changing one close of a series changes its fingerprint and no other."""
    b = cut(src.bars_priority(spark, sf))
    hit = b.groupBy("symbol").agg(F.max("ts").alias("hit"))
    changed = b.join(hit, "symbol").withColumn(
        "close", F.when((F.col("ts") == F.col("hit")) & F.col("symbol").isin("1-URGENT", "5-LOW"), F.col("close") + 0.5).otherwise(F.col("close"))
    ).drop("hit")
    return identity.changed(identity.dataset_identity(b), identity.dataset_identity(changed)).select("symbol", "matches")


QUERIES = {
    "dataset_identity": dataset_identity,
    "bundle_identity": bundle_identity,
    "tamper_test": tamper_test,
    "paper_fills": paper_fills,
    "paper_equity": paper_equity,
    "paper_halt": paper_halt,
    "paper_strategy": paper_strategy,
    "sleeve_attribution": sleeve_attribution,
    "audit_manifest": audit_manifest,
    "fill_reasons": fill_reasons,
    "halted_reasons": halted_reasons,
    "ledger_replay": ledger_replay,
    "tampered_replay": tampered_replay,
    "run_verification": run_verification,
    "payload_problems": payload_problems,
}

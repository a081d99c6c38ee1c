"""Registered queries: life cycle, chains, lineage, provenance, sinks, payloads, ticks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.operators import identity, ledger, lineage, ticks
from barloom.operators import lifecycle as lc
from barloom.operators import portfolio as pf
from barloom.plans import fixtures as fx
from barloom.plans import paper as paper_plan
from barloom.plans.core import r2, r6, stamp
from barloom.session import checkpoint_dir, cut
from barloom.sources import bars as src
from barloom.sources import payloads, sinks
from barloom.streaming import monitors

G = "portfolio_id"


# --- life cycle --------------------------------------------------------------
def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Stage changes per customer read from orders; many break the rules."""
    names = F.array(*[F.lit(s) for s in lc.STAGES])
    k = F.col("o_orderkey")
    return src.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("strategy_id"), k.alias("seq"),
        F.when(k % 10 > 0, F.get(names, (k % 7).cast("int"))).alias("source_stage"),
        F.get(names, (F.floor(k / 7) % 7).cast("int")).alias("target_stage"),
        F.col("o_orderpriority").alias("reason"),
    )


def lifecycle_violations(spark: SparkSession, sf: str) -> DataFrame:
    v = lc.transition_problems(stage_events(spark, sf))
    return v.groupBy("source_stage", "target_stage", "reason_text").agg(F.count(F.lit(1)).alias("events"))


def lifecycle_current(spark: SparkSession, sf: str) -> DataFrame:
    return lc.current_stage(stage_events(spark, sf))


def lifecycle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    g = lc.history_gaps(stage_events(spark, sf))
    return g.select("strategy_id", "seq", "source_stage", "prev_target_stage")


def hash_problems(spark: SparkSession, sf: str) -> DataFrame:
    """LC4: reasons of every 500th event are changed after hashing."""
    e = lc.with_event_hash(stage_events(spark, sf))
    e = e.withColumn("reason", F.when(F.col("seq") % 500 == 3, F.lit("edited")).otherwise(F.col("reason")))
    return lc.hash_problems(e).select("strategy_id", "seq", "reason")


def chain_audit(spark: SparkSession, sf: str) -> DataFrame:
    """LC5: one link altered every 2000 orders, one cycle missing every 3000, one entry twice every 5000."""
    cycles = src.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("cycle_id"), F.col("o_custkey").alias("generation"), "o_orderstatus",
        F.col("o_orderkey").alias("sequence"),
    )
    payload = ["cycle_id", "generation", "o_orderstatus"]
    audit = lc.chain(cycles, payload)
    audit = audit.withColumn("payload_digest", F.when(F.col("sequence") % 2000 == 7, F.lit("x")).otherwise(F.col("payload_digest")))
    audit = audit.where(F.col("sequence") % 3000 != 11)
    last = audit.where(F.col("sequence") % 5000 == 2).withColumn("sequence", F.col("sequence") + 10_000_000_000)
    a = audit.unionByName(last).select("sequence", "cycle_id", "generation", "payload_digest", "previous_digest")
    bad = lc.chain_audit(cut(a), cycles, payload)
    return bad.select("cycle_id", F.col("sequence").cast("double").alias("sequence"), "problem")


def event_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Health reports per user from events: a high value degrades, a very high one halts."""
    return src.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("strategy_id"), F.col("event_id").alias("seq"), "ts",
        (F.col("value") > 150).alias("degraded"), (F.col("value") > 300).alias("halt"),
        F.lit(30).alias("observations"), F.array(F.lit("maximum drawdown breached")).alias("reasons"),
    )


def health_states(spark: SparkSession, sf: str) -> DataFrame:
    s = lc.health_states(event_reports(spark, sf))
    moved = s.where(F.col("state") != F.col("previous_state"))
    return moved.select("strategy_id", "seq", "previous_state", "state")


def health_requests(spark: SparkSession, sf: str) -> DataFrame:
    r = lc.health_requests(lc.health_states(event_reports(spark, sf)))
    return r.select("strategy_id", "seq", "request_id", F.array_join("constraints", ",").alias("constraints"))


def feedback_problems(spark: SparkSession, sf: str) -> DataFrame:
    """LC8: the resulting state of some events is edited after fingerprinting."""
    r = lc.health_requests(lc.health_states(event_reports(spark, sf)))
    edited = r.withColumn("state", F.when(F.col("seq") % 3 == 0, F.lit("active")).otherwise(F.col("state")))
    return lc.feedback_problems(edited).select("strategy_id", "seq")


def portfolio_history(spark: SparkSession, sf: str) -> DataFrame:
    """PF12: newest health row per portfolio and the number of generations that did not increase."""
    h = src.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias(G), F.col("o_orderkey").alias("seq"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("generation"), F.col("o_orderstatus").alias("status"),
    )
    bad = pf.health_history(h).groupBy(G).agg(F.count(F.lit(1)).alias("out_of_order"))
    return pf.latest_health(h).join(bad, G, "left").select(G, "seq", "generation", "status", F.coalesce("out_of_order", F.lit(0)).alias("out_of_order"))


# --- lineage and provenance ---------------------------------------------------
def part_lineage(spark: SparkSession, sf: str, without_brand: str = "") -> DataFrame:
    """Parts as strategies: part k descends from k/2 and k/3; a few rows break a rule."""
    k = F.col("p_partkey")
    half, third = F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")
    return src.table(spark, sf, "part").where(F.col("p_brand") != without_brand).select(
        k.cast("string").alias("strategy_id"), F.when(k == 0, 0).otherwise(F.floor(F.log2(k.cast("double"))) + 1).cast("int").alias("generation"),
        F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(half, third))).alias("parent_ids"),
        F.when(k == 0, "seed").otherwise("mutate_threshold").alias("operator"),
    )


def lineage_problems(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("strategy_id").cast("bigint")
    bad = part_lineage(spark, sf).withColumn(
        "parent_ids", F.when(k % 97 == 5, F.array("strategy_id")).when(k % 101 == 7, F.array().cast("array<string>")).otherwise(F.col("parent_ids"))
    ).withColumn("operator", F.when(k % 103 == 9, "seed").otherwise(F.col("operator")))
    return lineage.lineage_problems(bad).select("strategy_id", F.array_join("reasons", "; ").alias("reasons"))


def lineage_closure(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.ancestor_counts(lineage.parent_edges(part_lineage(spark, sf)))


def lineage_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """GR3: an edge from 1 back to 40 closes cycles through the ancestors of 40."""
    e = lineage.parent_edges(part_lineage(spark, sf))
    back = e.where(F.col("strategy_id") == "1").select("strategy_id", F.lit("40").alias("parent_id"))
    return lineage.cycles(lineage.closure(lineage.cyclic_core(e.unionByName(back))))


def missing_parents(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.missing_parents(part_lineage(spark, sf, "Brand#7"))


def run_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Tables of the event paper runs, keyed for the provenance graph."""
    p = paper_plan.audited(spark, sf, None)
    manifest = cut(p["manifest"])
    runs = manifest.select(F.col(G), F.concat(F.lit("run-"), G).alias("run_id"), "event_count", "ledger_fingerprint")
    key = F.concat_ws(":", F.concat(F.lit("run-"), G), "event_id").alias("audit_key")
    attr = pf.attribution(cut(ledger.sleeve_returns(p["flags"], [G, "strategy_id"])), p["weights"])
    members = p["weights"].select(G, "strategy_id")
    exp = members.select(
        F.concat_ws("/", G, "strategy_id").alias("experiment_id"), G, "strategy_id", F.lit("events:v1").alias("dataset_key")
    )
    return {
        "runs": runs.select("run_id", G, "event_count"),
        "portfolios": runs.select(G, F.lit("b1").alias("data_bundle_version")),
        "datasets": runs.select(F.lit("events:v1").alias("dataset_key"), F.lit("b1").alias("data_bundle_version")).distinct(),
        "experiments": exp,
        "evidence": exp.select("experiment_id", F.lit(True).alias("eligible")),
        "promoted": exp.select("experiment_id", G),
        "strategies": members.select("strategy_id").distinct(),
        "lineage": members.select("strategy_id", F.lit(0).alias("generation")).distinct(),
        "attribution": cut(attr).select(F.concat_ws(":", F.concat(F.lit("run-"), G), "strategy_id").alias("attribution_key"), F.concat(F.lit("run-"), G).alias("run_id"), r6("return_contribution").alias("return_contribution")),
        "audit": p["events"].select(key, F.concat(F.lit("run-"), G).alias("run_id"), "action"),
        "fills": cut(ledger.fill_reasons(p["events"])).select(key, "reason", "decision_id"),
        "manifests": runs.select("run_id", "ledger_fingerprint"),
        "verifications": cut(paper_plan.verified_runs(p)).select(F.concat(F.lit("run-"), G).alias("run_id"), "valid", "reason"),
    }


def provenance_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = lineage.provenance_nodes(run_tables(spark, sf))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node_id").alias("ids"))


def provenance_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = run_tables(spark, sf)
    e = lineage.provenance_edges(t)
    n = cut(lineage.provenance_nodes(t)).select("node_id").distinct()
    loose = e.join(n.select(F.col("node_id").alias("source"), F.lit(1).alias("s")), "source", "left").join(
        n.select(F.col("node_id").alias("target"), F.lit(1).alias("t")), "target", "left"
    )
    return loose.groupBy("relation").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.when(F.col("s").isNull() | F.col("t").isNull(), 1).otherwise(0)).cast("bigint").alias("dangling"),
    )


def graph_problems(spark: SparkSession, sf: str) -> DataFrame:
    g = cut(fx.gated(spark, sf))
    e = g.select(
        F.col("candidate_id").alias("experiment_id"),
        F.when(F.col("symbol").endswith("6"), F.lit("other")).otherwise(F.col("strategy_id")).alias("candidate_id"), "strategy_id",
        F.col("symbol").alias(G), F.when(F.col("symbol").endswith("7"), "v2").otherwise("v1").alias("dataset_version"), "promotion_eligible",
    )
    evidence = e.where(~F.col(G).endswith("8")).select("experiment_id", F.col("promotion_eligible").alias("eligible"))
    members = e.where(F.col("promotion_eligible") | F.col(G).endswith("4")).where(~F.col(G).endswith("2")).select(
        G, "strategy_id", F.lit("v1").alias("dataset_version")
    )
    p = lineage.graph_problems(e, evidence, members)
    return p.groupBy("problem").agg(F.count(F.lit(1)).alias("experiments"))


def certificates(spark: SparkSession, sf: str) -> DataFrame:
    """GR6: certify the runs whose verification holds, change one stored field of one certificate, and re-check all."""
    t = run_tables(spark, sf)
    verified = t["manifests"].join(t["runs"], "run_id").join(t["verifications"], "run_id").select(
        "run_id", "valid", "reason", "event_count", "ledger_fingerprint",
        F.lit("v1").alias("dataset_version"), F.lit("b1").alias("data_bundle_version"), F.sha2("run_id", 256).alias("execution_fingerprint"),
    )
    parts = {
        "lineage_fingerprint": lineage.table_fingerprint(t["fills"].withColumn("run_id", F.split("audit_key", ":")[0]), ["run_id"]),
        "attribution_fingerprint": lineage.table_fingerprint(t["attribution"], ["run_id"]),
        "provenance_graph_fingerprint": lineage.table_fingerprint(t["audit"], ["run_id"]),
    }
    c = cut(lineage.certificates(verified, parts))
    edited = c.withColumn("event_count", F.when(F.col("run_id") == "run-click", F.col("event_count") + 1).otherwise(F.col("event_count")))
    edited = edited.withColumn("verified", F.col("run_id") != "run-error")
    return lineage.certificate_integrity(edited).select("run_id", "valid", "reason")


# --- sources and sinks ---------------------------------------------------------
def append_once(spark: SparkSession, sf: str) -> DataFrame:
    """SNK1: orders arrive again with some changed and some new rows."""
    o = src.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old = o.where(F.col("o_orderstatus") != "F").drop("o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    new = o.withColumn("o_totalprice", F.when(urgent, F.lit(0.0)).otherwise(F.col("o_totalprice"))).drop("o_orderpriority")
    fresh = sinks.new_rows(old, new, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("appended").alias("what"), "n")
    bad = sinks.payload_conflicts(old, new, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("conflicts").alias("what"), "n")
    return fresh.unionByName(bad)


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = src.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where(F.col("c_mktsegment") == "MACHINERY").withColumn("c_mktsegment", F.lit("MOVED"))
    u = sinks.upserted(c.where(F.col("c_acctbal") >= 0), new, ["c_custkey"])
    return u.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), r2(F.sum("c_acctbal")).alias("balance"))


def portfolio_members(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3: order lines as portfolio members ranked by their place in the definition."""
    li = src.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias(G),
        F.array(*[F.struct(F.concat(F.lit(n), F.col("s_suppkey").cast("string")).alias("strategy_id"), F.lit(w).alias("weight")) for n, w in (("a", 0.5), ("b", 0.25))]).alias("members"),
    )
    m = sinks.member_rows(li)
    runs = src.table(spark, sf, "nation").where(F.col("n_regionkey") == 1).select(F.col("n_nationkey").cast("string").alias(G))
    frozen = sinks.frozen_portfolios(li, runs).withColumn("frozen", F.lit(True))
    return m.join(frozen, G, "left").select(G, "strategy_id", "weight", F.col("rank").cast("bigint").alias("rank"), F.coalesce("frozen", F.lit(False)).alias("frozen"))


def request_bars(spark: SparkSession, sf: str) -> DataFrame:
    """SRC10, SRC11: every nation's first suppliers ask for a half year with an inclusive end."""
    req = src.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("symbol"), F.lit("1996-01-01").cast("timestamp_ntz").alias("start"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("1996-06-30")).otherwise(F.lit("1996-12-31")).cast("timestamp_ntz").alias("end"),
    )
    b = src.select_requests(src.bars_supplier(spark, sf), src.inclusive_end(req))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), stamp(F.min("ts")).alias("first_ts"), stamp(F.max("ts")).alias("last_ts"))


def tidy(b: DataFrame) -> DataFrame:
    return b.select("symbol", stamp().alias("ts"), "open", "high", "low", "close", "volume")


def chart_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC4 round trip: one document per symbol, the open missing on every seventh day of a month."""
    b = src.bars_priority(spark, sf)
    arr = F.sort_array(F.collect_list(F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
        F.when(F.dayofmonth("ts") != 7, F.col("open")).alias("open"), "high", "low", "close", "volume")))

    def values(name: str):
        return F.transform("a", lambda x: x[name])

    quote = F.struct(*[values(c).alias(c) for c in src.BAR_COLUMNS])
    doc = F.struct(F.struct(F.array(F.struct(
        values("t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    docs = b.groupBy("symbol").agg(arr.alias("a")).select("symbol", F.to_json(doc).alias("payload"))
    return tidy(payloads.chart_json(docs, start="1996-01-01", end="1999-01-01"))


def daily_series_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC5 round trip with string numbers keyed by date."""
    b = src.bars_priority(spark, sf)
    fields = F.create_map(*[x for c, k in payloads.DAILY_FIELDS.items() for x in (F.lit(k), F.col(c).cast("string"))])
    entries = F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("k"), fields.alias("v"))))
    docs = b.groupBy("symbol").agg(entries.alias("m")).select(
        "symbol", F.to_json(F.create_map(F.lit(payloads.SERIES_KEY), F.col("m"))).alias("payload")
    )
    return tidy(payloads.daily_series_json(docs, start="1997-01-01"))


def posted_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC9 round trip: one posted document per hour with the bars of all symbols; some lack a volume."""
    b = src.bars_event(spark, sf)
    bar = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "open", "high", "low", "close",
                   F.when(F.hour("ts") != 5, F.col("volume")).alias("volume"))
    docs = b.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.array(bar).alias("v")))).alias("m")).select(
        F.to_json("m").alias("payload")
    )
    return tidy(payloads.posted_bars(docs))


def daily_csv_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3: mixed-case headers, numbers as text, missing volumes."""
    raw = src.bars_supplier(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("symbol"),
        *[F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low", "close")],
        F.when(F.dayofmonth("ts") != 3, F.col("volume").cast("string")).alias("Volume"),
    )
    return tidy(payloads.daily_csv(raw, F.col("symbol"), end="1998-01-01"))


def macro_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC6: '.' and '' stand for missing observations."""
    raw = src.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("observation_date"),
        F.when(F.col("o_orderkey") % 9 == 0, ".").when(F.col("o_orderkey") % 9 == 1, "").otherwise(F.col("o_totalprice").cast("string")).alias("PRICE"),
    )
    m = payloads.macro_csv(raw, "PRICE")
    return m.groupBy("series_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("observations"), F.count("value").alias("present"), F.max("value").alias("highest")
    )


def company_facts_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC7 round trip: supplier balances as company facts."""
    s = src.table(spark, sf, "supplier")
    val = F.struct(F.lit("1998-12-31").alias("end"), F.col("s_acctbal").alias("val"), F.lit(1998).alias("fy"))
    doc = F.struct(
        F.col("s_name").alias("entityName"),
        F.struct(F.struct(F.struct(F.lit("Balance").alias("label"), F.struct(F.array(val, val.withField("fy", F.lit(1999))).alias("USD")).alias("units")).alias("AccountBalance")).alias("core")).alias("facts"),
    )
    docs = s.select(F.concat(F.lit("CIK-"), F.col("s_suppkey").cast("string")).alias("cik"), F.to_json(doc).alias("payload"))
    f = payloads.company_facts(docs)
    return f.select("cik", "entity", "taxonomy", "concept", "unit", F.col("val"), F.col("fy").cast("bigint").alias("fy"))


def news_payload(spark: SparkSession, sf: str) -> DataFrame:
    """SRC8: conversations as feeds in pages of fifty turns, the first two items of each page."""
    c = src.table(spark, sf, "conversations")
    page = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 50))
    items = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role"))),
        lambda x: F.struct(F.concat(x["role"], F.lit(" "), x["turn"].cast("string")).alias("title"), x["role"].alias("url")),
    )
    docs = c.groupBy(page.alias("feed_id")).agg(items.alias("feed")).select(
        "feed_id", F.to_json(F.struct("feed")).alias("payload")
    )
    n = payloads.news_feed(docs, 2)
    return n.select("feed_id", F.col("position").cast("bigint").alias("position"), "title")


def snapshot_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """SRC12: one snapshot per nation from supplier (market) and customer (macro) documents."""
    def env(table: str, key: str, dataset: str, body: list[str]) -> DataFrame:
        t = src.table(spark, sf, table)
        e = payloads.envelope(t, table, dataset, F.to_json(F.struct(F.col(key).alias("group_key"), *body)), F.lit("2024-01-01"))
        return e.withColumn("nation", F.get_json_object("payload", "$.group_key"))

    both = env("supplier", "s_nationkey", "daily_ohlcv", ["s_suppkey"]).unionByName(env("nation", "n_nationkey", "series", ["n_name"]))
    m = payloads.snapshot_manifest(both, "nation")
    return m.select("nation", "components", F.col("valid"), "snapshot_fingerprint")


def provenance_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """FP5, FP6: asserted segment of customers against the declared one, and unknown customers."""
    c = src.table(spark, sf, "customer")
    declared = c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("source"))
    asserted = c.select(
        F.col("c_custkey").alias("key"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 10 == 1, "FURNITURE").otherwise(F.col("c_mktsegment")).alias("source"),
    )
    wrong = identity.assertion_problems(asserted, declared, "key", ["source"]).select("key", F.array_join("reasons", "; ").alias("reason"))
    asked = src.table(spark, sf, "orders").select((F.col("o_custkey") + 3).alias("key"))
    return wrong.unionByName(identity.missing(asked, declared, ["key"]).select("key", F.lit("unknown dataset version").alias("reason")))


# --- ticks and streams -----------------------------------------------------------
def tick_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events as ticks: nothing bounds the length of a series, so it is bucketed by id."""
    px = F.lit(100.0) + F.col("value") / F.lit(1000.0)
    t = src.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "event_id", px.alias("close"),
        (F.col("value") < 20).alias("entry"), (F.col("value") > 80).alias("exit"),
    )
    return ls.with_bucket(t, F.col("event_id"))


def tick_backtest(spark: SparkSession, sf: str) -> DataFrame:
    b = ticks.tick_backtest(tick_rows(spark, sf), ["symbol"], ["event_id"])
    return b.select("symbol", "event_id", "target", r6("net_ret").alias("net_ret"), r2("equity").alias("equity"), r6("drawdown").alias("drawdown"))


STREAM_FILES = 4


def event_files(spark: SparkSession, sf: str) -> str:
    """The events as a folder of STREAM_FILES spans of time, written one after the other as they would arrive."""
    events = src.table(spark, sf, "events")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (span["hi"] - span["lo"]) / STREAM_FILES if span["lo"] is not None else None
    for k in range(STREAM_FILES if step is not None else 0):
        last = F.lit(k == STREAM_FILES - 1)
        part = events.where((F.col("ts") >= F.lit(span["lo"] + k * step)) & (last | (F.col("ts") < F.lit(span["lo"] + (k + 1) * step))))
        part.write.mode("append").parquet(folder)
    if step is None:
        events.write.parquet(folder)
    return folder


def stream_equity(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 over the events as a stream of several files, one to a trigger; rows that wait for later ones are judged as they stand."""

    def shape(raw: DataFrame) -> DataFrame:
        return raw.select(F.col("event_type").alias(G), "ts", (F.lit(1000.0) - F.col("value")).alias("equity"))

    stream = monitors.file_stream(spark, event_files(spark, sf), src.table(spark, sf, "events").schema, shape, files_per_trigger=1)
    out = monitors.run_available(spark, monitors.equity_monitor(stream, 0.49), waiting=lambda state: monitors.open_equity(state, 0.49))
    return out.select(G, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), r6("equity").alias("equity"), r6("peak").alias("peak"), "halted")


def stream_health(spark: SparkSession, sf: str) -> DataFrame:
    """ST2 over the events as a stream of several files: transitions only, those of waiting rows included."""

    def shape(raw: DataFrame) -> DataFrame:
        return raw.select(
            F.col("user_id").cast("string").alias("strategy_id"), "ts", (F.col("value") > 150).alias("degraded"), (F.col("value") > 300).alias("halt")
        )

    stream = monitors.file_stream(spark, event_files(spark, sf), src.table(spark, sf, "events").schema, shape, files_per_trigger=1)
    out = monitors.run_available(spark, monitors.health_monitor(stream), waiting=monitors.open_health)
    return out.select("strategy_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "previous_state", "state", "sequence")


QUERIES = {
    name: globals()[name]
    for name in (
        "lifecycle_violations", "lifecycle_current", "lifecycle_gaps", "hash_problems", "chain_audit", "health_states",
        "health_requests", "feedback_problems", "portfolio_history", "lineage_problems", "lineage_closure", "lineage_cycles",
        "missing_parents", "provenance_nodes", "provenance_edges", "graph_problems", "certificates", "append_once", "upsert",
        "portfolio_members", "request_bars", "chart_payload", "daily_series_payload", "posted_payload", "daily_csv_payload",
        "macro_payload", "company_facts_payload", "news_payload", "snapshot_manifests", "provenance_assertions",
        "tick_backtest", "stream_equity", "stream_health",
    )
}

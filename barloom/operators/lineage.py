"""Lineage rules, ancestor closure and the provenance graph (GR1-GR6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import content_id, digest_of, digest_parts, first_reason, reasons
from barloom.functions.scale import global_rank
from barloom.session import cut


def lineage_problems(lineage: DataFrame) -> DataFrame:
    """GR1: no self-parent, seeds have no parents, derived strategies have at least one."""
    n = F.greatest(F.coalesce(F.size("parent_ids"), F.lit(0)), F.lit(0))
    seed = F.col("operator") == "seed"
    why = reasons(
        (F.col("generation") < 0, "generation must be non-negative"),
        (
            F.array_contains("parent_ids", F.col("strategy_id")),
            F.concat(F.lit("strategy lineage cycle detected: "), "strategy_id"),
        ),
        (seed & (n > 0), "seed strategies cannot have parents"),
        (~seed & (n == 0), "derived strategies must have at least one parent"),
    )
    return lineage.select("strategy_id", why.alias("reasons")).where(F.size("reasons") > 0)


def parent_edges(lineage: DataFrame) -> DataFrame:
    return lineage.select("strategy_id", F.explode("parent_ids").alias("parent_id")).distinct()


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """GR2: every (strategy, ancestor) pair with its distance ``depth``, for all strategies or from ``roots`` only.

    From a few roots the sets of all the others would be waste: there only the frontier of the roots moves, a level to a round.
    """
    if roots is not None:
        return _frontier(cut(_child_up(edges)), roots)
    sets, names, bits = _ancestor_sets(edges)
    code = F.col("code")
    pairs = sets.select("child", F.explode("codes").alias("code")).select(
        "child", F.shiftright(code, bits).alias("up"), _depth(code, bits).alias("depth")
    )
    strategy = names.select(F.col("number").alias("child"), F.col("name").alias("strategy_id"))
    ancestor = names.select(F.col("number").alias("up"), F.col("name").alias("ancestor_id"))
    return pairs.join(strategy, "child", "left").join(ancestor, "up", "left").select("strategy_id", "ancestor_id", "depth")


def ancestor_counts(edges: DataFrame) -> DataFrame:
    """Number of ancestors and the distance ``farthest`` to the last of them for each strategy, from the sets behind ``closure``."""
    sets, names, bits = _ancestor_sets(edges)
    counts = sets.select(
        "child", F.size("codes").cast("bigint").alias("ancestors"),
        F.array_max(F.transform("codes", lambda c: _depth(c, bits))).cast("bigint").alias("farthest"),
    )
    strategy = names.select(F.col("number").alias("child"), F.col("name").alias("strategy_id"))
    return counts.join(strategy, "child", "left").select("strategy_id", "ancestors", "farthest")


def _child_up(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("strategy_id").alias("child"), F.col("parent_id").alias("up")).distinct()


def _depth(code: Column, bits: int) -> Column:
    return code.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


# Bits of the depth in a code of 32 bits, until a path is longer.
SHORT = 6


def _ancestor_sets(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """One row (child, codes) for each strategy, the names of the numbers, and the bits of the depth in a code.

    Strategies are numbered, and an ancestor at its least distance is one code, number * 2**bits + depth.  So the ancestors of a
    strategy move as one sorted array of numbers and not as rows with two names.

    Paths are doubled: an ancestor farther than 2**k and at most 2**(k + 1) away is one at most 2**k away from an ancestor at
    exactly 2**k.  So the rounds grow with the logarithm of the depth.  A cycle ends the loop, as its pairs are known at
    their least distance.  The edges are read twice.
    """
    e = _child_up(edges)
    ends = e.select(F.explode(F.array("child", "up")).alias("name")).where(F.col("name").isNotNull()).distinct()
    names = global_rank(ends, [F.col("name")], "number")
    n = names.count()
    bits, kind = (SHORT, "int") if n < 1 << (31 - SHORT) else (n.bit_length(), "bigint")
    # A null child is number 0 and a null parent -1: they count, but nothing follows from them.
    numbered = e.join(names.select(F.col("name").alias("child"), F.col("number").alias("c")), "child", "left").join(
        names.select(F.col("name").alias("up"), F.col("number").alias("u")), "up", "left"
    ).select(F.coalesce("c", F.lit(0)).cast(kind).alias("child"), F.coalesce("u", F.lit(-1)).cast(kind).alias("up"))
    sets = cut(numbered.groupBy("child").agg(F.collect_list((F.shiftleft("up", bits) + 1).cast(kind)).alias("codes")))
    reach = 1
    while True:
        if 2 * reach >= 1 << bits:
            # No path is longer than the number of strategies.
            wide = max(n.bit_length(), bits + 1)
            sets = sets.select(F.col("child").cast("bigint").alias("child"), F.transform(
                "codes", lambda c: F.shiftleft(F.shiftright(c, bits).cast("bigint"), wide) + _depth(c, bits)
            ).alias("codes"))
            bits, kind = wide, "bigint"
        far = sets.select("child", F.explode(F.filter("codes", lambda c: _depth(c, bits) == reach)).alias("code"))
        near = sets.select(F.col("child").alias("via"), F.transform("codes", lambda c: c + F.lit(reach).cast(kind)).alias("codes"))
        step = far.select("child", F.shiftright("code", bits).alias("via")).join(near, "via").select("child", "codes")
        merged = step.unionByName(sets).groupBy("child").agg(F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes"))
        # The first code of an ancestor has its least depth.
        first = F.filter("codes", lambda c, i: (i == 0) | (F.shiftright(c, bits) != F.shiftright(F.get("codes", i - 1), bits)))
        sets, reach = cut(merged.select("child", first.alias("codes"))), 2 * reach
        # Without an ancestor at exactly this distance there is none beyond.
        if sets.where(F.exists("codes", lambda c: _depth(c, bits) == reach)).isEmpty():
            return sets, names, bits


def _frontier(e: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of ``roots``, level by level over the cut edges (``child``, ``up``)."""
    start = e.join(roots.select(F.col("strategy_id").alias("child")).distinct(), "child", "left_semi")
    found = cut(start.select(F.col("child").alias("strategy_id"), F.col("up").alias("ancestor_id"), F.lit(1).alias("depth")))
    fresh, depth = found, 1
    while True:
        depth += 1
        step = (
            fresh.join(e, fresh["ancestor_id"] == e["child"])
            .select("strategy_id", F.col("up").alias("ancestor_id"))
            .distinct()
            .join(found, ["strategy_id", "ancestor_id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        fresh = cut(step)
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges without those that lie on no cycle because a strategy at their end has no parent or no child left.

    A round drops the outermost strategies on both sides, as long as that takes at least a tenth of the edges.  All cycles stay whole.
    """
    e = cut(edges.select("strategy_id", "parent_id").distinct())
    n = e.count()
    while True:
        children, ups = e.select(F.col("strategy_id").alias("parent_id")).distinct(), e.select(F.col("parent_id").alias("strategy_id")).distinct()
        e = cut(e.join(children, "parent_id", "left_semi").join(ups, "strategy_id", "left_semi"))
        before, n = n, e.count()
        if 10 * n > 9 * before or n == 0:
            return e


def cycles(closed: DataFrame) -> DataFrame:
    """GR3: strategies that are their own ancestor."""
    return closed.where(F.col("strategy_id") == F.col("ancestor_id")).select("strategy_id").distinct()


def missing_parents(lineage: DataFrame) -> DataFrame:
    """GR3: parents that have no lineage row."""
    return parent_edges(lineage).select(F.col("parent_id").alias("strategy_id")).distinct().join(
        lineage.select("strategy_id"), "strategy_id", "left_anti"
    )


# --- provenance graph -------------------------------------------------------
def node(df: DataFrame, kind: str, key: str | Column, attributes: list[str]) -> DataFrame:
    """GR4: nodes of one kind with id, key and JSON attributes."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    body = F.to_json(F.struct(*[F.col(a) for a in sorted(attributes)])) if attributes else F.lit("{}")
    return df.select(F.lit(kind).alias("kind"), k.alias("key"), body.alias("attributes")).distinct().withColumn(
        "node_id", content_id(["kind", "key"])
    )


def edge(df: DataFrame, source_kind: str, source: str, target_kind: str, target: str, relation: str) -> DataFrame:
    """Labelled edges between keys of two kinds."""
    return df.select(
        F.lit(source_kind).alias("source_kind"), F.col(source).cast("string").alias("source_key"),
        F.lit(target_kind).alias("target_kind"), F.col(target).cast("string").alias("target_key"),
        F.lit(relation).alias("relation"),
    ).distinct()


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def provenance_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """GR4: nodes of all kinds that the given tables describe."""
    out = []
    # The kinds of node.
    recipes = {
        "paper_run": ("runs", "run_id"), "portfolio": ("portfolios", "portfolio_id"), "dataset": ("datasets", "dataset_key"),
        "data_bundle": ("datasets", "data_bundle_version"), "experiment": ("experiments", "experiment_id"),
        "evaluation_evidence": ("evidence", "experiment_id"), "promotion": ("evidence", "experiment_id"),
        "strategy": ("strategies", "strategy_id"), "lineage": ("lineage", "strategy_id"),
        "feedback_event": ("feedback", "event_id"), "lifecycle_state": ("feedback", "state_key"),
        "research_request": ("requests", "request_id"), "successor_candidate": ("successors", "candidate_id"),
        "attribution": ("attribution", "attribution_key"), "audit_event": ("audit", "audit_key"),
        "fill_lineage": ("fills", "audit_key"), "execution_manifest": ("manifests", "run_id"),
        "replay_verification": ("verifications", "run_id"),
    }
    for kind, (table, key) in recipes.items():
        if table in tables:
            df = tables[table]
            out.append(node(df, kind, key, [c for c in df.columns if c != key]))
    return union(out)


def provenance_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """GR4: labelled edges of the research-to-paper graph."""
    # The kinds joined by each relation, and its name.
    recipes = [
        ("datasets", "dataset", "dataset_key", "data_bundle", "data_bundle_version", "bundles"),
        ("portfolios", "data_bundle", "data_bundle_version", "portfolio", "portfolio_id", "input_to"),
        ("runs", "portfolio", "portfolio_id", "paper_run", "run_id", "executed_as"),
        ("evidence", "experiment", "experiment_id", "evaluation_evidence", "experiment_id", "produced_evidence"),
        ("evidence", "evaluation_evidence", "experiment_id", "promotion", "experiment_id", "evaluated_for"),
        ("experiments", "experiment", "experiment_id", "portfolio", "portfolio_id", "candidate_for"),
        ("experiments", "experiment", "experiment_id", "dataset", "dataset_key", "uses_dataset"),
        ("experiments", "strategy", "strategy_id", "experiment", "experiment_id", "tested"),
        ("promoted", "promotion", "experiment_id", "portfolio", "portfolio_id", "promoted_to_candidate"),
        ("lineage", "lineage", "strategy_id", "strategy", "strategy_id", "defines"),
        ("parents", "strategy", "parent_id", "strategy", "strategy_id", "parent_of"),
        ("feedback", "strategy", "strategy_id", "feedback_event", "event_id", "experienced_feedback"),
        ("feedback", "feedback_event", "event_id", "lifecycle_state", "state_key", "transitioned_to"),
        ("requests", "feedback_event", "event_id", "research_request", "request_id", "generated_research_request"),
        ("successors", "research_request", "request_id", "successor_candidate", "candidate_id", "generated_successor"),
        ("successors", "strategy", "strategy_id", "successor_candidate", "candidate_id", "defines_strategy"),
        ("attribution", "attribution", "attribution_key", "paper_run", "run_id", "contributes_to"),
        ("audit", "paper_run", "run_id", "audit_event", "audit_key", "records"),
        ("fills", "audit_event", "audit_key", "fill_lineage", "audit_key", "explained_by"),
        ("manifests", "paper_run", "run_id", "execution_manifest", "run_id", "attested_by"),
        ("verifications", "replay_verification", "run_id", "paper_run", "run_id", "verifies"),
    ]
    parts = [edge(tables[t], a, b, c, d, r) for t, a, b, c, d, r in recipes if t in tables]
    out = union(parts)
    left = out.withColumns({"kind": F.col("source_kind"), "key": F.col("source_key")}).withColumn("source", content_id(["kind", "key"]))
    return left.withColumns({"kind": F.col("target_kind"), "key": F.col("target_key")}).withColumn(
        "target", content_id(["kind", "key"])
    ).drop("kind", "key")


def graph_problems(experiments: DataFrame, evidence: DataFrame, members: DataFrame) -> DataFrame:
    """GR5: experiments, their evidence and portfolio membership must agree.

    ``experiments`` (experiment_id, candidate_id, strategy_id, portfolio_id, dataset_version),
    ``evidence`` (experiment_id, eligible), ``members`` (portfolio_id, strategy_id, dataset_version).
    """
    e = evidence.select("experiment_id", "eligible").withColumn("has_evidence", F.lit(True))
    m = members.select("portfolio_id", "strategy_id").distinct().withColumn("is_member", F.lit(True))
    d = members.groupBy("portfolio_id").agg(F.max("dataset_version").alias("p_version"))
    df = experiments.join(e, "experiment_id", "left").join(m, ["portfolio_id", "strategy_id"], "left").join(d, "portfolio_id", "left")
    member = F.col("is_member").isNotNull()
    problem = first_reason(
        (F.col("has_evidence").isNull(), "experiment provenance is incomplete"),
        (F.col("candidate_id") != F.col("strategy_id"), "experiment strategy mismatch"),
        (F.col("dataset_version") != F.col("p_version"), "experiment dataset mismatch"),
        (F.col("eligible").isNull(), "promotion provenance is incomplete"),
        (F.col("eligible") & ~member, "eligible experiment not represented by portfolio member"),
        (~F.col("eligible") & member, "ineligible experiment selected into portfolio"),
    )
    return df.select("experiment_id", "portfolio_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def table_fingerprint(df: DataFrame, keys: list[str], length: int = 16) -> DataFrame:
    """Order-free fingerprint of the rows per key, from partial sums of row digests."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *digest_parts(df.columns))
    return agg.select(*keys, F.substring(digest_of("_n"), 1, length).alias("fingerprint"))


CERTIFICATE = [
    "provenance_schema_version", "run_id", "dataset_version", "data_bundle_version", "execution_fingerprint",
    "research_fingerprint", "provenance_graph_fingerprint", "ledger_fingerprint", "lineage_fingerprint",
    "attribution_fingerprint", "verification_fingerprint", "event_count",
]


def certificates(verified: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """GR6: certificates of valid runs.  ``verified`` holds run_id, valid, reason, event_count and the
    identity columns; ``parts`` maps a fingerprint name to (run_id, fingerprint) tables."""
    df = verified.where("valid")
    for name, table in parts.items():
        df = df.join(table.select("run_id", F.col("fingerprint").alias(name)), "run_id")
    df = df.withColumn("verification_fingerprint", content_id(["valid", "reason", "event_count", "ledger_fingerprint"]))
    inputs = ["run_id", "dataset_version", "lineage_fingerprint", "attribution_fingerprint", "provenance_graph_fingerprint"]
    df = df.withColumns({"research_fingerprint": content_id(inputs, 24), "provenance_schema_version": F.lit("1")})
    return df.withColumn("certificate_id", content_id(CERTIFICATE, 24)).select(
        *CERTIFICATE, "certificate_id", F.lit(True).alias("verified")
    )


def certificate_integrity(stored: DataFrame) -> DataFrame:
    """GR6: recompute the id of every stored certificate."""
    incomplete = F.lit(False)
    for c in CERTIFICATE:
        incomplete = incomplete | F.col(c).isNull()
    df = stored.withColumn("_expected", content_id(CERTIFICATE, 24))
    reason = first_reason(
        (~F.coalesce("verified", F.lit(False)), "certificate is not marked verified"),
        (incomplete, "certificate is structurally incomplete"),
        (F.coalesce(F.col("_expected") != F.col("certificate_id"), F.lit(True)), "certificate_id does not match certificate contents"),
    )
    return df.select("run_id", "certificate_id", reason.alias("reason")).withColumn("valid", F.col("reason").isNull())

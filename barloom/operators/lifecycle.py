"""Lifecycle tables, hash chains and the health state machine (LC1-LC8, W11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.functions.columns import content_id, first_reason

# Fixed stage transitions of the promotion life cycle.
TRANSITIONS = {
    "research": ("validated", "degraded"),
    "validated": ("promoted", "degraded"),
    "promoted": ("paper", "degraded", "retired"),
    "paper": ("degraded", "retired", "replaced"),
    "degraded": ("research", "retired", "replaced"),
    "retired": (),
    "replaced": (),
}
STAGES = tuple(TRANSITIONS)


def allowed(source: str | Column, target: str | Column) -> Column:
    """LC1 as an expression: the transition table is a literal map."""
    table = F.create_map(
        *[x for s, ts in TRANSITIONS.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in ts]).cast("array<string>"))]
    )
    s = F.col(source) if isinstance(source, str) else source
    t = F.col(target) if isinstance(target, str) else target
    return F.coalesce(F.array_contains(table[s], t), F.lit(False))


def transition_problems(events: DataFrame) -> DataFrame:
    """LC1: events that are not allowed; a first event (no source) may enter any stage."""
    bad = F.col("source_stage").isNotNull() & ~allowed("source_stage", "target_stage")
    text = F.concat(F.lit("invalid lifecycle transition: "), "source_stage", F.lit(" -> "), "target_stage")
    return events.where(bad).withColumn("reason_text", text)


def current_stage(events: DataFrame) -> DataFrame:
    """LC2: the target of the newest event."""
    return events.groupBy("strategy_id").agg(F.max_by("target_stage", "seq").alias("stage"))


def history_gaps(events: DataFrame, width: int | None = None) -> DataFrame:
    """LC3: events whose source is not the target of the event before.

    A strategy may own any share of the log, so the previous row comes from bucketed windows.
    """
    df = ls.with_bucket(events, F.col("seq"), width)
    df = ls.previous(df, ["strategy_id"], ["seq"], ["target_stage"])
    return ls.plain(df.where(~F.col("source_stage").eqNullSafe(F.col("prev_target_stage"))))


def with_event_hash(events: DataFrame, columns: Sequence[str] = ("strategy_id", "source_stage", "target_stage", "reason"),
                    out: str = "integrity_hash") -> DataFrame:
    """LC4: SHA-256 of the canonical event."""
    return events.withColumn(out, content_id(list(columns), 64))


def hash_problems(events: DataFrame, columns: Sequence[str] = ("strategy_id", "source_stage", "target_stage", "reason")) -> DataFrame:
    """LC4: rows whose stored hash differs from the recomputed one."""
    return with_event_hash(events, columns, "_expected").where(
        ~F.col("_expected").eqNullSafe(F.col("integrity_hash"))
    ).drop("_expected")


def chain(rows: DataFrame, payload: Sequence[str], order: str = "sequence", width: int | None = None) -> DataFrame:
    """Add ``payload_digest`` and the ``previous_digest`` link in sequence order."""
    df = rows.withColumn("payload_digest", content_id(list(payload), 64)).withColumn("_log", F.lit(0))
    df = ls.previous(ls.with_bucket(df, F.col(order), width), ["_log"], [order], ["payload_digest"])
    return df.withColumn("previous_digest", F.coalesce("prev_payload_digest", F.lit(""))).drop(
        "prev_payload_digest", "_log", ls.BUCKET, ls.BLOCK
    )


def chain_audit(audit: DataFrame, cycles: DataFrame, payload: Sequence[str], width: int | None = None) -> DataFrame:
    """LC5, W11: ``audit`` (sequence, cycle_id, generation, payload_digest, previous_digest) against
    the cycles it covers: duplicates, mismatches, broken links and missing coverage."""
    c = cycles.withColumn("expected", content_id(list(payload), 64)).select(
        "cycle_id", F.col("generation").alias("c_generation"), "expected"
    )
    df = ls.with_bucket(audit.withColumn("_log", F.lit(0)), F.col("sequence"), width)
    df = ls.previous(df, ["_log"], ["sequence"], ["payload_digest"]).drop("_log")
    repeats = audit.groupBy("cycle_id").agg(F.min("sequence").alias("first_seq"))
    df = df.join(repeats, "cycle_id").join(c, "cycle_id", "full_outer")
    problem = first_reason(
        (F.col("sequence").isNull(), "research cycle audit coverage is incomplete"),
        (F.col("sequence") > F.col("first_seq"), "duplicate research cycle audit entry"),
        (F.col("expected").isNull() | (F.col("c_generation") != F.col("generation")), "research cycle audit record mismatch"),
        (
            (F.col("payload_digest") != F.col("expected"))
            | (F.col("previous_digest") != F.coalesce("prev_payload_digest", F.lit(""))),
            "research cycle audit integrity verification failed",
        ),
    )
    return df.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("cycle_id", "sequence", "problem")


HEALTH = ("active", "degraded", "halted")


def health_states(reports: DataFrame, width: int | None = None) -> DataFrame:
    """LC6: state after every report (strategy_id, seq, degraded, halt): the worst state so far.

    HALTED is final and DEGRADED never heals, so the machine is a running maximum.
    """
    rank = F.when(F.col("halt"), 2).when(F.col("degraded"), 1).otherwise(0)
    df = ls.with_bucket(reports, F.col("seq"), width)
    df = ls.running(df, ["strategy_id"], ["seq"], {"_rank": ("max", rank)})
    df = ls.previous(df, ["strategy_id"], ["seq"], ["_rank"])
    names = F.array(*[F.lit(h) for h in HEALTH])
    return df.withColumns(
        {
            "state": F.get(names, F.col("_rank")),
            "previous_state": F.get(names, F.coalesce("prev__rank", F.lit(0))),
        }
    ).drop("_rank", "prev__rank", ls.BUCKET, ls.BLOCK)


def health_requests(states: DataFrame) -> DataFrame:
    """LC7: one replacement request and one feedback event per ACTIVE -> DEGRADED step.

    ``states`` also carries ``observations`` and the report's ``reasons``.
    """
    hit = states.where((F.col("previous_state") == "active") & (F.col("state") == "degraded"))
    text = F.concat_ws(
        ":", "strategy_id", F.lit("degraded"), F.col("observations").cast("string"), F.array_join("reasons", ",")
    )
    out = hit.withColumns(
        {
            "request_id": F.substring(F.sha2(text, 256), 1, 16),
            "request_reason": F.lit("degraded"),
            "priority": F.lit(0),
            "constraints": F.array(F.lit("avoid_known_failure")),
        }
    )
    return with_feedback_fingerprints(out)


FEEDBACK = ["strategy_id", "previous_state", "state", "report_fingerprint", "request_id", "research_fingerprint"]


def with_feedback_fingerprints(events: DataFrame) -> DataFrame:
    """LC8: fingerprints of report, request and event."""
    report = [c for c in ("strategy_id", "observations", "total_return", "max_drawdown", "volatility", "reasons") if c in events.columns]
    df = events.withColumns(
        {
            "report_fingerprint": content_id(report, 24),
            "research_fingerprint": content_id(["request_id", "strategy_id", "request_reason", "priority", "constraints"], 24),
        }
    )
    return df.withColumns({"fingerprint": content_id(FEEDBACK, 24)}).withColumn(
        "event_id", F.substring(F.sha2(F.concat(F.lit("feedback:"), "fingerprint"), 256), 1, 24)
    )


def feedback_problems(events: DataFrame) -> DataFrame:
    """LC8: events whose fingerprint does not match their content."""
    return events.withColumn("_f", content_id(FEEDBACK, 24)).where(
        ~F.col("_f").eqNullSafe(F.col("fingerprint"))
    ).drop("_f")

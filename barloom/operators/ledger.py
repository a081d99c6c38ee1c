"""Paper ledger tables from signals and prices (LG1-LG13).

No broker object: a closed trade multiplies sleeve cash by a factor that depends only on its
two prices, so cash and equity are running products, and the drawdown halt is the first bar of
the unhalted curve that breaks the limit.

With c, s = commission and slippage fractions and k = min(max_position, 1 / ((1+s)(1+c))):

    closed trade factor  = 1 - k(1+s)(1+c) + k (exit/entry)(1-s)(1-c)
    equity while holding = cash before the buy * (1 - k(1+s)(1+c) + k * close/entry)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.functions.columns import content_id, digest_of, digest_parts, finite, first_reason, reasons, running, series, whole
from barloom.operators.rules import toggle_state

CASH = 100_000.0


def _rates(commission_bps: float, slippage_bps: float) -> tuple[float, float]:
    if commission_bps < 0 or slippage_bps < 0:
        raise ValueError("transaction costs cannot be negative")
    return commission_bps / 10_000.0, slippage_bps / 10_000.0


def _size(max_position: Column, c: float, s: float) -> Column:
    return F.least(max_position, F.lit(1.0 / ((1 + s) * (1 + c))))


def sleeves(
    flags: DataFrame,
    keys: Sequence[str],
    *,
    commission_bps: float = 1.0,
    slippage_bps: float = 2.0,
    initial_buy: bool = True,
    order: str = "ts",
) -> DataFrame:
    """LG1-LG3 per sleeve and bar: held state, fills and equity on a unit of starting cash.

    ``flags``: keys, ts, close, entry, exit, max_position.  Trades fill on the signal bar.
    With ``initial_buy`` bar 0 buys without a signal (LG1); LG7 turns it off.
    """
    c, s = _rates(commission_bps, slippage_bps)
    df = flags
    if initial_buy:
        first = F.lag(order).over(series(keys, order)).isNull()
        df = df.withColumns(
            {
                "_entry": F.col("entry") | first,
                # bar 0 buys even when both flags are set, and cannot sell
                "_exit": F.col("exit") & ~first,
            }
        )
    else:
        df = df.withColumns({"_entry": F.col("entry"), "_exit": F.col("exit")})
    df = toggle_state(df, keys, order, "held", "_entry", "_exit")
    was = F.coalesce(F.lag("held").over(series(keys, order)), F.lit(False))
    df = df.withColumns({"was_held": was, "k": _size(F.col("max_position"), c, s)})
    w = running(keys, order)
    bought = F.col("held") & ~F.col("was_held")
    sold = ~F.col("held") & F.col("was_held")
    df = df.withColumns(
        {
            "side": F.when(bought, "buy").when(sold, "sell"),
            "entry_px": F.last(F.when(bought, F.col("close")), ignorenulls=True).over(w),
        }
    )
    spent = F.lit(1.0) - F.col("k") * F.lit((1 + s) * (1 + c))
    factor = spent + F.col("k") * F.col("close") / F.col("entry_px") * F.lit((1 - s) * (1 - c))
    # cash after the last closed trade, also the base of the open one
    df = df.withColumn("base", F.exp(F.sum(F.when(F.col("side") == "sell", F.log(factor)).otherwise(0.0)).over(w)))
    held_value = F.col("base") * (spent + F.col("k") * F.col("close") / F.col("entry_px"))
    return df.withColumns(
        {
            "equity": F.when(F.col("held"), held_value).otherwise(F.col("base")),
            "liquid": F.when(F.col("held"), F.col("base") * factor).otherwise(F.col("base")),
            # quantity per unit of starting cash: k * cash / price at the entry
            "qty": F.when(
                F.col("side") == "buy", F.col("base") * F.col("k") / F.col("close")
            ).when(
                (F.col("side") == "sell") | F.col("held"),
                # the open position was bought with the base before this bar's sale
                F.last(F.when(bought, F.col("base") * F.col("k") / F.col("close")), True).over(w),
            ),
        }
    ).drop("_entry", "_exit")


def paper_portfolio(
    flags: DataFrame,
    weights: DataFrame,
    *,
    cash: float = CASH,
    commission_bps: float = 1.0,
    slippage_bps: float = 2.0,
    max_drawdown: float | None = None,
    sleeve: str = "strategy_id",
    group: str = "portfolio_id",
) -> dict[str, DataFrame]:
    """LG1-LG5: snapshots, fills and result of every paper portfolio.

    ``flags``: (group, sleeve, ts, close, entry, exit, max_position) on common timestamps;
    ``weights``: (group, sleeve, weight).
    """
    if cash <= 0:
        raise ValueError("initial_cash must be positive")
    if max_drawdown is not None and not 0 < max_drawdown < 1:
        raise ValueError("max_drawdown must be between 0 and 1")
    keys = [group, sleeve]
    own = sleeves(flags, keys, commission_bps=commission_bps, slippage_bps=slippage_bps)
    own = own.join(weights.select(*keys, "weight"), keys).withColumn("start_cash", F.lit(cash) * F.col("weight"))
    reserve = weights.groupBy(group).agg((F.lit(cash) * (F.lit(1.0) - F.sum("weight"))).alias("reserve"))
    curve = own.groupBy(group, "ts").agg(
        F.sum(F.col("equity") * F.col("start_cash")).alias("marked"),
        F.sum(F.col("liquid") * F.col("start_cash")).alias("sold"),
    ).join(reserve, group).withColumns(
        {"equity": F.col("marked") + F.col("reserve"), "if_sold": F.col("sold") + F.col("reserve")}
    )
    peak = F.max("equity").over(running([group]))
    drawdown = F.lit(1.0) - F.col("equity") / F.when(peak != 0, peak)
    broken = F.col("equity") <= 0
    if max_drawdown is not None:
        broken = broken | (drawdown >= max_drawdown)
    curve = curve.withColumn("broken", F.coalesce(broken, F.lit(False)))
    ends = curve.groupBy(group).agg(
        F.min(F.when(F.col("broken"), F.col("ts"))).alias("halt_ts"), F.max("ts").alias("last_ts"),
        F.min_by(F.col("equity"), F.when(F.col("broken"), F.col("ts"))).alias("halt_equity"),
    ).withColumns(
        {
            "halted": F.col("halt_ts").isNotNull(),
            "end_ts": F.coalesce("halt_ts", "last_ts"),
            "halt_reason": F.when(F.col("halt_equity") <= 0, "non-positive equity").when(
                F.col("halt_ts").isNotNull(), "maximum drawdown breached"
            ),
        }
    )
    kept = curve.join(ends.select(group, "end_ts", "halted"), group).where(F.col("ts") <= F.col("end_ts"))
    snapshots = kept.select(
        group, "ts", F.when(F.col("ts") == F.col("end_ts"), F.col("if_sold")).otherwise(F.col("equity")).alias("equity"),
        "reserve",
    )
    result = kept.where(F.col("ts") == F.col("end_ts")).select(group, F.col("if_sold").alias("final_equity")).join(
        ends.select(group, "halted", "halt_reason", "end_ts"), group
    )
    c, s = _rates(commission_bps, slippage_bps)
    live = own.join(ends.select(group, "end_ts", "halted"), group).where(
        (F.col("ts") <= F.col("end_ts")) & (F.col("start_cash") > 0)
    )
    at_end = F.col("ts") == F.col("end_ts")
    legs = F.filter(
        F.array(
            F.when(F.col("side").isNotNull(), F.struct(F.col("side").alias("action"), F.lit(0).alias("phase"))),
            F.when(at_end & F.col("held"), F.struct(F.lit("sell").alias("action"), F.lit(1).alias("phase"))),
        ),
        lambda x: x.isNotNull(),
    )
    fills = live.withColumn("leg", F.explode(legs)).select(
        *keys, "ts", "leg.action", "leg.phase", "close", "entry", "exit", "halted", "end_ts",
        (F.col("qty") * F.col("start_cash")).alias("quantity"),
        (F.col("close") * F.when(F.col("leg.action") == "buy", F.lit(1 + s)).otherwise(F.lit(1 - s))).alias("price"),
    ).withColumn("fee", F.col("quantity") * F.col("price") * F.lit(c))
    return {"snapshots": snapshots, "fills": fills, "result": result, "sleeves": own}


def paper_strategy(
    flags: DataFrame, keys: Sequence[str], *, cash: float = CASH, commission_bps: float = 1.0,
    slippage_bps: float = 2.0, limit: str = "max_drawdown",
) -> DataFrame:
    """LG6: one strategy alone - no bar-0 buy, no liquidation on a halt, checks before and after each trade.

    A position that cash cannot pay for is an error in every buying run, reported in ``error``.
    The check before the trade looks at the position carried into the bar.
    """
    c, s = _rates(commission_bps, slippage_bps)
    df = sleeves(flags, keys, commission_bps=commission_bps, slippage_bps=slippage_bps, initial_buy=False)
    w = series(keys)
    prev_base = F.coalesce(F.lag("base").over(w), F.lit(1.0))
    spent = F.lit(1.0) - F.col("k") * F.lit((1 + s) * (1 + c))
    before = F.when(
        F.col("was_held"), prev_base * (spent + F.col("k") * F.col("close") / F.col("carried_px"))
    ).otherwise(prev_base)
    df = df.withColumn("carried_px", F.lag("entry_px").over(w)).withColumn("before", before)
    peak_prev = F.coalesce(
        F.max(F.greatest("before", "equity")).over(running(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    df = df.withColumn("peak_prev", peak_prev)
    stop = F.col(limit)
    hit_before = (F.col("before") <= 0) | (stop.isNotNull() & (F.lit(1.0) - F.col("before") / F.greatest("peak_prev", "before") >= stop))
    hit_after = (F.col("equity") <= 0) | (
        stop.isNotNull() & (F.lit(1.0) - F.col("equity") / F.greatest("peak_prev", "before", "equity") >= stop)
    )
    df = df.withColumns({"hit_before": F.coalesce(hit_before, F.lit(False)), "hit_after": F.coalesce(hit_after, F.lit(False))})
    ends = df.groupBy(*keys).agg(
        F.min(F.when(F.col("hit_before") | F.col("hit_after"), F.col("ts"))).alias("halt_ts"),
        F.max("ts").alias("last_ts"),
        F.bool_or((F.col("side") == "buy") & (F.col("max_position") * F.lit((1 + s) * (1 + c)) > 1 + 1e-12)).alias("poor"),
    )
    df = df.join(ends, list(keys)).withColumn("end_ts", F.coalesce("halt_ts", "last_ts")).where(
        F.col("ts") <= F.col("end_ts")
    )
    shown = F.when(F.col("hit_before") & (F.col("ts") == F.col("halt_ts")), F.col("before")).when(
        F.col("halt_ts").isNull() & (F.col("ts") == F.col("last_ts")), F.col("liquid")
    ).otherwise(F.col("equity"))
    return df.select(
        *keys, "ts", (shown * F.lit(cash)).alias("equity"),
        F.col("halt_ts").isNotNull().alias("halted"),
        F.when(F.coalesce("poor", F.lit(False)), "insufficient paper cash").alias("error"),
    )


def sleeve_returns(flags: DataFrame, keys: Sequence[str], **costs: float) -> DataFrame:
    """LG7: returns per sleeve for attribution: no bar-0 buy, liquidated on the last bar."""
    own = sleeves(flags, keys, initial_buy=False, **costs)
    last = F.lead("ts").over(series(keys)).isNull()
    own = own.withColumn("e", F.when(last, F.col("liquid")).otherwise(F.col("equity")))
    return own.select(
        *keys, "ts", F.coalesce(F.col("e") / F.lag("e").over(series(keys)) - 1.0, F.lit(0.0)).alias("r")
    )


# --- audit ------------------------------------------------------------------
AUDIT = ["sequence", "strategy_id", "action", "timestamp", "quantity", "price", "fee"]


def audit_events(fills: DataFrame, members: DataFrame, run: str = "portfolio_id", sleeve: str = "strategy_id") -> DataFrame:
    """LG8: fills numbered from 0 by time, phase and member rank, with a content id.

    The number is a running count over buckets of time, so a run of any length is spread over all tasks.
    """
    ranked = fills.join(members.select(run, sleeve, "member_rank"), [run, sleeve])
    placed = ls.with_bucket(ranked, F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    counted = ls.plain(ls.running(placed, [run], ["ts", "phase", "member_rank"], {"_number": ("sum", F.lit(1))}))
    df = counted.withColumns(
        {"sequence": (F.col("_number") - 1).cast("int"), "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")}
    ).withColumnRenamed(sleeve, "strategy_id")
    return df.withColumn("event_id", content_id(AUDIT)).select(
        run, *AUDIT, "event_id", "ts", "entry", "exit", "halted", "end_ts"
    )


def manifest(events: DataFrame, run: str = "portfolio_id") -> DataFrame:
    """LG9: contiguous sequence, unique ids and a digest of the ledger.

    The digest sums the SHA-256 of (sequence, event id) in parts, so a run of any length is a plain
    aggregate and no task holds the id list.
    """
    agg = events.groupBy(run).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("sequence").alias("n_seq"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
        F.count_distinct("event_id").alias("n_ids"),
        *digest_parts(["sequence", "event_id"]),
    )
    gap = (F.col("lo") != 0) | (F.col("hi") != F.col("event_count") - 1) | (F.col("n_seq") != F.col("event_count"))
    return agg.select(
        run, "event_count",
        F.substring(digest_of("event_count"), 1, 16).alias("ledger_fingerprint"),
        first_reason(
            (gap, "audit event sequences must be contiguous from zero"),
            (F.col("n_ids") != F.col("event_count"), "audit events must have unique identities"),
        ).alias("error"),
    )


def fill_reasons(events: DataFrame, run: str = "portfolio_id") -> DataFrame:
    """LG10: the decision that authorises each fill; a fill without one is an error."""
    # One row for each run, from map-side minima: no task sorts or holds the fills of a run.
    df = events.join(events.groupBy(run).agg(F.min("ts").alias("first_ts")), run)
    sell = F.col("action") == "sell"
    reason = (
        F.when(F.col("halted") & sell, F.when(F.col("ts") == F.col("end_ts"), F.lit("risk_halt")))
        .when(~sell & F.col("entry"), "entry_signal")
        .when(~sell & (F.col("ts") == F.col("first_ts")), "initial_allocation")
        .when(sell & F.col("exit"), "exit_signal")
        .when(sell & (F.col("ts") == F.col("end_ts")), "end_of_sample")
    )
    df = df.withColumn("reason", reason)
    return df.withColumns(
        {
            "decision_id": F.when(F.col("reason").isNotNull(), content_id(["strategy_id", "timestamp", "action", "reason"])),
            "error": F.when(
                F.col("reason").isNull(),
                F.concat(F.lit("fill at "), "timestamp", F.lit(" for "), "strategy_id", F.lit(" has no deterministic authorizing decision")),
            ),
        }
    ).drop("first_ts")


def replay(
    events: DataFrame, sleeves_cash: DataFrame, finals: DataFrame, *, commission_bps: float = 1.0,
    tolerance: float = 1e-8, run: str = "portfolio_id",
) -> DataFrame:
    """LG11: rebuild cash and position from the fills and name the first broken rule per run.

    ``sleeves_cash``: (run, strategy_id, start_cash); ``finals``: (run, final_equity).  Rules that
    stop at the event they meet are ordered by event; the end-of-ledger rules follow.
    """
    keys = [run, "strategy_id"]
    signed = F.when(F.col("action") == "buy", 1.0).otherwise(-1.0)
    notional = F.col("quantity") * F.col("price")
    expected = notional * F.lit(commission_bps / 10_000.0)
    # Both the run and the sleeve are walked in buckets of the sequence: neither bounds the number of its fills.
    df = ls.previous(ls.with_bucket(events, F.col("sequence")), [run], ["sequence"], ["ts"])
    df = df.join(sleeves_cash.select(*keys, "start_cash"), keys, "left").withColumns(
        {
            "notional": notional,
            "late": F.col("ts") < F.col("prev_ts"),
            "fee_off": F.abs(F.col("fee") - expected) > tolerance * F.greatest(expected, F.lit(1.0)),
            "flow": F.when(F.col("action") == "buy", -(notional + F.col("fee"))).otherwise(notional - F.col("fee")),
        }
    )
    df = ls.plain(ls.running(df, keys, ["sequence"], {"position": ("sum", signed * F.col("quantity")), "_flow": ("sum", F.col("flow"))}))
    df = df.withColumn("cash", F.col("start_cash") + F.col("_flow"))
    problem = first_reason(
        (F.col("start_cash").isNull(), "audit event references a strategy outside the execution"),
        (F.col("late"), "audit events must be chronological"),
        (~F.col("action").isin("buy", "sell"), "audit event action must be buy or sell"),
        ((F.col("quantity") <= 0) | (F.col("price") <= 0) | (F.col("fee") < 0), "audit fill quantity, price, and fee are invalid"),
        ((F.col("notional") <= 0) | ~finite("notional"), "audit fill notional is invalid"),
        ((F.col("action") == "sell") & (F.col("position") < -tolerance), "audit ledger contains a sell exceeding the strategy position"),
        ((F.col("action") == "buy") & (F.col("cash") < -tolerance), "audit ledger contains a buy exceeding available strategy cash"),
    )
    df = df.withColumn("problem", problem)
    per_sleeve = df.groupBy(*keys).agg(
        F.max_by("position", "sequence").alias("position"), F.sum("flow").alias("flow"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("sequence", "problem"))).alias("first"),
        F.bool_or(F.col("fee_off") & (F.col("fee") == 0)).alias("zero_fee"), F.bool_or("fee_off").alias("fee_off"),
    )
    totals = sleeves_cash.groupBy(run).agg(F.sum("start_cash").alias("start"))
    agg = per_sleeve.groupBy(run).agg(
        F.min("first").alias("first"), F.sum("flow").alias("flow"),
        F.max(F.abs("position")).alias("open"), F.bool_or("zero_fee").alias("zero_fee"), F.bool_or("fee_off").alias("fee_off"),
    ).join(totals, run).join(finals, run).withColumn("ending_cash", F.col("start") + F.col("flow"))
    fee_text = "audit fill fee does not match execution configuration"
    error = first_reason(
        (F.col("first").isNotNull(), F.col("first.problem")),
        (F.col("zero_fee"), fee_text),
        (F.col("open") > tolerance, "audit ledger does not end flat"),
        (F.col("fee_off"), fee_text),
        (
            F.abs(F.col("ending_cash") - F.col("final_equity")) > tolerance * F.greatest(F.abs("final_equity"), F.lit(1.0)),
            "audit ledger cash does not reconcile to final equity",
        ),
    )
    return agg.select(run, "ending_cash", "final_equity", error.alias("error")).withColumn(
        "valid", F.col("error").isNull()
    )


def run_identity(runs: DataFrame) -> DataFrame:
    """Run id and execution fingerprint from the inputs of a run."""
    inputs = [c for c in runs.columns if c not in ("run_id", "execution_fingerprint")]
    return runs.withColumns(
        {"execution_fingerprint": content_id(inputs, 24), "run_id": content_id(inputs, 16)}
    )


def verify_runs(stored: DataFrame, actual: DataFrame, accounting: DataFrame, lineage: DataFrame, run: str = "portfolio_id") -> DataFrame:
    """LG12: stored (run, event_count, ledger_fingerprint, run_id, expected_run_id, execution_fingerprint,
    expected_fingerprint) against the recomputed manifest, accounting and fill lineage; the first
    failing check by order gives the reason."""
    a = actual.select(run, F.col("event_count").alias("a_count"), F.col("ledger_fingerprint").alias("a_fp"), F.col("error").alias("a_error"))
    acc = accounting.select(run, F.col("error").alias("acc_error"))
    lin = lineage.groupBy(run).agg(F.max("error").alias("lin_error"), F.count(F.lit(1)).alias("lin_count"))
    df = stored.join(a, run, "left").join(acc, run, "left").join(lin, run, "left")
    reason = first_reason(
        (F.col("a_error").isNotNull(), F.col("a_error")),
        (F.col("ledger_fingerprint").isNull(), "stored execution is missing a ledger fingerprint commitment"),
        (
            (F.col("event_count") != F.coalesce("a_count", F.lit(0))) | (F.col("ledger_fingerprint") != F.coalesce("a_fp", F.lit(""))),
            "persisted execution ledger fingerprint mismatch",
        ),
        (F.col("run_id") != F.col("expected_run_id"), "portfolio run ID does not match persisted execution inputs"),
        (F.col("execution_fingerprint") != F.col("expected_fingerprint"), "execution fingerprint does not match persisted execution inputs"),
        (F.coalesce("lin_count", F.lit(0)) != F.col("event_count"), "stored execution is missing a complete fill lineage"),
        (F.col("acc_error").isNotNull(), F.concat(F.lit("execution ledger accounting mismatch: "), "acc_error")),
        (F.col("lin_error").isNotNull(), F.concat(F.lit("signal replay failed: "), "lin_error")),
    )
    return df.select(run, "run_id", "event_count", reason.alias("reason")).withColumn("valid", F.col("reason").isNull())


def payload_problems(attributed: DataFrame, events: DataFrame, members: DataFrame, run: str = "portfolio_id") -> DataFrame:
    """LG13: attribution and audit rows must belong to members, be unique and finite."""
    keys = [run, "strategy_id"]
    m = members.select(*keys).distinct()
    parts = [
        attributed.join(m, keys, "left_anti").select(*keys, F.lit("attribution references non-member strategy").alias("reason")),
        attributed.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate attribution strategy").alias("reason")),
        attributed.where(~finite("return_contribution") | ~finite("risk_contribution")).select(
            *keys, F.lit("attribution values must be finite").alias("reason")
        ),
        events.join(m, keys, "left_anti").select(*keys, F.lit("audit event references non-member strategy").alias("reason")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def eligibility_problems(decisions: DataFrame, members: DataFrame, sleeve: str = "strategy_id") -> DataFrame:
    """Members without an eligible promotion decision may not trade."""
    d = decisions.select(sleeve, "eligible", "stage")
    df = members.join(d, sleeve, "left")
    why = reasons(
        (F.col("eligible").isNull(), "paper eligibility decisions are required for every strategy"),
        (F.col("eligible").isNotNull() & (~F.col("eligible") | ~F.col("stage").isin("promoted", "paper", "live")),
         "strategy is not eligible for paper execution"),
    )
    return df.select(*members.columns, why.alias("reasons")).where(F.size("reasons") > 0)

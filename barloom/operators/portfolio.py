"""Portfolio construction, risk and feedback (PF1-PF12, RK3, RK8, MT9).

Returns are long rows (portfolio_id, strategy_id, ts, r); all portfolios are built together.
Portfolio volatility and risk shares use the identities  w'Cw = var(sum w r)  and
(Cw)_i = cov(r_i, sum w r), so they are linear in the rows and need no matrix.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.functions.columns import clip01, finite, first_reason, ratio, reasons, whole
from barloom.functions.scale import tiles
from barloom.operators.ranking import diversity_from, final_score
from barloom.session import cut

G = "portfolio_id"


def aligned(returns: DataFrame) -> DataFrame:
    """PF1, PF4: timestamps on which every strategy of the portfolio has a finite return."""
    members = returns.groupBy(G).agg(F.count_distinct("strategy_id").alias("n_members"))
    per_ts = returns.groupBy(G, "ts").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(finite("r")).alias("ok")
    )
    good = per_ts.join(members, G).where((F.col("n") == F.col("n_members")) & F.col("ok")).select(G, "ts")
    return returns.join(good, [G, "ts"], "left_semi")


# Members up to which the pairs of one timestamp are aggregated directly; larger portfolios go through block tiles.
PAIR_MEMBERS = 32


def pair_moments(returns: DataFrame) -> DataFrame:
    """``moments`` for small portfolios: the pairs of a timestamp are rows of a map-side aggregate."""
    at = returns.groupBy(G, "ts").agg(F.sort_array(F.collect_list(F.struct("strategy_id", "r"))).alias("m"))
    pairs = F.flatten(
        F.transform(
            "m",
            lambda a, i: F.transform(
                F.slice(F.col("m"), i + 1, F.size("m")),
                lambda b: F.struct(a["strategy_id"].alias("a"), b["strategy_id"].alias("b"), a["r"].alias("x"), b["r"].alias("y")),
            ),
        )
    )
    cells = at.select(G, F.inline(pairs)).groupBy(G, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("x", "y").alias("cov"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")
    )
    return cells.select(G, "a", "b", "n", "cov", ratio(F.col("cov"), F.col("sx") * F.col("sy")).alias("corr"))


def wide_moments(wide: DataFrame, members: dict[str, str], own: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """PF1-PF4 where the members of a portfolio stand side by side: ``members`` maps a strategy to the column of its returns.

    One aggregate over the aligned rows (all members finite) gives (portfolio_id, a, b, n, cov, corr, vol) for every pair a <= b and for
    every member as a = b; ``vol`` is the deviation of a.  ``own`` adds figures of a member (name to strategy to aggregate, over all
    rows), which are null for pairs.  No row of returns is copied, shuffled for a pair or kept.
    """
    names = sorted(members)
    good = functools.reduce(lambda x, y: x & y, [finite(members[s]) for s in names])
    r = {s: F.when(good, F.col(members[s])) for s in names}
    own = own or {}
    agg = [F.count(F.when(good, 1)).alias("n"), *[F.stddev_samp(r[s]).alias(f"sd{i}") for i, s in enumerate(names)]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    agg += [F.covar_samp(r[names[i]], r[names[j]]).alias(f"cov{i}_{j}") for i, j in pairs]
    agg += [by[s].alias(f"{c}_{i}") for c, by in own.items() for i, s in enumerate(names)]
    rows = [
        F.struct(
            F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col("n"), F.col(f"cov{i}_{j}").alias("cov"),
            ratio(F.col(f"cov{i}_{j}"), F.col(f"sd{i}") * F.col(f"sd{j}")).alias("corr"), F.col(f"sd{i}").alias("vol"),
            *[(F.col(f"{c}_{i}") if i == j else F.lit(None).cast("double")).alias(c) for c in own],
        )
        for i, j in pairs
    ]
    return wide.groupBy(G).agg(*agg).select(G, F.inline(F.array(*rows)))


def corr_from(pairs: DataFrame, picked: DataFrame) -> DataFrame:
    """``corr_with`` read from the pairs of ``wide_moments``."""
    both = pairs.select(G, "a", "b", "corr").unionByName(pairs.where("a <> b").select(G, F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return both.join(picked.select(G, F.col("pick").alias("b")), [G, "b"]).select(G, F.col("a").alias("strategy_id"), "corr")


def moments(returns: DataFrame, blocks: int | None = None, ts_blocks: int | None = None) -> DataFrame:
    """PF2, PF3: covariance and correlation of every strategy pair of aligned returns.

    Portfolios of up to PAIR_MEMBERS strategies take ``pair_moments`` (equal up to the order of sums).  For larger ones block
    tiles multiply matrices of (timestamps x strategies): a return is copied once per
    strategy block, not once per partner, and partial products add up over timestamp blocks.
    Returns are centred first, so the sums do not cancel.  Block counts follow from the largest
    portfolio unless given: a tile holds at most about 512 x 512 strategies and 4096 timestamps.
    """
    if blocks is None or ts_blocks is None:
        top = returns.groupBy(G, "strategy_id").agg(F.count(F.lit(1)).alias("t")).groupBy(G).agg(
            F.count(F.lit(1)).alias("n"), F.max("t").alias("t")
        ).agg(F.max("n").alias("n"), F.max("t").alias("t")).first()
        if blocks is None and (top["n"] or 0) <= PAIR_MEMBERS:
            return pair_moments(returns)
        blocks = blocks or max(1, math.ceil((top["n"] or 1) / 512))
        ts_blocks = ts_blocks or max(1, math.ceil((top["t"] or 1) / 4096))
    centred = returns.withColumn(
        "x", F.col("r") - F.avg("r").over(Window.partitionBy(G, "strategy_id"))
    ).withColumn("tb", F.pmod(F.xxhash64("ts"), F.lit(ts_blocks)).cast("int"))

    def matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Names and the (timestamps x strategies) matrix of one side; rows share the same timestamps."""
        t, ts = pd.factorize(pdf["ts"], sort=True)
        s, names = pd.factorize(pdf["strategy_id"], sort=True)
        m = np.zeros((len(ts), len(names)))
        m[t, s] = pdf["x"].to_numpy()
        return names.to_numpy(), m

    def cells_of(portfolio: str, a: np.ndarray, b: np.ndarray, sums: np.ndarray, n: int, same: bool) -> pd.DataFrame:
        left, right = np.meshgrid(a, b, indexing="ij")
        out = pd.DataFrame({G: portfolio, "a": left.ravel(), "b": right.ravel(), "sxy": sums.ravel(), "n": n})
        swap = (out["a"] > out["b"]).to_numpy()
        if same:
            return out[~swap]
        out.loc[swap, ["a", "b"]] = out.loc[swap, ["b", "a"]].to_numpy()
        return out

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = matrix(pdf)
        return cells_of(pdf[G].iloc[0], names, names, m.T @ m, len(m), True)

    def two_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        a, left = matrix(pdf[pdf["_side"] == "l"])
        b, right = matrix(pdf[pdf["_side"] == "r"])
        if not len(left) or not len(right):
            return pd.DataFrame({G: [], "a": [], "b": [], "sxy": [], "n": []})
        same = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        return cells_of(pdf[G].iloc[0], a, b, left.T @ right, len(left), same)

    schema = f"{G} string, a string, b string, sxy double, n long"
    rows = centred.select(G, "strategy_id", "ts", "x", "tb")
    if blocks == 1:
        parts = rows.groupBy(G, "tb").applyInPandas(one_block, schema)
    else:
        parts = tiles(
            rows, [G], F.pmod(F.xxhash64("strategy_id"), F.lit(blocks)).cast("int"), blocks, two_blocks, schema, split=["tb"]
        )
    cells = parts.groupBy(G, "a", "b").agg(F.sum("sxy").alias("sxy"), F.sum("n").alias("n"))
    diag = cells.where(F.col("a") == F.col("b"))
    va = diag.select(G, "a", F.col("sxy").alias("va"))
    vb = diag.select(G, "b", F.col("sxy").alias("vb"))
    full = cells.join(va, [G, "a"]).join(vb, [G, "b"])
    return full.select(
        G, "a", "b", "n",
        (F.col("sxy") / F.when(F.col("n") > 1, F.col("n") - 1)).alias("cov"),
        ratio(F.col("sxy"), F.sqrt(F.col("va") * F.col("vb"))).alias("corr"),
    )


def corr_with(returns: DataFrame, picked: DataFrame) -> DataFrame:
    """Correlation of every strategy with the one ``picked`` (portfolio_id, pick) per portfolio.

    Linear: each return meets only the picked series of its timestamp.
    """
    p = returns.join(
        picked.select(G, F.col("pick").alias("strategy_id")), [G, "strategy_id"]
    ).select(G, "ts", F.col("r").alias("y"))
    both = returns.join(p, [G, "ts"])
    n = F.count(F.lit(1))
    return both.groupBy(G, "strategy_id").agg(
        ratio(F.covar_samp("r", "y"), F.stddev_samp("r") * F.stddev_samp("y")).alias("corr"), n.alias("n")
    ).select(G, "strategy_id", "corr")


def _state(ranked: DataFrame, keep: Sequence[str]) -> DataFrame:
    return ranked.select(
        G, "strategy_id", *keep, F.lit(None).cast("int").alias("pos"),
        F.lit(0.0).alias("pos_sum"), F.lit(0).cast("bigint").alias("n_corr"),
    )


def _advance(state: DataFrame, picks: DataFrame, corr_of: Callable[[DataFrame], DataFrame], step: int, keep: Sequence[str]) -> DataFrame:
    """Mark the picks of this round and add their correlations to the running sums."""
    corr = corr_of(picks).where(F.col("corr").isNotNull())
    s = state.join(picks, G, "left").join(corr, [G, "strategy_id"], "left")
    is_pick = F.coalesce(F.col("pick") == F.col("strategy_id"), F.lit(False))
    open_ = F.col("pos").isNull() & ~is_pick & F.col("corr").isNotNull()
    return cut(
        s.select(
            G, "strategy_id", *keep,
            F.when(is_pick, F.lit(step)).otherwise(F.col("pos")).cast("int").alias("pos"),
            (F.col("pos_sum") + F.when(open_, F.greatest("corr", F.lit(0.0))).otherwise(0.0)).alias("pos_sum"),
            (F.col("n_corr") + F.when(open_, 1).otherwise(0)).alias("n_corr"),
        )
    )


def select_diversified(
    returns: DataFrame, ranked: DataFrame, *, max_strategies: int = 10, max_average_correlation: float = 0.75,
    min_history: int = 20,
) -> DataFrame:
    """PF5: in rank order, accept a strategy whose mean positive correlation to the accepted ones is low.

    Nothing changes between two acceptances, so the next one is simply the lowest rank after the last
    that passes.  Each round adds the correlations with one accepted series for all portfolios at
    once; there are at most ``max_strategies`` rounds.  ``ranked``: (portfolio_id, strategy_id, rank).
    """
    _check_selection(max_strategies, max_average_correlation, min_history)
    good = aligned(returns)
    history = good.groupBy(G).agg(F.count_distinct("ts").alias("n_ts")).where(F.col("n_ts") >= min_history).select(G)
    good = cut(good.join(history, G, "left_semi"))
    return _diversified(ranked, history, lambda picks: corr_with(good, picks), max_strategies, max_average_correlation)


def select_from_pairs(
    pairs: DataFrame, ranked: DataFrame, *, max_strategies: int = 10, max_average_correlation: float = 0.75, min_history: int = 20,
) -> DataFrame:
    """PF5 from the pairs of ``wide_moments``: the rounds read a few rows for each portfolio and no returns."""
    _check_selection(max_strategies, max_average_correlation, min_history)
    history = pairs.where(F.col("n") >= min_history).select(G).distinct()
    return _diversified(ranked, history, lambda picks: corr_from(pairs, picks), max_strategies, max_average_correlation)


def _check_selection(max_strategies: int, max_average_correlation: float, min_history: int) -> None:
    if max_strategies <= 0:
        raise ValueError("max_strategies must be positive")
    if not 0 <= max_average_correlation <= 1:
        raise ValueError("max_average_correlation must be between 0 and 1")
    if min_history < 2:
        raise ValueError("min_history must be at least 2")


def _diversified(
    ranked: DataFrame, history: DataFrame, corr_of: Callable[[DataFrame], DataFrame], max_strategies: int, max_average_correlation: float,
) -> DataFrame:
    """The rounds of PF5 for the portfolios of ``history``."""
    state = cut(_state(ranked.join(history, G, "left_semi"), ["rank"]))
    for step in range(1, max_strategies + 1):
        last = F.coalesce(F.max(F.when(F.col("pos").isNotNull(), F.col("rank"))).over(whole([G])), F.lit(0))
        mean = ratio("pos_sum", "n_corr")
        fits = F.lit(True) if step == 1 else (F.col("n_corr") > 0) & (mean <= max_average_correlation)
        open_ = state.withColumn("_last", last).where(
            F.col("pos").isNull() & (F.col("rank") > F.col("_last")) & fits
        )
        picks = open_.groupBy(G).agg(F.min_by("strategy_id", "rank").alias("pick"))
        state = _advance(state, picks, corr_of, step, ["rank"])
        if state.where(F.col("pos") == step).isEmpty():
            break
    return state.select(
        G, "strategy_id", "rank", F.col("pos").isNotNull().alias("selected"), "pos",
        F.when(F.col("pos").isNotNull(), F.col("pos_sum")).alias("pos_sum"),
        F.when(F.col("pos").isNotNull(), F.col("n_corr")).alias("n_corr"),
    )


def average_correlation(selection: DataFrame) -> DataFrame:
    """Mean positive correlation over the pairs of selected strategies."""
    s = selection.where("selected").groupBy(G).agg(
        F.sum("pos_sum").alias("s"), F.sum("n_corr").alias("n"), F.count(F.lit(1)).alias("members")
    )
    return s.select(G, "members", F.coalesce(ratio("s", "n"), F.lit(0.0)).alias("average_correlation"))


def select_survivors(
    returns: DataFrame, candidates: DataFrame, survivors: int,
    weights: tuple[float, float, float] = (0.6, 0.25, 0.15),
) -> DataFrame:
    """RK8: greedy survivors by fitness, robustness and diversity against those already taken.

    ``candidates``: (portfolio_id, strategy_id, fitness, robustness, eligible); places that eligible
    candidates cannot fill go to the others in id order.
    """
    ok = F.col("eligible") & finite("fitness")
    good = cut(aligned(returns.join(candidates.where(ok).select(G, "strategy_id"), [G, "strategy_id"], "left_semi")))
    return _survivors(lambda picks: corr_with(good, picks), candidates, survivors, weights)


def survivors_from_pairs(
    pairs: DataFrame, candidates: DataFrame, survivors: int, weights: tuple[float, float, float] = (0.6, 0.25, 0.15),
) -> DataFrame:
    """RK8 from the pairs of ``wide_moments``, whose members share all their timestamps."""
    return _survivors(lambda picks: corr_from(pairs, picks), candidates, survivors, weights)


def _survivors(
    corr_of: Callable[[DataFrame], DataFrame], candidates: DataFrame, survivors: int, weights: tuple[float, float, float],
) -> DataFrame:
    ok = F.col("eligible") & finite("fitness")
    keep = ["fitness", "robustness"]
    state = cut(_state(candidates.where(ok), keep))
    for step in range(1, survivors + 1):
        div = diversity_from(F.col("pos_sum"), F.col("n_corr"), F.lit(step > 1))
        score = final_score(F.col("fitness"), F.col("robustness"), div, weights)
        open_ = state.where(F.col("pos").isNull()).withColumn("_s", score)
        first = F.struct(-F.col("_s"), -F.col("fitness"), F.col("strategy_id"))
        picks = open_.groupBy(G).agg(F.min_by("strategy_id", first).alias("pick"))
        state = _advance(state, picks, corr_of, step, keep)
        if state.where(F.col("pos") == step).isEmpty():
            break
    taken = state.where(F.col("pos").isNotNull()).select(G, "strategy_id", "pos")
    rest = candidates.join(taken, [G, "strategy_id"], "left_anti").join(
        taken.groupBy(G).agg(F.max("pos").alias("used")), G, "left"
    )
    # the rank filter lets Spark keep the first rows per partition before the shuffle
    n = F.row_number().over(Window.partitionBy(G).orderBy("strategy_id"))
    fill = rest.withColumn("_n", n).where(F.col("_n") <= survivors).withColumn(
        "pos", (F.col("_n") + F.coalesce("used", F.lit(0))).cast("int")
    ).where(F.col("pos") <= survivors).select(G, "strategy_id", "pos")
    return taken.withColumn("fallback", F.lit(False)).unionByName(fill.withColumn("fallback", F.lit(True)))


def inverse_volatility(
    returns: DataFrame, *, total: float = 1.0, minimum: float = 0.0, maximum: float = 1.0,
    floor: float = 1e-8, groups: Sequence[str] = (G,),
) -> DataFrame:
    """PF6: inverse-volatility weights with floor, minimum, cap and total exposure.

    Water-filling in closed form: with strategies ordered by inverse volatility the capped ones are a
    prefix, and its length is the first rank whose share of what is left stays under the cap.
    """
    g = list(groups)
    return _filled(_member_volatility(returns, g, floor), g, total, minimum, maximum, floor)


def _filled(vol: DataFrame, g: list[str], total: float, minimum: float, maximum: float, floor: float) -> DataFrame:
    """Weights of the members ``vol`` (groups, strategy_id, est_vol, _obs, _ok)."""
    if not 0 < total <= 1:
        raise ValueError("max_total_weight must be in (0, 1]")
    if minimum < 0:
        raise ValueError("min_weight cannot be negative")
    if maximum < minimum or maximum <= 0:
        raise ValueError("max_weight must be positive and at least min_weight")
    if floor <= 0:
        raise ValueError("volatility_floor must be positive and finite")
    # One member that cannot be weighed fails its portfolio closed; allocation_problems says why.
    vol = vol.withColumn("_all", F.bool_and((F.col("_obs") >= 2) & F.col("_ok")).over(whole(g))).where("_all")
    order = Window.partitionBy(*g).orderBy(F.desc("inv"), "strategy_id")
    df = vol.withColumn("inv", F.lit(1.0) / F.col("est_vol"))
    df = df.withColumns(
        {
            "k": F.row_number().over(order),
            "n": F.count(F.lit(1)).over(whole(g)),
            "suf": F.sum("inv").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    step = maximum - minimum
    left = F.lit(total) - F.col("n") * F.lit(minimum) - (F.col("k") - 1) * F.lit(step)
    fits = (left <= 1e-12) | (F.lit(minimum) + left * F.col("inv") / F.col("suf") <= F.lit(maximum + 1e-12))
    df = df.withColumn("first_free", F.coalesce(F.min(F.when(fits, F.col("k"))).over(whole(g)), F.col("n") + 1))
    free_inv = F.sum(F.when(F.col("k") >= F.col("first_free"), F.col("inv"))).over(whole(g))
    rest = F.greatest(
        F.lit(total) - F.col("n") * F.lit(minimum) - (F.col("first_free") - 1) * F.lit(step), F.lit(0.0)
    )
    weight = F.when(F.col("k") < F.col("first_free"), F.lit(maximum)).otherwise(
        F.lit(minimum) + rest * F.col("inv") / free_inv
    )
    # a minimum that cannot be paid for every strategy fails closed
    return df.where(F.col("n") * F.lit(minimum) <= F.lit(total)).withColumn("weight", weight).select(
        *g, "strategy_id", "weight", "est_vol"
    )


def _member_volatility(returns: DataFrame, groups: Sequence[str], floor: float) -> DataFrame:
    return returns.groupBy(*groups, "strategy_id").agg(
        F.greatest(F.stddev_samp("r"), F.lit(floor)).alias("est_vol"), F.count(F.lit(1)).alias("_obs"), F.bool_and(finite("r")).alias("_ok"),
    )


def pairs_volatility(pairs: DataFrame) -> DataFrame:
    """Deviation and aligned bars of every member, as ``_member_volatility`` gives them."""
    return pairs.where("a = b").select(G, F.col("a").alias("strategy_id"), F.col("vol").alias("est_vol"), F.col("n").alias("_obs"), F.lit(True).alias("_ok"))


def allocation_problems(returns: DataFrame, *, total: float = 1.0, minimum: float = 0.0, groups: Sequence[str] = (G,)) -> DataFrame:
    """PF6: (portfolio, strategy_id or null, reason) of what keeps a portfolio from being weighed."""
    return _problems(_member_volatility(returns, groups, 0.0), list(groups), total, minimum)


def _problems(members: DataFrame, g: list[str], total: float, minimum: float) -> DataFrame:
    bad = members.select(
        *g, "strategy_id",
        first_reason((~F.col("_ok"), "strategy returns must contain only finite values"), (F.col("_obs") < 2, "at least two return observations are required")).alias("reason"),
    ).where(F.col("reason").isNotNull())
    dear = members.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * F.lit(minimum) > F.lit(total))
    return bad.unionByName(dear.select(*g, F.lit(None).cast("string").alias("strategy_id"), F.lit("minimum weights exceed total exposure").alias("reason")))


def build_portfolio(
    returns: DataFrame, ranked: DataFrame, *, max_strategies: int = 10, max_average_correlation: float = 0.75, min_history: int = 20,
    total: float = 1.0, minimum: float = 0.0, maximum: float = 1.0, floor: float = 1e-8,
) -> DataFrame:
    """PF7: from ranked candidates and their returns to a weighted portfolio, for every portfolio at once.

    Timestamps at which a candidate has no finite return are left out first; then complementary strategies are selected
    in rank order and weighed by inverse volatility.  Every ranked candidate comes back with ``selected, pos, weight, est_vol`` and,
    where its portfolio could not be built, ``problem``.
    """
    members = ranked.select(G, "strategy_id", "rank")
    kept = cut(aligned(returns.join(members.select(G, "strategy_id"), [G, "strategy_id"], "left_semi")))
    chosen = cut(
        select_diversified(kept, members, max_strategies=max_strategies, max_average_correlation=max_average_correlation, min_history=min_history)
    )
    taken = kept.join(chosen.where("selected").select(G, "strategy_id"), [G, "strategy_id"], "left_semi")
    history = kept.groupBy(G).agg(F.count_distinct("ts").alias("_bars"))
    limits = {"total": total, "minimum": minimum, "maximum": maximum, "floor": floor}
    return _built(members, chosen, _member_volatility(taken, [G], 0.0), history, min_history, limits)


def build_from_pairs(
    pairs: DataFrame, ranked: DataFrame, *, max_strategies: int = 10, max_average_correlation: float = 0.75, min_history: int = 20,
    total: float = 1.0, minimum: float = 0.0, maximum: float = 1.0, floor: float = 1e-8,
) -> DataFrame:
    """PF7 from the pairs of ``wide_moments``."""
    members = ranked.select(G, "strategy_id", "rank")
    chosen = cut(select_from_pairs(pairs, members, max_strategies=max_strategies, max_average_correlation=max_average_correlation, min_history=min_history))
    taken = pairs_volatility(pairs).join(chosen.where("selected").select(G, "strategy_id"), [G, "strategy_id"], "left_semi")
    history = pairs.where("n > 0").groupBy(G).agg(F.max("n").alias("_bars"))
    return _built(members, chosen, taken, history, min_history, {"total": total, "minimum": minimum, "maximum": maximum, "floor": floor})


def _built(members: DataFrame, chosen: DataFrame, vol: DataFrame, history: DataFrame, min_history: int, limits: dict[str, float]) -> DataFrame:
    """Weights and problems of the ``chosen`` members, whose deviations are ``vol``."""
    weights = _filled(vol.withColumn("est_vol", F.greatest("est_vol", F.lit(limits["floor"]))), [G], **limits)
    problems = _problems(vol, [G], limits["total"], limits["minimum"]).groupBy(G).agg(F.min("reason").alias("_problem"))
    out = members.join(chosen.drop("rank"), [G, "strategy_id"], "left").join(weights, [G, "strategy_id"], "left")
    out = out.join(problems, G, "left").join(history, G, "left")
    why = first_reason(
        (F.col("_bars").isNull(), "returns contain no finite observations"), (F.col("_bars") < min_history, "not enough common history"), (F.col("_problem").isNotNull(), F.col("_problem")),
    )
    return out.select(G, "strategy_id", "rank", F.coalesce("selected", F.lit(False)).alias("selected"), "pos", "weight", "est_vol", why.alias("problem"))


def portfolio_returns(returns: DataFrame, weights: DataFrame, groups: Sequence[str] = (G,)) -> DataFrame:
    """Weighted return per timestamp."""
    g = list(groups)
    w = weights.select(*g, "strategy_id", "weight")
    return returns.join(w, [c for c in g if c in returns.columns] + ["strategy_id"]).groupBy(*g, "ts").agg(
        F.sum(F.col("weight") * F.col("r")).alias("p")
    )


def portfolio_volatility(returns: DataFrame, weights: DataFrame, groups: Sequence[str] = (G,)) -> DataFrame:
    """PF8."""
    p = portfolio_returns(returns, weights, groups)
    return p.groupBy(*groups).agg(F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("volatility"))


def risk_prefix(
    returns: DataFrame, selection: DataFrame, *, max_volatility: float = 0.25, **allocation: float
) -> DataFrame:
    """PF9: largest prefix of the selected strategies, in acceptance order, whose volatility is allowed.

    Each return is moved once: the members' returns of a timestamp meet in one row, which holds the weights of all
    prefixes beside them, and gives one return for each prefix.  The policy bounds the members, so also these rows.
    """
    if max_volatility <= 0:
        raise ValueError("max_portfolio_volatility must be finite and positive")
    limits = {"total": 1.0, "minimum": 0.0, "maximum": 1.0, "floor": 1e-8} | allocation
    sel = selection.where("selected").select(G, "strategy_id", "pos")
    size = sel.groupBy(G).agg(F.max("pos").alias("members"))
    rows = returns.join(sel, [G, "strategy_id"]).select(G, "strategy_id", "ts", "pos", "r")
    pref = sel.join(size, G).withColumn("prefix", F.explode(F.sequence("pos", "members"))).select(G, "strategy_id", "prefix")
    single = _member_volatility(rows, [G], limits["floor"]).join(pref, [G, "strategy_id"])
    weights = _filled(single, [G, "prefix"], **limits).join(sel, [G, "strategy_id"])
    by_prefix = weights.groupBy(G, "prefix").agg(F.map_from_entries(F.collect_list(F.struct("pos", "weight"))).alias("w"))
    by_prefix = by_prefix.groupBy(G).agg(F.collect_list(F.struct("prefix", "w")).alias("prefixes"))
    at = rows.groupBy(G, "ts").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("rs")).join(by_prefix, G)

    def combined(p: Column) -> Column:
        own = F.filter("rs", lambda x: x["pos"] <= p["prefix"])
        total = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x["r"] * F.element_at(p["w"], x["pos"]))
        return F.struct(p["prefix"].alias("prefix"), F.when(F.size(own) > 0, total).alias("p"))

    parts = at.select(G, F.inline(F.transform("prefixes", combined))).where(F.col("p").isNotNull())
    return _admitted(parts.groupBy(G, "prefix").agg(F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("volatility")), size, max_volatility)


def prefix_from_pairs(pairs: DataFrame, selection: DataFrame, *, max_volatility: float = 0.25, **allocation: float) -> DataFrame:
    """PF9 from the pairs of ``wide_moments``: the volatility of a prefix is sqrt(w'Cw) over its few members."""
    if max_volatility <= 0:
        raise ValueError("max_portfolio_volatility must be finite and positive")
    limits = {"total": 1.0, "minimum": 0.0, "maximum": 1.0, "floor": 1e-8} | allocation
    sel = selection.where("selected").select(G, "strategy_id", "pos")
    size = sel.groupBy(G).agg(F.max("pos").alias("members"))
    pref = sel.join(size, G).withColumn("prefix", F.explode(F.sequence("pos", "members"))).select(G, "strategy_id", "prefix")
    single = pairs_volatility(pairs).withColumn("est_vol", F.greatest("est_vol", F.lit(limits["floor"]))).join(pref, [G, "strategy_id"])
    w = _filled(single, [G, "prefix"], **limits).select(G, "prefix", "strategy_id", "weight")
    cells = pairs.join(w.select(G, "prefix", F.col("strategy_id").alias("a"), F.col("weight").alias("wa")), [G, "a"])
    cells = cells.join(w.select(G, "prefix", F.col("strategy_id").alias("b"), F.col("weight").alias("wb")), [G, "prefix", "b"])
    part = F.col("wa") * F.col("wb") * F.col("cov") * F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    vol = cells.groupBy(G, "prefix").agg(F.coalesce(F.sqrt(F.greatest(F.sum(part), F.lit(0.0))), F.lit(0.0)).alias("volatility"))
    return _admitted(vol, size, max_volatility)


def _admitted(vol: DataFrame, size: DataFrame, max_volatility: float) -> DataFrame:
    """The largest prefix whose volatility is allowed."""
    ok = F.when(F.col("volatility") <= max_volatility, F.col("prefix"))
    best = vol.groupBy(G).agg(
        F.max(ok).alias("admitted"), F.min_by("volatility", "prefix").alias("last_vol"),
        F.max_by("volatility", ok).alias("ok_vol"),
    )
    return best.join(size, G).select(
        G, "members", F.coalesce("admitted", F.lit(0)).alias("admitted"),
        F.col("admitted").isNotNull().alias("admission_passed"),
        F.coalesce("ok_vol", "last_vol").alias("volatility"),
    )


def attribution(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """PF10: return and risk contribution per strategy."""
    p = portfolio_returns(returns, weights)
    rows = returns.join(weights.select(G, "strategy_id", "weight"), [G, "strategy_id"]).join(p, [G, "ts"])
    agg = rows.groupBy(G, "strategy_id").agg(
        F.max("weight").alias("weight"),
        F.sum(F.col("weight") * F.col("r")).alias("return_contribution"),
        F.coalesce(F.covar_samp("r", "p"), F.lit(0.0)).alias("cov_p"),
        F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("volatility"),
        F.count(F.lit(1)).alias("observations"),
    )
    risk = F.coalesce(ratio(F.col("weight") * F.col("cov_p"), F.col("volatility")), F.lit(0.0))
    return agg.select(
        G, "strategy_id", "weight", "return_contribution", risk.alias("risk_contribution"), "volatility",
        "observations",
    )


def attribution_from_pairs(pairs: DataFrame, **allocation: float) -> DataFrame:
    """PF6 and PF10 from the pairs of ``wide_moments`` with own figures ``bars`` (all rows) and ``total`` (sum of returns) of each member.

    (Cw)_i is a sum over the few members of a portfolio and the volatility is sqrt(w'Cw), so no row of returns is read again.
    A portfolio with a return that is not finite has fewer aligned bars than rows and fails closed, as in ``inverse_volatility``.
    """
    limits = {"total": 1.0, "minimum": 0.0, "maximum": 1.0, "floor": 1e-8} | allocation
    own = pairs.where((F.col("a") == F.col("b")) & (F.col("n") == F.col("bars")))
    vol = pairs_volatility(own).withColumn("est_vol", F.greatest("est_vol", F.lit(limits["floor"])))
    w = _filled(vol, [G], **limits).select(G, "strategy_id", "weight")
    both = pairs.select(G, "a", "b", "cov").unionByName(pairs.where("a <> b").select(G, F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    part = both.join(w.select(G, F.col("strategy_id").alias("b"), "weight"), [G, "b"])
    cov_p = part.groupBy(G, F.col("a").alias("strategy_id")).agg(F.coalesce(F.sum(F.col("weight") * F.col("cov")), F.lit(0.0)).alias("cov_p"))
    df = w.join(cov_p, [G, "strategy_id"]).join(own.select(G, F.col("a").alias("strategy_id"), "total", F.col("n").alias("observations")), [G, "strategy_id"])
    df = df.withColumn("volatility", F.sqrt(F.greatest(F.sum(F.col("weight") * F.col("cov_p")).over(whole([G])), F.lit(0.0))))
    risk = F.coalesce(ratio(F.col("weight") * F.col("cov_p"), F.col("volatility")), F.lit(0.0))
    return df.select(
        G, "strategy_id", "weight", (F.col("weight") * F.col("total")).alias("return_contribution"), risk.alias("risk_contribution"), "volatility",
        "observations",
    )


def portfolio_health(
    attributed: DataFrame, *, min_total_return: float = 0.0, max_volatility: float = 0.25,
    max_risk_fraction: float = 0.60, min_observations: int = 2,
) -> DataFrame:
    """MT9: limits, strategies to replace, status and decision per portfolio."""
    share = F.coalesce(
        ratio(F.abs("risk_contribution"), F.sum(F.abs("risk_contribution")).over(whole([G]))), F.lit(0.0)
    )
    agg = attributed.withColumn("share", share).groupBy(G).agg(
        F.sum("return_contribution").alias("total_return"), F.max("volatility").alias("volatility"),
        F.max("share").alias("max_risk_fraction"), F.min("observations").alias("observations"),
        F.sort_array(
            F.collect_list(F.when(F.col("share") > max_risk_fraction, F.col("strategy_id")))
        ).alias("replace_strategy_ids"),
    ).where(F.col("observations") >= min_observations)
    limits = reasons(
        (F.col("total_return") < min_total_return, "total_return"),
        (F.col("volatility") > max_volatility, "volatility"),
        (F.col("max_risk_fraction") > max_risk_fraction, "concentration"),
    )
    df = agg.withColumn("breached_limits", limits)
    return df.withColumns(
        {
            "status": F.when(F.size("breached_limits") == 0, "HEALTHY").otherwise("REVIEW_REQUIRED"),
            "decision": F.when(F.size("breached_limits") == 0, "CONTINUE_PORTFOLIO")
            .when(F.array_contains("breached_limits", "concentration"), "REBALANCE_OR_RESEARCH_REPLACEMENT")
            .otherwise("RESEARCH_REPLACEMENT"),
            "execution_authority": F.lit(False),
        }
    )


def portfolio_feedback(selection: DataFrame, admission: DataFrame) -> DataFrame:
    """PF11: one research signal per selected strategy from correlation and risk pressure."""
    diag = average_correlation(selection).join(admission.select(G, "admission_passed", "volatility"), G)
    pressure = clip01(F.col("average_correlation"))
    risk = clip01(F.col("volatility") / F.greatest("volatility", F.lit(1.0)))
    df = selection.where("selected").select(G, "strategy_id").join(diag, G)
    crowded = pressure >= 0.75
    uncertainty = F.when(~F.col("admission_passed"), F.greatest(pressure, risk)).otherwise(pressure)
    return df.select(
        G, "strategy_id",
        F.when(~F.col("admission_passed"), "degraded").when(crowded, "diversification").otherwise("capacity").alias("reason"),
        F.lit(0.0).alias("fitness"),
        F.when(F.col("admission_passed"), 1.0).otherwise(0.0).alias("robustness"),
        clip01(F.lit(1.0) - pressure).alias("novelty"),
        clip01(uncertainty).alias("uncertainty"),
        F.when(F.col("admission_passed") & ~crowded, 1.0).otherwise(0.0).alias("capacity_gap"),
    )


def health_history(history: DataFrame, width: int | None = None) -> DataFrame:
    """PF12: rows whose generation does not increase in append order (``seq``)."""
    df = ls.previous(ls.with_bucket(history, F.col("seq"), width), [G], ["seq"], ["generation"])
    return ls.plain(df.where(F.col("generation") <= F.col("prev_generation")))


def latest_health(history: DataFrame) -> DataFrame:
    """PF12: newest health row per portfolio."""
    rest = [c for c in history.columns if c != G]
    return history.groupBy(G).agg(F.max_by(F.struct(*rest), "seq").alias("h")).select(G, "h.*")


def admission_check(selected: Column, weights: Column) -> Column:
    """Selection and allocation must name the same strategies."""
    return F.size(F.array_except(selected, weights)) + F.size(F.array_except(weights, selected)) == 0

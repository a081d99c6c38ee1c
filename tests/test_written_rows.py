"""What the plans write and copy grows with their results, not with their rows times the strategies."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import candidates
from barloom.operators import evaluation as ev
from barloom.operators import portfolio as pf
from barloom.operators import ranking
from barloom.operators.specs import demo_records, spec_table
from barloom.plans import fixtures as fx
from barloom.plans import portfolios
from barloom.session import cut
from tests.helpers import bars, walk
from tests.test_portfolio import greedy, make_returns

G = pf.G
SMOKE = "/root/testdata/sf0.001"


def wide_of(returns, k):
    """Members side by side; a member that lacks a timestamp is null there."""
    return returns.groupBy(G, "ts").pivot("strategy_id", [f"s{j}" for j in range(k)]).agg(F.first("r"))


def test_wide_moments_match_pandas(spark):
    frames, r = make_returns(spark, {"P": 5, "Q": 5})
    r = r.where(~((F.col(G) == "Q") & (F.col("strategy_id") == "s2") & (F.dayofmonth("ts") == 3)))
    pairs = pf.wide_moments(wide_of(r, 5), {f"s{j}": f"s{j}" for j in range(5)}, {"best": {f"s{j}": F.max(f"s{j}") for j in range(5)}})
    plain = {(x[G], x.a, x.b): x for x in pf.moments(pf.aligned(r)).collect()}
    got = {(x[G], x.a, x.b): x for x in pairs.collect()}
    assert got.keys() == plain.keys()
    for key, x in got.items():
        assert x.n == plain[key].n and x.cov == pytest.approx(plain[key].cov, rel=1e-9) and x.corr == pytest.approx(plain[key].corr, rel=1e-9)
        assert (x.best is not None) == (x.a == x.b)


def test_selection_from_pairs_is_that_from_returns(spark):
    frames, r = make_returns(spark, {"P": 5, "Q": 5}, seed=4)
    ranked = spark.createDataFrame([(p, s, i + 1) for p, m in frames.items() for i, s in enumerate(m)], f"{G} string, strategy_id string, rank int")
    pairs = pf.wide_moments(wide_of(r, 5), {f"s{j}": f"s{j}" for j in range(5)}).cache()
    chosen = pf.select_from_pairs(pairs, ranked, max_strategies=3, max_average_correlation=0.3)
    got = {p: [x.strategy_id for x in chosen.where("selected").orderBy("pos").collect() if x[G] == p] for p in frames}
    assert got == {p: greedy(m, list(m), 0.3, 3) for p, m in frames.items()}
    a = {x[G]: x.asDict() for x in pf.risk_prefix(r, chosen, max_volatility=0.01).collect()}
    b = {x[G]: x.asDict() for x in pf.prefix_from_pairs(pairs, chosen, max_volatility=0.01).collect()}
    for p in frames:
        assert (a[p]["admitted"], a[p]["members"]) == (b[p]["admitted"], b[p]["members"]) and a[p]["volatility"] == pytest.approx(b[p]["volatility"])


@pytest.mark.parametrize("name", ["average_correlation", "diversified_selection", "portfolio_build", "portfolio_feedback", "risk_prefix", "survivors", "corr_matrix"])
def test_portfolio_queries_write_a_few_rows_for_each_portfolio(spark, monkeypatch, name):
    written = []
    for module in (fx, pf):
        real = module.cut

        def counted(df, real=real):
            out = real(df)
            written.append(out.count())
            return out

        monkeypatch.setattr(module, "cut", counted)
    suppliers = spark.read.parquet(f"{SMOKE}/lineitem.parquet").select("l_suppkey").distinct().count()
    portfolios.QUERIES[name](spark, SMOKE).collect()
    assert written and max(written) <= 15 * suppliers


def test_specs_side_by_side_are_those_one_by_one(spark):
    bars = fx.src.bars_supplier(spark, SMOKE)
    side = ev.compiled(demo_records()).runs(bars, ("symbol",))
    flags = ev.compiled(demo_records())(bars, ("symbol",))
    plain = ev.bt.backtest_bars(ev.held(flags, ev.CANDIDATE), ev.CANDIDATE)
    columns = ["strategy_id", "symbol", "ts", "signal", "target", "prev_target", "prev_close", "gross_ret", "turnover", "net_ret", "equity", "drawdown"]
    a = {(r.strategy_id, r.symbol, r.ts): r for r in side.select(columns).collect()}
    b = {(r.strategy_id, r.symbol, r.ts): r for r in plain.select(columns).collect()}
    assert a.keys() == b.keys() and len(a) > 100
    for key, x in a.items():
        for c in columns[3:]:
            assert x[c] == b[key][c] or np.isclose(x[c], b[key][c], rtol=1e-12)
    assert "Exchange hashpartitioning(strategy_id" not in side._jdf.queryExecution().executedPlan().toString()


def test_front_reads_one_vector_for_equal_rest(spark, monkeypatch):
    rows = [(str(i), float(i % 5), float(i % 7), i * 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    written = []
    real = ranking.cut
    # Every vector that comes out of the aggregate passes through the local step.
    monkeypatch.setattr(ranking, "_dominated", lambda points, by: np.zeros(len(points), bool))
    monkeypatch.setattr(ranking, "cut", lambda d: written.append(d.count()) or real(d))
    ranking.pareto_front(df, ["a", "b", "c"])
    assert written[0] <= 35


def test_bootstrap_matches_a_loop(spark):
    rets = {"A": [0.1, -0.05, 0.02, -0.01, 0.03], "B": [-0.02, 0.04]}
    rows = [("s", k, 0, i, r) for k, v in rets.items() for i, r in enumerate(v)]
    t = spark.createDataFrame(rows, "strategy_id string, symbol string, window_id int, trade_id bigint, trade_return double")
    mc = ev.bootstrap(t, simulations=50, seed=9)
    # No row for a path: one row for each candidate leaves the trades.
    assert "Generate" not in mc._jdf.queryExecution().executedPlan().toString()
    for x in mc.collect():
        own = rets[x.symbol]
        paths = [np.prod([1 + own[int(hashlib.md5(f"9:{k}:{d}".encode()).hexdigest()[:8], 16) % len(own)] for d in range(len(own))]) - 1 for k in range(50)]
        assert x.mc_simulations == 50 and x.mc_median == pytest.approx(np.percentile(paths, 50)) and x.mc_lower == pytest.approx(np.percentile(paths, 5))
        assert x.mc_worst == pytest.approx(min(paths)) and x.mc_pass_rate == pytest.approx(np.mean(np.array(paths) >= 0))


def test_evidence_of_a_list_writes_no_rows_of_candidates(spark, monkeypatch):
    """of a short list of specs only bars and rows of a series or candidate are written, and the figures are those of the spec table."""
    closes = {s: walk(k, n) for k, (s, n) in enumerate({"A": 150, "B": 97, "C": 10, "short": 9}.items())}
    closes["flat"] = [100.0] * 60
    b = bars(spark, closes)
    written = []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(candidates, "cut", counted)
    listed = candidates.evidence(b, ev.compiled(demo_records()), simulations=40, seed=2).collect()
    assert max(written) <= b.count()
    assert sum(written) <= b.count() * 1.5 + 2 * 5 * len(closes)
    specs = spec_table(spark, [{**r, "universe": list(closes)} for r in demo_records()])
    rows = candidates.evidence(b, ev.from_table(specs), simulations=40, seed=2).join(specs.select("strategy_id", "name"), "strategy_id")
    rows = rows.drop("strategy_id").withColumnRenamed("name", "strategy_id").collect()
    got, want = ({(r.strategy_id, r.symbol): r.asDict() for r in found} for found in (listed, rows))
    assert {s for _, s in got} == {"A", "B", "C", "flat"}
    assert got.keys() == want.keys()
    for key, figures in want.items():
        for name, value in figures.items():
            assert got[key][name] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value), (key, name)


def test_bootstrap_takes_equal_numbers_of_trades_together():
    """candidates are grouped by their number of trades; figures, order and unknown paths are those of each alone."""
    rng = np.random.default_rng(1)
    logs = [rng.normal(0, 0.01, n) for n in (3, 7, 3, 1, 7, 3)] + [np.array([np.nan, 0.1, 0.2]), np.array([np.nan])]
    pdf = pd.DataFrame({"symbol": list("abcdefgh"), "logs": logs})
    with pytest.MonkeyPatch.context() as patch:
        calls = []
        percentile = np.percentile
        patch.setattr(ev.np, "percentile", lambda *a, **k: calls.append(1) or percentile(*a, **k))
        both = pd.concat(ev.resampled(iter([pdf]), 5, 50, 5.0, 0.0))
    alone = pd.concat([pd.concat(ev.resampled(iter([pdf[k : k + 1]]), 5, 50, 5.0, 0.0)) for k in range(len(pdf))])
    pd.testing.assert_frame_equal(both, alone)
    # Two for each of the three lengths, and two for the one candidate with some unknown paths.
    assert len(calls) <= 8

"""Back-test, metrics, splits and evaluation against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import evaluation as ev
from barloom.operators import metrics, quality, splits
from barloom.operators.specs import demo_records, spec
from tests.helpers import bars, table, ts, walk


def loop_backtest(closes, signal, mp=0.25, cost=0.0003, cash=100_000.0):
    target = [False] + [bool(x) for x in signal[:-1]]
    eq, rets, trades, entry, prev_pos = cash, [], [], None, 0.0
    curve = []
    for i, c in enumerate(closes):
        pos = mp if target[i] else 0.0
        move = 0.0 if i == 0 else closes[i] / closes[i - 1] - 1.0
        r = move * pos - abs(pos - prev_pos) * cost
        if pos and not prev_pos:
            entry = c
        if not pos and prev_pos:
            trades.append((c / entry - 1.0) * mp - 2 * cost)
        prev_pos = pos
        eq *= 1 + r
        rets.append(r)
        curve.append(eq)
    return rets, curve, trades


def with_signal(spark, closes, signal, mp=0.25):
    b = bars(spark, {"A": closes})
    s = spark.createDataFrame([(ts(i), bool(x)) for i, x in enumerate(signal)], "ts timestamp_ntz, signal boolean")
    return b.join(s, "ts").withColumn("max_position", F.lit(mp))


def test_backtest_matches_loop(spark):
    closes = walk(11, 150)
    signal = [(i * 7) % 11 < 5 for i in range(150)]
    df = with_signal(spark, closes, signal)
    b = bt.backtest_bars(df, ["symbol"])
    rets, curve, trades = loop_backtest(closes, signal)
    np.testing.assert_allclose(table(b, "symbol", "net_ret")["A"], rets, atol=1e-14)
    np.testing.assert_allclose(table(b, "symbol", "equity")["A"], curve, rtol=1e-12)
    t = bt.closed_trades(bt.with_moves(df, ["symbol"]), ["symbol"])
    np.testing.assert_allclose(table(t, "symbol", "trade_return", "trade_id")["A"], trades, atol=1e-14)
    m = bt.summary(b, ["symbol"]).first()
    s = pd.Series(curve)
    r = s.pct_change().dropna()
    assert m.sharpe == pytest.approx(math.sqrt(252) * r.mean() / r.std(ddof=1), rel=1e-9)
    assert m.max_drawdown == pytest.approx((s / s.cummax() - 1).min(), rel=1e-9)
    assert m.cagr == pytest.approx((s.iloc[-1] / s.iloc[0]) ** (252 / 149) - 1, rel=1e-9)
    rec = bt.reconcile(b, ["symbol"]).first()
    assert rec.passed and rec.max_error < 1e-9


def test_open_last_trade_gives_no_return(spark):
    df = with_signal(spark, [1.0, 2, 3, 4], [True, True, True, True])
    assert bt.closed_trades(bt.with_moves(df, ["symbol"]), ["symbol"]).count() == 0
    assert [r.action for r in bt.trade_events(bt.with_moves(df, ["symbol"]), ["symbol"]).collect()] == ["buy"]


def test_flat_strategy_has_zero_sharpe(spark):
    m = bt.summary(bt.backtest_bars(with_signal(spark, walk(1, 30), [False] * 30), ["symbol"]), ["symbol"]).first()
    assert m.sharpe == 0.0 and m.total_return == 0.0 and m.entries == 0


def test_bad_arguments():
    for args in ((0, 1, 1), (1, -1, 0), (1, 0, -1)):
        with pytest.raises(ValueError):
            bt.check_config(*args)


def test_degradation_and_qualification(spark):
    rows = [("ok", ts(i), 100.0 + i * 0.01) for i in range(70)] + [("bad", ts(i), 100.0 - i) for i in range(70)]
    rows += [("short", ts(i), 100.0) for i in range(5)] + [("neg", ts(i), 100.0 - 5 * i) for i in range(30)]
    e = spark.createDataFrame(rows, "strategy_id string, ts timestamp_ntz, equity double")
    d = {r.strategy_id: r for r in metrics.degradation(e, ["strategy_id"]).collect()}
    assert not d["ok"].degraded and d["bad"].reasons == ["maximum drawdown breached", "minimum return breached"]
    assert d["short"].invalid == "insufficient observations" and d["neg"].invalid == "equity must remain positive"
    stages = spark.createDataFrame([("ok", "paper"), ("bad", "research")], "strategy_id string, stage string")
    q = {r.strategy_id: r for r in metrics.qualification(e, stages, ["strategy_id"]).collect()}
    assert q["ok"].decision == "eligible_for_live_review" and not q["ok"].execution_authority
    assert q["bad"].reasons[0] == "strategy must remain in PAPER lifecycle stage"


def test_windows_match_loop(spark):
    for n, (tr, va, te, g) in [(60, (10, 5, 5, 1)), (53, (20, 7, 6, 4)), (19, (10, 5, 5, 2))]:
        w = splits.walk_forward_windows(bars(spark, {"A": walk(n, n)}), tr, va, te, g)
        got = {(r.window_id, r.segment, r.ts) for r in w.select("window_id", "segment", "ts").collect()}
        want, start, k = set(), 0, 0
        while start + tr + va + te <= n:
            for i in range(start, start + tr + va + te):
                seg = "train" if i < start + tr else "validation" if i < start + tr + va else "test"
                want.add((k, seg, ts(i)))
            start, k = start + g, k + 1
        assert got == want


def test_folds_keep_a_partial_last_test(spark):
    n, tr, te = 47, 20, 10
    f = splits.fold_rows(bars(spark, {"A": walk(2, n)}), tr, te)
    got = {(r.window_id, r.segment, r.ts) for r in f.select("window_id", "segment", "ts").collect()}
    want, start, k = set(), 0, 0
    while start + tr < n:
        for i in range(start, min(start + tr + te, n)):
            want.add((k, "train" if i < start + tr else "test", ts(i)))
        start, k = start + te, k + 1
    assert got == want


def test_fraction_errors():
    for a, b in ((0, 0.2), (0.6, 1), (0.7, 0.3)):
        with pytest.raises(ValueError):
            splits._check_fractions(a, b)


def test_walk_forward_restarts_indicators(spark):
    """A segment is evaluated alone, so the average is unknown in its first rows."""
    closes = walk(21, 100)
    seg = splits.default_windows(bars(spark, {"A": closes}))
    runs = ev.segment_runs(seg, ev.compiled([demo_records()[4]]))
    test = closes[80:]
    mean = pd.Series(test).rolling(20).mean()
    active, signal = False, []
    for c, m in zip(test, mean):
        active = True if c < m else False if c > m else active
        signal.append(active)
    rets, curve, trades = loop_backtest(test, signal)
    rows = runs.where("segment = 'test'")
    np.testing.assert_allclose(table(rows, "symbol", "net_ret")["A"], rets, atol=1e-14)
    assert ev.oos_trades(runs).count() == len(trades)


def test_bootstrap_is_bounded_by_trades(spark):
    rows = [("s", "A", 0, 1, 0.1), ("s", "A", 0, 2, -0.05), ("s", "B", 0, 1, 0.02)]
    t = spark.createDataFrame(rows, "strategy_id string, symbol string, window_id int, trade_id bigint, trade_return double")
    mc = {r.symbol: r for r in ev.bootstrap(t, simulations=300, seed=1).collect()}
    assert mc["B"].mc_median == pytest.approx(0.02) and mc["B"].mc_pass_rate == 1.0
    assert mc["A"].mc_worst == pytest.approx(0.95**2 - 1) and 0 < mc["A"].mc_pass_rate < 1
    again = {r.symbol: r for r in ev.bootstrap(t, simulations=300, seed=1, chunks=3).collect()}
    assert again == mc
    all_ = spark.createDataFrame([("s", "A"), ("s", "Z")], "strategy_id string, symbol string")
    z = {r.symbol: r for r in ev.bootstrap_or_fail(all_, ev.bootstrap(t, simulations=50)).collect()}["Z"]
    assert (z.mc_simulations, z.mc_pass_rate, z.mc_lower) == (0, 0.0, -1.0)


def test_cost_scenarios(spark):
    closes = walk(5, 80)
    signal = [i % 4 < 2 for i in range(80)]
    moves = bt.with_moves(with_signal(spark, closes, signal).withColumn("strategy_id", F.lit("s")), ["strategy_id", "symbol"])
    s = ev.cost_scenarios(moves, 0.999).first()
    for name, rate in bt.scenario_rates().items():
        assert s[f"eq_{name}"] == pytest.approx(loop_backtest(closes, signal, cost=rate)[1][-1], rel=1e-10)
    assert not s.rob_passed and s.rob_ratio == pytest.approx(s.eq_cost_slippage_2x / s.eq_baseline)


def test_quality_rules(spark):
    good = bars(spark, {"A": walk(1, 20)})
    assert quality.require_valid(good).count() == 20
    with pytest.raises(ValueError, match="duplicates"):
        quality.require_valid(good.unionByName(good.limit(1)))
    with pytest.raises(ValueError, match="volume cannot be negative"):
        quality.require_valid(good.withColumn("volume", F.lit(-1.0)))
    with pytest.raises(ValueError, match="low must not exceed"):
        quality.require_valid(good.withColumn("low", F.col("high") + 1))
    with pytest.raises(ValueError, match="non-finite"):
        quality.require_valid(good.withColumn("open", F.lit(float("nan"))))
    with pytest.raises(ValueError, match="missing required"):
        quality.require_valid(good.drop("volume"))
    with pytest.raises(ValueError, match="timezone-naive"):
        quality.require_valid(good.withColumn("ts", F.col("ts").cast("timestamp")))
    with pytest.raises(ValueError, match="empty"):
        quality.require_valid(good.limit(0))


def test_supplier_series_lie_in_bounded_tasks(spark, monkeypatch):
    """Tasks follow the number of bars, not their compressed bytes, and the windows add no exchange of their own."""
    from barloom.plans import evidence as plans
    from barloom.sources import bars as source

    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(source, "TASK_ROWS", 2000)
    rows = source.bars_supplier(spark, sf).groupBy(F.spark_partition_id().alias("task"), "symbol").count().collect()
    tasks = {}
    for r in rows:
        tasks[r.task] = tasks.get(r.task, 0) + r["count"]
    assert len({r.symbol for r in rows}) == len(rows)
    assert len(tasks) >= 20 and max(tasks.values()) <= 3 * 2000
    plan = plans.discovery(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in plan


def test_discovery_uses_the_entry_flag_alone(spark):
    rec = spec("always", [], [("close", ">", 0.0)], [("close", ">", 0.0)])
    d = ev.discovery(bars(spark, {"A": [100.0, 110.0, 121.0]}), ev.compiled([rec])).first()
    assert d.total_return > 0.04

"""Ledger tables against a plain step-by-step account, and tamper tests."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import identity, ledger, lifecycle, lineage, research
from barloom.session import cut
from tests.helpers import bars, ts, walk

G = "portfolio_id"


def loop_portfolio(series, flags, weights, cash, c, s, mp, limit):
    acc = {k: [cash * w, 0.0] for k, w in weights.items()}
    reserve = cash * (1 - sum(weights.values()))
    n = len(next(iter(series.values())))
    fills, curve, peak, halted = [], [], 0.0, False

    def sell(k, i):
        px = series[k][i] * (1 - s)
        q = acc[k][1]
        acc[k][0] += q * px * (1 - c)
        acc[k][1] = 0.0
        fills.append((k, i, "sell", q))

    def mark(i):
        return reserve + sum(a[0] + a[1] * series[k][i] for k, a in acc.items())

    for i in range(n):
        for k, a in acc.items():
            px = series[k][i]
            en, ex = flags[k][i]
            if a[1] == 0 and a[0] > 0 and (i == 0 or en):
                q = min(a[0] * mp / px, a[0] / (px * (1 + s) * (1 + c)))
                a[0] -= q * px * (1 + s) * (1 + c)
                a[1] = q
                fills.append((k, i, "buy", q))
            elif i > 0 and ex and a[1] > 0:
                sell(k, i)
        eq = mark(i)
        peak = max(peak, eq)
        if eq <= 0 or (limit and 1 - eq / peak >= limit):
            halted = True
        if halted or i == n - 1:
            for k, a in acc.items():
                if a[1] > 0:
                    sell(k, i)
            curve.append(mark(i))
            break
        curve.append(eq)
    return fills, curve, halted


@pytest.mark.parametrize("mp,limit,seed", [(0.25, None, 1), (1.0, 0.05, 2), (0.9, 0.02, 3), (1.0, None, 4)])
def test_portfolio_matches_account(spark, mp, limit, seed):
    rng = random.Random(seed)
    n, names = 80, ["a", "b", "c"]
    series = {k: walk(seed * 10 + j, n) for j, k in enumerate(names)}
    flags = {k: [(rng.random() < 0.25, rng.random() < 0.25) for _ in range(n)] for k in names}
    weights = {"a": 0.5, "b": 0.3, "c": 0.0}
    rows = [("P", k, ts(i), series[k][i], *flags[k][i], mp) for k in names for i in range(n)]
    f = spark.createDataFrame(rows, f"{G} string, strategy_id string, ts timestamp_ntz, close double, entry boolean, exit boolean, max_position double")
    w = spark.createDataFrame([("P", k, v, j) for j, (k, v) in enumerate(weights.items())], f"{G} string, strategy_id string, weight double, member_rank int")
    out = ledger.paper_portfolio(f, w, cash=1000.0, commission_bps=10, slippage_bps=20, max_drawdown=limit)
    fills, curve, halted = loop_portfolio(series, flags, weights, 1000.0, 0.001, 0.002, mp, limit)
    got = [r.equity for r in out["snapshots"].orderBy("ts").collect()]
    assert got == pytest.approx(curve, rel=1e-10)
    ev = ledger.audit_events(out["fills"], w)
    rows = ev.orderBy("sequence").collect()
    assert [(r.strategy_id, r.ts, r.action) for r in rows] == [(k, ts(i), a) for k, i, a, _ in fills]
    assert [r.quantity for r in rows] == pytest.approx([q for *_, q in fills], rel=1e-9)
    res = out["result"].first()
    assert res.halted == halted and res.final_equity == pytest.approx(curve[-1])
    cash = w.where("weight > 0").select(G, "strategy_id", (F.col("weight") * 1000.0).alias("start_cash"))
    fin = out["result"].select(G, (F.col("final_equity") - 200.0).alias("final_equity"))
    ok = ledger.replay(ev, cash, fin, commission_bps=10).first()
    assert ok.valid, ok.error
    man = ledger.manifest(ev).first()
    assert man.error is None and man.event_count == len(fills)
    edited = ev.withColumn("fee", F.when(F.col("sequence") == 0, F.lit(0.0)).otherwise(F.col("fee")))
    assert ledger.replay(edited, cash, fin, commission_bps=10).first().error == "audit fill fee does not match execution configuration"
    short = ev.where(F.col("sequence") < len(fills) - 1)
    assert ledger.replay(short, cash, fin, commission_bps=10).first().error == "audit ledger does not end flat"
    assert ledger.manifest(ev.where("sequence <> 1")).first().error == "audit event sequences must be contiguous from zero"
    assert ledger.manifest(short).first().ledger_fingerprint != man.ledger_fingerprint


def test_buy_costs(spark):
    """Buying 5 at 100 with 10 bp fee and 20 bp slippage leaves 498.499 of 1,000."""
    rows = [("P", "a", ts(0), 100.0, False, False, 0.5), ("P", "a", ts(1), 100.0, False, False, 0.5)]
    f = spark.createDataFrame(rows, f"{G} string, strategy_id string, ts timestamp_ntz, close double, entry boolean, exit boolean, max_position double")
    r = ledger.sleeves(f, [G, "strategy_id"], commission_bps=10, slippage_bps=20).orderBy("ts").first()
    assert 1000 * r.qty == pytest.approx(5.0) and 1000 * r.equity - 500.0 == pytest.approx(498.499)


def test_identity_detects_change_and_ignores_order(spark):
    b = bars(spark, {"A": walk(1, 30), "B": walk(2, 30)})
    one = {r.symbol: r.version for r in identity.dataset_identity(b).collect()}
    two = {r.symbol: r.version for r in identity.dataset_identity(b.orderBy(F.desc("close"))).collect()}
    assert one == two
    three = {r.symbol: r.version for r in identity.dataset_identity(b.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("ts") == ts(3)), 1.0).otherwise(F.col("close")))).collect()}
    assert three["B"] == one["B"] and three["A"] != one["A"]
    x = identity.bundle_identity(identity.dataset_identity(b), "d", source="s").first()
    y = identity.bundle_identity(identity.dataset_identity(b), "d", source="t").first()
    assert x.version != y.version and x.rows == 60


def test_budget_matches_loop(spark):
    rng = random.Random(6)
    rows, plans = [], {}
    for p in range(25):
        n = rng.randrange(1, 9)
        scores = [round(rng.random() * rng.choice([0.05, 1, 5]), 3) for _ in range(n)]
        plans[f"p{p}"] = scores
        rows += [(f"p{p}", f"r{i}", i, s, 0.0, 0.0, 0.0, 0.0) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "plan_id string, request_id string, position int, fitness double, robustness double, novelty double, uncertainty double, capacity_gap double")
    for total, lo, hi in ((100, 1, 60), (20, 2, 7), (7, 1, 3)):
        got = {(r.plan_id, r.request_id): r.units for r in research.allocate_budget(df, total=total, minimum=lo, maximum=hi).collect()}
        for p, sc in plans.items():
            s = sc if sum(sc) > 0 else [1.0] * len(sc)
            u = [max(lo, min(hi, int(total * x / sum(s)))) for x in s]
            while sum(u) > total and any(x > lo for x in u):
                u[min((i for i, x in enumerate(u) if x > lo), key=lambda i: (s[i] / max(u[i], 1), f"r{i}"))] -= 1
            while sum(u) < total and any(x < hi for x in u):
                u[max((i for i, x in enumerate(u) if x < hi), key=lambda i: (s[i] / max(u[i], 1), -i))] += 1
            assert [got[p, f"r{i}"] for i in range(len(u))] == u


def test_closure_doubles_paths(spark, monkeypatch):
    """A deep chain with side branches and a cycle at its end: rounds by the logarithm of the depth, least distances."""
    rng = random.Random(8)
    edges = {(k, k + 1) for k in range(300)} | {(rng.randrange(290), rng.randrange(5) + 290) for _ in range(10)} | {(300, 295)}
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    expected = {}
    for a in up:
        level, depth = {a}, 0
        while level:
            depth += 1
            level = {c for b in level for c in up.get(b, ()) if (a, c) not in expected}
            expected |= {(a, c): depth for c in level}
    rounds = []
    monkeypatch.setattr(lineage, "cut", lambda df: rounds.append(1) or cut(df))
    got = lineage.closure(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "strategy_id string, parent_id string"))
    assert {(int(r.strategy_id), int(r.ancestor_id)): r.depth for r in got.collect()} == expected
    assert len(rounds) <= 10
    assert lineage.closure(spark.createDataFrame([], "strategy_id string, parent_id string")).count() == 0


def test_closure_moves_one_row_for_a_strategy(spark, monkeypatch):
    """The ancestors of a strategy are one row of every round, not a row each; a null parent counts and leads nowhere."""
    edges = [(str(k), str(p)) for k in range(1, 400) for p in {k // 2, k // 3}] + [("7", None), (None, "5")]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    expected = {}
    for a in up:
        level, depth, seen = {a}, 0, {}
        while level:
            depth += 1
            level = {c for b in level if b is not None or depth == 1 for c in up.get(b, ()) if c not in seen}
            seen |= {c: depth for c in level}
        expected[a] = seen
    rows = []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage, "cut", counted)
    e = spark.createDataFrame(edges, "strategy_id string, parent_id string")
    got = {}
    for r in lineage.closure(e).collect():
        assert r.ancestor_id not in got.setdefault(r.strategy_id, {})
        got[r.strategy_id][r.ancestor_id] = r.depth
    assert got == expected
    assert max(rows) <= len(up)
    counts = {r.strategy_id: (r.ancestors, r.farthest) for r in lineage.ancestor_counts(e).collect()}
    assert counts == {a: (len(x), max(x.values())) for a, x in expected.items()}


def test_cycles_need_no_closure_of_the_trees_around(spark, monkeypatch):
    from barloom.plans import records

    e = [(str(k), str(k // 2)) for k in range(1, 200)] + [("1", "6"), ("x", "x"), ("y", None)]
    core = lineage.cyclic_core(spark.createDataFrame(e, "strategy_id string, parent_id string"))
    assert {(r.strategy_id, r.parent_id) for r in core.collect()} == {("1", "6"), ("6", "3"), ("3", "1"), ("x", "x")}
    given, closure = [], lineage.closure
    monkeypatch.setattr(lineage, "closure", lambda e, *roots: given.append(e.count()) or closure(e, *roots))
    found = {int(r.strategy_id) for r in records.lineage_cycles(spark, "/root/testdata/sf0.001").collect()}
    assert found == {1, 2, 3, 4, 5, 6, 10, 13, 20, 40} and given[0] < 40


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("e", "d")], "strategy_id string, parent_id string")
    c = lineage.closure(e)
    assert {r.strategy_id for r in lineage.cycles(c).collect()} == set("abcd")
    only = lineage.closure(e.where("strategy_id <> 'a'"), spark.createDataFrame([("e",)], "strategy_id string"))
    assert {(r.ancestor_id, r.depth) for r in only.collect()} == {("d", 1), ("c", 2), ("b", 3), ("a", 4)}


def test_chain_audit_clean(spark):
    rows = [(str(i), i, "x", i) for i in range(50)]
    cycles = spark.createDataFrame(rows, "cycle_id string, generation int, body string, sequence bigint")
    audit = lifecycle.chain(cycles, ["cycle_id", "body"], width=7).select("sequence", "cycle_id", "generation", "payload_digest", "previous_digest")
    assert lifecycle.chain_audit(audit, cycles, ["cycle_id", "body"], width=7).count() == 0
    bad = audit.withColumn("payload_digest", F.when(F.col("sequence") == 20, "x").otherwise(F.col("payload_digest")))
    assert {r.cycle_id for r in lifecycle.chain_audit(bad, cycles, ["cycle_id", "body"], width=7).collect()} == {"20", "21"}


def test_transition_table(spark):
    df = spark.createDataFrame([(s, t) for s in lifecycle.STAGES for t in lifecycle.STAGES], "s string, t string")
    ok = {(r.s, r.t) for r in df.where(lifecycle.allowed("s", "t")).collect()}
    assert ok == {(s, t) for s, ts_ in lifecycle.TRANSITIONS.items() for t in ts_}


def test_certificate_integrity(spark):
    v = spark.createDataFrame([("r1", True, None, 4, "fp", "v1", "b1", "e1"), ("r2", False, "x", 4, "fp", "v1", "b1", "e1")],
                              "run_id string, valid boolean, reason string, event_count bigint, ledger_fingerprint string, dataset_version string, data_bundle_version string, execution_fingerprint string")
    part = spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, fingerprint string")
    c = lineage.certificates(v, {k: part for k in ("lineage_fingerprint", "attribution_fingerprint", "provenance_graph_fingerprint")})
    assert [r.run_id for r in c.collect()] == ["r1"]
    assert lineage.certificate_integrity(c).first().valid
    assert lineage.certificate_integrity(c.withColumn("dataset_version", F.lit("v2"))).first().reason == "certificate_id does not match certificate contents"

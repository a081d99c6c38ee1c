"""Indicators, rules, hold states and long series against pandas and plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import longseries as ls
from barloom.operators import backtest as bt
from barloom.operators import indicators as ind
from barloom.operators import rules, ticks
from barloom.operators.specs import spec, spec_table
from tests.helpers import bars, table, ts, walk


def rsi(s: pd.Series, p: int) -> pd.Series:
    d = s.diff()
    up = d.clip(lower=0.0).ewm(alpha=1 / p, adjust=False, min_periods=p).mean()
    dn = (-d.clip(upper=0.0)).ewm(alpha=1 / p, adjust=False, min_periods=p).mean()
    out = 100.0 - 100.0 / (1.0 + up / dn.replace(0.0, np.nan))
    return out.mask((dn == 0) & (up > 0), 100.0)


def test_sma_warm_up(spark):
    b = bars(spark, {"A": [float(i) for i in range(1, 31)]})
    v = table(ind.with_indicators(b, ["symbol"], [("sma", "close", 5)]), "symbol", "ind_sma_close_5")["A"]
    assert v[:4] == [None] * 4 and v[4] == 3.0 and v[-1] == 28.0


@pytest.mark.parametrize("n", [40, 900])
def test_recursive_means_match_pandas(spark, n):
    series = {"A": walk(1, n), "B": walk(2, n // 2)}
    wanted = {f"{k}{p}": (k, "close", p) for k in ("ema", "rsi") for p in (1, 2, 5, 14, 50, 200)}
    df = ind.with_recursive(bars(spark, series), ["symbol"], wanted)
    for out, (kind, _, p) in wanted.items():
        got = table(df, "symbol", out)
        for s, closes in series.items():
            x = pd.Series(closes)
            want = x.ewm(span=p, adjust=False, min_periods=p).mean() if kind == "ema" else rsi(x, p)
            np.testing.assert_allclose(np.array(got[s], dtype=float), want.to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rsi_edges(spark):
    b = bars(spark, {"UP": [1.0, 2, 3, 4, 5], "FLAT": [3.0] * 5})
    v = table(ind.with_rsi(b, ["symbol"], "close", 2, "r"), "symbol", "r")
    assert v["UP"][1] is None and v["UP"][2] == 100.0 and v["FLAT"] == [None] * 5


def test_blocks_cover_all_factors():
    groups = ind.block_groups([2 / (p + 1) for p in range(2, 400)] + [1 / p for p in range(2, 400)])
    for size, alphas in groups:
        for a in alphas:
            assert ind.LOST - 1 <= ind.decay(a) * size <= ind.LIMIT + ind.decay(a)
    assert len(groups) <= 4


def test_cross_needs_previous_bar(spark):
    b = bars(spark, {"A": [1.0, 2, 3, 2, 4]})
    rec = spec("x", [], [("close", "crosses_above", 3.0)], [("close", "crosses_below", 2.5)])
    f = rules.compiled_signals(b, [rec])
    assert table(f, "symbol", "entry")["A"] == [False, False, False, False, True]
    assert table(f, "symbol", "exit")["A"] == [False, False, False, True, False]


def test_indicator_name_shadows_column(spark):
    b = bars(spark, {"A": [1.0, 2, 3, 4, 5, 6]})
    rec = spec("x", [("open", "sma", 3)], [("close", ">", "open")], [("close", "<", 0.0)])
    assert table(rules.compiled_signals(b, [rec]), "symbol", "entry")["A"] == [False, False, True, True, True, True]


def test_unknown_operand_fails(spark):
    rec = spec("x", [], [("close", ">", "nope")], [("close", "<", 0.0)])
    with pytest.raises(ValueError, match="missing data column"):
        rules.compiled_signals(bars(spark, {"A": [1.0, 2.0]}), [rec])


def test_table_route_equals_compiled_route(spark):
    recs = [
        spec("a", [("f", "sma", 3), ("s", "ema", 7)], [("f", "crosses_above", "s")], [("f", "<", "s")], universe=["A", "B"]),
        spec("b", [("r", "rsi", 5)], [("r", ">", 55.0), ("close", ">=", "open")], [("r", "<=", 45.0)],
             entry_any=[("volume", "==", 10.0), ("close", "<", 0.0)], universe=["A", "B"]),
    ]
    b = bars(spark, {"A": walk(3, 120), "B": walk(4, 90)})
    specs = spec_table(spark, recs)
    names = {r["strategy_id"]: r["name"] for r in specs.select("strategy_id", "name").collect()}
    got = {(names[r.strategy_id], r.symbol, r.ts): (r.entry, r.exit) for r in rules.table_signals(b, specs).collect()}
    want = {(r.strategy_id, r.symbol, r.ts): (r.entry, r.exit) for r in rules.compiled_signals(b, recs).collect()}
    assert got == want and len(got) == 420


def flags(spark, n_series=4, n=200, seed=5):
    rng = random.Random(seed)
    rows = [(f"S{k}", ts(i), i, rng.random() < 0.3, rng.random() < 0.3) for k in range(n_series) for i in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, pos bigint, entry boolean, exit boolean")


def test_hold_and_toggle_match_loops(spark):
    rows, df = flags(spark)
    df = rules.toggle_state(df.withColumn("hold", rules.hold_state("entry", "exit", ["symbol"])), ["symbol"])
    hold, tog = table(df, "symbol", "hold"), table(df, "symbol", "held")
    for s in {r[0] for r in rows}:
        a = t = False
        for i, (_, _, _, en, ex) in enumerate(r for r in rows if r[0] == s):
            a = True if en else False if ex else a
            t = True if (not t and en) else False if (t and ex) else t
            assert hold[s][i] == a and tog[s][i] == t
    exact = spark.createDataFrame(
        [("A", ts(i), e, x) for i, (e, x) in enumerate(zip([True, False, False, True], [False, False, True, False]))],
        "symbol string, ts timestamp_ntz, entry boolean, exit boolean",
    )
    got = exact.withColumn("h", rules.hold_state("entry", "exit", ["symbol"]))
    assert table(got, "symbol", "h")["A"] == [True, True, False, True]


@pytest.mark.parametrize("width", [1, 7, 1000, None])
def test_long_series_primitives(spark, width):
    rng = random.Random(9)
    rows = [("HOT" if rng.random() < 0.7 else f"K{rng.randrange(5)}", i, rng.choice([None, float(rng.randrange(50))])) for i in range(300)]
    df = ls.with_bucket(spark.createDataFrame(rows, "k string, i bigint, v double"), F.col("i"), width)
    out = ls.running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
    out = ls.previous(out, ["k"], ["i"], ["v"])
    got = {r.i: r for r in out.collect()}
    state: dict = {}
    for k, i, v in rows:
        s, m, last, prev = state.get(k, (0.0, None, None, None))
        assert got[i].prev_v == prev
        s += v or 0.0
        m = v if m is None else m if v is None else max(m, v)
        last = last if v is None else v
        assert (got[i].s, got[i].m, got[i].l) == (s, m, last)
        state[k] = (s, m, last, v)
    assert len(got) == 300


def test_one_key_fills_all_partitions(spark):
    """A constant key: rows are dealt evenly, and no group of a summary is longer than the square root of the buckets."""
    n, parts = 200_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = ls.with_bucket(spark.range(7, 7 + n).select(F.lit(0).alias("k"), F.col("id").alias("i")), F.col("i"))
    dealt = sorted(r["count"] for r in df.repartition(parts, "k", ls.BUCKET).groupBy(F.spark_partition_id()).count().collect())
    assert len(dealt) == parts and dealt[-1] < 2 * dealt[len(dealt) // 2]
    buckets = df.select(ls.BUCKET, ls.BLOCK).distinct()
    total, blocks = buckets.count(), buckets.groupBy(ls.BLOCK).count()
    assert 16 * parts <= total and blocks.agg(F.max("count")).first()[0] ** 2 <= 2 * total and blocks.count() ** 2 <= 2 * total
    out = ls.previous(ls.running(df, ["k"], ["i"], {"s": ("sum", F.lit(1))}), ["k"], ["i"], ["i"])
    assert out.where("s <> i - 6 OR NOT prev_i <=> nullif(i - 1, 6)").count() == 0


def test_buckets_of_nothing(spark):
    df = ls.with_bucket(spark.createDataFrame([], "k string, i bigint"), F.col("i"))
    assert ls.previous(df, ["k"], ["i"], ["i"]).count() == 0


def test_tick_backtest_equals_plain_backtest(spark):
    rows, df = flags(spark, 3, 150, 8)
    prices = {s: walk(n, 150) for n, s in enumerate(["S0", "S1", "S2"])}
    px = spark.createDataFrame([(s, i, c) for s, cs in prices.items() for i, c in enumerate(cs)], "symbol string, pos bigint, close double")
    df = df.join(px, ["symbol", "pos"])
    plain = bt.backtest_bars(
        df.withColumn("signal", rules.hold_state("entry", "exit", ["symbol"])).withColumn("max_position", F.lit(0.25)), ["symbol"]
    )
    long = ticks.tick_backtest(ls.with_bucket(df, F.col("pos"), 11), ["symbol"], ["pos"])
    for c in ("net_ret", "equity", "drawdown"):
        a, b = table(plain, "symbol", c), table(long, "symbol", c)
        for s in a:
            np.testing.assert_allclose(a[s], b[s], rtol=1e-12, atol=1e-12)

"""Files, payloads, write-once tables and streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import identity, lineage
from barloom.sources import bars as src
from barloom.sources import payloads, sinks
from barloom.streaming import monitors
from tests.helpers import bars, ts, walk


def test_csv_and_range(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("Date,open,high,low,close,volume\n2024-01-01,1,2,0.5,1.5,10\n2024-01-02,2,3,1.5,2.5,20\n")
    b = src.read_csv_bars(spark, str(f), "A")
    assert [tuple(r) for r in b.orderBy("ts").collect()][1] == ("A", ts(1), 2.0, 3.0, 1.5, 2.5, 20.0)
    p = str(tmp_path / "bars")
    bars(spark, {"A": walk(1, 30), "B": walk(2, 30)}).write.parquet(p)
    r = src.read_bars(spark, p, "B", "2024-01-05", "2024-01-10")
    assert r.count() == 5 and r.agg(F.min("ts")).first()[0] == ts(4)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(symbol)" in plan or "EqualTo(symbol,B)" in plan


def test_packed_order(spark):
    df = spark.createDataFrame([(1, 9), (2, 0), (1, 10)], "a bigint, b bigint")
    got = [tuple(r)[:2] for r in df.withColumn("p", src.packed((F.col("a"), 10), (F.col("b"), 5))).orderBy("p").collect()]
    assert got == [(1, 9), (1, 10), (2, 0)]
    with pytest.raises(Exception):
        df.select(src.packed((F.col("b"), 1))).collect()


def test_requests(spark):
    b = bars(spark, {"A": walk(1, 10), "B": walk(2, 10)})
    req = spark.createDataFrame([("A", ts(2), ts(4)), ("B", None, ts(1)), ("Z", None, None)], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert {r.symbol: r["count"] for r in src.select_requests(b, req).groupBy("symbol").count().collect()} == {"A": 2, "B": 1}
    assert [tuple(r) for r in src.request_problems(b, req).collect()] == [("Z", "requested market-data range is empty")]
    assert {r.symbol: r["count"] for r in src.select_requests(b, src.inclusive_end(req)).groupBy("symbol").count().collect()} == {"A": 3, "B": 2}


def test_payloads(spark):
    chart = {"chart": {"result": [{"timestamp": [1704067200, 1704153600], "indicators": {"quote": [{"open": [1, None], "high": [2, 2], "low": [0.5, 1], "close": [1.5, 1], "volume": [7, 8]}]}}]}}
    docs = spark.createDataFrame([("A", json.dumps(chart)), ("B", '{"chart":{"result":[]}}')], "symbol string, payload string")
    assert [tuple(r) for r in payloads.chart_json(docs).collect()] == [("A", ts(0), 1.0, 2.0, 0.5, 1.5, 7.0)]
    assert [r.symbol for r in payloads.chart_problems(docs).collect()] == ["B"]
    day = {payloads.SERIES_KEY: {"2024-01-02": {k: "3" for k in payloads.DAILY_FIELDS.values()}}}
    docs = spark.createDataFrame([("A", json.dumps(day)), ("B", '{"Note": "slow down"}')], "symbol string, payload string")
    assert payloads.daily_series_json(docs).first().ts == ts(1)
    assert payloads.daily_series_problems(docs).first().problem == "provider rate limit: slow down"
    raw = spark.createDataFrame([("2024-01-01", "."), ("2024-01-02", ""), ("2024-01-03", "4.5")], "observation_date string, GDP string")
    assert [r.value for r in payloads.macro_csv(raw, "GDP").orderBy("date").collect()] == [None, None, 4.5]
    with pytest.raises(ValueError):
        payloads.macro_csv(raw, "CPI")
    assert spark.createDataFrame([("cik 320-193",)], "c string").select(payloads.pad_cik("c")).first()[0] == "0000320193"
    post = spark.createDataFrame([(json.dumps({"s1": [{"timestamp": "2024-01-01T00:00:00", "open": 1, "high": 1, "low": 1, "close": 1}]}),)], "payload string")
    assert payloads.posted_bars(post).first().volume == 0.0
    with pytest.raises(ValueError):
        payloads.news_feed(post, 0)


def test_append_once_and_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_once(spark, p, df, ["k"])
    sinks.append_once(spark, p, df.union(spark.createDataFrame([(3, "c")], df.schema)), ["k"])
    assert spark.read.parquet(p).count() == 3
    with pytest.raises(ValueError, match="immutable"):
        sinks.append_once(spark, p, spark.createDataFrame([(1, "z")], df.schema), ["k"])
    assert spark.read.parquet(p).count() == 3
    u = str(tmp_path / "u")
    cols = "k int, v string, part string"
    sinks.upsert(spark, u, spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], cols), ["k"], "part")
    sinks.upsert(spark, u, spark.createDataFrame([(2, "B", "x"), (4, "d", "x")], cols), ["k"], "part")
    assert {(r.k, r.v) for r in spark.read.parquet(u).collect()} == {(1, "a"), (2, "B"), (3, "c"), (4, "d")}


def test_hashes_and_sinks_see_nulls(spark, tmp_path):
    left = spark.createDataFrame([(1, None, 5.0)], "k int, a double, b double")
    right = spark.createDataFrame([(1, 5.0, None)], left.schema)
    assert sinks.payload_conflicts(left, right, ["k"]).count() == 1
    assert sinks.payload_conflicts(left, left, ["k"]).count() == 0
    prints = {identity.frame_fingerprint(df).first()["fingerprint"] for df in (left, right)}
    assert len(prints) == 2
    prints = {lineage.table_fingerprint(df, ["k"]).first()["fingerprint"] for df in (left, right)}
    assert len(prints) == 2
    null_key = spark.createDataFrame([(None, 1.0, 2.0)], left.schema)
    assert sinks.new_rows(null_key, null_key, ["k"]).count() == 0
    # A key that moves to another partition leaves its old one; of two versions in one load the later counts.
    u, cols = str(tmp_path / "u"), "k int, v string, n int, part string"
    sinks.upsert(spark, u, spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "x"), (3, "c", 1, "z z")], cols), ["k"], "part")
    sinks.upsert(spark, u, spark.createDataFrame([(2, "old", 1, "x"), (2, "new", 2, "y"), (3, "d", 1, "x")], cols), ["k"], "part", "n")
    assert sorted((r.k, r.v, r.part) for r in spark.read.parquet(u).collect()) == [(1, "a", "x"), (2, "new", "y"), (3, "d", "x")]


def equity_run(spark, path, schema, limit, out, files=1):
    stream = monitors.file_stream(spark, path, schema, lambda r: r, files_per_trigger=files)
    return monitors.run_available(spark, monitors.equity_monitor(stream, limit), out, waiting=lambda state: monitors.open_equity(state, limit)).collect()


def test_equity_stream_survives_restart(spark, tmp_path):
    rows = [("P", ts(i), e) for i, e in enumerate([100.0, 110.0, 105.0, 98.0, 120.0])] + [("Q", ts(i), 50.0 + i) for i in range(5)]
    schema = "portfolio_id string, ts timestamp_ntz, equity double"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema)

    def run():
        got = equity_run(spark, path, schema, 0.1, out)
        assert len({(r.portfolio_id, r.ts) for r in got}) == len(got)
        return {(r.portfolio_id, r.ts): (r.peak, r.halted, r.provisional) for r in got}

    df.where(F.col("ts") < ts(2)).coalesce(1).write.parquet(path)
    first = run()
    # The newest day is within the hour: it is judged, and may still change.
    assert {k: v[2] for k, v in first.items()} == {(p, ts(i)): i == 1 for p in "PQ" for i in range(2)}
    assert first["P", ts(1)] == (110.0, False, True)
    df.where(F.col("ts") >= ts(2)).coalesce(1).write.mode("append").parquet(path)
    df.where(F.col("ts") == ts(0)).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("R", ts(20), -1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    got = run()
    assert len(got) == 11
    assert [got["P", ts(i)][:2] for i in range(5)] == [(100.0, False), (110.0, False), (110.0, False), (110.0, True), (120.0, True)]
    assert not any(h for (p, _), (_, h, _) in got.items() if p == "Q")
    assert [k for k, v in got.items() if v[2]] == [("R", ts(20))] and got["R", ts(20)][1]
    assert run() == got  # nothing new: nothing changes


def test_streams_do_not_depend_on_triggers(spark, tmp_path):
    """Ties and rows out of order, in six files: one or all to a trigger."""
    rng = random.Random(1)
    rows = [(rng.choice("PQ"), datetime(2020, 1, 1) + timedelta(minutes=rng.randrange(600)), float(rng.randrange(80, 120))) for _ in range(300)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(50)))
    schema = "portfolio_id string, ts timestamp_ntz, equity double"
    path = str(tmp_path / "in")
    for k in range(6):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], schema).coalesce(1).write.mode("append").parquet(path)
    closed = max(r[1] for r in rows) - timedelta(hours=1)
    expected = []
    for p in "PQ":
        peak, halted = 0.0, False
        for _, at, equity in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2])):
            peak = max(peak, equity)
            halted |= 1 - equity / peak >= 0.25
            expected.append((p, at, equity, peak, halted, at > closed))
    for n in (1, 2, 64):
        got = equity_run(spark, path, schema, 0.25, str(tmp_path / f"o{n}"), n)
        assert sorted(map(tuple, got)) == sorted(expected)


def test_health_stream(spark, tmp_path):
    rows = [("s", ts(0), False, False), ("s", ts(1), True, False), ("s", ts(2), True, False), ("s", ts(3), False, True), ("s", ts(4), True, False), ("s", ts(9), True, False)]
    rows += [("t", ts(9), True, False), ("t", ts(9) + timedelta(minutes=1), False, False), ("t", ts(9) + timedelta(minutes=2), True, True), ("u", ts(9), False, False)]
    schema = "strategy_id string, ts timestamp_ntz, degraded boolean, halt boolean"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    out = monitors.run_available(spark, monitors.health_monitor(monitors.file_stream(spark, path, schema, lambda r: r)), str(tmp_path / "o"), waiting=monitors.open_health)
    got = [(r.strategy_id, r.previous_state, r.state, r.sequence, r.provisional) for r in out.orderBy("strategy_id", "sequence").collect()]
    assert got == [
        ("s", "active", "degraded", 1, False), ("s", "degraded", "halted", 2, False), ("t", "active", "degraded", 1, True), ("t", "degraded", "halted", 2, True),
    ]


def test_stream_without_files(spark, tmp_path):
    schema = "portfolio_id string, ts timestamp_ntz, equity double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    assert equity_run(spark, str(tmp_path / "in"), schema, 0.25, str(tmp_path / "o")) == []


def test_requests_meet_their_next_bar(spark):
    """Against a loop over all bars: repeated requests of one symbol, open ends, empty ranges, unknown symbols."""
    rng = random.Random(7)
    day = datetime(2020, 1, 1)
    held = {s: sorted(rng.sample(range(400), n)) for s, n in (("HOT", 200), ("A", 3), ("B", 1))}
    b = spark.createDataFrame([(s, day + timedelta(hours=h), 1.0) for s, hs in held.items() for h in hs], "symbol string, ts timestamp_ntz, close double")
    asked = []
    for k in range(300):
        s = rng.choice(["HOT", "HOT", "A", "B", "none"])
        start, length = rng.choice([None, rng.randrange(-50, 450)]), rng.choice([None, 1, 5, 90])
        end = None if length is None else (start or 0) + length
        asked.append((k, s, start, end))
    when = lambda h: None if h is None else day + timedelta(hours=h)
    r = spark.createDataFrame([(k, s, when(a), when(e)) for k, s, a, e in asked], "request_id int, symbol string, start timestamp_ntz, end timestamp_ntz")
    expected = {}
    for k, s, a, e in asked:
        if s not in held:
            expected[k] = "unknown symbol: none"
        elif not any((a is None or h >= a) and (e is None or h < e) for h in held[s]):
            expected[k] = "requested market-data range is empty"
    assert {x.request_id: x.reason for x in src.load_problems(b, r).collect()} == expected
    assert len(set(expected.values())) == 2 and len(expected) < 250
    assert {x.reason for x in src.load_problems(b.limit(0), r).collect()} == {f"unknown symbol: {s}" for s in ("HOT", "A", "B", "none")}

"""A spread of registered queries against their SQL twins at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "sma_cross_summary", "dq_report", "ema_bars", "rsi_bars", "signal_rules", "toggle_positions", "backtest_trades",
    "walk_forward_windows", "walk_forward_oos", "inv_vol_weights", "attribution", "paper_fills", "paper_halt",
    "ledger_replay", "research_queue", "generation_history", "lifecycle_gaps", "chain_audit", "lineage_closure",
    "tick_backtest", "stream_health", "spec_checks", "sweep_neighbours",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql().get(name), SF)
    assert ok, text


def test_every_twin_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    assert entry_module.entry(spark).count() == 10

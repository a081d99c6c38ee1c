"""Attribution and health from one aggregate over the bars."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio as pf
from barloom.plans import fixtures as fx
from barloom.plans import portfolios
from tests.helpers import ts
from tests.test_portfolio import make_returns
from tests.test_written_rows import SMOKE, wide_of

G = pf.G
NAMES = [f"s{j}" for j in range(5)]
FIGURES = ["weight", "return_contribution", "risk_contribution", "volatility", "observations"]


@pytest.mark.parametrize("limits", [{}, {"maximum": 0.5}, {"minimum": 0.05, "maximum": 0.3, "total": 0.9}])
def test_attribution_from_pairs_is_that_from_returns(spark, limits):
    _, r = make_returns(spark, {"P": 5, "Q": 5, "R": 5, "S": 5, "T": 5})
    lost = (F.col(G) == "R") & (F.col("strategy_id") == "s2") & (F.col("ts") == F.lit(ts(3)))
    r = r.withColumn("r", F.when(lost, float("inf")).when(F.col(G) == "S", 0.0).otherwise(F.col("r")))
    r = r.where((F.col(G) != "T") | (F.col("ts") == F.lit(ts(0)))).cache()
    own = {"bars": dict.fromkeys(NAMES, F.count(F.lit(1)).cast("double")), "total": {s: F.sum(s) for s in NAMES}}
    pairs = pf.wide_moments(wide_of(r, 5), {s: s for s in NAMES}, own)
    plain = {(x[G], x.strategy_id): x.asDict() for x in pf.attribution(r, pf.inverse_volatility(r, **limits)).collect()}
    got = {(x[G], x.strategy_id): x.asDict() for x in pf.attribution_from_pairs(pairs, **limits).collect()}
    assert got.keys() == plain.keys() == {(p, s) for p in "PQS" for s in NAMES}
    for key, x in got.items():
        assert x.keys() == plain[key].keys()
        assert [x[c] for c in FIGURES] == pytest.approx([plain[key][c] for c in FIGURES], rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("name", ["attribution", "portfolio_health"])
def test_queries_write_no_returns(spark, monkeypatch, name):
    written = []
    for module in (fx, pf):
        real = module.cut

        def count(df, real=real):
            out = real(df)
            written.append(out.count())
            return out

        monkeypatch.setattr(module, "cut", count)
    out = portfolios.QUERIES[name](spark, SMOKE)
    members = out.select(G).distinct().count()
    assert members and max(written) <= 15 * members

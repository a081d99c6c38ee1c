"""SQL twins of the queries in barloom.plans.evidence."""

from oracles.core import FIT, rsi_sql
from oracles.parts import PARTS, RUN, backtest_parts, hold_sql, part, r2, r6, sma_sql, with_parts

DEMO_NAMES = ["sma_5_20", "sma_10_30", "ema_10_30", "rsi_14", "revert_20"]
CAND = "strategy_id, symbol"
SQL = {}


def indicator_parts(prefix: str, source: str, keys: str) -> None:
    """All demo indicators over ``source`` (keys, ts, close); recursions run one row at a time."""
    kl = [k.strip() for k in keys.split(",")]
    join = " AND ".join(f"b.{k} = p.{k}" for k in kl)
    bk = ", ".join(f"b.{k}" for k in kl)
    part(f"{prefix}_rn",
         f"SELECT {keys}, ts, close, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i, "
         f"close - LAG(close) OVER (PARTITION BY {keys} ORDER BY ts) AS d, LAG(close) OVER (PARTITION BY {keys} ORDER BY ts) AS pc, "
         + ", ".join(f"{sma_sql('close', keys, p)} AS sma{p}" for p in (5, 10, 20, 30)) + f" FROM {source}")
    part(f"{prefix}_rec",
         f"SELECT {keys}, ts, i, close AS e10, close AS e30, CAST(NULL AS DOUBLE) AS g14, CAST(NULL AS DOUBLE) AS l14 FROM {prefix}_rn WHERE i = 0 UNION ALL "
         f"SELECT {bk}, b.ts, b.i, e10 + (b.close - e10) * (2.0E0/11), e30 + (b.close - e30) * (2.0E0/31), "
         "CASE WHEN b.i = 1 THEN GREATEST(b.d, 0) ELSE g14 + (GREATEST(b.d, 0) - g14) / 14.0E0 END, "
         "CASE WHEN b.i = 1 THEN GREATEST(-b.d, 0) ELSE l14 + (GREATEST(-b.d, 0) - l14) / 14.0E0 END "
         f"FROM {prefix}_rec p JOIN {prefix}_rn b ON {join} AND b.i = p.i + 1")
    part(f"{prefix}_ind",
         f"SELECT b.*, CASE WHEN b.i >= 9 THEN p.e10 END AS ema10, CASE WHEN b.i >= 29 THEN p.e30 END AS ema30, "
         f"CASE WHEN b.i >= 14 THEN {rsi_sql('p.g14', 'p.l14')} END AS rsi14, "
         f"LAG(sma10) OVER (PARTITION BY {bk} ORDER BY b.ts) AS psma10, LAG(sma30) OVER (PARTITION BY {bk} ORDER BY b.ts) AS psma30 "
         f"FROM {prefix}_rn b JOIN {prefix}_rec p ON {join} AND b.i = p.i")


DEMO_RULES = {
    "sma_5_20": ("sma5 > sma20", "sma5 < sma20"),
    "sma_10_30": ("sma10 > sma30 AND psma10 <= psma30", "sma10 < sma30 AND psma10 >= psma30"),
    "ema_10_30": ("ema10 > sma_never" , ""),
    "rsi_14": ("rsi14 > 50", "rsi14 < 45"),
    "revert_20": ("close < sma20", "close > sma20"),
}
DEMO_RULES["ema_10_30"] = ("ema10 > ema30", "ema10 < ema30")


def flag_parts(prefix: str, source: str, keys: str, names=DEMO_NAMES, keep: str = "") -> None:
    """Union of strategy flags and held signals: {prefix}_flags and {prefix}_sig."""
    part(f"{prefix}_flags", " UNION ALL ".join(
        f"SELECT '{n}' AS strategy_id, {keys}, ts, close{keep}, 0.25E0 AS max_position, COALESCE({DEMO_RULES[n][0]}, FALSE) AS entry, "
        f"COALESCE({DEMO_RULES[n][1]}, FALSE) AS exit FROM {source}" for n in names))
    part(f"{prefix}_sig",
         f"SELECT strategy_id, {keys}, ts, close{keep}, max_position, {hold_sql('entry', 'exit', 'strategy_id, ' + keys)} AS signal FROM {prefix}_flags")


def default_windows(source: str) -> str:
    return (
        "SELECT symbol, 0 AS window_id, ts, close, CASE WHEN i < t THEN 'train' WHEN i < t + v THEN 'validation' ELSE 'test' END AS segment FROM ("
        "SELECT *, GREATEST(2, FLOOR(n * 0.6E0)) AS t, GREATEST(2, FLOOR(n * 0.2E0)) AS v FROM ("
        f"SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM {source})) "
        "WHERE n >= 10 AND n - t - v >= 2")


def sized_windows(source: str, tr: int, va: int, te: int, g: int) -> str:
    t = tr + va + te
    return (
        f"SELECT b.symbol, k AS window_id, b.ts, b.close, CASE WHEN b.i - k * {g} < {tr} THEN 'train' WHEN b.i - k * {g} < {tr + va} THEN 'validation' ELSE 'test' END AS segment "
        f"FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM {source}) b "
        f"JOIN (SELECT UNNEST(RANGE(0, 100000)) AS k) w ON k * {g} <= b.i AND b.i < k * {g} + {t} AND k * {g} + {t} <= b.n")


part("sup_seg", default_windows("bars_supplier"))
part("pri_seg", default_windows("bars_priority"))
part("pri_win", sized_windows("bars_priority", 300, 100, 40, 20))
part("sup_win", sized_windows("bars_supplier", 120, 40, 40, 40))
SEG = "symbol, window_id, segment"
RUNK = "strategy_id, " + SEG

indicator_parts("ss", "sup_seg", SEG)
flag_parts("ss", "ss_ind", SEG)
backtest_parts("ss", "ss_sig", RUNK)
indicator_parts("ps", "pri_seg", SEG)
flag_parts("ps", "ps_ind", SEG)
backtest_parts("ps", "ps_sig", RUNK)
part("pw_rn", f"SELECT {SEG}, ts, close, " + ", ".join(f"{sma_sql('close', SEG, p)} AS sma{p}" for p in (5, 20)) + " FROM pri_win")
flag_parts("pw", "pw_rn", SEG, ["sma_5_20", "revert_20"])
backtest_parts("pw", "pw_sig", RUNK)
indicator_parts("sf", "bars_supplier", "symbol")
flag_parts("sf", "sf_ind", "symbol")
backtest_parts("sf", "sf_sig", CAND)
indicator_parts("pf", "bars_priority", "symbol")
flag_parts("pf", "pf_ind", "symbol")
backtest_parts("pf", "pf_sig", CAND)

SQL["chronological_split"] = with_parts(
    "SELECT symbol, segment, COUNT(*) AS bars, STRFTIME(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, STRFTIME(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM ("
    "SELECT *, CASE WHEN FLOOR(n * 0.6E0) < 1 OR FLOOR(n * 0.8E0) <= FLOOR(n * 0.6E0) OR FLOOR(n * 0.8E0) >= n THEN NULL "
    "WHEN i < FLOOR(n * 0.6E0) THEN 'train' WHEN i < FLOOR(n * 0.8E0) THEN 'validation' ELSE 'test' END AS segment FROM ("
    "SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars_supplier)) GROUP BY symbol, segment")
SQL["walk_forward_windows"] = with_parts(
    "SELECT symbol, CAST(window_id AS INTEGER) AS window_id, segment, COUNT(*) AS bars, STRFTIME(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, STRFTIME(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_ts "
    "FROM sup_win GROUP BY symbol, window_id, segment")


def wf_parts(prefix: str) -> None:
    """Stitched OOS metrics and pass flags from a segment back-test chain."""
    part(f"{prefix}_oos",
         f"SELECT {CAND}, ts, MIN_BY(net_ret, window_id) AS net_ret, MIN_BY(close, window_id) AS close FROM {prefix}_n WHERE segment = 'test' GROUP BY {CAND}, ts")
    part(f"{prefix}_oose",
         f"SELECT *, PRODUCT(1.0E0 + net_ret) OVER (PARTITION BY {CAND} ORDER BY ts {RUN}) AS eq, ROW_NUMBER() OVER (PARTITION BY {CAND} ORDER BY ts) AS rn FROM {prefix}_oos")
    part(f"{prefix}_oosd",
         f"SELECT *, eq / MAX(eq) OVER (PARTITION BY {CAND} ORDER BY ts {RUN}) - 1.0E0 AS dd FROM {prefix}_oose")
    part(f"{prefix}_oosm",
         f"SELECT {CAND}, COUNT(*) AS oos_bars, MAX_BY(eq, ts) - 1.0E0 AS oos_return, ABS(MIN(dd)) AS oos_drawdown, "
         "CASE WHEN COUNT(*) < 3 OR STDDEV_SAMP(net_ret) FILTER (WHERE rn > 1) = 0 THEN 0.0E0 ELSE "
         "SQRT(252.0E0) * AVG(net_ret) FILTER (WHERE rn > 1) / STDDEV_SAMP(net_ret) FILTER (WHERE rn > 1) END AS oos_sharpe "
         f"FROM {prefix}_oosd GROUP BY {CAND}")
    part(f"{prefix}_segp",
         f"SELECT {CAND}, BOOL_AND(sharpe >= 0.5 AND ABS(max_drawdown) <= 0.25) AS segs, COUNT(DISTINCT window_id) AS windows, "
         f"MIN_BY(max_drawdown, window_id) FILTER (WHERE segment = 'train') AS train_drawdown FROM {prefix}_s GROUP BY {CAND}")
    part(f"{prefix}_wf",
         f"SELECT m.*, p.windows, p.train_drawdown, p.segs AND oos_sharpe >= 0.5 AND oos_drawdown <= 0.25 AS wf_passed FROM {prefix}_oosm m JOIN {prefix}_segp p USING ({CAND})")


for _p in ("pw", "ss", "ps"):
    wf_parts(_p)
SQL["walk_forward_oos"] = with_parts(
    f"SELECT {CAND}, windows, oos_bars, {r6('oos_return')} AS oos_return, {r6('oos_sharpe')} AS oos_sharpe, {r6('oos_drawdown')} AS oos_drawdown, wf_passed FROM pw_wf")
SQL["segment_evaluation"] = with_parts(
    f"SELECT {CAND}, segment, bars, {r6('total_return')} AS total_return, {r6('sharpe')} AS sharpe, {r6('max_drawdown')} AS max_drawdown, {r6(FIT)} AS fitness, "
    "sharpe >= 0.5 AND ABS(max_drawdown) <= 0.25 AS eligible FROM ss_s")

part("pri_fold",
     "SELECT b.symbol, k AS window_id, b.ts, b.close, CASE WHEN b.i - k * 150 >= 400 THEN 'test' ELSE 'train' END AS segment "
     "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars_priority) b "
     "JOIN (SELECT UNNEST(RANGE(0, 100000)) AS k) w ON k * 150 <= b.i AND b.i < k * 150 + 550 AND k * 150 + 400 < b.n WHERE b.n >= 550")
part("fo_rn", "SELECT *, " + ", ".join(f"{sma_sql('close', 'symbol, window_id', p)} AS sma{p}" for p in (5, 20)) + " FROM pri_fold")
flag_parts("fo", "fo_rn", "symbol, window_id", ["sma_5_20", "revert_20"], keep=", segment")
part("fo_test", "SELECT strategy_id, symbol, window_id, ts, close, max_position, entry AS signal FROM fo_flags WHERE segment = 'test'")
backtest_parts("fo", "fo_test", "strategy_id, symbol, window_id")
OK = "sharpe >= 0.5 AND ABS(max_drawdown) <= 0.25"
SQL["fold_validation"] = with_parts(
    f"SELECT {CAND}, CAST(window_id AS INTEGER) AS window_id, bars, {r6('total_return')} AS total_return, {r6('sharpe')} AS sharpe, {r6('max_drawdown')} AS max_drawdown, {OK} AS valid FROM fo_s")
SQL["fold_summary"] = with_parts(
    f"SELECT {CAND}, BOOL_AND({OK}) AS passed, COUNT(*) AS folds, "
    f"COALESCE(STRING_AGG('fold ' || window_id || ' failed validation', '; ' ORDER BY window_id) FILTER (WHERE NOT ({OK})), '') AS reasons FROM fo_s GROUP BY {CAND}")

part("di_sig", "SELECT strategy_id, symbol, ts, close, max_position, entry AS signal FROM sf_flags")
backtest_parts("di", "di_sig", CAND)
SQL["discovery"] = with_parts(
    f"SELECT {CAND}, {r6('total_return')} AS total_return, {r6('sharpe')} AS sharpe, {OK} AS accepted FROM di_s")

# The sweep over the spec table: one SELECT per spec and period pair.
GRID = (5, 10, 14, 20, 50, 100, 200)


def sweep_specs():
    base = {
        "sma_5_20": [("sma", 5), ("sma", 20)], "sma_10_30": [("sma", 10), ("sma", 30)],
        "ema_10_30": [("ema", 10), ("ema", 30)], "rsi_14": [("rsi", 14)], "revert_20": [("sma", 20)],
    }
    for name, inds in base.items():
        seen = [tuple(inds)]
        for i, (k, p) in enumerate(inds):
            for q in GRID:
                if q != p:
                    seen.append(tuple(inds[:i] + [(k, q)] + inds[i + 1:]))
        for s in seen:
            yield name, s


def sweep_rule(name: str, cols: list[str]) -> tuple[str, str]:
    a = cols[0]
    b = cols[1] if len(cols) > 1 else ""
    return {
        "sma_5_20": (f"{a} > {b}", f"{a} < {b}"),
        "sma_10_30": (f"{a} > {b} AND p{a} <= p{b}", f"{a} < {b} AND p{a} >= p{b}"),
        "ema_10_30": (f"{a} > {b}", f"{a} < {b}"),
        "rsi_14": (f"{a} > 50", f"{a} < 45"),
        "revert_20": (f"close < {a}", f"close > {a}"),
    }[name]


SMAS = (5, 10, 14, 20, 30, 50, 100, 200)
EMAS = (5, 10, 14, 20, 30, 50, 100, 200)
RSIS = GRID


def wide_parts(prefix: str, source: str, keys: str) -> None:
    kl = [k.strip() for k in keys.split(",")]
    join = " AND ".join(f"b.{k} = p.{k}" for k in kl)
    bk = ", ".join(f"b.{k}" for k in kl)
    part(f"{prefix}_wrn",
         f"SELECT {keys}, ts, close, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i, "
         f"close - LAG(close) OVER (PARTITION BY {keys} ORDER BY ts) AS d, "
         + ", ".join(f"{sma_sql('close', keys, p)} AS sma{p}" for p in SMAS) + f" FROM {source}")
    part(f"{prefix}_wrec",
         f"SELECT {keys}, ts, i, " + ", ".join(f"close AS e{p}" for p in EMAS) + ", "
         + ", ".join(f"CAST(NULL AS DOUBLE) AS g{p}, CAST(NULL AS DOUBLE) AS l{p}" for p in RSIS)
         + f" FROM {prefix}_wrn WHERE i = 0 UNION ALL SELECT {bk}, b.ts, b.i, "
         + ", ".join(f"e{p} + (b.close - e{p}) * (2.0E0/{p + 1})" for p in EMAS) + ", "
         + ", ".join(
             f"CASE WHEN b.i = 1 THEN GREATEST(b.d, 0) ELSE g{p} + (GREATEST(b.d, 0) - g{p}) / {p}.0E0 END, "
             f"CASE WHEN b.i = 1 THEN GREATEST(-b.d, 0) ELSE l{p} + (GREATEST(-b.d, 0) - l{p}) / {p}.0E0 END" for p in RSIS)
         + f" FROM {prefix}_wrec p JOIN {prefix}_wrn b ON {join} AND b.i = p.i + 1")
    part(f"{prefix}_wind",
         "SELECT b.*, " + ", ".join(f"CASE WHEN b.i >= {p - 1} THEN p.e{p} END AS ema{p}" for p in EMAS) + ", "
         + ", ".join(f"CASE WHEN b.i >= {p} THEN {rsi_sql(f'p.g{p}', f'p.l{p}')} END AS rsi{p}" for p in RSIS)
         + f" FROM {prefix}_wrn b JOIN {prefix}_wrec p ON {join} AND b.i = p.i")
    part(f"{prefix}_wide",
         f"SELECT *, " + ", ".join(f"LAG(sma{p}) OVER (PARTITION BY {keys} ORDER BY ts) AS psma{p}" for p in SMAS) + f" FROM {prefix}_wind")


wide_parts("pf", "bars_priority", "symbol")
_tables = []
for _n, _s in sweep_specs():
    _en, _ex = sweep_rule(_n, [f"{k}{p}" for k, p in _s])
    _tables.append(
        f"SELECT symbol, '{_n}' AS name, '{','.join(str(p) for _, p in _s)}' AS periods, "
        f"CAST(COUNT(*) FILTER (WHERE {_en}) AS BIGINT) AS entries, CAST(COUNT(*) FILTER (WHERE {_ex}) AS BIGINT) AS exits FROM pf_wide GROUP BY symbol")
SQL["table_signals"] = with_parts(" UNION ALL ".join(_tables))

RATES = {"baseline": "0.0003E0", "cost_2x": "0.0004E0", "slippage_2x": "0.0005E0", "cost_slippage_2x": "0.0006E0"}


def scenario_part(prefix: str, ratio: str, name: str) -> None:
    part(name,
         f"SELECT {CAND}, " + ", ".join(f"100000.0E0 * PRODUCT(1.0E0 + gross_ret - turnover * {r}) AS eq_{s}" for s, r in RATES.items())
         + f" FROM {prefix}_m GROUP BY {CAND}")
    part(f"{name}_r",
         "SELECT *, LEAST(" + ", ".join(f"eq_{s}" for s in RATES) + ") / eq_baseline AS rob_ratio, "
         + "CONCAT_WS('; ', " + ", ".join(f"CASE WHEN eq_{s} < eq_baseline * {ratio} THEN '{s} equity fell below robustness threshold' END" for s in RATES)
         + f") AS rob_reasons FROM {name}")


scenario_part("sf", "0.9E0", "sc_sup")
scenario_part("sf", "0.98E0", "sc_sup98")
scenario_part("pf", "0.9E0", "sc_pri")
SQL["cost_scenarios"] = with_parts(" UNION ALL ".join(
    f"SELECT {CAND}, '{s}' AS scenario, {r2('eq_' + s)} AS final_equity, rob_reasons = '' AS rob_passed FROM sc_sup_r" for s in RATES))
SQL["robustness_ratio"] = with_parts(
    f"SELECT {CAND}, {r6('rob_ratio')} AS rob_ratio, rob_reasons = '' AS rob_passed, rob_reasons AS reasons FROM sc_sup98_r")


def bootstrap_parts(prefix: str, sims: int, seed: int, where: str = "TRUE") -> None:
    """Closed test trades and their resampled paths."""
    part(f"{prefix}_tid",
         f"SELECT *, SUM(CASE WHEN target AND NOT prev_target THEN 1 ELSE 0 END) OVER (PARTITION BY {RUNK} ORDER BY ts {RUN}) AS tid FROM {prefix}_m WHERE segment = 'test' AND {where}")
    part(f"{prefix}_tr",
         f"SELECT {RUNK}, tid, MIN_BY(close, ts) FILTER (WHERE target) AS px0, MIN_BY(close, ts) FILTER (WHERE NOT target AND prev_target) AS px1 FROM {prefix}_tid WHERE tid > 0 GROUP BY {RUNK}, tid")
    part(f"{prefix}_trr",
         f"SELECT {CAND}, ROW_NUMBER() OVER (PARTITION BY {CAND} ORDER BY window_id, tid) - 1 AS j, COUNT(*) OVER (PARTITION BY {CAND}) AS n, "
         f"(px1 / px0 - 1.0E0) * 0.25E0 - 0.0006E0 AS r FROM {prefix}_tr WHERE px1 IS NOT NULL")
    part(f"{prefix}_draws",
         f"SELECT {CAND}, sim, CAST('0x' || SUBSTR(MD5('{seed}:' || sim || ':' || j), 1, 8) AS BIGINT) % n AS pick FROM {prefix}_trr, (SELECT UNNEST(RANGE(0, {sims})) AS sim)")
    part(f"{prefix}_paths",
         f"SELECT d.strategy_id, d.symbol, d.sim, PRODUCT(1.0E0 + t.r) - 1.0E0 AS o FROM {prefix}_draws d JOIN {prefix}_trr t ON t.strategy_id = d.strategy_id AND t.symbol = d.symbol AND t.j = d.pick GROUP BY 1, 2, 3")
    part(f"{prefix}_mc",
         f"SELECT {CAND}, COUNT(*) AS mc_simulations, MEDIAN(o) AS mc_median, MIN(o) AS mc_worst, QUANTILE_CONT(o, 0.05) AS mc_lower, "
         f"AVG(CASE WHEN o >= 0 THEN 1.0E0 ELSE 0.0E0 END) AS mc_pass_rate FROM {prefix}_paths GROUP BY {CAND}")


part("p2_sig", "SELECT * FROM ps_sig WHERE strategy_id IN ('sma_5_20', 'revert_20')")
backtest_parts("p2", "p2_sig", RUNK)
bootstrap_parts("p2", 500, 7)
bootstrap_parts("ss", 200, 3)
bootstrap_parts("ps", 500, 1)
SQL["bootstrap"] = with_parts(
    f"SELECT {CAND}, mc_simulations, " + ", ".join(f"{r6(c)} AS {c}" for c in ("mc_median", "mc_worst", "mc_lower", "mc_pass_rate")) + " FROM p2_mc")


def regime_parts(prefix: str, seg: str, oos: str) -> None:
    w = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    part(f"{prefix}_rl0",
         f"SELECT symbol, ts, COALESCE(close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1.0E0, 0.0E0) AS br FROM {seg} WHERE segment = 'test'")
    part(f"{prefix}_rl1",
         f"SELECT *, CASE WHEN COUNT(*) OVER {w} = 20 THEN STDDEV_SAMP(br) OVER {w} END AS vol FROM {prefix}_rl0")
    part(f"{prefix}_rl", f"SELECT *, COALESCE(vol >= MEDIAN(vol) OVER (PARTITION BY symbol), FALSE) AS hv FROM {prefix}_rl1")
    part(f"{prefix}_reg",
         f"SELECT {CAND}, AVG(net_ret) FILTER (WHERE br >= 0) AS rising, AVG(net_ret) FILTER (WHERE br < 0) AS falling, "
         f"AVG(net_ret) FILTER (WHERE hv) AS high_volatility, AVG(net_ret) FILTER (WHERE NOT hv) AS low_volatility FROM {oos} JOIN {prefix}_rl USING (symbol, ts) GROUP BY {CAND}")
    part(f"{prefix}_regs",
         f"SELECT *, LEAST(rising, falling, high_volatility, low_volatility) - GREATEST(rising, falling, high_volatility, low_volatility) AS regime_score FROM {prefix}_reg")


regime_parts("ps", "pri_seg", "ps_oos")
regime_parts("ss", "sup_seg", "ss_oos")
SQL["regimes"] = with_parts(
    f"SELECT {CAND}, " + ", ".join(f"{r6(c + ' * 1000.0E0')} AS {c}" for c in ("rising", "falling", "high_volatility", "low_volatility", "regime_score"))
    + " FROM ps_regs WHERE strategy_id IN ('sma_5_20', 'revert_20')")


def gate(prefix: str, scen: str, pert: bool) -> str:
    checks = [
        ("NOT wf_passed", "walk-forward/OOS evaluation failed"),
        ("oos_sharpe < 0.5", "OOS Sharpe is below the promotion minimum"),
        ("oos_drawdown > 0.25", "OOS drawdown exceeds the promotion maximum"),
        ("mc_pass_rate < 0.95", "Monte Carlo pass rate is below the promotion minimum"),
        ("mc_lower < -0.1", "Monte Carlo lower-percentile return is too weak"),
    ]
    if pert:
        checks.append(("pert_pass_rate < 0.8", "parameter perturbation stability is below the promotion minimum"))
    else:
        checks.append(("TRUE", "parameter perturbation evidence is required"))
    checks += [
        ("regime_score IS NULL", "regime stability evidence is required"),
        ("regime_score < -0.05", "regime stability is below the promotion minimum"),
    ]
    text = "CONCAT_WS('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in checks) + ", NULLIF(rob_reasons, ''))"
    return (
        f"SELECT w.*, COALESCE(m.mc_pass_rate, 0.0E0) AS mc_pass_rate, COALESCE(m.mc_lower, -1.0E0) AS mc_lower, COALESCE(m.mc_simulations, 0) AS mc_simulations, "
        f"g.regime_score, s.rob_ratio, s.rob_reasons, s.eq_baseline" + (", q.pert_pass_rate" if pert else "")
        + f" FROM {prefix}_wf w LEFT JOIN {prefix}_mc m USING ({CAND}) LEFT JOIN {prefix}_regs g USING ({CAND}) LEFT JOIN {scen}_r s USING ({CAND})"
        + (f" LEFT JOIN pert q USING ({CAND})" if pert else "")
    ), text


_sel, _text = gate("ss", "sc_sup", False)
part("sup_ev0", _sel)
part("sup_ev", f"SELECT *, {_text} AS why, {_text} = '' AS promoted FROM sup_ev0")
SQL["promotion_gate"] = with_parts(
    f"SELECT {CAND}, {r6('oos_sharpe')} AS oos_sharpe, {r6('oos_drawdown')} AS oos_drawdown, wf_passed, {r6('mc_pass_rate')} AS mc_pass_rate, {r6('rob_ratio')} AS rob_ratio, "
    "CASE WHEN promoted THEN 'paper' ELSE 'research' END AS stage, promoted AS promotion_eligible, why AS reasons FROM sup_ev")


# --- perturbations: the same draws, the variants spelled out ---------------------------------
def perturbation_parts(seed: int = 1, samples: int = 20) -> None:
    base = {
        "sma_5_20": [("sma", 5), ("sma", 20)], "sma_10_30": [("sma", 10), ("sma", 30)],
        "ema_10_30": [("ema", 10), ("ema", 30)], "rsi_14": [("rsi", 14)], "revert_20": [("sma", 20)],
    }
    edits, signals = [], []
    for name, inds in base.items():
        n = 0
        for i, (k, p) in enumerate(inds):
            for q in GRID:
                if q == p:
                    continue
                v = inds[:i] + [(k, q)] + inds[i + 1:]
                label = name + ":" + ",".join(str(x) for _, x in v)
                edits.append(f"('{name}', 0, {n}, '{label}')")
                n += 1
                en, ex = sweep_rule(name, [f"{a}{b}" for a, b in v])
                signals.append(
                    f"SELECT '{label}' AS strategy_id, symbol, ts, close, 0.25E0 AS max_position, COALESCE({en}, FALSE) AS entry, COALESCE({ex}, FALSE) AS exit FROM pt_wide")
    part("pt_edits", "SELECT * FROM (VALUES " + ", ".join(edits) + ") t(name, op, edit, label)")
    names = ", ".join(f"('{n}', {2 if n == 'rsi_14' else 1}, {len(i) * 7 - sum(p in GRID for _, p in i)})" for n, i in base.items())
    md5 = lambda tail: f"CAST('0x' || SUBSTR(MD5('{seed}:' || name || ':' || sample || ':{tail}'), 1, 8) AS BIGINT)"
    part("pt_draw",
         f"SELECT name, sample, {md5('op')} % n_ops AS op, CASE WHEN {md5('op')} % n_ops = 1 THEN 0 ELSE {md5('edit')} % n_edits END AS edit, "
         f"0.9E0 + 0.2E0 * {md5('factor')} / 4294967296.0E0 AS factor "
         f"FROM (VALUES {names}) t(name, n_ops, n_edits), (SELECT UNNEST(RANGE(0, {samples})) AS sample)")
    part("pt_pick",
         "SELECT d.name, d.sample, d.factor, d.op, COALESCE(e.label, d.name || ':threshold:' || d.sample) AS label "
         "FROM pt_draw d LEFT JOIN pt_edits e ON e.name = d.name AND e.op = d.op AND e.edit = d.edit")
    part("pt_test", "SELECT symbol, ts, close FROM pri_seg WHERE segment = 'test'")
    wide_parts("pt", "pt_test", "symbol")
    signals.append(
        "SELECT p.label AS strategy_id, w.symbol, w.ts, w.close, 0.25E0 AS max_position, COALESCE(w.rsi14 > 50.0E0 * p.factor, FALSE) AS entry, "
        "COALESCE(w.rsi14 < 45, FALSE) AS exit FROM pt_wide w, pt_pick p WHERE p.op = 1")
    part("pt_flags", " UNION ALL ".join(signals))
    part("pt_sig", f"SELECT strategy_id, symbol, ts, close, max_position, {hold_sql('entry', 'exit', CAND)} AS signal FROM pt_flags")
    backtest_parts("pt", "pt_sig", CAND)
    part("pert",
         "SELECT p.name AS strategy_id, s.symbol, COUNT(*) AS pert_samples, AVG(CASE WHEN s.sharpe >= 0 THEN 1.0E0 ELSE 0.0E0 END) AS pert_pass_rate, "
         "MIN(s.sharpe) AS pert_worst, MEDIAN(s.sharpe) AS pert_median FROM pt_pick p JOIN pt_s s ON s.strategy_id = p.label GROUP BY 1, 2")


perturbation_parts()
SQL["perturbations"] = with_parts(
    f"SELECT {CAND}, pert_samples, " + ", ".join(f"{r6(c)} AS {c}" for c in ("pert_pass_rate", "pert_worst", "pert_median")) + " FROM pert")
_sel, _text = gate("ps", "sc_pri", True)
part("pri_ev0", _sel)
part("pri_ev", f"SELECT *, {_text} AS why, {_text} = '' AS promoted FROM pri_ev0")
SQL["candidate_evidence"] = with_parts(
    f"SELECT {CAND}, " + ", ".join(f"{r6(c)} AS {c}" for c in ("oos_return", "oos_sharpe", "oos_drawdown", "mc_pass_rate", "mc_lower", "pert_pass_rate", "rob_ratio"))
    + f", {r6('regime_score * 1000.0E0')} AS regime_score, wf_passed, rob_reasons = '' AS rob_passed, "
    "CASE WHEN promoted THEN 'paper' ELSE 'research' END AS stage, promoted AS promotion_eligible, why AS reasons FROM pri_ev")

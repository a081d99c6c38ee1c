"""SQL twins of the queries in barloom.plans.portfolios."""

from oracles import selection as _selection  # noqa: F401
from oracles.parts import part, r6, with_parts

SQL = {}
G = "portfolio_id"
part("ret", "SELECT symbol AS portfolio_id, strategy_id, ts, net_ret AS r FROM sf_b")
part("mem",
     "SELECT symbol AS portfolio_id, strategy_id, fitness, CASE WHEN rob_passed THEN 1.0E0 ELSE 0.0E0 END AS robustness, fitness > -1.5 AS eligible, "
     "ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY fitness DESC, strategy_id) AS rank FROM scores")
part("cmat",
     "SELECT x.portfolio_id, x.strategy_id AS a, y.strategy_id AS b, COUNT(*) AS n, COVAR_SAMP(x.r, y.r) AS cov, STDDEV_SAMP(x.r) AS sa, STDDEV_SAMP(y.r) AS sb "
     "FROM ret x JOIN ret y ON x.portfolio_id = y.portfolio_id AND x.ts = y.ts GROUP BY 1, 2, 3")
part("corrs", "SELECT *, CASE WHEN sa * sb <> 0 THEN cov / (sa * sb) END AS corr FROM cmat")
SQL["corr_matrix"] = with_parts(f"SELECT {G}, a, b, n, {r6('cov * 1000000.0E0')} AS cov_ppm, {r6('corr')} AS corr FROM corrs WHERE a <= b")


def weights_parts(name: str, lo: float, hi: float, source: str = "ret") -> None:
    """Water-filling one capped strategy after the other, as unrolled rounds (five members)."""
    part(f"{name}_w0", f"SELECT {G}, strategy_id, GREATEST(STDDEV_SAMP(r), 1e-8) AS vol, {lo}E0 AS w, TRUE AS active FROM {source} GROUP BY 1, 2")
    for k in range(1, 7):
        p = f"{name}_w{k - 1}"
        part(f"{name}_q{k}",
             f"SELECT *, CASE WHEN active THEN w + GREATEST(rest, 0.0E0) / vol / tot END AS prop FROM (SELECT *, 1.0E0 - SUM(w) OVER (PARTITION BY {G}) AS rest, "
             f"SUM(CASE WHEN active THEN 1.0E0 / vol END) OVER (PARTITION BY {G}) AS tot FROM {p})")
        part(f"{name}_w{k}",
             f"SELECT {G}, strategy_id, vol, CASE WHEN active AND rest > 1e-12 THEN (CASE WHEN BOOL_OR(prop > {hi}E0 + 1e-12) OVER (PARTITION BY {G}) THEN (CASE WHEN prop > {hi}E0 + 1e-12 THEN {hi}E0 ELSE w END) ELSE prop END) ELSE w END AS w, "
             f"active AND rest > 1e-12 AND COALESCE(BOOL_OR(prop > {hi}E0 + 1e-12) OVER (PARTITION BY {G}), FALSE) AND NOT prop > {hi}E0 + 1e-12 AS active FROM {name}_q{k}")
    part(name, f"SELECT {G}, strategy_id, vol, w FROM {name}_w6")


weights_parts("wts_a", 0.02, 0.24)
weights_parts("wts_b", 0.0, 1.0)
weights_parts("wts_c", 0.0, 0.5)
SQL["inv_vol_weights"] = with_parts(f"SELECT {G}, strategy_id, {r6('w')} AS weight, {r6('vol')} AS est_vol FROM wts_a")
SQL["portfolio_volatility"] = with_parts(
    f"SELECT c.portfolio_id, {r6('SQRT(SUM(x.w * y.w * c.cov)) * 1000.0E0')} AS volatility_permille FROM cmat c JOIN wts_b x ON x.portfolio_id = c.portfolio_id AND x.strategy_id = c.a "
    "JOIN wts_b y ON y.portfolio_id = c.portfolio_id AND y.strategy_id = c.b GROUP BY 1")

# greedy selection, one unrolled step per accepted strategy
part("hist", f"SELECT {G} FROM ret GROUP BY {G} HAVING COUNT(DISTINCT ts) >= 20")
part("sel1", f"SELECT m.portfolio_id, m.strategy_id, m.rank, 1 AS pos FROM mem m JOIN hist USING ({G}) WHERE m.rank = 1")
for k in range(2, 5):
    p = f"sel{k - 1}"
    part(f"opt{k}",
         f"SELECT m.portfolio_id, m.strategy_id, m.rank, AVG(GREATEST(c.corr, 0.0E0)) AS mc FROM mem m JOIN {p} s ON s.portfolio_id = m.portfolio_id "
         f"JOIN corrs c ON c.portfolio_id = m.portfolio_id AND c.a = m.strategy_id AND c.b = s.strategy_id AND c.corr IS NOT NULL "
         f"WHERE m.rank > (SELECT MAX(z.rank) FROM {p} z WHERE z.portfolio_id = m.portfolio_id) GROUP BY 1, 2, 3")
    part(f"sel{k}",
         f"SELECT * FROM {p} UNION ALL SELECT {G}, MIN_BY(strategy_id, rank), MIN(rank), {k} FROM opt{k} WHERE mc <= 0.35 GROUP BY {G}")
SQL["diversified_selection"] = with_parts(
    f"SELECT m.portfolio_id, m.strategy_id, s.pos IS NOT NULL AS selected, CAST(s.pos AS DOUBLE) AS pos FROM mem m JOIN hist USING ({G}) LEFT JOIN sel4 s ON s.portfolio_id = m.portfolio_id AND s.strategy_id = m.strategy_id")
part("ret_sel", f"SELECT r.* FROM ret r JOIN sel4 s ON s.{G} = r.{G} AND s.strategy_id = r.strategy_id")
weights_parts("wts_d", 0.0, 0.6, "ret_sel")
SQL["portfolio_build"] = with_parts(
    f"SELECT m.{G}, m.strategy_id, s.pos IS NOT NULL AS selected, CAST(s.pos AS DOUBLE) AS pos, {r6('w.w')} AS weight, {r6('w.vol')} AS est_vol, "
    f"CASE WHEN h.{G} IS NULL THEN 'not enough common history' END AS problem FROM mem m LEFT JOIN hist h ON h.{G} = m.{G} "
    f"LEFT JOIN sel4 s ON s.{G} = m.{G} AND s.strategy_id = m.strategy_id LEFT JOIN wts_d w ON w.{G} = m.{G} AND w.strategy_id = m.strategy_id")
part("avgc",
     f"SELECT s.portfolio_id, COUNT(DISTINCT s.strategy_id) AS members, COALESCE(AVG(GREATEST(c.corr, 0.0E0)) FILTER (WHERE c.corr IS NOT NULL), 0.0E0) AS ac FROM sel4 s "
     "LEFT JOIN sel4 t ON t.portfolio_id = s.portfolio_id AND t.strategy_id < s.strategy_id LEFT JOIN corrs c ON c.portfolio_id = s.portfolio_id AND c.a = s.strategy_id AND c.b = t.strategy_id GROUP BY 1")
SQL["average_correlation"] = with_parts(f"SELECT {G}, members, {r6('ac')} AS average_correlation FROM avgc")

part("sv0", f"SELECT {G}, strategy_id, CAST(NULL AS BIGINT) AS pos FROM mem WHERE FALSE")
for k in range(1, 4):
    p = f"sv{k - 1}"
    div = "1.0E0" if k == 1 else (
        "COALESCE((SELECT LEAST(1.0E0, GREATEST(0.0E0, 1.0E0 - AVG(GREATEST(c.corr, 0.0E0)))) FROM corrs c "
        f"JOIN {p} s ON s.portfolio_id = c.portfolio_id AND s.strategy_id = c.b WHERE c.portfolio_id = m.portfolio_id AND c.a = m.strategy_id AND c.corr IS NOT NULL), 0.0E0)")
    part(f"svo{k}",
         f"SELECT m.portfolio_id, m.strategy_id, m.fitness, 0.6E0 * m.fitness + 0.25E0 * m.robustness + 0.15E0 * {div} AS sc FROM mem m "
         f"WHERE m.eligible AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.portfolio_id = m.portfolio_id AND z.strategy_id = m.strategy_id)")
    part(f"sv{k}",
         f"SELECT * FROM {p} UNION ALL SELECT {G}, strategy_id, {k} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {G} ORDER BY sc DESC, fitness DESC, strategy_id) AS rn FROM svo{k}) WHERE rn = 1")
SQL["survivors"] = with_parts(
    f"SELECT {G}, strategy_id, pos, FALSE AS fallback FROM sv3 UNION ALL SELECT {G}, strategy_id, pos, TRUE FROM ("
    f"SELECT m.portfolio_id, m.strategy_id, ROW_NUMBER() OVER (PARTITION BY m.portfolio_id ORDER BY m.strategy_id) + (SELECT COUNT(*) FROM sv3 z WHERE z.portfolio_id = m.portfolio_id) AS pos "
    "FROM mem m WHERE NOT EXISTS (SELECT 1 FROM sv3 z WHERE z.portfolio_id = m.portfolio_id AND z.strategy_id = m.strategy_id)) WHERE pos <= 3")

part("pre", f"SELECT s.portfolio_id, s.strategy_id, s.pos, t.k FROM sel4 s JOIN (SELECT {G}, pos AS k FROM sel4) t ON t.portfolio_id = s.portfolio_id AND s.pos <= t.k")
part("pre_w",
     f"SELECT p.portfolio_id, p.strategy_id, p.k, (1.0E0 / v.vol) / SUM(1.0E0 / v.vol) OVER (PARTITION BY p.portfolio_id, p.k) AS w FROM pre p JOIN wts_b v ON v.portfolio_id = p.portfolio_id AND v.strategy_id = p.strategy_id")
part("pre_v",
     "SELECT x.portfolio_id, x.k, SQRT(GREATEST(SUM(x.w * y.w * c.cov), 0.0E0)) AS vol FROM pre_w x JOIN pre_w y ON x.portfolio_id = y.portfolio_id AND x.k = y.k "
     "JOIN cmat c ON c.portfolio_id = x.portfolio_id AND c.a = x.strategy_id AND c.b = y.strategy_id GROUP BY 1, 2")
part("pre_a",
     f"SELECT {G}, MAX(k) AS members, COALESCE(MAX(k) FILTER (WHERE vol <= 0.0006), 0) AS admitted, "
     f"COALESCE(MAX_BY(vol, k) FILTER (WHERE vol <= 0.0006), MIN_BY(vol, k)) AS vol FROM pre_v GROUP BY {G}")
SQL["risk_prefix"] = with_parts(
    f"SELECT {G}, CAST(members AS BIGINT) AS members, CAST(admitted AS BIGINT) AS admitted, admitted > 0 AS admission_passed, {r6('vol * 1000.0E0')} AS volatility_permille FROM pre_a")

part("attr",
     "SELECT w.portfolio_id, w.strategy_id, w.w, k.rc, k2.mr, k2.mr / SQRT(SUM(w.w * k2.mr) OVER (PARTITION BY w.portfolio_id)) * w.w AS risk, SQRT(SUM(w.w * k2.mr) OVER (PARTITION BY w.portfolio_id)) AS vol FROM wts_c w "
     "JOIN (SELECT r.portfolio_id, r.strategy_id, SUM(r.r * w.w) AS rc FROM ret r JOIN wts_c w ON w.portfolio_id = r.portfolio_id AND w.strategy_id = r.strategy_id GROUP BY 1, 2) k ON k.portfolio_id = w.portfolio_id AND k.strategy_id = w.strategy_id "
     "JOIN (SELECT c.portfolio_id, c.a, SUM(c.cov * w.w) AS mr FROM cmat c JOIN wts_c w ON w.portfolio_id = c.portfolio_id AND w.strategy_id = c.b GROUP BY 1, 2) k2 ON k2.portfolio_id = w.portfolio_id AND k2.a = w.strategy_id")
SQL["attribution"] = with_parts(
    f"SELECT {G}, strategy_id, {r6('w')} AS weight, {r6('rc')} AS return_contribution, {r6('risk * 1000.0E0')} AS risk_permille FROM attr")
part("hlth",
     f"SELECT {G}, SUM(rc) AS tr, MAX(vol) AS vol, MAX(sh) AS mf, COALESCE(STRING_AGG(strategy_id, ',' ORDER BY strategy_id) FILTER (WHERE sh > 0.3), '') AS rep FROM ("
     f"SELECT *, ABS(risk) / SUM(ABS(risk)) OVER (PARTITION BY {G}) AS sh FROM attr) GROUP BY {G}")
part("hlth2", "SELECT *, CONCAT_WS(',', CASE WHEN tr < 0 THEN 'total_return' END, CASE WHEN vol > 0.25 THEN 'volatility' END, CASE WHEN mf > 0.3 THEN 'concentration' END) AS br FROM hlth")
SQL["portfolio_health"] = with_parts(
    f"SELECT {G}, {r6('tr')} AS total_return, {r6('mf')} AS max_risk_fraction, CASE WHEN br = '' THEN 'HEALTHY' ELSE 'REVIEW_REQUIRED' END AS status, "
    "CASE WHEN br = '' THEN 'CONTINUE_PORTFOLIO' WHEN mf > 0.3 THEN 'REBALANCE_OR_RESEARCH_REPLACEMENT' ELSE 'RESEARCH_REPLACEMENT' END AS decision, br AS breached, rep AS replace FROM hlth2")
SQL["portfolio_feedback"] = with_parts(
    f"SELECT s.portfolio_id, s.strategy_id, CASE WHEN admitted = 0 THEN 'degraded' WHEN ac >= 0.75 THEN 'diversification' ELSE 'capacity' END AS reason, "
    "CASE WHEN admitted > 0 THEN 1.0E0 ELSE 0.0E0 END AS robustness, "
    f"{r6('1.0E0 - ac')} AS novelty, {r6('CASE WHEN admitted = 0 THEN GREATEST(ac, vol / GREATEST(vol, 1.0E0)) ELSE ac END')} AS uncertainty, "
    "CASE WHEN admitted > 0 AND ac < 0.75 THEN 1.0E0 ELSE 0.0E0 END AS capacity_gap FROM sel4 s JOIN avgc USING (portfolio_id) JOIN pre_a USING (portfolio_id)")

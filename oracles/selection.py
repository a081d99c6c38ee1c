"""SQL twins of the queries in barloom.plans.selection."""

from oracles import evidence as _evidence  # noqa: F401  (registers the parts used here)
from oracles.parts import part, r6, with_parts

SQL = {}
CAND = "strategy_id, symbol"

part("p_raw",
     "SELECT p_partkey AS part, p_brand AS name, CASE WHEN p_size = 50 THEN 0 ELSE 1 END AS version, p_type AS universe, "
     "['sma', 'ema', 'rsi'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS kind, p_size - 1 AS fast, 30 + p_size % 5 * 10 AS slow, 40.0E0 + p_size % 20 AS level, "
     "CASE WHEN p_size % 2 = 0 THEN 0.25E0 ELSE 0.5E0 END AS cap, CASE WHEN p_size = 48 THEN 0.5E0 WHEN p_size % 2 = 0 THEN 0.25E0 ELSE 0.5E0 END AS risk_cap FROM part")
SQL["spec_checks"] = with_parts(
    "SELECT CAST(part AS VARCHAR) AS part, CONCAT_WS('; ', CASE WHEN version < 1 THEN 'version must be at least 1' END, "
    "CASE WHEN fast <= 0 THEN 'indicator period must be positive' END, "
    "CASE WHEN risk_cap > cap THEN 'risk.max_position cannot exceed position_sizing.max_position' END) AS reasons FROM p_raw")
GENES = {
    "g_name": "name", "g_version": "version", "g_universe": "universe",
    "g_ind": "kind || fast || CASE WHEN kind = 'rsi' THEN '' ELSE ',' || slow END",
    "g_rule": "CASE WHEN kind = 'rsi' THEN 'rsi>' || level ELSE 'fast>slow' END", "g_cap": "cap", "g_risk": "risk_cap",
}
part("p_gene", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in GENES.items()) + " FROM p_raw")
SQL["seed_dedupe"] = with_parts(
    "SELECT name, COUNT(*) AS specs, COUNT(DISTINCT (" + ", ".join(GENES) + ")) AS seeds FROM p_gene GROUP BY name")
part("p_spec", "SELECT DISTINCT name, version, universe, kind, fast, slow_or, level_or, cap, " + ", ".join(GENES) + " FROM ("
     "SELECT *, CASE WHEN kind = 'rsi' THEN NULL ELSE slow END AS slow_or, CASE WHEN kind = 'rsi' THEN level END AS level_or FROM p_gene "
     "WHERE version <> 0 AND fast > 0 AND risk_cap <= cap)")
# entry and exit always differ together, so the rule gene counts twice; four fields never differ.
DIST = "((a.g_name <> b.g_name)::INT + (a.g_version <> b.g_version)::INT + (a.g_universe <> b.g_universe)::INT + (a.g_ind <> b.g_ind)::INT + 2 * (a.g_rule <> b.g_rule)::INT + (a.g_cap <> b.g_cap)::INT + (a.g_risk <> b.g_risk)::INT)"
part("p_num", "SELECT *, ROW_NUMBER() OVER (ORDER BY " + ", ".join(GENES) + ") AS id FROM p_spec")
SQL["genome_novelty"] = with_parts(
    f"SELECT a.name, a.universe AS symbol, a.kind, CAST(a.fast AS INTEGER) AS period, {r6(f'MAX(s)')} AS novelty FROM ("
    f"SELECT a.id, AVG({DIST}) / 11.0E0 AS s FROM p_num a JOIN p_num b ON a.id <> b.id GROUP BY a.id) d JOIN p_num a ON a.id = d.id GROUP BY 1, 2, 3, 4")
SQL["genome_distances"] = with_parts(
    f"SELECT m.name, members, {r6('COALESCE(mean_d, 0.0E0)')} AS mean_distance, {r6('COALESCE(min_d, 0.0E0)')} AS min_distance, {r6('COALESCE(max_d, 0.0E0)')} AS max_distance FROM "
    "(SELECT name, COUNT(*) AS members FROM p_num GROUP BY name) m LEFT JOIN ("
    f"SELECT a.name, AVG({DIST}) / 11.0E0 AS mean_d, MIN({DIST}) / 11.0E0 AS min_d, MAX({DIST}) / 11.0E0 AS max_d FROM p_num a JOIN p_num b ON a.name = b.name AND a.id < b.id GROUP BY a.name) d ON d.name = m.name")
_PERIODS = "(SELECT UNNEST([5, 10, 14, 20, 50, 100, 200]) AS q)"
part("p_edits",
     f"SELECT name, 'mutate_indicator_period' AS operator, CAST(q AS BIGINT) AS per, COALESCE(level_or, 0.0E0) AS lv, 0 AS cr, 0.25E0 AS v FROM p_num, {_PERIODS} WHERE q <> fast UNION ALL "
     f"SELECT name, 'mutate_indicator_period', fast, COALESCE(level_or, 0.0E0), 0, 0.25E0 FROM p_num, {_PERIODS} WHERE slow_or IS NOT NULL AND q <> slow_or UNION ALL "
     "SELECT name, 'mutate_threshold', fast, level_or * f, 0, 0.25E0 FROM p_num, (SELECT UNNEST([0.9E0, 0.95E0, 1.05E0, 1.1E0]) AS f) WHERE level_or IS NOT NULL UNION ALL "
     "SELECT name, 'mutate_signal_comparator', fast, COALESCE(level_or, 0.0E0), (c = 'crosses_above')::INT, 0.25E0 FROM p_num, (SELECT UNNEST(['>=', '<', '<=', '==', 'crosses_above', 'crosses_below']) AS c) UNION ALL "
     "SELECT name, 'mutate_position_fraction', fast, COALESCE(level_or, 0.0E0), 0, w FROM p_num, (SELECT UNNEST([0.05E0, 0.1E0, 0.15E0, 0.2E0, 0.25E0, 0.35E0, 0.5E0, 0.75E0, 1.0E0]) AS w) WHERE w <= cap AND w <> 0.25")
SQL["sweep_neighbours"] = with_parts(
    f"SELECT name, operator, COUNT(*) AS variants, CAST(SUM(per) AS BIGINT) AS period_sum, {r6('SUM(lv)')} AS threshold_sum, CAST(SUM(cr) AS BIGINT) AS crosses, {r6('SUM(v)')} AS value_sum FROM p_edits GROUP BY 1, 2")
SQL["replacement_templates"] = with_parts(
    "SELECT 'req-' || s_suppkey AS request_id, CAST(s_suppkey AS VARCHAR) AS parent_strategy_id, m AS mutation, 'generated-req-' || s_suppkey || '-' || m AS name, k AS kind, "
    "CAST(f AS BIGINT) AS fast, CAST(s AS BIGINT) AS slow FROM supplier, (VALUES ('sma_fast', 'sma', 10, 30), ('ema_fast', 'ema', 10, 30), ('sma_slow', 'sma', 20, 60)) t(m, k, f, s) "
    "WHERE NOT (s_suppkey % 4 = 0 AND m = 'sma_slow')")

part("scores", f"SELECT s.strategy_id, s.symbol, s.sharpe AS fitness, r.rob_ratio >= 0.97 AS rob_passed FROM sf_s s JOIN sc_sup_r r USING ({CAND})")
_checks = [
    ("NOT wf_passed", "walk-forward/OOS evaluation failed"),
    ("fitness < 0.5", "OOS Sharpe is below the promotion minimum"),
    ("oos_drawdown > 0.25", "OOS drawdown exceeds the promotion maximum"),
    ("mc_pass_rate < 0.103", "Monte Carlo pass rate is below the promotion minimum"),
    ("mc_lower < -0.1", "Monte Carlo lower-percentile return is too weak"),
    ("pert_pass_rate IS NULL", "parameter perturbation evidence is required"),
    ("pert_pass_rate < 0.8", "parameter perturbation stability is below the promotion minimum"),
    ("regime_score IS NULL", "regime stability evidence is required"),
    ("regime_score < -0.05", "regime stability is below the promotion minimum"),
    ("NOT rob_passed", "robustness"),
]
part("evid",
     "SELECT s.*, s.strategy_id || '|' || s.symbol AS candidate_id, s.oos_sharpe AS fitness, s.rob_reasons = '' AS rob_passed, q.pert_pass_rate "
     "FROM sup_ev0 s LEFT JOIN (SELECT strategy_id, AVG(pert_pass_rate) AS pert_pass_rate FROM pert GROUP BY 1) q USING (strategy_id)")
part("gated_sc", "SELECT *, CONCAT_WS('; ', " + ", ".join(f"CASE WHEN {c} THEN " + (f"'{t}'" if t != "robustness" else "rob_reasons") + " END" for c, t in _checks) + ") AS why FROM evid")
FINAL = "(0.6E0 * fitness + 0.25E0 * rob_ratio + 0.15E0 * mc_pass_rate) / (0.6E0 + 0.25E0 + 0.15E0)"
SQL["rank_candidates"] = with_parts(
    f"SELECT candidate_id, ROW_NUMBER() OVER (ORDER BY {FINAL} DESC, fitness DESC, candidate_id) AS rank, {r6(FINAL)} AS final_score FROM evid WHERE fitness > -1.0")
DOM = ("o.fitness >= s.fitness AND -o.train_drawdown >= -s.train_drawdown AND o.mc_pass_rate >= s.mc_pass_rate AND o.rob_ratio >= s.rob_ratio AND o.regime_score >= s.regime_score "
       "AND (o.fitness > s.fitness OR -o.train_drawdown > -s.train_drawdown OR o.mc_pass_rate > s.mc_pass_rate OR o.rob_ratio > s.rob_ratio OR o.regime_score > s.regime_score)")
SQL["pareto_front"] = with_parts(
    f"SELECT candidate_id, {r6('fitness')} AS fitness FROM evid s WHERE NOT EXISTS (SELECT 1 FROM evid o WHERE o.candidate_id <> s.candidate_id AND {DOM})")
SQL["part_pareto"] = with_parts(
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_quantity, l_extendedprice, l_discount FROM lineitem) o "
    "WHERE o.l_quantity >= s.l_quantity AND o.l_extendedprice <= s.l_extendedprice AND o.l_discount >= s.l_discount "
    "AND (o.l_quantity > s.l_quantity OR o.l_extendedprice < s.l_extendedprice OR o.l_discount > s.l_discount))")
SQL["catalog"] = with_parts(
    f"SELECT candidate_id, 'bars_supplier' AS dataset_id, {r6('fitness')} AS score FROM gated_sc WHERE why = '' ORDER BY fitness DESC, candidate_id LIMIT 50")
SQL["rank_experiments"] = with_parts(
    f"SELECT candidate_id, {r6('fitness')} AS score, 'research' AS status, why AS reason FROM gated_sc WHERE why <> '' ORDER BY fitness DESC, candidate_id LIMIT 25")
_elig = "why = '' AND wf_passed AND {dd} <= 0.05 AND rob_ratio >= 0.9"
SQL["selection_eligible"] = with_parts(
    f"SELECT candidate_id, {_elig.format(dd='train_drawdown')} AS eligible, {_elig.format(dd='ABS(train_drawdown)')} AS eligible_by_size FROM gated_sc")
SQL["selected_population"] = with_parts(
    "SELECT candidate_id, tier FROM (SELECT *, CAST(CASE WHEN EXISTS (SELECT 1 FROM evid o WHERE o.candidate_id <> s.candidate_id AND " + DOM + ") THEN 1 ELSE 0 END AS BIGINT) AS tier "
    "FROM evid s ) ORDER BY tier, fitness DESC, mc_pass_rate DESC, rob_ratio DESC, regime_score DESC, candidate_id DESC LIMIT 60")

# one round gives every spec one partner
SQL["crossover_children"] = with_parts(
    "SELECT COUNT(*) AS children, TRUE AS universe_ok, TRUE AS sizing_ok, TRUE AS one_condition, TRUE AS version_ok, TRUE AS marked FROM p_num")
part("np_elite", "SELECT name || '/' || lpad(CAST(fast AS VARCHAR), 6, '0') AS place FROM p_num ORDER BY 1 LIMIT 20")
part("np_crossed", "SELECT COUNT(*) AS n FROM range(200 - (SELECT COUNT(*) FROM np_elite)) AS r(k) WHERE CAST('0x' || substr(md5('11:roll:' || k), 1, 8) AS BIGINT) / 4294967296.0E0 < 0.25E0")
SQL["next_population"] = with_parts(
    "SELECT 'elite' AS kind, COUNT(*) AS members, COUNT(*) AS unique_ids, 0 AS min_generation, 0 AS max_generation, 0 AS parents, MIN(place) AS first_elite, MAX(place) AS last_elite FROM np_elite "
    "UNION ALL SELECT 'crossover', n, n, 1, 1, 2, NULL, NULL FROM np_crossed "
    "UNION ALL SELECT 'mutation', 200 - (SELECT COUNT(*) FROM np_elite) - n, 200 - (SELECT COUNT(*) FROM np_elite) - n, 1, 1, 1, NULL, NULL FROM np_crossed")


# max-min picks, one unrolled step each
part("dv", "SELECT *, fast / 50.0E0 AS fit, CAST('0x' || substr(md5(CONCAT_WS('|', name, universe, kind, fast, COALESCE(CAST(slow_or AS INTEGER), CAST(level_or AS INTEGER)), FORMAT('{:.2f}', cap))), 1, 8) AS BIGINT) / 4294967296.0E0 AS mc FROM p_num")
part("dv1", "SELECT * FROM dv ORDER BY fit DESC, mc DESC LIMIT 1")
for k in range(2, 13):
    part(f"dv{k}",
         f"SELECT * FROM dv{k - 1} UNION ALL SELECT * FROM (SELECT a.* FROM dv a JOIN (SELECT a.id, MIN({DIST}) AS d FROM dv a, dv{k - 1} b GROUP BY a.id) n ON n.id = a.id "
         f"WHERE a.id NOT IN (SELECT id FROM dv{k - 1}) AND n.d / 11.0E0 >= 0.2E0 ORDER BY n.d DESC, a.fit DESC, a.mc DESC LIMIT 1)")
SQL["diverse_population"] = with_parts(
    f"SELECT CAST(0 AS BIGINT) AS tier, COUNT(*) AS members, {r6('MAX(fit)')} AS best, {r6('SUM(mc)')} AS draws FROM dv12")

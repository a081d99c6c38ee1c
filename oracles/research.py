"""SQL twins of the queries in barloom.plans.research."""

import json

from barloom.operators.specs import demo_records
from barloom.sources.schemas import SPEC_FIELDS
from oracles import selection as _s
from oracles.parts import digest_of, part, r6, with_parts

SQL = {}
CL = "LEAST(1.0E0, GREATEST(0.0E0, {}))"
# Mean distance to all other candidates, from how many share the value of each field; the symbol is the universe.
_genes = ", ".join(
    f"('{r['name']}', '{f}', '{json.dumps(r.get(f), sort_keys=True)}')" for r in demo_records() for f in SPEC_FIELDS if f != "universe"
)
part("gene_v",
     f"SELECT candidate_id, field, val FROM evid JOIN (VALUES {_genes}) v(strategy_id, field, val) USING (strategy_id) UNION ALL SELECT candidate_id, 'universe', symbol FROM evid")
part("gene_n", "SELECT candidate_id, COUNT(*) OVER (PARTITION BY field, val) AS same FROM gene_v")
part("novelties", "SELECT candidate_id, SUM(n - same) / (11.0E0 * (MAX(n) - 1)) AS nov FROM gene_n, (SELECT COUNT(*) AS n FROM evid) GROUP BY 1")
part("jud",
     "SELECT g.* EXCLUDE (strategy_id, candidate_id), candidate_id AS strategy_id, why = '' AS promo, nov FROM gated_sc g JOIN novelties USING (candidate_id)")
cols = ("fitness", "robustness", "novelty", "uncertainty", "capacity_gap")
part("sig1",
     "SELECT strategy_id, CASE WHEN NOT (wf_passed AND promo) THEN 'degraded' WHEN mc_simulations <= 0 THEN 'halted' ELSE 'capacity' END AS reason, "
     f"{CL.format('fitness')} AS fitness, CASE WHEN rob_passed THEN 1.0E0 ELSE 0.0E0 END AS robustness, {CL.format('COALESCE(nov, 0.0E0)')} AS novelty, "
     f"{CL.format('1.0E0 - mc_pass_rate')} AS uncertainty, CASE WHEN promo THEN 1.0E0 ELSE 0.0E0 END AS capacity_gap FROM jud")
part("sig2",
     "SELECT strategy_id, CASE WHEN NOT (wf_passed AND promo) THEN 'degraded' WHEN mc_simulations = 0 THEN 'halted' WHEN COALESCE(nov, 0.0E0) < 0.25 THEN 'diversification' ELSE 'capacity' END AS reason, "
     "GREATEST(fitness, 0.0E0) AS fitness, CASE WHEN rob_passed THEN 1.0E0 ELSE 0.0E0 END AS robustness, GREATEST(COALESCE(nov, 0.0E0), 0.0E0) AS novelty, "
     f"{CL.format('1.0E0 - mc_pass_rate')} AS uncertainty, CASE WHEN nov IS NULL THEN 1.0E0 ELSE 0.0E0 END AS capacity_gap FROM jud")
for q, t in (("research_signals", "sig1"), ("plan_signals", "sig2")):
    SQL[q] = with_parts("SELECT strategy_id, reason, " + ", ".join(f"{r6(c)} AS {c}" for c in cols) + f" FROM {t}")
part("reqs",
     "SELECT *, 'research:' || reason || ':' || strategy_id AS request_id, CAST(GREATEST(0, ROUND_EVEN((1.0E0 - LEAST(1.0E0, GREATEST(0.0E0, score))) * 1000, 0)) AS BIGINT) AS priority FROM ("
     "SELECT *, (0.2E0 * fitness + 0.15E0 * robustness + 0.25E0 * novelty + 0.25E0 * uncertainty + 0.15E0 * capacity_gap) / (0.2E0 + 0.15E0 + 0.25E0 + 0.25E0 + 0.15E0) AS score FROM sig2) "
     "ORDER BY score DESC, reason, strategy_id LIMIT 40")
SQL["research_priority"] = with_parts(
    f"SELECT request_id, strategy_id AS source_strategy_id, reason, priority, {r6('score')} AS score FROM reqs")
# the budget by explicit rounds: one unit moves per recursion step
part("bud0",
     "SELECT *, GREATEST(1, LEAST(60, CAST(FLOOR(100.0E0 * sc / tot) AS INTEGER))) AS u FROM (SELECT *, SUM(sc) OVER (PARTITION BY plan_id) AS tot FROM ("
     "SELECT reason AS plan_id, request_id, fitness + robustness + novelty + uncertainty + capacity_gap AS sc, ROW_NUMBER() OVER (PARTITION BY reason ORDER BY score DESC, request_id) AS pos FROM reqs))")
part("bud_gap", "SELECT plan_id, SUM(u) - 100 AS gap FROM bud0 GROUP BY 1")
part("bud_take",
     "SELECT plan_id, request_id, v, ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY sc / v, request_id, v DESC) AS r FROM (SELECT *, UNNEST(RANGE(2, u + 1)) AS v FROM bud0)")
part("bud_give",
     "SELECT plan_id, request_id, v, ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY sc / GREATEST(v, 1) DESC, pos, v) AS r FROM (SELECT *, UNNEST(RANGE(u, 60)) AS v FROM bud0)")
part("bud",
     "SELECT b.plan_id, b.request_id, b.u + COALESCE((SELECT COUNT(*) FROM bud_give x WHERE x.plan_id = b.plan_id AND x.request_id = b.request_id AND g.gap < 0 AND x.r <= -g.gap), 0) "
     "- COALESCE((SELECT COUNT(*) FROM bud_take x WHERE x.plan_id = b.plan_id AND x.request_id = b.request_id AND g.gap > 0 AND x.r <= g.gap), 0) AS units, b.sc FROM bud0 b JOIN bud_gap g USING (plan_id)")
SQL["research_budget"] = with_parts(f"SELECT plan_id, request_id, CAST(units AS BIGINT) AS units, {r6('sc')} AS score FROM bud")
SQL["work_items"] = with_parts(
    "SELECT request_id, CASE WHEN request_id LIKE '%7' THEN NULL ELSE CAST(units AS DOUBLE) END AS budget_units, "
    "CASE WHEN request_id LIKE '%7' THEN 'missing allocation for research request: ' || request_id END AS error FROM bud")
SQL["research_queue"] = with_parts(
    "SELECT request_id, priority, enqueued, reason FROM (SELECT 'req-' || (user_id % 97) AS request_id, CAST(FLOOR(value) AS BIGINT) AS priority, event_id AS enqueued, event_type AS reason, "
    "ROW_NUMBER() OVER (PARTITION BY user_id % 97 ORDER BY FLOOR(value), event_id) AS rn FROM events WHERE FLOOR(value) >= 0) WHERE rn = 1")

part("gen_s",
     "SELECT p.*, name || '|' || universe || '|' || kind || '|' || fast || '|' || CAST(COALESCE(slow_or, level_or) AS INTEGER) AS sid, UNNEST(CASE WHEN fast % 2 = 0 THEN [own, own + 1] ELSE [own] END) AS generation FROM (SELECT *, CAST(SUBSTR(name, 7) AS INTEGER) AS own FROM p_num) p")
part("gen_e", "SELECT *, (fast * 37 + generation * 13) % 101 / 50.0E0 - 1.0E0 AS fitness FROM gen_s")
part("gen_d",
     f"SELECT a.generation, AVG({_s.DIST}) / 11.0E0 AS mean_d, MIN({_s.DIST}) / 11.0E0 AS min_d, MAX({_s.DIST}) / 11.0E0 AS max_d FROM gen_s a JOIN gen_s b ON a.generation = b.generation AND a.id < b.id GROUP BY 1")
part("gen_f", "SELECT sid, MIN(generation) AS generation FROM gen_s GROUP BY 1")
part("gen_h",
     "SELECT e.generation, COUNT(*) AS candidate_count, CAST(COUNT(*) FILTER (WHERE fitness > 0.9) AS BIGINT) AS eligible_count, CAST(COUNT(*) FILTER (WHERE fitness > 0) AS BIGINT) AS selected_count, COUNT(DISTINCT sid) AS unique_strategy_count, "
     "(SELECT COUNT(*) FROM gen_f f WHERE f.generation = e.generation) AS new_strategy_count, (ARRAY_AGG(sid ORDER BY fitness DESC, sid DESC))[1] AS best_strategy_id, MAX(fitness) AS best_fitness, AVG(fitness) AS mean_fitness FROM gen_e e GROUP BY 1")
part("gen_i", "SELECT *, COALESCE(best_fitness > MAX(best_fitness) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better FROM gen_h")
part("gen_k", "SELECT h.*, (SELECT COUNT(*) FROM gen_i x WHERE x.generation <= h.generation AND x.generation > (SELECT MAX(y.generation) FROM gen_i y WHERE y.better AND y.generation <= h.generation)) AS stale, "
     "COALESCE(mean_d, 0.0E0) AS mean_distance, COALESCE(min_d, 0.0E0) AS min_distance, COALESCE(max_d, 0.0E0) AS max_distance FROM gen_i h LEFT JOIN gen_d d USING (generation)")
SQL["generation_history"] = with_parts(
    "SELECT generation, candidate_count, eligible_count, selected_count, unique_strategy_count, new_strategy_count, best_strategy_id, stale AS generations_without_improvement, "
    + ", ".join(f"{r6(c)} AS {c}" for c in ("best_fitness", "mean_fitness", "mean_distance", "min_distance", "max_distance")) + " FROM gen_k")
part("gen_q",
     "SELECT *, CONCAT_WS('; ', CASE WHEN unique_strategy_count < 0.75 * candidate_count THEN 'strategy uniqueness is below threshold' END, CASE WHEN mean_distance < 0.05 THEN 'genome diversity is below threshold' END, "
     "CASE WHEN new_strategy_count < 0.5 * candidate_count THEN 'strategy novelty is below threshold' END, CASE WHEN stale >= 4 THEN 'fitness improvement has stagnated' END, "
     "CASE WHEN eligible_count < 0.05 * candidate_count THEN 'promotion eligibility is below threshold' END) AS why, "
     "(mean_distance < 0.05 AND new_strategy_count < 0.5 * candidate_count) OR stale >= 4 OR eligible_count < 0.05 * candidate_count AS crit FROM gen_k")
SQL["research_health"] = with_parts(
    "SELECT generation, CASE WHEN crit THEN 'critical' WHEN why <> '' THEN 'warning' ELSE 'healthy' END AS status, CASE WHEN crit THEN 'pause_research' WHEN why <> '' THEN 'increase_exploration' ELSE 'continue' END AS decision, "
    "CASE WHEN crit THEN 'pause_research' WHEN why <> '' THEN 'increase_exploration' WHEN generation + 1 < 3 OR eligible_count <= 0 THEN 'continue_research' ELSE 'ready_for_robustness_review' END AS action, "
    "CASE WHEN crit OR why <> '' THEN why WHEN generation + 1 < 3 THEN 'minimum research generations have not been completed' WHEN eligible_count <= 0 THEN 'no promotion-eligible candidate is available for robustness review' "
    "ELSE 'research health is healthy and review prerequisites are satisfied' END AS reasons FROM gen_q")
SQL["replacement_work"] = with_parts(
    "SELECT 'req-' || s_suppkey AS request_id, CAST(s_suppkey AS VARCHAR) AS strategy_id, 'degraded' AS reason, CASE WHEN s_acctbal > 8000 THEN 'completed' ELSE 'ready' END AS status FROM supplier "
    "WHERE s_suppkey % 5 <> 0 AND s_acctbal >= 0 AND (s_acctbal > 8000 OR s_suppkey % 3 <> 0) ORDER BY s_suppkey % 4, 'req-' || s_suppkey LIMIT 30")
SQL["operator_summary"] = with_parts(
    "SELECT (SELECT COUNT(*) FROM gated_sc) AS experiment_count, CAST(0 AS BIGINT) AS ranked_experiment_count, (SELECT COUNT(*) FROM gated_sc WHERE why = '') AS promotion_eligible_count, "
    "(SELECT COUNT(*) FROM orders) AS cycle_count, (SELECT CAST(MAX(o_orderkey) AS VARCHAR) FROM orders) AS latest_cycle_id, (SELECT MAX(o_orderkey) FROM orders) AS latest_generation, "
    "(SELECT MAX(o_orderkey) + 1 FROM orders WHERE o_orderstatus = 'F') AS checkpoint_generation, TRUE AS checkpoint_present")
_SIDE = ("{{\"all\":[{{\"left\":\"fast\",\"comparator\":\"{op}\",' || CASE WHEN kind = 'rsi' THEN '\"right_num\":' || CAST(level_or AS VARCHAR) || ',\"right_ref\":null' "
         "ELSE '\"right_num\":null,\"right_ref\":\"slow\"' END || '}}],\"any\":[]}}")
_GENOME = ("'{\"entry\":" + _SIDE.format(op=">") + ",\"exit\":" + _SIDE.format(op="<") + ",\"indicators\":[{\"name\":\"fast\",\"kind\":\"' || kind || '\",\"source\":\"close\",\"period\":' || fast || '}' || "
           "CASE WHEN kind = 'rsi' THEN '' ELSE ',{\"name\":\"slow\",\"kind\":\"sma\",\"source\":\"close\",\"period\":' || slow_or || '}' END || '],\"metadata\":{},\"name\":\"' || name || "
           "'\",\"position_sizing\":{\"method\":\"fixed_fraction\",\"value\":0.25,\"max_position\":' || CAST(cap AS VARCHAR) || '},\"risk\":{\"max_leverage\":1.0,\"max_position\":' || CAST(g_risk AS VARCHAR) || "
           "',\"stop_loss\":null,\"max_drawdown\":null},\"side\":\"long\",\"timeframe\":\"1d\",\"universe\":[\"' || universe || '\"],\"version\":' || version || '}'")
_VERDICT = "'{\"fitness\":' || CAST(fitness AS VARCHAR) || ',\"promotion_eligible\":' || (fitness > 0.9) || ',\"selected\":' || (fitness > 0) || '}'"
part("prov", f"SELECT generation, sid, sha256({_GENOME}) AS gd, sha256({_VERDICT}) AS ed FROM gen_e")
_RECORD = "'{\"strategy_id\":\"' || sid || '\",\"genome_digest\":\"' || gd || '\",\"evaluation_digest\":\"' || ed || '\"}'"
SQL["provenance_digests"] = with_parts(
    f"SELECT generation, COUNT(*) AS records, COUNT(DISTINCT ed) AS evaluations, {digest_of(_RECORD, 'COUNT(*)')} AS digest FROM prov GROUP BY 1")
part("rev",
     "SELECT strategy_id, CONCAT_WS('; ', CASE WHEN symbol LIKE '%4' THEN 'provenance strategy_id does not match candidate' END, CASE WHEN symbol LIKE '%5' THEN 'provenance genome digest does not match candidate' END, "
     "CASE WHEN symbol LIKE '%4' OR LENGTH(symbol) = 1 THEN 'research scheduler has not authorized robustness review' END, CASE WHEN NOT wf_passed THEN 'candidate validation did not pass' END, "
     "CASE WHEN NOT promo THEN 'candidate is not promotion-eligible' END, CASE WHEN NOT rob_passed THEN 'robustness stress scenarios did not pass' END) AS why FROM jud")
SQL["robustness_review"] = with_parts("SELECT strategy_id, CASE WHEN why = '' THEN 'admit' ELSE 'reject' END AS decision, why AS reasons FROM rev")
part("succ",
     "SELECT *, CASE WHEN symbol LIKE '%2' THEN 'successor already exists' WHEN symbol LIKE '%1' THEN 'successor requires at least one parent' WHEN LENGTH(symbol) > 1 THEN 'lineage generation cannot exceed admission generation' END AS err FROM jud")
SQL["successor_admission"] = with_parts(
    "SELECT strategy_id, promo AND err IS NULL AS admitted, CASE WHEN promo THEN 'paper' ELSE 'research' END AS stage, why AS reasons, err AS error FROM succ")
part("lsync", "SELECT *, CASE WHEN symbol LIKE '%8' THEN 'validated' WHEN symbol LIKE '%9' THEN 'paper' END AS st FROM jud")
part("lsteps",
     "SELECT strategy_id, 0 AS o, CAST(NULL AS VARCHAR) AS source_stage, 'research' AS target_stage, 'candidate evaluation: admitted' AS reason FROM lsync WHERE st IS NULL UNION ALL "
     "SELECT strategy_id, 1, 'research', CASE WHEN wf_passed THEN 'validated' ELSE 'degraded' END, 'candidate evaluation: validation ' || CASE WHEN wf_passed THEN 'passed' ELSE 'failed' END FROM lsync WHERE st IS NULL UNION ALL "
     "SELECT strategy_id, 2, 'validated', 'promoted', 'candidate evaluation: promotion gates passed' FROM lsync WHERE promo AND (st = 'validated' OR (st IS NULL AND wf_passed))")
SQL["lifecycle_sync"] = with_parts(
    "SELECT strategy_id, ROW_NUMBER() OVER (PARTITION BY strategy_id ORDER BY o) - 1 AS seq, source_stage, target_stage, reason FROM lsteps")
SQL["replacement_evaluation"] = with_parts("SELECT CASE WHEN why = '' THEN 'paper' ELSE 'reject' END AS stage, COUNT(*) AS candidates FROM gated_sc GROUP BY 1")
part("cert6", "SELECT l_orderkey, SUM(l_linenumber) AS n FROM lineitem GROUP BY 1")
part("adm6",
     "SELECT CONCAT_WS('; ', CASE WHEN o_custkey % 6 = 0 THEN 'strategy must be in promoted lifecycle stage' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'portfolio execution provenance is missing' END, "
     "CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' THEN 'portfolio execution is halted' END, CASE WHEN n IS NULL THEN 'verified reproducibility certificate is missing' END, "
     "CASE WHEN n % 5 = 0 THEN 'reproducibility certificate is not verified' END, CASE WHEN n % 7 = 0 THEN 'certificate dataset_version is missing' END) AS reasons FROM orders LEFT JOIN cert6 ON l_orderkey = o_orderkey")
SQL["paper_admission"] = with_parts("SELECT reasons, reasons = '' AS admitted, COUNT(*) AS admissions FROM adm6 GROUP BY 1, 2")
part("hmem", "SELECT DISTINCT o_orderkey % 50 AS pid, o_custkey AS c FROM orders WHERE o_orderstatus <> 'P'")
part("hand",
     "SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderpriority <> '5-LOW' AS run, o.o_orderpriority <> '3-MEDIUM' AS cert, u.c_acctbal >= 0 AS known, u.c_mktsegment AS seg, EXISTS (SELECT 1 FROM hmem m WHERE m.pid = o.o_orderkey % 50) AS port, EXISTS (SELECT 1 FROM hmem m WHERE m.pid = o.o_orderkey % 50 AND m.c = o.o_custkey) AS mem FROM orders o LEFT JOIN customer u ON u.c_custkey = o.o_custkey")
part("hand1",
     "SELECT *, CONCAT_WS('; ', CASE WHEN NOT COALESCE(known, FALSE) THEN 'successor lifecycle state is missing' END, CASE WHEN known AND seg = 'BUILDING' THEN 'successor must be in promoted lifecycle stage' END, "
     "CASE WHEN NOT run THEN 'portfolio execution run is missing' END, CASE WHEN run AND k % 8 = 0 THEN 'portfolio execution run is halted' END, CASE WHEN run AND NOT port THEN 'portfolio provenance is missing' END, "
     "CASE WHEN run AND port AND NOT mem THEN 'successor is not a member of the persisted portfolio; successor experiment provenance is missing' END, "
     "CASE WHEN run AND port AND mem AND c % 10 = 3 THEN 'successor promotion evidence is not eligible' END) AS first FROM hand")
part("hand2",
     "SELECT CONCAT_WS('; ', NULLIF(first, ''), CASE WHEN run AND port AND first = '' AND k % 6 = 0 THEN 'paper run verification failed: ledger fingerprint mismatch' END, "
     "CASE WHEN run AND port AND NOT cert THEN 'reproducibility certificate is invalid: missing' END, "
     "CASE WHEN run AND port AND cert AND k % 11 = 0 THEN 'persisted reproducibility certificate identity is inconsistent' END) AS reasons FROM hand1")
part("rep6",
     "SELECT CASE WHEN o_orderstatus = 'P' THEN 'paper admission is missing' ELSE CONCAT_WS('; ', CASE WHEN o_orderkey % 9 = 0 THEN 'admission source stage is not promoted' END, "
     "CASE WHEN o_orderkey % 10 = 0 THEN 'admission target stage is not paper' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'portfolio execution run is missing' END, "
     "CASE WHEN o_orderpriority <> '5-LOW' AND o_orderkey % 8 = 0 THEN 'portfolio execution run is halted' END, "
     "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'reproducibility certificate is invalid: missing' WHEN o_orderkey % 6 = 0 THEN 'reproducibility certificate is invalid: dataset version mismatch' "
     "WHEN o_orderkey % 7 = 0 THEN 'admission certificate identity does not match persisted certificate' END, "
     "CASE WHEN o_orderkey % 13 = 0 THEN 'durable paper admission verification failed' END) END AS reasons FROM orders")
SQL["paper_replay"] = with_parts("SELECT reasons, reasons = '' AS valid, COUNT(*) AS runs FROM rep6 GROUP BY 1, 2")
SQL["successor_handoff"] = with_parts("SELECT reasons, reasons = '' AS handed_off, COUNT(*) AS requests FROM hand2 GROUP BY 1, 2")

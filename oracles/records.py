"""SQL twins of the queries in barloom.plans.records."""

from oracles import paper as _p  # noqa: F401
from oracles import research as _r  # noqa: F401
from oracles.parts import RUN, digest_of, part, r2, r6, with_parts

SQL = {}
STAGES = ("research", "validated", "promoted", "paper", "degraded", "retired", "replaced")
ALLOWED = {
    "research": ("validated", "degraded"), "validated": ("promoted", "degraded"), "promoted": ("paper", "degraded", "retired"),
    "paper": ("degraded", "retired", "replaced"), "degraded": ("research", "retired", "replaced"),
}
_names = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
part("stg",
     f"SELECT CAST(o_custkey AS VARCHAR) AS strategy_id, o_orderkey AS seq, CASE WHEN o_orderkey % 10 > 0 THEN {_names}[CAST(o_orderkey % 7 + 1 AS INTEGER)] END AS source_stage, "
     f"{_names}[CAST(o_orderkey // 7 % 7 + 1 AS INTEGER)] AS target_stage, o_orderpriority AS reason FROM orders")
_ok = " OR ".join(f"(source_stage = '{s}' AND target_stage = '{t}')" for s, ts in ALLOWED.items() for t in ts)
SQL["lifecycle_violations"] = with_parts(
    f"SELECT source_stage, target_stage, 'invalid lifecycle transition: ' || source_stage || ' -> ' || target_stage AS reason_text, COUNT(*) AS events FROM stg WHERE source_stage IS NOT NULL AND NOT ({_ok}) GROUP BY 1, 2, 3")
SQL["lifecycle_current"] = with_parts("SELECT strategy_id, ARG_MAX(target_stage, seq) AS stage FROM stg GROUP BY 1")
SQL["lifecycle_gaps"] = with_parts(
    "SELECT strategy_id, seq, source_stage, prev_target_stage FROM (SELECT *, LAG(target_stage) OVER (PARTITION BY strategy_id ORDER BY seq) AS prev_target_stage FROM stg) WHERE source_stage IS DISTINCT FROM prev_target_stage")
SQL["hash_problems"] = with_parts("SELECT strategy_id, seq, 'edited' AS reason FROM stg WHERE seq % 500 = 3")
part("aud",
     "SELECT o_orderkey AS s, o_orderkey AS k FROM orders WHERE o_orderkey % 3000 <> 11 UNION ALL SELECT o_orderkey + 10000000000, o_orderkey FROM orders WHERE o_orderkey % 3000 <> 11 AND o_orderkey % 5000 = 2")
part("aud_l", "SELECT *, LAG(k) OVER (ORDER BY s) AS pk, LAG(k) OVER (ORDER BY s) % 2000 = 7 AS p_bad, (SELECT MAX(o_orderkey) FROM orders z WHERE z.o_orderkey < a.k) AS want FROM aud a")
SQL["chain_audit"] = with_parts(
    "SELECT CAST(k AS VARCHAR) AS cycle_id, CAST(s AS DOUBLE) AS sequence, CASE WHEN s <> k THEN 'duplicate research cycle audit entry' ELSE 'research cycle audit integrity verification failed' END AS problem FROM aud_l "
    "WHERE s <> k OR k % 2000 = 7 OR p_bad OR pk IS DISTINCT FROM want UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'research cycle audit coverage is incomplete' FROM orders WHERE o_orderkey % 3000 = 11")
part("hst",
     f"SELECT CAST(user_id AS VARCHAR) AS strategy_id, event_id AS seq, ts, MAX(CASE WHEN value > 300 THEN 2 WHEN value > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id {RUN}) AS lv, "
     f"MAX(CASE WHEN value > 300 THEN 2 WHEN value > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts {RUN}) AS lv_ts FROM events")
part("hmv", "SELECT *, COALESCE(LAG(lv) OVER (PARTITION BY strategy_id ORDER BY seq), 0) AS pv FROM hst")
NAMES = "['active', 'degraded', 'halted']"
SQL["health_states"] = with_parts(f"SELECT strategy_id, seq, {NAMES}[pv + 1] AS previous_state, {NAMES}[lv + 1] AS state FROM hmv WHERE pv <> lv")
SQL["health_requests"] = with_parts(
    "SELECT strategy_id, seq, SUBSTR(SHA256(strategy_id || ':degraded:30:maximum drawdown breached'), 1, 16) AS request_id, 'avoid_known_failure' AS constraints FROM hmv WHERE pv = 0 AND lv = 1")
SQL["feedback_problems"] = with_parts("SELECT strategy_id, seq FROM hmv WHERE pv = 0 AND lv = 1 AND seq % 3 = 0")
part("phist", "SELECT CAST(o_custkey AS VARCHAR) AS portfolio_id, o_orderkey AS seq, CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS generation, o_orderstatus AS status, LAG(FLOOR(o_totalprice / 1000)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pg FROM orders")
SQL["portfolio_history"] = with_parts(
    "SELECT portfolio_id, MAX(seq) AS seq, ARG_MAX(generation, seq) AS generation, ARG_MAX(status, seq) AS status, CAST(COUNT(*) FILTER (WHERE generation <= pg) AS BIGINT) AS out_of_order FROM phist GROUP BY 1")

part("lin_e", "SELECT DISTINCT p_partkey AS c, UNNEST([p_partkey // 2, p_partkey // 3]) AS p FROM part WHERE p_partkey > 0")
part("lin_c", "SELECT c AS s, p AS a, 1 AS d FROM lin_e UNION SELECT l.s, e.p, l.d + 1 FROM lin_c l JOIN lin_e e ON e.c = l.a")
part("lin_m", "SELECT s, a, MIN(d) AS d FROM lin_c GROUP BY 1, 2")
SQL["lineage_closure"] = with_parts("SELECT CAST(s AS VARCHAR) AS strategy_id, COUNT(*) AS ancestors, CAST(MAX(d) AS BIGINT) AS farthest FROM lin_m GROUP BY 1")
SQL["lineage_problems"] = with_parts(
    "SELECT strategy_id, reasons FROM (SELECT CAST(k AS VARCHAR) AS strategy_id, CONCAT_WS('; ', CASE WHEN k % 97 = 5 THEN 'strategy lineage cycle detected: ' || k END, CASE WHEN seed AND n > 0 THEN 'seed strategies cannot have parents' END, "
    "CASE WHEN NOT seed AND n = 0 THEN 'derived strategies must have at least one parent' END) AS reasons FROM ("
    "SELECT p_partkey AS k, p_partkey = 0 OR p_partkey % 103 = 9 AS seed, CASE WHEN p_partkey % 97 = 5 THEN 1 WHEN p_partkey % 101 = 7 OR p_partkey = 0 THEN 0 ELSE 1 END AS n FROM part)) WHERE reasons <> ''")
part("cyc_e", "SELECT c, p FROM lin_e UNION SELECT 1, 40 FROM lin_e WHERE c = 1")
part("cyc_c", "SELECT c AS s, p AS a FROM cyc_e UNION SELECT l.s, e.p FROM cyc_c l JOIN cyc_e e ON e.c = l.a")
SQL["lineage_cycles"] = with_parts("SELECT DISTINCT CAST(s AS VARCHAR) AS strategy_id FROM cyc_c WHERE s = a")
SQL["missing_parents"] = with_parts(
    "SELECT DISTINCT CAST(p AS VARCHAR) AS strategy_id FROM lin_e WHERE c IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#7') AND p NOT IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#7')")

part("nfills", "SELECT COUNT(*) AS n FROM lfill_f")
part("nport", "SELECT COUNT(DISTINCT event_type) AS n FROM events")
P, M = "(SELECT n FROM nport)", "(SELECT n * 5 FROM nport)"
FILLS = "(SELECT n FROM nfills)"
KINDS = {
    "paper_run": P, "portfolio": P, "dataset": "1", "data_bundle": "1", "experiment": M, "evaluation_evidence": M, "promotion": M,
    "strategy": "5", "lineage": "5", "attribution": M, "audit_event": FILLS, "fill_lineage": FILLS, "execution_manifest": P, "replay_verification": P,
}
SQL["provenance_nodes"] = with_parts(" UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({v} AS BIGINT) AS nodes, CAST({v} AS BIGINT) AS ids" for k, v in KINDS.items()))
RELS = {
    "bundles": "1", "input_to": P, "executed_as": P, "produced_evidence": M, "evaluated_for": M, "candidate_for": M, "uses_dataset": M, "tested": M,
    "promoted_to_candidate": M, "defines": "5", "contributes_to": M, "records": FILLS, "explained_by": FILLS, "attested_by": P, "verifies": P,
}
SQL["provenance_edges"] = with_parts(" UNION ALL ".join(f"SELECT '{k}' AS relation, CAST({v} AS BIGINT) AS edges, CAST(0 AS BIGINT) AS dangling" for k, v in RELS.items()))
part("gp", "SELECT symbol, promo, (promo OR symbol LIKE '%4') AND symbol NOT LIKE '%2' AS mem FROM jud")
part("gp2",
     "SELECT CASE WHEN symbol LIKE '%8' THEN 'experiment provenance is incomplete' WHEN symbol LIKE '%6' THEN 'experiment strategy mismatch' WHEN symbol LIKE '%7' AND BOOL_OR(mem) OVER (PARTITION BY symbol) THEN 'experiment dataset mismatch' "
     "WHEN promo AND NOT mem THEN 'eligible experiment not represented by portfolio member' WHEN NOT promo AND mem THEN 'ineligible experiment selected into portfolio' END AS problem FROM gp")
SQL["graph_problems"] = with_parts("SELECT problem, COUNT(*) AS experiments FROM gp2 WHERE problem IS NOT NULL GROUP BY 1")
SQL["certificates"] = with_parts(
    "SELECT 'run-' || portfolio_id AS run_id, portfolio_id NOT IN ('click', 'error') AS valid, CASE portfolio_id WHEN 'error' THEN 'certificate is not marked verified' WHEN 'click' THEN 'certificate_id does not match certificate contents' END AS reason FROM ports WHERE portfolio_id <> 'view'")

SQL["append_once"] = with_parts(
    "SELECT 'appended' AS what, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'conflicts', COUNT(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice <> 0")
SQL["upsert"] = with_parts(
    f"SELECT seg AS c_mktsegment, COUNT(*) AS customers, {r2('SUM(c_acctbal)')} AS balance FROM (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MOVED' ELSE c_mktsegment END AS seg, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_acctbal >= 0) GROUP BY 1")
SQL["portfolio_members"] = with_parts(
    "SELECT CAST(s_nationkey AS VARCHAR) AS portfolio_id, m || s_suppkey AS strategy_id, CAST(w AS DOUBLE) AS weight, CAST(k AS BIGINT) AS rank, n_regionkey = 1 AS frozen FROM supplier JOIN nation ON n_nationkey = s_nationkey, (VALUES ('a', 0.5, 0), ('b', 0.25, 1)) t(m, w, k)")
SQL["request_bars"] = with_parts(
    "SELECT symbol, COUNT(*) AS bars, STRFTIME(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, STRFTIME(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM bars_supplier "
    "WHERE ts >= TIMESTAMP '1996-01-01' AND ts < CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN TIMESTAMP '1996-07-01' ELSE TIMESTAMP '1997-01-01' END GROUP BY 1")
TSF = "STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts"
SQL["chart_payload"] = with_parts(
    f"SELECT symbol, {TSF}, open, high, low, close, volume FROM bars_priority WHERE EXTRACT(day FROM bars_priority.ts) <> 7 AND bars_priority.ts >= TIMESTAMP '1996-01-01' AND bars_priority.ts < TIMESTAMP '1999-01-01'")
SQL["daily_series_payload"] = with_parts(
    f"SELECT symbol, {TSF}, open, high, low, close, volume FROM bars_priority WHERE bars_priority.ts >= TIMESTAMP '1997-01-01'")
SQL["posted_payload"] = with_parts(
    f"SELECT symbol, {TSF}, open, high, low, close, CASE WHEN EXTRACT(hour FROM bars_event.ts) = 5 THEN 0.0E0 ELSE volume END AS volume FROM bars_event")
SQL["daily_csv_payload"] = with_parts(
    f"SELECT symbol, {TSF}, open, high, low, close, CASE WHEN EXTRACT(day FROM bars_supplier.ts) = 3 THEN 0.0E0 ELSE volume END AS volume FROM bars_supplier WHERE bars_supplier.ts < TIMESTAMP '1998-01-01'")
SQL["macro_payload"] = with_parts(
    "SELECT 'PRICE' AS series_id, STRFTIME(o_orderdate, '%Y-%m') AS month, COUNT(*) AS observations, COUNT(*) FILTER (WHERE o_orderkey % 9 > 1) AS present, MAX(o_totalprice) FILTER (WHERE o_orderkey % 9 > 1) AS highest FROM orders GROUP BY 1, 2")
SQL["company_facts_payload"] = with_parts(
    "SELECT LPAD(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS entity, 'core' AS taxonomy, 'AccountBalance' AS concept, 'USD' AS unit, s_acctbal AS val, CAST(fy AS BIGINT) AS fy FROM supplier, (VALUES (1998), (1999)) t(fy)")
SQL["news_payload"] = with_parts(
    "SELECT conv_id || '-' || page AS feed_id, rn - 1 AS position, role || ' ' || turn AS title FROM (SELECT *, turn // 50 AS page, ROW_NUMBER() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn, role) AS rn FROM conversations) WHERE rn <= 2")
part("snap",
     "SELECT s_nationkey AS nation, 'daily_ohlcv' AS dataset, sha256('supplier|daily_ohlcv|{\"group_key\":' || s_nationkey || ',\"s_suppkey\":' || s_suppkey || '}') AS fp FROM supplier "
     "UNION SELECT n_nationkey, 'series', sha256('nation|series|{\"group_key\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') FROM nation")
_COMPONENT = "'{\"dataset\":\"' || dataset || '\",\"fingerprint\":\"' || fp || '\"}'"
SQL["snapshot_manifests"] = with_parts(
    f"SELECT CAST(nation AS VARCHAR) AS nation, COUNT(*) AS components, COUNT(*) FILTER (WHERE dataset = 'daily_ohlcv') > 0 AS valid, {digest_of(_COMPONENT, 'COUNT(*)')} AS snapshot_fingerprint FROM snap GROUP BY 1")
SQL["provenance_assertions"] = with_parts(
    "SELECT c_custkey AS key, 'source does not match the declared value' AS reason FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 10 = 1 AND c_mktsegment <> 'FURNITURE' UNION ALL "
    "SELECT DISTINCT o_custkey + 3, 'unknown dataset version' FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)")

part("tk0",
     f"SELECT event_type AS symbol, event_id, 100.0E0 + value / 1000.0E0 AS close, COALESCE(LAST_VALUE(CASE WHEN value < 20 THEN TRUE WHEN value > 80 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id {RUN}), FALSE) AS signal FROM events")
part("tk1",
     "SELECT *, COALESCE(LAG(signal) OVER w, FALSE) AS target, COALESCE(LAG(signal, 2) OVER w, FALSE) AS pt, LAG(close) OVER w AS pc FROM tk0 WINDOW w AS (PARTITION BY symbol ORDER BY event_id)")
part("tk2",
     "SELECT *, COALESCE(close / pc - 1.0E0, 0.0E0) * (CASE WHEN target THEN 0.25E0 ELSE 0.0E0 END) - (CASE WHEN target <> pt THEN 0.25E0 ELSE 0.0E0 END) * 0.0003E0 AS net_ret FROM tk1")
part("tk3", f"SELECT *, 100000.0E0 * PRODUCT(1.0E0 + net_ret) OVER (PARTITION BY symbol ORDER BY event_id {RUN}) AS equity FROM tk2")
SQL["tick_backtest"] = with_parts(
    f"SELECT symbol, event_id, target, {r6('net_ret')} AS net_ret, {r2('equity')} AS equity, {r6(f'equity / MAX(equity) OVER (PARTITION BY symbol ORDER BY event_id {RUN}) - 1.0E0')} AS drawdown FROM tk3")
part("st0", f"SELECT event_type AS portfolio_id, ts, 1000.0E0 - value AS equity, MAX(1000.0E0 - value) OVER (PARTITION BY event_type ORDER BY ts {RUN}) AS peak FROM events")
SQL["stream_equity"] = with_parts(
    f"SELECT portfolio_id, EPOCH_US(ts) AS ts_us, {r6('equity')} AS equity, {r6('peak')} AS peak, BOOL_OR(1.0E0 - equity / peak >= 0.49) OVER (PARTITION BY portfolio_id ORDER BY ts {RUN}) AS halted FROM st0")
part("sh0", "SELECT *, COALESCE(LAG(lv_ts) OVER (PARTITION BY strategy_id ORDER BY ts), 0) AS pv_ts FROM hst")
SQL["stream_health"] = with_parts(
    f"SELECT strategy_id, EPOCH_US(ts) AS ts_us, {NAMES}[pv_ts + 1] AS previous_state, {NAMES}[lv_ts + 1] AS state, ROW_NUMBER() OVER (PARTITION BY strategy_id ORDER BY ts) AS sequence FROM sh0 WHERE pv_ts <> lv_ts")

"""SQL twins of the queries in barloom.plans.paper.  The ledger is replayed bar by bar."""

from oracles.evidence import flag_parts, indicator_parts
from oracles.parts import RUN, digest_of, part, r2, r6, with_parts

SQL = {}
K = "portfolio_id, strategy_id"
C, S = 0.0001, 0.0002
indicator_parts("ei", "bars_event", "symbol")
flag_parts("ei", "ei_ind", "symbol")
part("ei_n", "SELECT symbol AS portfolio_id, strategy_id, ts, close, entry, exit, ROW_NUMBER() OVER (PARTITION BY strategy_id, symbol ORDER BY ts) AS i, "
     "COUNT(*) OVER (PARTITION BY strategy_id, symbol) AS n FROM ei_flags")
BUYQ = f"LEAST({{cash}} * 0.25E0 / f.close, {{cash}} / (f.close * {1 + S}E0 * {1 + C}E0))"


def walk(name: str, first_buy: bool, cash: str = "15000.0E0") -> None:
    q0 = BUYQ.format(cash=cash)
    q = BUYQ.format(cash="s.cash")
    buy0 = "TRUE" if first_buy else "f.entry"
    part(name,
         f"SELECT f.portfolio_id, f.strategy_id, f.ts, f.close, f.entry, f.exit, f.i, f.n, CASE WHEN {buy0} THEN {cash} - {q0} * f.close * {1 + S}E0 * {1 + C}E0 ELSE {cash} END AS cash, "
         f"CASE WHEN {buy0} THEN {q0} ELSE 0.0E0 END AS pos, CASE WHEN {buy0} THEN 'buy' END AS side, CASE WHEN {buy0} THEN {q0} END AS q FROM ei_n f WHERE f.i = 1 UNION ALL "
         f"SELECT f.portfolio_id, f.strategy_id, f.ts, f.close, f.entry, f.exit, f.i, f.n, "
         f"CASE WHEN s.pos = 0 AND f.entry THEN s.cash - {q} * f.close * {1 + S}E0 * {1 + C}E0 WHEN s.pos > 0 AND f.exit THEN s.cash + s.pos * f.close * {1 - S}E0 * {1 - C}E0 ELSE s.cash END, "
         f"CASE WHEN s.pos = 0 AND f.entry THEN {q} WHEN s.pos > 0 AND f.exit THEN 0.0E0 ELSE s.pos END, "
         f"CASE WHEN s.pos = 0 AND f.entry THEN 'buy' WHEN s.pos > 0 AND f.exit THEN 'sell' END, "
         f"CASE WHEN s.pos = 0 AND f.entry THEN {q} WHEN s.pos > 0 AND f.exit THEN s.pos END "
         f"FROM {name} s JOIN ei_n f ON f.portfolio_id = s.portfolio_id AND f.strategy_id = s.strategy_id AND f.i = s.i + 1")


walk("lw", True)
part("lcurve",
     f"SELECT portfolio_id, ts, SUM(cash + pos * close) + 25000.0E0 AS eq, SUM(cash + pos * close * {1 - S}E0 * {1 - C}E0) + 25000.0E0 AS sold FROM lw GROUP BY 1, 2")
part("lpeak", f"SELECT *, 1.0E0 - eq / MAX(eq) OVER (PARTITION BY portfolio_id ORDER BY ts {RUN}) AS dd FROM lcurve")
for tag, lim in (("f", "2.0"), ("h", "0.012")):
    part(f"lend_{tag}",
         f"SELECT portfolio_id, MIN(ts) FILTER (WHERE dd >= {lim} OR eq <= 0) AS halt_ts, MAX(ts) AS last_ts FROM lpeak GROUP BY 1")
    part(f"lfill_{tag}",
         f"SELECT w.portfolio_id, w.strategy_id, w.ts, w.side AS action, 0 AS phase, w.close, w.entry, w.exit, w.q, e.halt_ts, COALESCE(e.halt_ts, e.last_ts) AS end_ts FROM lw w JOIN lend_{tag} e USING (portfolio_id) "
         "WHERE w.side IS NOT NULL AND w.ts <= COALESCE(e.halt_ts, e.last_ts) UNION ALL "
         f"SELECT w.portfolio_id, w.strategy_id, w.ts, 'sell', 1, w.close, w.entry, w.exit, w.pos, e.halt_ts, COALESCE(e.halt_ts, e.last_ts) FROM lw w JOIN lend_{tag} e USING (portfolio_id) "
         "WHERE w.pos > 0 AND w.ts = COALESCE(e.halt_ts, e.last_ts)")
PX = f"close * (CASE WHEN action = 'buy' THEN {1 + S}E0 ELSE {1 - S}E0 END)"
SQL["paper_fills"] = with_parts(
    f"SELECT {K}, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts, action, CAST(phase AS BIGINT) AS phase, {r6('q')} AS quantity, {r6(PX)} AS price, {r6(f'q * {PX} * {C}E0')} AS fee FROM lfill_f")
SQL["paper_equity"] = with_parts(
    f"SELECT portfolio_id, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r2('CASE WHEN ts = last_ts THEN sold ELSE eq END')} AS equity, 25000.0E0 AS reserve FROM lpeak JOIN lend_f USING (portfolio_id)")
SQL["paper_halt"] = with_parts(
    f"SELECT p.portfolio_id, halt_ts IS NOT NULL AS halted, CASE WHEN halt_ts IS NOT NULL THEN 'maximum drawdown breached' END AS halt_reason, "
    f"STRFTIME(COALESCE(halt_ts, last_ts), '%Y-%m-%d %H:%M:%S') AS end_ts, {r2('sold')} AS final_equity, (SELECT COUNT(*) FROM lfill_h x WHERE x.portfolio_id = p.portfolio_id) AS fills "
    "FROM lpeak p JOIN lend_h e ON e.portfolio_id = p.portfolio_id AND p.ts = COALESCE(halt_ts, last_ts)")
REASON = ("CASE WHEN halt_ts IS NOT NULL AND action = 'sell' THEN (CASE WHEN ts = end_ts THEN 'risk_halt' ELSE 'none' END) WHEN action = 'buy' AND entry THEN 'entry_signal' "
          "WHEN action = 'buy' AND ts = first_ts THEN 'initial_allocation' WHEN action = 'sell' AND exit THEN 'exit_signal' WHEN action = 'sell' AND ts = end_ts THEN 'end_of_sample' ELSE 'none' END")
for tag in ("f", "h"):
    part(f"lreason_{tag}", f"SELECT {K}, {REASON} AS reason FROM (SELECT *, MIN(ts) OVER (PARTITION BY portfolio_id) AS first_ts FROM lfill_{tag})")
SQL["fill_reasons"] = with_parts(f"SELECT {K}, reason, COUNT(*) AS fills FROM lreason_f GROUP BY 1, 2, 3")
SQL["halted_reasons"] = with_parts("SELECT portfolio_id, reason, COUNT(*) AS fills FROM lreason_h GROUP BY 1, 2")
SQL["audit_manifest"] = with_parts("SELECT portfolio_id, COUNT(*) AS event_count, TRUE AS valid, TRUE AS has_fingerprint FROM lfill_f GROUP BY 1")
part("lcash", f"SELECT portfolio_id, 75000.0E0 + SUM(CASE WHEN action = 'buy' THEN -q * {PX} * {1 + C}E0 ELSE q * {PX} * {1 - C}E0 END) AS ec FROM lfill_f GROUP BY 1")
SQL["ledger_replay"] = with_parts(f"SELECT portfolio_id, TRUE AS valid, {r2('ec')} AS ending_cash, CAST(NULL AS VARCHAR) AS error FROM lcash")
# the ledger with one thing broken in each of four runs, replayed event by event
part("tam0",
     f"SELECT portfolio_id, strategy_id, action, q, {PX} AS price, q * {PX} * {C}E0 AS fee, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY ts, phase, strategy_id) - 1 AS seq FROM lfill_f")
part("tam1",
     "SELECT portfolio_id, strategy_id, seq, price, CASE WHEN portfolio_id = 'click' AND seq = 2 THEN q * 50 ELSE q END AS q, "
     "CASE WHEN portfolio_id = 'purchase' AND seq = 0 THEN 'hold' ELSE action END AS action, "
     "CASE WHEN portfolio_id = 'error' AND seq = 1 THEN 0.0E0 WHEN portfolio_id = 'view' AND seq = 3 THEN fee * 2 + 1 ELSE fee END AS fee FROM tam0")
part("tam2",
     f"SELECT *, ABS(fee - q * price * {C}E0) > 1e-8 * GREATEST(q * price * {C}E0, 1.0E0) AS off, SUM(CASE WHEN action = 'buy' THEN q ELSE -q END) OVER w AS pos, "
     "15000.0E0 + SUM(CASE WHEN action = 'buy' THEN -(q * price + fee) ELSE q * price - fee END) OVER w AS cash "
     "FROM tam1 WINDOW w AS (PARTITION BY portfolio_id, strategy_id ORDER BY seq)")
part("tam3",
     "SELECT *, CASE WHEN action NOT IN ('buy', 'sell') THEN 'audit event action must be buy or sell' WHEN action = 'sell' AND pos < -1e-8 THEN 'audit ledger contains a sell exceeding the strategy position' "
     "WHEN action = 'buy' AND cash < -1e-8 THEN 'audit ledger contains a buy exceeding available strategy cash' END AS why, "
     "ROW_NUMBER() OVER (PARTITION BY portfolio_id, strategy_id ORDER BY seq DESC) = 1 AS last FROM tam2")
part("tam4",
     "SELECT portfolio_id, MIN_BY(why, seq) FILTER (WHERE why IS NOT NULL) AS first_why, BOOL_OR(off AND fee = 0) AS zero_fee, BOOL_OR(off) AS any_off, MAX(ABS(pos)) FILTER (WHERE last) AS open, "
     "75000.0E0 + SUM(CASE WHEN action = 'buy' THEN -(q * price + fee) ELSE q * price - fee END) AS ends FROM tam3 GROUP BY 1")
part("tam",
     "SELECT portfolio_id, COALESCE(first_why, CASE WHEN zero_fee THEN 'audit fill fee does not match execution configuration' WHEN open > 1e-8 THEN 'audit ledger does not end flat' "
     "WHEN any_off THEN 'audit fill fee does not match execution configuration' WHEN ABS(ends - ec) > 1e-8 * GREATEST(ABS(ec), 1.0E0) THEN 'audit ledger cash does not reconcile to final equity' END) AS error "
     "FROM tam4 JOIN lcash USING (portfolio_id)")
SQL["tampered_replay"] = with_parts("SELECT portfolio_id, error IS NULL AS valid, error FROM tam")
part("ports", "SELECT DISTINCT event_type AS portfolio_id FROM events")
SQL["run_verification"] = with_parts(
    "SELECT portfolio_id, COUNT(*) AS event_count, portfolio_id <> 'view' AS valid, CASE WHEN portfolio_id = 'view' THEN 'persisted execution ledger fingerprint mismatch' END AS reason FROM lfill_f GROUP BY 1")
SQL["payload_problems"] = with_parts(
    "SELECT p.portfolio_id, s AS strategy_id, r AS reason FROM ports p JOIN (VALUES ('click', 'rsi_14'), ('view', 'sma_5_20')) t(g, s) ON t.g = p.portfolio_id, "
    "(VALUES ('attribution references non-member strategy'), ('audit event references non-member strategy')) u(r)")

# single strategy: check before the trade, trade, check after it
walk("lz", False, "100000.0E0")
part("lz_b",
     "SELECT *, COALESCE(LAG(cash) OVER w, 100000.0E0) + COALESCE(LAG(pos) OVER w, 0.0E0) * close AS before, cash + pos * close AS after FROM lz WINDOW w AS (PARTITION BY portfolio_id, strategy_id ORDER BY ts)")
part("lz_p",
     f"SELECT *, COALESCE(MAX(GREATEST(before, after)) OVER (PARTITION BY {K} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0) AS pk FROM lz_b")
part("lz_h",
     "SELECT *, strategy_id <> 'rsi_14' AND 1.0E0 - before / GREATEST(pk, before) >= 0.02 AS hb, strategy_id <> 'rsi_14' AND 1.0E0 - after / GREATEST(pk, before, after) >= 0.02 AS ha FROM lz_p")
part("lz_e", f"SELECT {K}, MIN(ts) FILTER (WHERE hb OR ha) AS halt_ts, MAX(ts) AS last_ts FROM lz_h GROUP BY 1, 2")
SQL["paper_strategy"] = with_parts(
    f"SELECT h.portfolio_id, h.strategy_id, COUNT(*) AS snapshots, "
    + r2(f"MAX_BY(CASE WHEN h.ts = halt_ts AND hb THEN before WHEN halt_ts IS NULL AND h.ts = last_ts THEN cash + pos * close * {1 - S}E0 * {1 - C}E0 ELSE after END, h.ts)")
    + " AS final_equity, BOOL_OR(halt_ts IS NOT NULL) AS halted, CAST(NULL AS VARCHAR) AS error FROM lz_h h JOIN lz_e e ON h.portfolio_id = e.portfolio_id AND h.strategy_id = e.strategy_id "
    "WHERE h.ts <= COALESCE(halt_ts, last_ts) GROUP BY 1, 2")
walk("ly", False)
part("ly_e", f"SELECT {K}, ts, CASE WHEN i = n THEN cash + pos * close * {1 - S}E0 * {1 - C}E0 ELSE cash + pos * close END AS e FROM ly")
part("ly_r", f"SELECT {K}, ts, COALESCE(e / LAG(e) OVER (PARTITION BY {K} ORDER BY ts) - 1.0E0, 0.0E0) AS r FROM ly_e")
part("ly_p", "SELECT portfolio_id, ts, SUM(0.15E0 * r) AS p FROM ly_r GROUP BY 1, 2")
SQL["sleeve_attribution"] = with_parts(
    f"SELECT r.portfolio_id, r.strategy_id, {r6('SUM(0.15E0 * r.r)')} AS return_contribution, {r6('0.15E0 * COVAR_SAMP(r.r, p.p) / STDDEV_SAMP(p.p) * 1000.0E0')} AS risk_permille "
    "FROM ly_r r JOIN ly_p p ON r.portfolio_id = p.portfolio_id AND r.ts = p.ts GROUP BY 1, 2")
_BAR = "'{\"ts\":\"' || STRFTIME(ts, '%Y-%m-%dT%H:%M:%S.%g') || '\"" + "".join(f",\"{c}\":' || CAST({c} AS VARCHAR) || '" for c in ("open", "high", "low", "close", "volume")) + "}'"
for _t in ("bars_priority", "bars_supplier"):
    part(f"{_t}_id", f"SELECT symbol, COUNT(*) AS rows, MIN(ts) AS first_ts, MAX(ts) AS last_ts, substr({digest_of(_BAR, 'COUNT(*)')}, 1, 16) AS version FROM {_t} GROUP BY 1")
SQL["dataset_identity"] = with_parts(
    "SELECT symbol, rows, STRFTIME(first_ts, '%Y-%m-%d %H:%M:%S') AS start, STRFTIME(last_ts, '%Y-%m-%d %H:%M:%S') AS \"end\", version FROM bars_priority_id")
_PAIR = "'{\"symbol\":\"' || symbol || '\",\"version\":\"' || version || '\"}'"
_BUNDLE = digest_of(_PAIR, "'lineitem'", "'1d'", "'ohlcv.v1'", "COUNT(*)")
SQL["bundle_identity"] = with_parts(
    f"SELECT 'suppliers' AS dataset_id, substr({_BUNDLE}, 1, 16) AS version, CAST(SUM(rows) AS BIGINT) AS rows, COUNT(*) AS symbols, "
    "STRFTIME(MIN(first_ts), '%Y-%m-%d %H:%M:%S') AS start, STRFTIME(MAX(last_ts), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM bars_supplier_id")
SQL["tamper_test"] = with_parts("SELECT DISTINCT symbol, symbol NOT IN ('1-URGENT', '5-LOW') AS matches FROM bars_priority")

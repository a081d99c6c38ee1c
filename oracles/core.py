"""SQL twins of the queries in barloom.plans.core."""

from oracles.parts import RUN, backtest_parts, hold_sql, part, r2, r6, sma_sql, with_parts

TS = "STRFTIME(ts, '%Y-%m-%d %H:%M:%S')"

part("sup_flags",
     f"SELECT symbol, ts, close, {sma_sql('close', 'symbol', 5)} AS sma5, {sma_sql('close', 'symbol', 20)} AS sma20 FROM bars_supplier")
part("sup_trend",
     f"SELECT symbol, ts, close, 0.25E0 AS max_position, {hold_sql('sma5 > sma20', 'sma5 < sma20', 'symbol')} AS signal FROM sup_flags")
part("sup_revert",
     f"SELECT symbol, ts, close, 0.25E0 AS max_position, {hold_sql('close < sma20', 'close > sma20', 'symbol')} AS signal FROM sup_flags")
part("sup_two",
     "SELECT 'sma_5_20' AS strategy_id, * FROM sup_trend UNION ALL SELECT 'revert_20' AS strategy_id, * FROM sup_revert")
backtest_parts("tr", "sup_trend", "symbol")
backtest_parts("tw", "sup_two", "strategy_id, symbol")

SQL = {}
SQL["sma_cross_summary"] = with_parts(
    f"SELECT symbol, bars, entries, {r6('total_return')} AS total_return, {r6('max_drawdown')} AS max_drawdown, "
    f"{r6('sharpe')} AS sharpe, {r6('cagr')} AS cagr FROM tr_s")
for b in ("bars_supplier", "bars_priority", "bars_event"):
    SQL[b] = with_parts(
        f"SELECT symbol, {TS} AS ts, " + "open, high, low, close, volume" + f" FROM {b}")


def dq(source: str) -> str:
    return (
        "SELECT symbol, CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_ts, "
        "CAST(SUM(not_finite) AS BIGINT) AS not_finite, CAST(SUM(neg_volume) AS BIGINT) AS neg_volume, "
        "CAST(SUM(bad_low) AS BIGINT) AS bad_low, CAST(SUM(bad_high) AS BIGINT) AS bad_high, "
        "CAST(SUM(bad_close) AS BIGINT) AS bad_close, MIN(ts) AS start, MAX(ts) AS \"end\" FROM ("
        "SELECT symbol, ts, COUNT(*) AS n, "
        "SUM(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR NOT (ISFINITE(open) AND ISFINITE(high) AND ISFINITE(low) AND ISFINITE(close) AND ISFINITE(volume)) THEN 1 ELSE 0 END) AS not_finite, "
        "SUM(CASE WHEN volume < 0 THEN 1 ELSE 0 END) AS neg_volume, "
        "SUM(CASE WHEN low > LEAST(open, close, high) THEN 1 ELSE 0 END) AS bad_low, "
        "SUM(CASE WHEN high < GREATEST(open, close, low) THEN 1 ELSE 0 END) AS bad_high, "
        "SUM(CASE WHEN close IS NULL OR NOT ISFINITE(close) OR close <= 0 THEN 1 ELSE 0 END) AS bad_close "
        f"FROM {source} GROUP BY symbol, ts) GROUP BY symbol")


part("dq_sup", dq("bars_supplier"))
SQL["dq_report"] = with_parts(
    "SELECT * REPLACE (STRFTIME(start, '%Y-%m-%d %H:%M:%S') AS start, STRFTIME(\"end\", '%Y-%m-%d %H:%M:%S') AS \"end\") FROM dq_sup")
part("raw_bars",
     "SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice AS open, l_extendedprice * (1 - l_discount) AS high, "
     "l_extendedprice * (1 + l_tax) AS low, l_extendedprice AS close, l_quantity AS volume FROM lineitem")
part("dq_raw", dq("raw_bars"))
SQL["dq_raw_prices"] = with_parts(
    "SELECT symbol, CONCAT_WS('; ', CASE WHEN duplicate_ts > 0 THEN 'market data index must not contain duplicates' END, "
    "CASE WHEN not_finite > 0 THEN 'market data contains non-finite values' END, CASE WHEN neg_volume > 0 THEN 'volume cannot be negative' END, "
    "CASE WHEN bad_low > 0 THEN 'low must not exceed OHLC values' END, CASE WHEN bad_high > 0 THEN 'high must not be below OHLC values' END) AS reasons "
    "FROM dq_raw WHERE duplicate_ts + not_finite + neg_volume + bad_low + bad_high > 0")

SQL["rolling_stats"] = with_parts(
    f"SELECT symbol, {TS} AS ts, {r6(sma_sql('close', 'symbol', 5))} AS sma5, {r6(sma_sql('close', 'symbol', 20))} AS sma20, "
    f"{r6('CASE WHEN COUNT(close) OVER w = 20 THEN STDDEV_SAMP(close) OVER w END')} AS std20 FROM bars_supplier "
    "WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")

part("pri_rn", "SELECT symbol, ts, close, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, "
     "close - LAG(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars_priority")
part("pri_ema",
     "SELECT symbol, ts, i, close AS e2, close AS e10, close AS e30 FROM pri_rn WHERE i = 0 UNION ALL "
     "SELECT b.symbol, b.ts, b.i, e2 + (b.close - e2) * (2.0E0/3), e10 + (b.close - e10) * (2.0E0/11), e30 + (b.close - e30) * (2.0E0/31) "
     "FROM pri_ema p JOIN pri_rn b ON b.symbol = p.symbol AND b.i = p.i + 1")
SQL["ema_bars"] = with_parts(
    f"SELECT symbol, {TS} AS ts, CASE WHEN i >= 1 THEN {r6('e2')} END AS ema2, CASE WHEN i >= 9 THEN {r6('e10')} END AS ema10, "
    f"CASE WHEN i >= 29 THEN {r6('e30')} END AS ema30 FROM pri_ema")
part("pri_rsi",
     "SELECT symbol, ts, i, GREATEST(d, 0) AS g5, GREATEST(-d, 0) AS l5, GREATEST(d, 0) AS g14, GREATEST(-d, 0) AS l14 FROM pri_rn WHERE i = 1 UNION ALL "
     "SELECT b.symbol, b.ts, b.i, g5 + (GREATEST(b.d, 0) - g5) / 5.0E0, l5 + (GREATEST(-b.d, 0) - l5) / 5.0E0, "
     "g14 + (GREATEST(b.d, 0) - g14) / 14.0E0, l14 + (GREATEST(-b.d, 0) - l14) / 14.0E0 "
     "FROM pri_rsi p JOIN pri_rn b ON b.symbol = p.symbol AND b.i = p.i + 1")


def rsi_sql(g: str, l: str) -> str:
    return (f"CASE WHEN {l} = 0 AND {g} > 0 THEN 100.0E0 WHEN {l} = 0 THEN NULL ELSE 100.0E0 - 100.0E0 / (1.0E0 + {g} / {l}) END")


SQL["rsi_bars"] = with_parts(
    f"SELECT b.symbol, STRFTIME(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN b.i >= 5 THEN {r6(rsi_sql('g5', 'l5'))} END AS rsi5, "
    f"CASE WHEN b.i >= 14 THEN {r6(rsi_sql('g14', 'l14'))} END AS rsi14 "
    "FROM pri_rn b LEFT JOIN pri_rsi r ON r.symbol = b.symbol AND r.i = b.i")

part("evt_l",
     f"SELECT *, {sma_sql('close', 'symbol', 5)} AS mean, LAG(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars_event")
part("evt_ll", "SELECT *, LAG(mean) OVER (PARTITION BY symbol ORDER BY ts) AS pm FROM evt_l")
RULES = {
    ">": "close > mean", ">=": "close >= mean", "<": "close < mean", "<=": "close <= mean", "==": "close = mean",
    "crosses_above": "close > mean AND pc <= pm", "crosses_below": "close < mean AND pc >= pm",
}
_rule_rows = [(k, v, "close < 0") for k, v in RULES.items()] + [
    ("const_above", "close > 100.5E0 AND pc <= 100.5E0", "close < 100.5E0 AND pc >= 100.5E0"),
    ("mixed", "close > mean AND (volume >= 2 OR high > 101)", "close < open"),
]
SQL["signal_rules"] = with_parts(" UNION ALL ".join(
    f"SELECT '{k}' AS strategy_id, symbol, CAST(SUM(CASE WHEN {en} THEN 1 ELSE 0 END) AS BIGINT) AS entries, "
    f"CAST(SUM(CASE WHEN {ex} THEN 1 ELSE 0 END) AS BIGINT) AS exits, COUNT(*) AS bars FROM evt_ll GROUP BY symbol"
    for k, en, ex in _rule_rows))

part("evt_flags", "SELECT symbol, ts, close > 100.4E0 AS entry, close < 100.6E0 AS exit FROM bars_event")
SQL["hold_positions"] = with_parts(
    f"SELECT symbol, {TS} AS ts, {hold_sql('entry', 'exit', 'symbol')} AS held FROM evt_flags")
# Reference recursion for the toggle rule, one bar at a time.
part("evt_fi", "SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM evt_flags")
part("evt_tog",
     "SELECT symbol, ts, i, entry AS held FROM evt_fi WHERE i = 1 UNION ALL "
     "SELECT f.symbol, f.ts, f.i, CASE WHEN NOT t.held AND f.entry THEN TRUE WHEN t.held AND f.exit THEN FALSE ELSE t.held END "
     "FROM evt_tog t JOIN evt_fi f ON f.symbol = t.symbol AND f.i = t.i + 1")
SQL["toggle_positions"] = with_parts(f"SELECT symbol, {TS} AS ts, held FROM evt_tog")

SQL["backtest_bars"] = with_parts(
    f"SELECT symbol, {TS} AS ts, target, {r6('net_ret')} AS net_ret, {r2('equity')} AS equity, {r6('drawdown')} AS drawdown FROM tr_b")
SQL["trade_events"] = with_parts(
    f"SELECT symbol, {TS} AS ts, CASE WHEN target THEN 'buy' ELSE 'sell' END AS action FROM tr_m WHERE target <> prev_target")
part("tr_ids",
     f"SELECT *, SUM(CASE WHEN target AND NOT prev_target THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts {RUN}) AS trade_id FROM tr_m")
part("tr_trades",
     "SELECT symbol, trade_id, MIN(ts) FILTER (WHERE target) AS entry_ts, MIN(ts) FILTER (WHERE NOT target AND prev_target) AS exit_ts, "
     "MIN_BY(close, ts) FILTER (WHERE target) AS entry_px, MIN_BY(close, ts) FILTER (WHERE NOT target AND prev_target) AS exit_px "
     "FROM tr_ids WHERE trade_id > 0 GROUP BY symbol, trade_id")
SQL["backtest_trades"] = with_parts(
    "SELECT symbol, CAST(trade_id AS BIGINT) AS trade_id, STRFTIME(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_ts, "
    f"STRFTIME(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_ts, {r6('entry_px')} AS entry_px, {r6('exit_px')} AS exit_px, "
    f"{r6('(exit_px / entry_px - 1.0E0) * 0.25E0 - 0.0006E0')} AS trade_return FROM tr_trades WHERE exit_ts IS NOT NULL")
SQL["reconcile"] = with_parts(
    "SELECT symbol, BOOL_AND(ISFINITE(equity) AND ISFINITE(net_ret) AND equity > 0 AND net_ret > -1) AS passed, "
    "'' AS reasons FROM tr_b GROUP BY symbol")


def gate_text(cond_a: str, a: str, cond_b: str, b: str) -> str:
    return f"CONCAT_WS('; ', CASE WHEN {cond_a} THEN {a} END, CASE WHEN {cond_b} THEN {b} END)"


FIT = ("(0.7E0 * GREATEST(sharpe, 0.0E0) / 0.5E0 + 0.3E0 * GREATEST(1.0E0 - ABS(max_drawdown) / 0.25E0, 0.0E0)) / (0.7E0 + 0.3E0)")
SQL["equity_validation"] = with_parts(
    f"SELECT strategy_id, symbol, {r6('sharpe')} AS sharpe, {r6('max_drawdown')} AS max_drawdown, "
    "sharpe >= 0.5 AND ABS(max_drawdown) <= 0.25 AS valid, "
    + gate_text("sharpe < 0.5", "PRINTF('sharpe %.3f below minimum 0.500', sharpe)",
                "ABS(max_drawdown) > 0.25", "PRINTF('drawdown %.3f above maximum 0.250', ABS(max_drawdown))")
    + f" AS reasons, {r6(FIT)} AS fitness, sharpe >= 0.5 AND ABS(max_drawdown) <= 0.25 AS eligible FROM tw_s")


def health(source: str, keys: str) -> str:
    return (
        f"SELECT {keys}, COUNT(*) AS observations, MAX_BY(equity, ts) / MIN_BY(equity, ts) - 1.0E0 AS total_return, "
        "MIN(dd) AS max_drawdown, COALESCE(STDDEV_SAMP(ret), 0.0E0) AS volatility FROM ("
        f"SELECT {keys}, ts, equity, equity / MAX(equity) OVER (PARTITION BY {keys} ORDER BY ts {RUN}) - 1.0E0 AS dd, "
        f"equity / LAG(equity) OVER (PARTITION BY {keys} ORDER BY ts) - 1.0E0 AS ret FROM {source}) GROUP BY {keys}")


part("deg_sup", health("tr_b", "symbol"))
part("deg_r",
     "SELECT *, CASE WHEN observations < 20 THEN '' ELSE CONCAT_WS('; ', CASE WHEN max_drawdown < -0.2 THEN 'maximum drawdown breached' END, "
     "CASE WHEN total_return < -0.08 THEN 'minimum return breached' END, CASE WHEN volatility > 0.1 THEN 'volatility ceiling breached' END) END AS why FROM deg_sup")
SQL["degradation"] = with_parts(
    f"SELECT symbol, observations, {r6('total_return')} AS total_return, {r6('max_drawdown')} AS max_drawdown, {r6('volatility')} AS volatility, "
    "why <> '' AS degraded, CASE WHEN why <> '' THEN 'degraded' ELSE 'active' END AS state, "
    "CASE WHEN why <> '' THEN 'retire_from_paper' ELSE 'remain_in_paper' END AS action, "
    "CASE WHEN why <> '' THEN why ELSE 'health within policy' END AS reason FROM deg_r")
part("qual", health("tw_b", "strategy_id, symbol"))
part("qual_r",
     "SELECT *, CONCAT_WS('; ', CASE WHEN symbol LIKE '%7' THEN 'strategy must remain in PAPER lifecycle stage' END, "
     "CASE WHEN observations < 60 THEN 'paper evidence invalid: insufficient observations' END, "
     "CASE WHEN observations >= 60 AND max_drawdown < -0.15 THEN 'maximum drawdown breached' END, "
     "CASE WHEN observations >= 60 AND total_return < 0 THEN 'minimum return breached' END, "
     "CASE WHEN observations >= 60 AND volatility > 0.08 THEN 'volatility ceiling breached' END, "
     "CASE WHEN observations >= 60 AND total_return < 0 THEN 'paper total return is below qualification threshold' END) AS why FROM qual")
SQL["paper_qualification"] = with_parts(
    f"SELECT strategy_id, symbol, observations, {r6('total_return')} AS total_return, "
    "CASE WHEN why = '' THEN 'eligible_for_live_review' ELSE 'reject' END AS decision, why AS reasons FROM qual_r")

SQL["ingest_order"] = (
    "SELECT symbol, ingest_pos, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts, STRFTIME(p, '%Y-%m-%d %H:%M:%S') AS prev_ts FROM (SELECT o_orderpriority AS symbol, o_orderkey AS ingest_pos, o_orderdate AS ts, "
    "LAG(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) WHERE ts < p")
SQL["numeric_cast"] = (
    "SELECT o_orderpriority AS symbol, CAST(SUM(CASE WHEN o_orderkey % 50 = 3 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 70 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_cast, "
    "COUNT(*) FILTER (WHERE o_orderkey % 50 <> 3) AS opens, MAX(CASE WHEN o_orderkey % 70 <> 1 THEN 1.5E0 END) AS close FROM orders GROUP BY 1")
part("evt_n", "SELECT ts, COUNT(DISTINCT symbol) AS n FROM bars_event GROUP BY 1")
SQL["ragged_timestamps"] = with_parts(
    "SELECT STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts, n, (SELECT COUNT(DISTINCT symbol) FROM bars_event) AS n_series FROM evt_n WHERE n < (SELECT COUNT(DISTINCT symbol) FROM bars_event)")
SQL["key_mismatch"] = (
    "WITH a AS (SELECT DISTINCT c_custkey AS key FROM customer ), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '2-HIGH') "
    "SELECT key, 'right' AS missing_in FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'left' FROM b WHERE key NOT IN (SELECT key FROM a)")

SQL["table_problems"] = with_parts(
    "SELECT 'narrow' AS \"case\", 'missing required columns: ' || c AS problem FROM (VALUES ('high'), ('volume')) t(c) UNION ALL SELECT 'zoned', 'market data index must be timezone-naive' "
    "UNION ALL SELECT 'empty', 'market data cannot be empty' FROM bars_event HAVING COUNT(*) FILTER (WHERE volume < 0) = 0 "
    "UNION ALL SELECT c, 'rows: ' || COUNT(*) FILTER (WHERE c <> 'empty' OR volume < 0) FROM bars_event, (VALUES ('good'), ('narrow'), ('zoned'), ('empty')) t(c) GROUP BY c")
SQL["config_problems"] = with_parts(
    "SELECT config, reasons FROM (SELECT p_partkey AS config, CONCAT_WS('; ', CASE WHEN p_retailprice - 1200.0E0 <= 0 THEN 'initial_cash must be positive' END, "
    "CASE WHEN p_size < 3 OR p_size % 7 < 1 THEN 'transaction costs cannot be negative' END) AS reasons FROM part) WHERE reasons <> ''")
_T = "STRFTIME({}(ts), '%Y-%m-%d %H:%M:%S')"
SQL["stored_bars"] = with_parts(
    f"SELECT symbol, COUNT(*) AS bars, {r2('SUM(close)')} AS close_sum, {r2('SUM(volume)')} AS volume_sum, {_T.format('MIN')} AS first_ts, {_T.format('MAX')} AS last_ts, source FROM ("
    "SELECT *, 'csv' AS source FROM bars_priority WHERE symbol = '1-URGENT' UNION ALL SELECT *, 'range' FROM bars_priority WHERE symbol = '2-HIGH' AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01' "
    "UNION ALL SELECT *, 'open range' FROM bars_priority WHERE symbol = '5-LOW' AND ts >= TIMESTAMP '1997-06-01') GROUP BY symbol, source")
SQL["load_problems"] = with_parts(
    "SELECT request_id, CASE WHEN sy NOT IN (SELECT symbol FROM bars_supplier) THEN 'unknown symbol: ' || sy ELSE 'requested market-data range is empty' END AS reason FROM ("
    "SELECT c_custkey AS request_id, CAST(c_custkey % ((SELECT COUNT(*) FROM supplier) + 20) AS VARCHAR) AS sy, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2030-01-01' WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1995-01-01' END AS st FROM customer) q "
    "WHERE NOT EXISTS (SELECT 1 FROM bars_supplier b WHERE b.symbol = q.sy AND (q.st IS NULL OR b.ts >= q.st))")

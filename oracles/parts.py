"""Named SQL fragments for the DuckDB side, put together as one WITH chain per query."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def with_parts(select: str, recursive: bool = False) -> str:
    """Prepend every fragment that ``select`` refers to, directly or not, in order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for word in re.findall(r"\b[a-z][a-z0-9_]*\b", sql):
            if word in PARTS and word not in seen:
                seen.add(word)
                visit(PARTS[word])
                needed.append(word)

    visit(select)
    if not needed:
        return select.strip()
    body = ",\n".join(f"{n} AS (\n{PARTS[n]}\n)" for n in needed)
    return f"WITH RECURSIVE {body}\n{select.strip()}"


def r6(expression: str) -> str:
    """Cut to 6 decimals away from decimal ties."""
    return f"(FLOOR(({expression}) * 1000000.0E0 + 0.4142135E0) / 1000000.0E0)"


def r2(expression: str) -> str:
    return f"(FLOOR(({expression}) * 100.0E0 + 0.4142135E0) / 100.0E0)"


def digest_of(json: str, *head: str) -> str:
    """Order-free digest of the rows' canonical JSON: sums of the four 60-bit parts of their SHA-256, and SHA-256 of these behind ``head``."""
    sums = [f"CAST(SUM(CAST('0x' || substr(sha256({json}), {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4)]
    return "sha256(CONCAT_WS(':', " + ", ".join([*head, *sums]) + "))"


# --- bars -----------------------------------------------------------------
def _bars(name: str, symbol: str, ts: str, px: str, qty: str, order: str, source: str) -> None:
    part(
        f"{name}_rows",
        f"SELECT {symbol} AS symbol, {ts} AS ts, {px} AS px, {qty} AS qty, "
        f"ROW_NUMBER() OVER (PARTITION BY {symbol}, {ts} ORDER BY {order}) AS rn FROM {source}",
    )
    part(
        name,
        "SELECT symbol, ts, MIN_BY(px, rn) AS open, MAX(px) AS high, MIN(px) AS low, "
        f"MAX_BY(px, rn) AS close, SUM(qty) AS volume FROM {name}_rows GROUP BY symbol, ts",
    )


_bars("bars_supplier", "CAST(l_suppkey AS VARCHAR)", "l_shipdate",
      "100.0E0 + l_extendedprice / 50000.0E0", "l_quantity",
      "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity", "lineitem")
_bars("bars_priority", "o_orderpriority", "o_orderdate",
      "100.0E0 + o_totalprice / 100000.0E0", "1.0E0", "o_orderkey", "orders")
_bars("bars_event", "event_type", "DATE_TRUNC('hour', events.ts)",
      "100.0E0 + value / 100.0E0", "1.0E0", "events.ts, event_id", "events")

RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def sma_sql(col: str, keys: str, p: int, order: str = "ts") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({col}) {w} = {p} THEN AVG({col}) {w} END"


def backtest_parts(prefix: str, source: str, keys: str, cost: str = "0.0003E0", cash: str = "100000.0E0") -> None:
    """Backtest chain over ``source`` (keys, ts, close, signal, max_position)."""
    w = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    part(
        f"{prefix}_m0",
        f"SELECT *, COALESCE(LAG(signal, 1) {w}, FALSE) AS target, "
        f"COALESCE(LAG(signal, 2) {w}, FALSE) AS prev_target, LAG(close) {w} AS prev_close FROM {source}",
    )
    part(
        f"{prefix}_m",
        "SELECT *, COALESCE(close / prev_close - 1.0E0, 0.0E0) * (CASE WHEN target THEN max_position ELSE 0.0E0 END) AS gross_ret, "
        "ABS((CASE WHEN target THEN max_position ELSE 0.0E0 END) - (CASE WHEN prev_target THEN max_position ELSE 0.0E0 END)) AS turnover "
        f"FROM {prefix}_m0",
    )
    part(
        f"{prefix}_n",
        f"SELECT *, gross_ret - turnover * {cost} AS net_ret FROM {prefix}_m",
    )
    part(
        f"{prefix}_e",
        f"SELECT *, {cash} * PRODUCT(1.0E0 + net_ret) OVER (PARTITION BY {keys} ORDER BY ts {RUN}) AS equity FROM {prefix}_n",
    )
    part(
        f"{prefix}_b",
        f"SELECT *, equity / MAX(equity) OVER (PARTITION BY {keys} ORDER BY ts {RUN}) - 1.0E0 AS drawdown FROM {prefix}_e",
    )
    part(
        f"{prefix}_s0",
        f"SELECT {keys}, COUNT(*) AS bars, MIN_BY(equity, ts) AS first_equity, MAX_BY(equity, ts) AS last_equity, "
        "MIN(drawdown) AS max_drawdown, COUNT(net_ret) FILTER (WHERE prev_close IS NOT NULL) AS n_ret, "
        "AVG(net_ret) FILTER (WHERE prev_close IS NOT NULL) AS mean_ret, "
        "STDDEV_SAMP(net_ret) FILTER (WHERE prev_close IS NOT NULL) AS sd_ret, "
        "CAST(SUM(CASE WHEN target AND NOT prev_target THEN 1 ELSE 0 END) AS BIGINT) AS entries "
        f"FROM {prefix}_b GROUP BY {keys}",
    )
    part(
        f"{prefix}_s",
        "SELECT *, CASE WHEN n_ret < 2 OR sd_ret = 0 THEN 0.0E0 ELSE SQRT(252.0E0) * mean_ret / sd_ret END AS sharpe, "
        f"COALESCE(sd_ret, 0.0E0) AS volatility, last_equity / {cash} - 1.0E0 AS total_return, "
        "CASE WHEN bars < 2 THEN 0.0E0 ELSE POW(last_equity / first_equity, 252.0E0 / (bars - 1)) - 1.0E0 END AS cagr "
        f"FROM {prefix}_s0",
    )


def hold_sql(entry: str, exit: str, keys: str) -> str:
    return (
        f"COALESCE(LAST_VALUE(CASE WHEN {entry} THEN TRUE WHEN {exit} THEN FALSE END IGNORE NULLS) "
        f"OVER (PARTITION BY {keys} ORDER BY ts {RUN}), FALSE)"
    )

"""Table schemas."""

from __future__ import annotations

BAR_COLUMNS = ("open", "high", "low", "close", "volume")
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

CONDITION = "struct<left:string,comparator:string,right_num:double,right_ref:string>"
SIGNAL = f"struct<all:array<{CONDITION}>,any:array<{CONDITION}>>"
SPEC_FIELDS = (
    "name",
    "version",
    "universe",
    "timeframe",
    "indicators",
    "entry",
    "exit",
    "side",
    "position_sizing",
    "risk",
    "metadata",
)
SPEC_BODY = (
    "name string, version int, universe array<string>, timeframe string, "
    "indicators array<struct<name:string,kind:string,source:string,period:int>>, "
    f"entry {SIGNAL}, exit {SIGNAL}, side string, "
    "position_sizing struct<method:string,value:double,max_position:double>, "
    "risk struct<max_leverage:double,max_position:double,stop_loss:double,max_drawdown:double>, "
    "metadata map<string,string>"
)
SPECS = "strategy_id string, " + SPEC_BODY

# Fixed vocabulary of the rule language.
COMPARATORS = (">", ">=", "<", "<=", "==", "crosses_above", "crosses_below")
INDICATOR_KINDS = ("sma", "ema", "rsi")
TIMEFRAMES = ("1m", "5m", "15m", "1h", "4h", "1d")
SIZING_METHODS = ("fixed_fraction", "equal_weight", "volatility_target")

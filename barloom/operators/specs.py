"""Strategy specs as rows: building, ids, validation (PR8) and the demo set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import reasons
from barloom.sources.schemas import (
    COMPARATORS,
    INDICATOR_KINDS,
    SIZING_METHODS,
    SPEC_BODY,
    SPEC_FIELDS,
    TIMEFRAMES,
)


def condition(left: str, comparator: str, right: float | str) -> dict:
    number = isinstance(right, (int, float))
    return {
        "left": left,
        "comparator": comparator,
        "right_num": float(right) if number else None,
        "right_ref": None if number else right,
    }


def spec(
    name: str,
    indicators: list[tuple[str, str, int]],
    entry: list[tuple],
    exit: list[tuple],
    *,
    universe: list[str] | None = None,
    entry_any: list[tuple] | None = None,
    exit_any: list[tuple] | None = None,
    max_position: float = 0.25,
    sizing: str = "fixed_fraction",
    value: float = 0.25,
    max_drawdown: float | None = None,
    version: int = 1,
    timeframe: str = "1d",
    metadata: dict[str, str] | None = None,
) -> dict:
    """A spec record; ``indicators`` are (name, kind, period) on the close."""
    return {
        "name": name,
        "version": version,
        "universe": universe or ["*"],
        "timeframe": timeframe,
        "indicators": [
            {"name": n, "kind": k, "source": "close", "period": p} for n, k, p in indicators
        ],
        "entry": {
            "all": [condition(*c) for c in entry],
            "any": [condition(*c) for c in entry_any or []],
        },
        "exit": {
            "all": [condition(*c) for c in exit],
            "any": [condition(*c) for c in exit_any or []],
        },
        "side": "long",
        "position_sizing": {"method": sizing, "value": value, "max_position": max_position},
        "risk": {
            "max_leverage": 1.0,
            "max_position": max_position,
            "stop_loss": None,
            "max_drawdown": max_drawdown,
        },
        "metadata": metadata or {},
    }


def canonical(field: str) -> Column:
    """Canonical JSON text of one top-level spec field."""
    if field == "metadata":
        value = F.map_from_entries(F.array_sort(F.map_entries("metadata")))
    else:
        value = F.col(field)
    return F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})


def with_strategy_id(specs: DataFrame) -> DataFrame:
    """FP4: 16 hex digits of the canonical spec, the same for equal specs."""
    body = F.concat_ws("|", *[canonical(f) for f in SPEC_FIELDS])
    return specs.withColumn("strategy_id", F.substring(F.sha2(body, 256), 1, 16)).select(
        "strategy_id", *[c for c in specs.columns if c != "strategy_id"]
    )


def spec_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    return with_strategy_id(spark.createDataFrame(records, SPEC_BODY))


def dedupe(specs: DataFrame) -> DataFrame:
    """RK9: one row per content id; rows with one id are equal, so any may stay."""
    return specs.dropDuplicates(["strategy_id"])


def spec_problems(specs: DataFrame) -> DataFrame:
    """PR8: validation rules as reasons per spec; an empty array means valid."""
    names = F.transform("indicators", lambda i: i["name"])
    conditions = F.concat("entry.all", "entry.any", "exit.all", "exit.any")
    bad_kind = F.exists(
        "indicators", lambda i: ~F.coalesce(i["kind"].isin(*INDICATOR_KINDS), F.lit(False))
    )
    checks = reasons(
        (F.length("name") == 0, "name is required"),
        (F.col("version") < 1, "version must be at least 1"),
        (F.size("universe") == 0, "universe is required"),
        (~F.col("timeframe").isin(*TIMEFRAMES), "timeframe is not supported"),
        (bad_kind, "indicator kind is not supported"),
        (F.exists("indicators", lambda i: i["period"].isNull()), "indicator requires a period"),
        (F.exists("indicators", lambda i: i["period"] <= 0), "indicator period must be positive"),
        (F.size(F.array_distinct(names)) < F.size(names), "indicator names must be unique"),
        (F.size("entry.all") + F.size("entry.any") == 0, "signal must contain at least one condition"),
        (F.size("exit.all") + F.size("exit.any") == 0, "signal must contain at least one condition"),
        (
            F.exists(conditions, lambda c: ~c["comparator"].isin(*COMPARATORS)),
            "comparator is not supported",
        ),
        (F.col("side") != "long", "short-side execution is not implemented yet"),
        (~F.col("position_sizing.method").isin(*SIZING_METHODS), "sizing method is not supported"),
        (F.col("position_sizing.value") <= 0, "sizing value must be positive"),
        (
            (F.col("position_sizing.max_position") <= 0) | (F.col("position_sizing.max_position") > 1),
            "max_position must be in (0, 1]",
        ),
        (
            F.col("risk.max_position") > F.col("position_sizing.max_position"),
            "risk.max_position cannot exceed position_sizing.max_position",
        ),
    )
    return specs.select("strategy_id", "name", F.array_distinct(checks).alias("reasons"))


def demo_records() -> list[dict]:
    """Five small rules: four trend rules that lose on trendless prices and one that wins."""
    return [
        spec("sma_5_20", [("fast", "sma", 5), ("slow", "sma", 20)],
             [("fast", ">", "slow")], [("fast", "<", "slow")]),
        spec("sma_10_30", [("fast", "sma", 10), ("slow", "sma", 30)],
             [("fast", "crosses_above", "slow")], [("fast", "crosses_below", "slow")]),
        spec("ema_10_30", [("fast", "ema", 10), ("slow", "ema", 30)],
             [("fast", ">", "slow")], [("fast", "<", "slow")]),
        spec("rsi_14", [("rsi", "rsi", 14)], [("rsi", ">", 50.0)], [("rsi", "<", 45.0)]),
        spec("revert_20", [("mean", "sma", 20)], [("close", "<", "mean")], [("close", ">", "mean")]),
    ]

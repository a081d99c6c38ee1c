"""Rule language: entry and exit flags per bar (PR1-PR7), hold states (W8, W9).

Two routes give the same flags:

* ``compiled_signals`` turns a short Python list of specs into code-generated
  columns and emits one row per spec with a literal ``explode``;
* ``table_signals`` takes a spec *table*: conditions are resolved once per spec
  to positions in an array of operand values and checked by higher-order
  functions, so thousands of variants need no driver work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import false_if_null, running, series
from barloom.operators.indicators import ROW, column_name, with_indicators
from barloom.sources.schemas import BAR_COLUMNS


# --- compiled route -------------------------------------------------------
def used_columns(records: Sequence[dict]) -> list[str]:
    """Bar columns that a short list of specs and its back-test read."""
    found = {"close"} | {i["source"] for r in records for i in r["indicators"]}
    for r in records:
        own = {i["name"] for i in r["indicators"]}
        sides = [c for side in ("entry", "exit") for kind in ("all", "any") for c in r[side][kind]]
        found |= {c[o] for c in sides for o in ("left", "right_ref") if c[o] is not None and c[o] not in own}
    return [c for c in BAR_COLUMNS if c in found]


def namespace(record: dict) -> dict[str, str]:
    """PR4: operand name -> column; indicator names shadow data columns."""
    names = {c: c for c in BAR_COLUMNS}
    names.update(
        {i["name"]: column_name(i["kind"], i["source"], i["period"]) for i in record["indicators"]}
    )
    return names


def condition_column(cond: dict, names: dict[str, str], keys: Sequence[str], order: str = "ts") -> Column:
    """PR1-PR3, PR5: one comparison, never null."""
    for operand in (cond["left"], cond["right_ref"]):
        if operand is not None and operand not in names:
            raise ValueError(f"missing data column: {operand}")
    left = F.col(names[cond["left"]])
    right = F.lit(cond["right_num"]) if cond["right_ref"] is None else F.col(names[cond["right_ref"]])
    op = cond["comparator"]
    if op in ("crosses_above", "crosses_below"):
        w = series(keys, order)
        before_left = F.lag(left).over(w)
        before_right = right if cond["right_ref"] is None else F.lag(right).over(w)
        if op == "crosses_above":
            return false_if_null((left > right) & (before_left <= before_right))
        return false_if_null((left < right) & (before_left >= before_right))
    table = {
        ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right,
        "==": left == right,
    }
    return false_if_null(table[op])


def signal_column(signal: dict, names: dict[str, str], keys: Sequence[str], order: str = "ts") -> Column:
    """PR6: AND over ``all``, OR over ``any``; both groups present -> both must hold."""
    groups = []
    if signal["all"]:
        groups.append(reduce(lambda a, b: a & b, [condition_column(c, names, keys, order) for c in signal["all"]]))
    if signal["any"]:
        groups.append(reduce(lambda a, b: a | b, [condition_column(c, names, keys, order) for c in signal["any"]]))
    if not groups:
        raise ValueError("signal must contain at least one condition")
    return reduce(lambda a, b: a & b, groups)


def wanted_indicators(records: Sequence[dict]) -> list[tuple[str, str, int]]:
    return sorted({(i["kind"], i["source"], i["period"]) for r in records for i in r["indicators"]})


def compiled_flags(
    bars: DataFrame, records: Sequence[dict], keys: Sequence[str] = ("symbol",), order: str = "ts",
    keep: Sequence[str] = ("close",),
) -> DataFrame:
    """PR7 side by side: one row per bar, with ``entry_n`` and ``exit_n`` for the n-th spec of a short list."""
    df = with_indicators(bars, keys, wanted_indicators(records), order)
    flags = {}
    for n, record in enumerate(records):
        names = namespace(record)
        flags[f"entry_{n}"] = signal_column(record["entry"], names, keys, order)
        flags[f"exit_{n}"] = signal_column(record["exit"], names, keys, order)
    return df.withColumns(flags).select(*keys, order, *keep, *flags)


def compiled_signals(
    bars: DataFrame, records: Sequence[dict], keys: Sequence[str] = ("symbol",), order: str = "ts",
    keep: Sequence[str] = ("close",),
) -> DataFrame:
    """PR7: rows (strategy, keys, ts, entry, exit, max_position) for every spec of a short list."""
    df = compiled_flags(bars, records, keys, order, keep)
    rows = [
        F.struct(
            F.lit(r["name"]).alias("strategy_id"),
            F.col(f"entry_{n}").alias("entry"),
            F.col(f"exit_{n}").alias("exit"),
            F.lit(r["position_sizing"]["max_position"]).alias("max_position"),
        )
        for n, r in enumerate(records)
    ]
    return df.select(*keys, order, *keep, F.inline(F.array(*rows)))


# --- spec-table route -----------------------------------------------------
# Parts of a symbol's bars in the join with the specs; a spec row is copied once for each.
SALTS = 16


def table_indicators(specs: DataFrame) -> list[tuple[str, str, int]]:
    """Distinct (kind, source, period) of a spec table: metadata, not data."""
    rows = (
        specs.select(F.explode("indicators").alias("i"))
        .select("i.kind", "i.source", "i.period").distinct().collect()
    )
    return sorted((r["kind"], r["source"], r["period"]) for r in rows)


def resolve_conditions(specs: DataFrame, operands: Sequence[str]) -> DataFrame:
    """Replace operand names by positions in ``operands`` (PR4), once per spec."""
    position = F.create_map(*[x for n, c in enumerate(operands) for x in (F.lit(c), F.lit(n))])

    def locate(name: Column) -> Column:
        own = F.element_at(
            F.filter("indicators", lambda i: i["name"] == name), 1
        )
        key = F.when(
            F.exists("indicators", lambda i: i["name"] == name),
            F.concat_ws("_", F.lit("ind"), own["kind"], own["source"], own["period"].cast("string")),
        ).otherwise(name)
        return position[key]

    def group(path: str) -> Column:
        return F.transform(
            path,
            lambda c: F.struct(
                locate(c["left"]).alias("l"),
                c["comparator"].alias("op"),
                F.when(c["right_ref"].isNotNull(), locate(c["right_ref"])).alias("r"),
                c["right_num"].alias("num"),
            ),
        )

    return specs.select(
        "strategy_id",
        "universe",
        *[
            group(f"{side}.{kind}").alias(f"{side}_{kind}")
            for side in ("entry", "exit")
            for kind in ("all", "any")
        ],
        F.col("position_sizing.max_position").alias("max_position"),
    )


def _holds(c: Column) -> Column:
    left, before = F.get("_vals", c["l"]), F.get("_prev", c["l"])
    right = F.when(c["r"].isNull(), c["num"]).otherwise(F.get("_vals", c["r"]))
    right_before = F.when(c["r"].isNull(), c["num"]).otherwise(F.get("_prev", c["r"]))
    op = c["op"]
    return false_if_null(
        F.when(op == ">", left > right)
        .when(op == ">=", left >= right)
        .when(op == "<", left < right)
        .when(op == "<=", left <= right)
        .when(op == "==", left == right)
        .when(op == "crosses_above", (left > right) & (before <= right_before))
        .when(op == "crosses_below", (left < right) & (before >= right_before))
    )


def _signal(side: str) -> Column:
    both = F.forall(f"{side}_all", _holds)
    either = F.exists(f"{side}_any", _holds)
    return (
        F.when((F.size(f"{side}_all") > 0) & (F.size(f"{side}_any") > 0), both & either)
        .when(F.size(f"{side}_all") > 0, both)
        .otherwise(either)
    )


def table_signals(
    bars: DataFrame, specs: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "ts",
    keep: Sequence[str] = ("close",),
) -> DataFrame:
    """PR7 for a spec table: specs meet the bars of their universe by an equi-join on symbol.

    Indicators are computed once per series before the join; only keys, flags and
    kept columns travel to the per-run shuffle.  Spark broadcasts the spec side
    only when its own size statistics allow it.
    """
    wanted = table_indicators(specs)
    operands = [*BAR_COLUMNS, *[column_name(*d) for d in wanted]]
    df = with_indicators(bars, keys, wanted, order).withColumn("_vals", F.array(*operands))
    df = df.withColumn("_prev", F.lag("_vals").over(series(keys, order)))
    # A rule check needs one bar only: a hot symbol is spread over SALTS parts by time, and each rule goes to all of them.
    df = df.select(*keys, order, *keep, "_vals", "_prev", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int").alias("_salt"))
    rules = resolve_conditions(specs, operands).withColumn("symbol", F.explode("universe")).drop("universe")
    rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.join(rules, ["symbol", "_salt"]).select(
        "strategy_id", *keys, order, *keep,
        _signal("entry").alias("entry"), _signal("exit").alias("exit"), "max_position",
    )


# --- hold states ----------------------------------------------------------
def hold_state(entry: str | Column, exit: str | Column, keys: Sequence[str], order: str = "ts", back: int = 0) -> Column:
    """W8: exit is applied first, entry wins on a tie.  With ``back`` the state so many rows before, False where there is none."""
    event = F.when(entry if isinstance(entry, Column) else F.col(entry), True).when(
        exit if isinstance(exit, Column) else F.col(exit), False
    )
    until = series(keys, order).rowsBetween(Window.unboundedPreceding, -back)
    return F.coalesce(F.last(event, ignorenulls=True).over(until), F.lit(False))


def toggle_state(df: DataFrame, keys: Sequence[str], order: str = "ts", out: str = "held",
                 entry: str = "entry", exit: str = "exit") -> DataFrame:
    """W9: flat + entry buys, held + exit sells, so a bar with both flags toggles.

    State = last one-sided event, flipped once per two-sided bar since then.
    """
    w = running(keys, order)
    both = F.col(entry) & F.col(exit)
    df = df.withColumn("_both", F.sum(F.when(both, 1).otherwise(0)).over(w))
    one_sided = F.when(
        F.col(entry) != F.col(exit), F.struct(F.col(entry).alias("on"), F.col("_both").alias("at"))
    )
    df = df.withColumn("_set", F.last(one_sided, ignorenulls=True).over(w))
    flips = F.col("_both") - F.coalesce(F.col("_set.at"), F.lit(0))
    state = F.coalesce(F.col("_set.on"), F.lit(False)) != (flips % 2 == 1)
    return df.withColumn(out, state).drop("_both", "_set")

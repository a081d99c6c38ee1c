"""Moving averages and RSI as window expressions.

Exponential averages are recursions.  They are evaluated here without one: the
series is cut into blocks long enough that the weight of anything before the
previous block is lost in a double, so

    ema_t = local_t + q**(k+1) * local_end_of_previous_block

where ``local`` is a weighted running sum inside the block.  Every window is
partitioned by the series keys (plus the block), which one hash exchange serves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import series, trailing
from barloom.sources.schemas import INDICATOR_KINDS

ROW = "_row"


def with_row_number(df: DataFrame, keys: Sequence[str], order: str = "ts") -> DataFrame:
    """0-based position inside the series."""
    if ROW in df.columns:
        return df
    return df.withColumn(ROW, F.row_number().over(series(keys, order)) - 1)


def sma(value: str | Column, keys: Sequence[str], period: int, order: str = "ts") -> Column:
    """W1: mean of the last ``period`` rows, null until the window is full."""
    w = trailing(keys, period, order)
    return F.when(F.count(value).over(w) == period, F.avg(value).over(w))


def rolling_std(value: str | Column, keys: Sequence[str], window: int, order: str = "ts") -> Column:
    """W5: sample deviation of a full window only."""
    w = trailing(keys, window, order)
    return F.when(F.count(value).over(w) == window, F.stddev_samp(value).over(w))


# A weight below e**-45 (3e-20) is lost in a double; above e**600 the rescaled sums would overflow.
LOST, LIMIT = 45.0, 600.0


def decay(alpha: float) -> float:
    return -math.log1p(-alpha)


def block_groups(alphas: Sequence[float]) -> list[tuple[int, list[float]]]:
    """Group smoothing factors that can share one block length, slowest first.

    A block must be so long that its oldest weight is lost for the slowest member and so short that
    the fastest member does not overflow, hence a spread of LIMIT / LOST per group.
    """
    groups: list[tuple[int, list[float]]] = []
    for alpha in sorted(set(alphas)):
        if groups and decay(alpha) * groups[-1][0] <= LIMIT:
            groups[-1][1].append(alpha)
        else:
            groups.append((max(2, math.ceil(LOST / decay(alpha))), [alpha]))
    return groups


def ewm(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float, int]], order: str = "ts"
) -> DataFrame:
    """Add ``adjust=False`` exponential means: output -> (input column, alpha, first weighted row).

    Rows before the first weighted one give null.  All means whose factors fit one block length
    share the same two windows.
    """
    df = with_row_number(df, keys, order)
    instant = {o: F.when(F.col(ROW) >= f, F.col(c)) for o, (c, a, f) in wanted.items() if a >= 1.0}
    if instant:
        df = df.withColumns(instant)
    slow = {o: w for o, w in wanted.items() if w[1] < 1.0}
    for size, alphas in block_groups([w[1] for w in slow.values()]):
        members = {o: w for o, w in slow.items() if w[1] in alphas}
        df = df.withColumns(
            {"_blk": F.floor(F.col(ROW) / F.lit(size)).cast("long"), "_k": F.pmod(F.col(ROW), F.lit(size)).cast("int")}
        )
        inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        before = Window.partitionBy(*keys).orderBy("_blk").rangeBetween(-1, -1)

        def local(source: str, alpha: float, first: int) -> Column:
            seed = F.when(F.col(ROW) == first, F.lit(1.0)).otherwise(F.lit(alpha))
            scaled = F.when(F.col(ROW) >= first, F.col(source) * seed * F.pow(F.lit(1.0 / (1.0 - alpha)), F.col("_k")))
            return F.pow(F.lit(1.0 - alpha), F.col("_k")) * F.sum(scaled).over(inside)

        def carried(out: str, alpha: float, first: int) -> Column:
            last = F.max(F.when(F.col("_k") == size - 1, F.col(f"_l_{out}"))).over(before)
            return F.when(
                F.col(ROW) >= first,
                F.col(f"_l_{out}") + F.coalesce(last, F.lit(0.0)) * F.pow(F.lit(1.0 - alpha), F.col("_k") + 1),
            )

        df = df.withColumns({f"_l_{o}": local(*w) for o, w in members.items()})
        df = df.withColumns({o: carried(o, w[1], w[2]) for o, w in members.items()})
        df = df.drop("_blk", "_k", *[f"_l_{o}" for o in members])
    return df


def with_recursive(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, str, int]], order: str = "ts"
) -> DataFrame:
    """W2, W3: output -> (kind, source, period) for ``ema`` and ``rsi``, all in shared windows.

    EMA has span ``period`` and is null on the first ``period - 1`` rows.  Wilder RSI is seeded with
    the first delta (row 1) and null before row ``period``.
    """
    df = with_row_number(df, keys, order)
    rsi_sources = sorted({s for kind, s, _ in wanted.values() if kind == "rsi"})
    deltas = {f"_d_{s}": F.col(s) - F.lag(s).over(series(keys, order)) for s in rsi_sources}
    if deltas:
        df = df.withColumns(deltas)
        moves = {}
        for s in rsi_sources:
            d = F.col(f"_d_{s}")
            moves[f"_up_{s}"] = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
            moves[f"_dn_{s}"] = F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))
        df = df.withColumns(moves)
    means: dict[str, tuple[str, float, int]] = {}
    for out, (kind, source, period) in wanted.items():
        if kind == "ema":
            means[f"_m_{out}"] = (source, 2.0 / (period + 1.0), 0)
        else:
            means[f"_g_{out}"] = (f"_up_{source}", 1.0 / period, 1)
            means[f"_s_{out}"] = (f"_dn_{source}", 1.0 / period, 1)
    df = ewm(df, keys, means, order)
    result = {}
    for out, (kind, _, period) in wanted.items():
        if kind == "ema":
            result[out] = F.when(F.col(ROW) >= period - 1, F.col(f"_m_{out}"))
        else:
            gain, loss = F.col(f"_g_{out}"), F.col(f"_s_{out}")
            rs = gain / F.when(loss != 0, loss)
            value = F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(
                F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)
            )
            result[out] = F.when(F.col(ROW) >= period, value)
    df = df.withColumns(result)
    return df.drop(*means, *deltas, *[f"_{p}_{s}" for s in rsi_sources for p in ("up", "dn")])


def with_ema(
    df: DataFrame, keys: Sequence[str], source: str, period: int, out: str, order: str = "ts"
) -> DataFrame:
    return with_recursive(df, keys, {out: ("ema", source, period)}, order)


def with_rsi(
    df: DataFrame, keys: Sequence[str], source: str, period: int, out: str, order: str = "ts"
) -> DataFrame:
    return with_recursive(df, keys, {out: ("rsi", source, period)}, order)


def column_name(kind: str, source: str, period: int) -> str:
    return f"ind_{kind}_{source}_{period}"


def with_indicators(
    df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, str, int]], order: str = "ts"
) -> DataFrame:
    """One column per distinct (kind, source, period), however many strategies use it."""
    wanted = sorted(set(wanted))
    unknown = [kind for kind, _, _ in wanted if kind not in INDICATOR_KINDS]
    if unknown:
        raise ValueError(f"unsupported indicator: {unknown[0]}")
    averages = {column_name(*d): sma(d[1], keys, d[2], order) for d in wanted if d[0] == "sma"}
    if averages:
        df = df.withColumns(averages)
    recursive = {column_name(*d): d for d in wanted if d[0] != "sma"}
    return with_recursive(df, keys, recursive, order) if recursive else df

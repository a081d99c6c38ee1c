"""Chronological splits and walk-forward windows by row arithmetic (SP1, SP2, SP7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import series, whole

SYMBOL = ("symbol",)


def with_position(bars: DataFrame, keys: Sequence[str] = SYMBOL, order: str = "ts") -> DataFrame:
    """Row position ``i`` (from 0) and series length ``n``."""
    return bars.withColumns(
        {
            "i": F.row_number().over(series(keys, order)) - 1,
            "n": F.count(F.lit(1)).over(whole(keys)),
        }
    )


def _check_fractions(train: float, validation: float) -> None:
    if not 0 < train < 1:
        raise ValueError("train_fraction must be between 0 and 1")
    if not 0 < validation < 1:
        raise ValueError("validation_fraction must be between 0 and 1")
    if train + validation >= 1:
        raise ValueError("train_fraction + validation_fraction must be below 1")


def chronological_split(
    bars: DataFrame, train: float = 0.6, validation: float = 0.2, keys: Sequence[str] = SYMBOL
) -> DataFrame:
    """SP1: ``segment`` per row; series whose fractions give an empty part get no segment."""
    _check_fractions(train, validation)
    df = with_position(bars, keys)
    t = F.floor(F.col("n") * F.lit(train))
    v = F.floor(F.col("n") * F.lit(train + validation))
    ok = (t >= 1) & (v > t) & (v < F.col("n"))
    segment = F.when(F.col("i") < t, "train").when(F.col("i") < v, "validation").otherwise("test")
    return df.withColumn("segment", F.when(ok, segment))


def _windows(df: DataFrame, train: Column, validation: Column, test: Column, step: Column) -> DataFrame:
    total = train + validation + test
    first = F.greatest(F.lit(0), F.floor((F.col("i") - total + step) / step)).cast("int")
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - total) / step)).cast("int")
    member = F.when((F.col("n") >= total) & (first <= last), F.sequence(first, last))
    df = df.withColumns({"_t": train, "_v": train + validation, "_g": step})
    df = df.withColumn("window_id", F.explode(member))
    offset = F.col("i") - F.col("window_id") * F.col("_g")
    return df.withColumn(
        "segment",
        F.when(offset < F.col("_t"), "train").when(offset < F.col("_v"), "validation").otherwise("test"),
    ).drop("_t", "_v", "_g")


def walk_forward_windows(
    bars: DataFrame, train: int, validation: int, test: int, step: int | None = None,
    keys: Sequence[str] = SYMBOL,
) -> DataFrame:
    """SP2: one row per (bar, complete window).  The default step of 1 copies a bar into
    ``train + validation + test`` windows, so long tables should pass a step."""
    if min(train, validation, test) <= 0:
        raise ValueError("window sizes must be positive")
    if step is not None and step <= 0:
        raise ValueError("step_size must be positive")
    df = with_position(bars, keys)
    return _windows(df, F.lit(train), F.lit(validation), F.lit(test), F.lit(step or 1)).drop("i", "n")


def default_segments(bars: DataFrame, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """SP7 labels: position, series length and ``segment`` of the single 60/20/20 window; null in series that are too short."""
    df = with_position(bars, keys)
    train = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(0.6)))
    validation = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(0.2)))
    test = F.col("n") - train - validation
    segment = F.when(F.col("i") < train, "train").when(F.col("i") < train + validation, "validation").otherwise("test")
    return df.withColumn("segment", F.when((F.col("n") >= 10) & (test >= 2), segment))


def default_windows(bars: DataFrame, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """SP7: the single 60/20/20 window per series; series that are too short drop out."""
    df = default_segments(bars, keys).where(F.col("segment").isNotNull())
    # always 0, but not a constant: a literal key would be folded out of the later window
    # partitioning and cost a second shuffle
    window = F.floor(F.col("i") / F.col("n")).cast("int")
    return df.select(*bars.columns, window.alias("window_id"), "segment")


def fold_rows(
    bars: DataFrame, train: int, test: int, step: int | None = None, keys: Sequence[str] = SYMBOL
) -> DataFrame:
    """SP6 membership: folds of context (train) and test rows; the last test may be partial."""
    if train <= 0 or test <= 0:
        raise ValueError("train_size and test_size must be positive")
    g = test if step is None else step
    if g <= 0:
        raise ValueError("step must be positive")
    df = with_position(bars, keys).where(F.col("n") >= train + test)
    first = F.greatest(F.lit(0), F.floor((F.col("i") - F.lit(train + test) + g) / g)).cast("int")
    # fold k exists while k * g + train < n
    last = F.least(F.floor(F.col("i") / g), F.floor((F.col("n") - 1 - train) / g)).cast("int")
    df = df.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    is_test = F.col("i") - F.col("window_id") * g >= train
    return df.withColumn("segment", F.when(is_test, "test").otherwise("train")).drop("i", "n")

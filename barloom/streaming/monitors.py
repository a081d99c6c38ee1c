"""Two stateful stream monitors: equity halt (ST1) and health states (ST2).

Rows wait in the state of their key until the watermark (newest event time less ``late``) has passed them and are then
worked off in order of time, ties included.  What comes out therefore does not depend on how the rows were spread over
triggers, as long as no row is later than ``late`` against the newest row before it; a later one is dropped, which is the
rule for late rows.

Rows newer than the watermark stay in the state for the next run.  They are judged all the same: ``run_available`` reads
the state when the stream has stopped and adds what these rows would give now, marked ``provisional``.  The next run
continues from the same state, so its rows replace them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.session import checkpoint_dir

LATE = "1 hour"
EQUITY_OUT = "portfolio_id string, ts timestamp_ntz, equity double, peak double, halted boolean"
EQUITY_STATE = "peak double, halted boolean, open_ts array<bigint>, open_equity array<double>"
HEALTH_OUT = "strategy_id string, ts timestamp_ntz, previous_state string, state string, sequence bigint"
HEALTH_STATE = "state int, sequence bigint, open_ts array<bigint>, open_want array<double>"
NAMES = ("active", "degraded", "halted")


def _arrived(chunks: Iterable[pd.DataFrame], value: Callable[[pd.DataFrame], np.ndarray], times: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    """Open and new rows of a key in order of time, then value, as two arrays of 16 bytes a row."""
    t, v = [np.asarray(times, np.int64)], [np.asarray(values, np.float64)]
    for chunk in chunks:
        t.append(chunk["_us"].to_numpy(np.int64))
        v.append(value(chunk))
    at, what = np.concatenate(t), np.concatenate(v)
    order = np.lexsort((what, at))
    return at[order], what[order]


def _closed(at: np.ndarray, state: GroupState) -> int:
    """How many leading rows the watermark has passed; asks to be called again for the others."""
    watermark = state.getCurrentWatermarkMs()
    n = int(np.searchsorted(at, watermark * 1000, side="right"))
    if n < len(at):
        state.setTimeoutTimestamp(max(int(at[n]) // 1000, watermark + 1))
    return n


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """Event time as microseconds and as the watermark's column, whatever the session's time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return stream.withColumn("_us", micros).withColumn("_at", F.timestamp_micros("_us")).withWatermark("_at", late)


def equity_monitor(stream: DataFrame, max_drawdown: float | None, late: str = LATE) -> DataFrame:
    """ST1: (portfolio_id, ts, equity) to rows with the running peak and a latched halt flag."""
    if max_drawdown is not None and not 0 < max_drawdown < 1:
        raise ValueError("max_drawdown must be between 0 and 1")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, halted, times, values = state.get if state.exists else (0.0, False, [], [])
        at, equity = _arrived(() if state.hasTimedOut else chunks, lambda c: c["equity"].to_numpy(np.float64), times, values)
        n = _closed(at, state)
        eq = equity[:n]
        peaks = np.maximum.accumulate(np.maximum(eq, peak))
        broken = eq <= 0
        if max_drawdown is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                broken = broken | (np.where(peaks > 0, 1.0 - eq / peaks, 0.0) >= max_drawdown)
        flags = np.logical_or.accumulate(broken) | halted
        state.update((float(peaks[-1]) if n else peak, bool(flags[-1]) if n else halted, at[n:].tolist(), equity[n:].tolist()))
        if n:
            yield pd.DataFrame({"portfolio_id": key[0], "ts": at[:n].astype("datetime64[us]"), "equity": eq, "peak": peaks, "halted": flags})

    return _timed(stream, late).groupBy("portfolio_id").applyInPandasWithState(
        step, EQUITY_OUT, EQUITY_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def health_monitor(stream: DataFrame, late: str = LATE) -> DataFrame:
    """ST2: reports (strategy_id, ts, degraded, halt) to state transitions; HALTED absorbs."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, sequence, times, values = state.get if state.exists else (0, 0, [], [])
        want_of = lambda c: np.where(c["halt"], 2.0, np.where(c["degraded"], 1.0, 0.0))
        at, wants = _arrived(() if state.hasTimedOut else chunks, want_of, times, values)
        n = _closed(at, state)
        after = np.maximum.accumulate(np.maximum(wants[:n], level)).astype(int)
        before = np.concatenate([[level], after[:-1]]).astype(int)[:n]
        moved = after != before
        numbers = sequence + np.cumsum(moved)
        state.update((int(after[-1]) if n else level, int(numbers[-1]) if n else sequence, at[n:].tolist(), wants[n:].tolist()))
        if moved.any():
            yield pd.DataFrame(
                {
                    "strategy_id": key[0], "ts": at[:n][moved].astype("datetime64[us]"),
                    "previous_state": [NAMES[i] for i in before[moved]], "state": [NAMES[i] for i in after[moved]],
                    "sequence": numbers[moved],
                }
            )

    return _timed(stream, late).groupBy("strategy_id").applyInPandasWithState(
        step, HEALTH_OUT, HEALTH_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def _open_rows(state: DataFrame, key: str, value: str) -> DataFrame:
    """The rows that wait in a state: key, the state's own fields, ``_us`` and the value."""
    held = F.col("value.groupState")
    fields = [c for c in state.select("value.groupState.*").columns if not c.startswith("open_")]
    rows = F.inline(F.arrays_zip(held["open_ts"].alias("_us"), held[f"open_{value}"].alias("_value")))
    return state.select(F.col(f"key.{key}"), *[held[c].alias(f"_{c}") for c in fields], rows).toDF(key, *[f"_{c}" for c in fields], "_us", "_value")


# Microseconds since 1970 as a timestamp without time zone.
MOMENT = "timestampadd(MICROSECOND, _us, TIMESTAMP_NTZ '1970-01-01 00:00:00') AS ts"


def open_equity(state: DataFrame, max_drawdown: float | None) -> DataFrame:
    """ST1 for the rows that still wait: the same columns, on top of the peak and flag of the key."""
    rows = _open_rows(state, "portfolio_id", "equity")
    so_far = Window.partitionBy("portfolio_id").orderBy("_us", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("peak", F.greatest(F.max("_value").over(so_far), "_peak"))
    broken = F.col("_value") <= 0
    if max_drawdown is not None:
        broken = broken | ((F.col("peak") > 0) & (1.0 - F.col("_value") / F.col("peak") >= max_drawdown))
    halted = F.bool_or(broken).over(so_far) | F.col("_halted")
    return rows.select("portfolio_id", F.expr(MOMENT), F.col("_value").alias("equity"), "peak", halted.alias("halted"))


def open_health(state: DataFrame) -> DataFrame:
    """ST2 for the rows that still wait: the transitions they make."""
    rows = _open_rows(state, "strategy_id", "want")
    order = Window.partitionBy("strategy_id").orderBy("_us", "_value")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_after", F.greatest(F.max("_value").over(so_far).cast("int"), "_state"))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_after").over(order), F.col("_state")))
    rows = rows.withColumn("sequence", F.col("_sequence") + F.sum((F.col("_after") != F.col("_before")).cast("int")).over(so_far))
    names = F.array(*[F.lit(n) for n in NAMES])
    moved = rows.where("_after <> _before")
    return moved.select("strategy_id", F.expr(MOMENT), F.get(names, F.col("_before")).alias("previous_state"), F.get(names, F.col("_after")).alias("state"), "sequence")


def run_available(spark: SparkSession, stream: DataFrame, folder: str | None = None, waiting: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process what is there, write it as Parquet beside the stream checkpoint, and read it back with a column ``provisional``.

    ``waiting`` turns the state into the rows that it holds back; without it only final rows are returned.  A run on the same
    ``folder`` continues where the last one stopped, and its result replaces the last one's.
    """
    base = folder or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    final = spark.read.schema(stream.schema).parquet(f"{base}/rows").withColumn("provisional", F.lit(False))
    commits = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/state/commits/0")
    started = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(commits) or query.lastProgress is not None
    if waiting is None or not started:
        return final
    state = spark.read.format("statestore").load(f"{base}/state")
    return final.unionByName(waiting(state).withColumn("provisional", F.lit(True)))


def file_stream(spark: SparkSession, path: str, schema, shape: Callable[[DataFrame], DataFrame], files_per_trigger: int = 8) -> DataFrame:
    """Stream of Parquet files, oldest first, shaped by ``shape``; a trigger's files bound what a key's task holds."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return shape(raw)

"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed.  A pass over the distinct vectors computes the product of the centred covariance with a block of
vectors; a scaled Chebyshev polynomial of the covariance, one pass for each degree, damps the part of the spectrum that is not wanted;
QR and Rayleigh-Ritz follow on the driver, on matrices of dimension times block.  Rounds go on until the residuals of
the wanted pairs are at the level of rounding.

Vectors are kept as whole numbers: an entry c is floor(64 c) + 1000000, so counts, sums and squared deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.llm.stored import stored

# Fixed by the task.
SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
# The block holds the wanted components and at least as many more; passes for each round of the filter.
DEGREE = 12
SEED = 20_011
# Residual relative to the largest eigenvalue at which a pair is certain; rounding stops it near 1e-15.
CERTAIN = 2e-14
# A filter lifts the largest pair at most so much above the least wanted one, or rounding would bury that one.
LIFT = 1e8
ROUNDS = 60
# Components whose variance is below this share of the largest are rounding only.
RANK = 1e-12
LONG = 2**63 - 1


@dataclass
class Basis:
    """The fit: number and sums of the distinct vectors, components as columns with their variances, and how certain they are."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int


def whole(col: Column) -> Column:
    """Entries as whole numbers."""
    return F.transform(col, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vector is there, not empty, and has finite entries only."""
    col = F.col(f"`{vector_col}`")
    limit = float(2**62 // SCALE)
    fine = F.forall(col, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False)))
    picked = df.where(col.isNotNull() & (F.size(col) > 0)).where(fine)
    return picked.select(F.col(f"`{id_col}`").alias("vec_id"), whole(col).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The x vectors of a batch, one to a row."""
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: whole means are taken off first, so that only the spread is multiplied."""
    mean = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    return (x - mean) * n - rest


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n; the numerator is exact, so a large mean costs no digits."""
    return numerators(x, n, sums) / n


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(x)``, an array of ``size`` numbers, over the rows; Spark adds up what the tasks return."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = fit.select("x").mapInArrow(read, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def product(fit: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """Covariance times ``block`` in one pass: the mean of x (x . block) over centred x."""

    def part(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ (c @ block)

    return summed(fit, part, block.size).reshape(block.shape) / n


def degree_for(top: float, least: float, high: float, most: int) -> int:
    """The degree up to ``most`` at which a filter of [0, high] lifts ``top`` no more than LIFT times above ``least``."""
    growth = [np.arccosh(max(2 * v / high - 1, 1.0)) for v in (top, least)]
    return int(np.clip(np.log(LIFT) / max(growth[0] - growth[1], 1e-9), 2, most))


def filtered(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, image: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """Scaled Chebyshev polynomial of the covariance on ``block``: at most 1 on [low, high], growing fast above, scaled at ``top``.

    ``image`` is the covariance times ``block``, known from the round before, so the first degree costs no pass.
    """
    half, mid = (high - low) / 2, (high + low) / 2
    scale = first = half / (top - mid)
    before, now = block, (image - mid * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (apply(now) - mid * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


def fit_sums(fit: DataFrame, dim: int) -> tuple[int, list[int], float]:
    """Number of vectors, exact sums for each dimension, and the trace of the covariance."""
    x = F.col("x")
    rows = fit.select(F.posexplode(x).alias("at", "v")).select("at", (F.col("v") - SHIFT).cast("decimal(19,0)").alias("v"))
    got = rows.groupBy("at").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,0)")).alias("q")).collect()
    n = got[0]["n"]
    sums, trace = [0] * dim, 0
    for r in got:
        sums[r["at"]] = int(r["s"]) + SHIFT * n
        trace += n * int(r["q"]) - int(r["s"]) ** 2
    return n, sums, trace / n**2


def subspace(apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, degree: int = DEGREE, certain: float = CERTAIN, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest pairs of the symmetric operator ``apply`` and their residual relative to the largest eigenvalue.

    Pairs that are certain are locked: they leave the block, and what is filtered further is kept orthogonal to them.  Rounds end when all
    are, or have come close and get no better for two rounds, which is where rounding in the sums stops it.
    """
    width = min(dim, wanted + max(wanted, 16))
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    locked, fixed, first = np.zeros((dim, 0)), np.zeros(0), 0.0
    best, worse = np.inf, 0

    def free(x: np.ndarray) -> np.ndarray:
        return x - locked @ (locked.T @ x)

    for _ in range(rounds):
        image = free(apply(block))
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        first = max(first, values[0])
        if first <= 0:
            return block[:, :0], values[:0], 0.0
        # Directions without variance have nothing to converge to.
        real = min(wanted - locked.shape[1], int((values > RANK * first).sum()))
        residuals = np.linalg.norm(image[:, :real] - block[:, :real] * values[:real], axis=0) / first
        worst = float(residuals.max(initial=0.0))
        worse = 0 if worst < best else worse + 1
        best = min(best, worst)
        if worst <= certain or best <= 1000 * certain and worse >= 2 or width == dim:
            pairs, found = np.hstack([locked, block[:, :real]]), np.r_[fixed, values[:real]]
            order = np.argsort(-found, kind="stable")
            return pairs[:, order], found[order], worst
        done = int(np.cumprod(residuals <= certain).sum())
        if done:
            locked, fixed = np.hstack([locked, block[:, :done]]), np.r_[fixed, values[:done]]
            block, image, values, real = free(block[:, done:]), free(image[:, done:]), values[done:], real - done
            best, worse = np.inf, 0
        high = max(values[-1], RANK * first)
        lifted = filtered(lambda x: free(apply(x)), block, image, degree_for(values[0], values[real - 1], high, degree), 0.0, high, values[0])
        block = np.linalg.qr(free(np.linalg.qr(free(lifted))[0]))[0]
    raise ArithmeticError(f"components are not certain after {rounds} rounds: residual {best:.1e}")


def basis(fit: DataFrame, components: int = COMPONENTS) -> Basis | None:
    """Components of the distinct vectors ``x`` (all of one length) by falling variance; None without any vector."""
    head = fit.select(F.size("x").alias("dim")).first()
    if head is None:
        return None
    dim = head["dim"]
    n, sums, trace = fit_sums(fit, dim)
    passes = 0

    def apply(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(fit, n, sums, block)

    pairs, values, residual = subspace(apply, dim, min(components, dim))
    return Basis(n, sums, trace, pairs, values, residual, passes)


def identity_error(fit: DataFrame, base: Basis) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    k, n, sums, turn = len(base.values), base.n, base.sums, base.vectors / np.sqrt(base.values)

    def part(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ turn
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = summed(fit, part, k + k * k) / n
    mean = got[:k]
    return float(np.abs(got[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def project(rows: DataFrame, base: Basis, error: float) -> DataFrame:
    """A row for each vector and component."""
    k, n, sums = len(base.values), base.n, base.sums
    turn, share = base.vectors / np.sqrt(base.values), base.values / base.trace

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            off = numerators(x, n, sums)
            if int(np.abs(off).max()) ** 2 * x.shape[1] <= LONG:
                deviation = pa.array((off * off).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in off]
                deviation = pa.array([v if v <= LONG else None for v in exact], pa.int64())
            white = (off / n) @ turn
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    deviation.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(read, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Left out: vectors that are null or empty, or hold null or non-finite entries (or entries of 7e16 and above, which are no longer
    whole numbers in a long), and vectors that have not the most frequent length (of equally frequent ones the longest).  Rows that
    repeat an id or a vector are projected like any other, but a vector counts once in the fit.  Components without variance are not
    returned, so equal vectors or an empty table give no rows.  ``deviation`` is exact and null where it does not fit a long.  Other
    columns are not read.
    """
    rows = stored(vectors(df, id_col, vector_col), "vectors")
    # A row for each length of a vector; only the first of them comes to the driver.
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["dim"])
    fit = stored(rows.select("x").distinct(), "fit-vectors")
    base = basis(fit, components)
    if not len(base.values):
        return df.sparkSession.createDataFrame([], schema)
    return project(rows, base, identity_error(fit, base))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings in whitened components."""
    return whitened(table(spark, sf_dir, "embeddings"))

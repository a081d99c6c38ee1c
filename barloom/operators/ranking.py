"""Ranking, Pareto front, genome distance and population selection (RK1-RK9)."""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip01, finite
from barloom.functions.scale import global_rank, value_counts
from barloom.operators.specs import canonical
from barloom.session import cut
from barloom.sources.schemas import SPEC_FIELDS

N_FIELDS = len(SPEC_FIELDS)
BLOCK = 2048


def final_score(
    fitness: Column, robustness: Column, diversity: Column,
    weights: tuple[float, float, float] = (0.6, 0.25, 0.15),
) -> Column:
    if any(w < 0 or not math.isfinite(w) for w in weights) or sum(weights) <= 0:
        raise ValueError("ranking weights must be finite, non-negative, and non-zero")
    a, b, c = weights
    return (F.lit(a) * fitness + F.lit(b) * robustness + F.lit(c) * diversity) / F.lit(a + b + c)


def rank_candidates(
    candidates: DataFrame, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)
) -> DataFrame:
    """RK1: eligible candidates with finite scores, ranked over the whole table."""
    ok = F.col("eligible") & finite("fitness") & finite("robustness") & finite("diversity")
    scored = candidates.where(ok).withColumn(
        "final_score", final_score(F.col("fitness"), F.col("robustness"), F.col("diversity"), weights)
    )
    return global_rank(scored, [F.desc("final_score"), F.desc("fitness"), F.asc("candidate_id")])


def rank_experiments(
    experiments: DataFrame, dataset_id: str | None = None, limit: int | None = None, status: str = "eligible"
) -> DataFrame:
    """RK2: top experiments by score; the limit is the report size."""
    rows = experiments.where(F.col("status") == status)
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    rows = rows.orderBy(F.desc("score"), "experiment_id")
    return rows if limit is None else rows.limit(limit)


# --- genome distance --------------------------------------------------------
def genome_fields(specs: DataFrame) -> DataFrame:
    """One row per (strategy, field) with a hash of the field's canonical JSON."""
    items = [F.struct(F.lit(f).alias("field"), F.xxhash64(canonical(f)).alias("value")) for f in SPEC_FIELDS]
    return specs.select("strategy_id", F.inline(F.array(*items)))


def novelty(specs: DataFrame) -> DataFrame:
    """RK5 averaged over all peers: mean distance of every strategy to all others.

    A pair differs in a field unless both hold the same value, so the mean needs only the number
    of equal values per field - a linear aggregate in place of N*(N-1)/2 pairs.
    """
    total = specs.count()
    if total < 2:
        return specs.select("strategy_id", F.lit(1.0).alias("novelty"))
    same = value_counts(genome_fields(specs), ["field", "value"], total)
    return same.groupBy("strategy_id").agg(
        (F.sum(F.lit(total) - F.col("n_same")) / F.lit(float(N_FIELDS * (total - 1)))).alias("novelty")
    )


def mean_distance(specs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean pairwise distance per group from value counts."""
    items = [F.struct(F.lit(f).alias("field"), F.xxhash64(canonical(f)).alias("value")) for f in SPEC_FIELDS]
    rows = specs.select(*groups, F.inline(F.array(*items)))
    per_value = rows.groupBy(*groups, "field", "value").agg(F.count(F.lit(1)).alias("c"))
    per_field = per_value.groupBy(*groups, "field").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")
    )
    pairs = F.max("n") * (F.max("n") - 1)
    return per_field.groupBy(*groups).agg(
        F.max("n").alias("members"),
        F.when(pairs > 0, F.sum(F.col("n") * F.col("n") - F.col("sq")) / (pairs * F.lit(float(N_FIELDS))))
        .otherwise(F.lit(0.0)).alias("mean_distance"),
    )


def distance_extremes(specs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest pairwise distance per group from counts; no pair is ever a row, nor compared.

    For every subset of the fields, the rows that agree on it are counted.  Summed over the subsets of k fields these
    pairs are B(k) = sum over j of C(j, k) E(j), where E(j) pairs agree on exactly j fields; solved for E, the least
    and the greatest j with a pair give the distances.  Fields that never differ are left out of the subsets,
    equal vectors are one row with a count, and strategies that repeat count once.
    """
    keys = list(groups)
    genes = [f"_g{n}" for n in range(N_FIELDS)]
    hashed = specs.select(*keys, "strategy_id", *[F.xxhash64(canonical(f)).alias(g) for f, g in zip(SPEC_FIELDS, genes)])
    vectors = hashed.distinct().groupBy(*keys, *genes).agg(F.count(F.lit(1)).alias("_c"))
    vectors = cut(vectors)
    span = vectors.agg(*[(F.min(g) != F.max(g)).alias(g) for g in genes]).first()
    varying = [g for g in genes if span[g]]
    f = len(varying)
    spread = vectors.select(*keys, "_c", *varying, F.explode(F.sequence(F.lit(0), F.lit(2**f - 1))).alias("_mask"))
    masked = [F.when(F.getbit(F.col("_mask"), F.lit(n)) == 1, F.col(g)).alias(g) for n, g in enumerate(varying)]
    alike = spread.select(*keys, "_mask", "_c", *masked).groupBy(*keys, "_mask", *varying).agg(F.sum("_c").cast("decimal(19,0)").alias("n"))
    pairs = (F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")
    agree = [F.coalesce(F.sum(F.when(F.bit_count("_mask") == k, pairs)), F.lit(0)).alias(f"_b{k}") for k in range(f + 1)]
    sums = alike.groupBy(*keys).agg(*agree)
    exactly = [sum((-1) ** (k - j) * math.comb(k, j) * F.col(f"_b{k}") for k in range(j, f + 1)) > 0 for j in range(f + 1)]
    apart = [F.when(there, F.lit((f - j) / N_FIELDS)) for j, there in enumerate(exactly)]
    return sums.select(
        *keys,
        F.coalesce(*reversed(apart), F.lit(0.0)).alias("min_distance"),
        F.coalesce(*apart, F.lit(0.0)).alias("max_distance"),
    )


# --- Pareto front -----------------------------------------------------------
def _dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=bool)
    for start in range(0, len(points), 256):
        p = points[start : start + 256, None, :]
        out[start : start + 256] = ((by[None] >= p).all(axis=2) & (by[None] > p).any(axis=2)).any(axis=1)
    return out


# Cells of the front search: at most so many, from so many sampled vectors for each.
MOST_CELLS, CELL_SAMPLE = 256, 64


@dataclasses.dataclass
class Split:
    """A cut of the objective space: values up to ``at`` in one objective on the left; a leaf has a cell number instead."""

    column: int = -1
    at: float = 0.0
    left: Split | None = None
    right: Split | None = None
    cell: int = -1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.empty(len(points), np.int32)
        todo = [(self, np.arange(len(points)))]
        while todo:
            node, which = todo.pop()
            if node.left is None:
                out[which] = node.cell
                continue
            low = points[which, node.column] <= node.at
            todo += [(node.left, which[low]), (node.right, which[~low])]
        return out


def cut_space(sample: np.ndarray, leaf: int) -> tuple[Split, int]:
    """Cells of about ``leaf`` sampled points, cut at medians of the objectives in turn; and how many there are."""
    root = Split()
    todo, cells = [(root, sample, 0)], 0
    while todo:
        node, own, depth = todo.pop()
        for turn in range(own.shape[1] if len(own) > leaf else 0):
            column = (depth + turn) % own.shape[1]
            at = np.sort(own[:, column])[(len(own) - 1) // 2]
            low = own[:, column] <= at
            if not low.all():
                node.column, node.at, node.left, node.right = column, float(at), Split(), Split()
                todo += [(node.left, own[low], column + 1), (node.right, own[~low], column + 1)]
                break
        else:
            node.cell, cells = cells, cells + 1
    return root, cells


def undominated(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell, block and role: first the points that are judged, which are held, then those that may beat them, which pass by."""
    key, held, alive = None, [], None

    def judged() -> pd.DataFrame:
        points = np.vstack(held) if alive is None else held[0][alive]
        return pd.DataFrame(points, columns=cols)

    for pdf in batches:
        for (cell, part, role), own in pdf.groupby(["cell", "part", "role"], sort=True):
            points = own[cols].to_numpy(dtype=float)
            if (cell, part) != key:
                if held:
                    yield judged()
                key, held, alive = (cell, part), [], None
            if role == 0:
                held.append(points)
                continue
            if not held:
                continue
            if alive is None:
                held = [np.vstack(held)]
                alive = np.ones(len(held[0]), bool)
            left = np.flatnonzero(alive)
            alive[left[_dominated(held[0][left], points)]] = False
    if held:
        yield judged()


def pareto_front(df: DataFrame, objectives: Sequence[str], block: int = BLOCK) -> DataFrame:
    """RK4: rows that no other row dominates (every objective larger is better).

    Rows without a finite ``fitness`` (if it is an objective) are left out.  A null or NaN in another objective compares
    with nothing: such a row neither dominates nor is dominated, and stays.

    1. Of the rows that agree in all objectives but one, only those with the largest value there can be in the front: an aggregate on
       the map side keeps one vector for each.  The objective left out is the one with most values; copies collapse with it.
    2. Each partition drops what a window of its best rows dominates; the window has a bound, and what finds no room goes on.
    3. The survivors are dealt to cells of the objective space.  A cell whose best corner another one's worst corner dominates goes as a
       whole; the others are compared only with cells that reach above them, which pass by the held ones in batches.
    4. An equi-join on the vector brings back every row of the front.
    """
    cols = list(objectives)
    schema = ", ".join(f"{c} double" for c in cols)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((0, len(cols)))
        for pdf in batches:
            points = pdf[cols].to_numpy(dtype=float)
            points = points[np.argsort(-points.sum(axis=1), kind="stable")]
            for start in range(0, len(points), block):
                part = points[start : start + block]
                part = part[~_dominated(part, part)]
                part = part[~_dominated(part, kept)] if len(kept) else part
                kept = np.vstack([kept[~_dominated(kept, part)] if len(part) and len(kept) else kept, part])
                if len(kept) > 2 * block:
                    # The points with the largest sums dominate most; the others are passed on.
                    order = np.argsort(-kept.sum(axis=1), kind="stable")
                    yield pd.DataFrame(kept[order[block:]], columns=cols)
                    kept = kept[order[:block]]
        yield pd.DataFrame(kept, columns=cols)

    if "fitness" in cols:
        df = df.where(finite("fitness"))
    known = functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    apart, df = df.where(~known), df.where(known)
    # Any choice is exact; the objective with most values leaves the fewest vectors.
    spread = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    free = max(cols, key=lambda c: spread[c])
    numbers = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in cols])
    best = numbers.groupBy(*[c for c in cols if c != free]).agg(F.max(free).alias(free)).where(F.col(free).isNotNull()).select(*cols)
    candidates = cut(best.mapInPandas(local, schema))
    count = candidates.count()
    cells = max(1, min(MOST_CELLS, math.ceil(count / block)))
    every = max(1, count // (CELL_SAMPLE * cells))
    sample = candidates.where(F.pmod(F.xxhash64(F.lit("cell"), *cols), F.lit(every)) == 0).toPandas()[cols].to_numpy(dtype=float)
    tree, _ = cut_space(sample, CELL_SAMPLE if cells > 1 else max(1, len(sample)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=tree.of(pdf[cols].to_numpy(dtype=float)))

    placed = cut(candidates.mapInPandas(place, f"{schema}, cell int"))
    # At most 2 * MOST_CELLS rows: one for each cell.
    bounds = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("l", F.min), ("h", F.max))]).collect()
    low, high = (np.array([[r[f"{k}{i}"] for i in range(len(cols))] for r in bounds]).reshape(len(bounds), len(cols)) for k in "lh")
    routes = []
    for b, row in enumerate(bounds):
        if ((low >= high[b]).all(axis=1) & (low > high[b]).any(axis=1)).any():
            continue
        parts = max(1, math.ceil(row["n"] / (4 * block)))
        routes += [(bounds[a]["cell"], row["cell"], parts) for a in np.flatnonzero((high >= low[b]).all(axis=1))]
    spark = df.sparkSession
    route = F.broadcast(spark.createDataFrame(routes, "cell int, target int, parts int"))
    met = placed.join(route, "cell")
    own = met.where("cell = target").select(F.col("target").alias("cell"), F.pmod(F.xxhash64(*cols), "parts").cast("int").alias("part"), F.lit(0).alias("role"), *cols)
    above = met.select(F.col("target").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), *cols)
    dealt = own.unionByName(above).repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
    front = dealt.mapInPandas(lambda batches: undominated(batches, cols), schema)
    return df.join(front, cols, "left_semi").select(*df.columns).unionByName(apart)


# --- greedy subsets ---------------------------------------------------------
# Candidates that one pass of the max-min choice brings to the driver.
SHORTLIST = 1024
RANK_KEY = ("fitness", "mc_pass_rate", "rob_ratio", "regime_score", "candidate_id")


def _key_order(row: Row) -> tuple:
    """The rank key as Spark orders it: null lowest, NaN highest."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in (row[c] for c in RANK_KEY))


def _nearer(base: DataFrame, fields: list[str], picks: np.ndarray) -> DataFrame:
    """``_d`` lowered to the distance from the nearest of ``picks``."""

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, d = pdf[fields].to_numpy(), pdf["_d"].to_numpy(copy=True)
            for pick in picks:
                np.minimum(d, (own != pick).sum(axis=1) / N_FIELDS, out=d)
            yield pdf.assign(_d=d)

    return base.mapInPandas(lower, base.schema)


def diverse_subset(
    evaluated: DataFrame, genes: DataFrame, size: int, minimum_distance: float = 0.0, shortlist: int = SHORTLIST
) -> list[str]:
    """RK6: start from the best candidate, then add the one farthest from the chosen set; of equally far ones the best.

    Distances to the chosen set only fall.  So a pass brings the ``shortlist`` candidates that are farthest as of now, and the driver
    picks among these, lowering their distances, as long as the best of them is not below what the first one left out had:
    no candidate that is not on the list can be farther.  Then the distances of all are lowered to the picks of the pass
    and the next list is drawn.  A pass gives many picks; the driver holds one list.
    """
    fields = [f"_g{n}" for n in range(N_FIELDS)]
    wide = genes.select(
        F.col("strategy_id").alias("candidate_id"),
        *[F.xxhash64(canonical(f)).alias(g) for f, g in zip(SPEC_FIELDS, fields)],
    )
    base = cut(evaluated.select(*RANK_KEY).join(wide, "candidate_id").withColumn("_d", F.lit(2.0)))
    chosen: list[str] = []
    while True:
        rows = base.orderBy(F.desc("_d"), *[F.desc(c) for c in RANK_KEY]).limit(shortlist + 1).collect()
        if not rows:
            return chosen
        keys = [_key_order(r) for r in rows]
        bound = (rows[-1]["_d"], keys[-1]) if len(rows) > shortlist else (-1.0, ())
        own = np.array([[r[g] for g in fields] for r in rows])
        d = np.array([r["_d"] for r in rows])
        picks: list[int] = []
        while len(chosen) < size:
            free = [k for k in range(len(rows)) if k not in picks]
            best = max(free, key=lambda k: (d[k], keys[k]), default=None)
            if best is None or (d[best], keys[best]) < bound or chosen and d[best] < minimum_distance:
                break
            picks.append(best)
            chosen.append(rows[best]["candidate_id"])
            d = np.minimum(d, (own != own[best]).sum(axis=1) / N_FIELDS)
        done = {rows[k]["candidate_id"] for k in picks}
        # Nothing was left out and nothing could be picked, or the best of all is too near.
        if len(chosen) >= size or len(rows) <= shortlist or not picks:
            return chosen
        rest = base.join(F.broadcast(base.sparkSession.createDataFrame([(c,) for c in sorted(done)], "candidate_id string")), "candidate_id", "left_anti")
        base = cut(_nearer(rest.select(*base.columns), fields, own[picks]))


def select_population(
    evaluated: DataFrame, specs: DataFrame, size: int, *, preserve_diversity: bool = True,
    minimum_distance: float = 0.0, objectives: Sequence[str] = (),
) -> DataFrame:
    """RK7: diverse subset (or Pareto front) first, the rest filled by rank, ``size`` rows in all.

    ``evaluated`` holds the eligible candidates with the rank-key columns; fewer of them than ``size`` is an error.
    """
    if evaluated.count() < size:
        raise ValueError("fewer eligible candidates than requested population size")
    order = [F.desc(c) for c in RANK_KEY]
    spark = evaluated.sparkSession
    if preserve_diversity:
        picked = diverse_subset(evaluated, specs, size, minimum_distance)
        rows = [(c, n) for n, c in enumerate(picked)]
        first = spark.createDataFrame(rows, "candidate_id string, pos int")
        tagged = evaluated.join(F.broadcast(first), "candidate_id", "left").withColumn("_tier", F.col("pos").isNull().cast("int"))
        order = [F.asc("_tier"), F.asc("pos"), *order]
    else:
        front = pareto_front(evaluated, objectives).select("candidate_id").withColumn("_front", F.lit(0))
        tagged = evaluated.join(front, "candidate_id", "left").withColumn("_tier", F.coalesce("_front", F.lit(1)))
        order = [F.asc("_tier"), *order]
    chosen = tagged.orderBy(*order).limit(size)
    return chosen.select(*evaluated.columns, "_tier").withColumnRenamed("_tier", "tier")


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Positional rank inside groups whose size a policy bounds."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def diversity_from(sum_positive: Column, n: Column, any_selected: Column) -> Column:
    """RK3: 1 with nothing selected, 0 when no correlation is defined, else 1 - mean positive correlation."""
    return F.when(~any_selected, F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(
        clip01(F.lit(1.0) - sum_positive / F.when(n != 0, n))
    )

"""Parameter sweeps over spec tables (SW1-SW7).

Every neighbour is an *edit* row (operator, index, number, text).  One function
lists the edits of a spec, one applies an edit, so listing, sampling and
crossing stay DataFrame work whatever the number of specs.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import content_id, draw
from barloom.functions.scale import global_rank
from barloom.operators.specs import spec, spec_table, with_strategy_id
from barloom.session import cut
from barloom.sources.schemas import COMPARATORS, SPEC_FIELDS

# Fixed search grids.
PERIODS = (5, 10, 14, 20, 50, 100, 200)
FRACTIONS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.35, 0.50, 0.75, 1.0)
FACTORS = (0.90, 0.95, 1.05, 1.10)
# Fixed templates of the replacement generator: name, kind of the fast average, fast and slow period.
TEMPLATES = (("sma_fast", "sma", 10, 30), ("ema_fast", "ema", 10, 30), ("sma_slow", "sma", 20, 60))

PERIOD, THRESHOLD, COMPARATOR, FRACTION = (
    "mutate_indicator_period",
    "mutate_threshold",
    "mutate_signal_comparator",
    "mutate_position_fraction",
)


def _edit(op: str, idx: Column, num: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(op).alias("op"),
        idx.cast("int").alias("idx"),
        (F.lit(None) if num is None else num).cast("double").alias("num"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def _per_item(items: str, values: Column, make) -> Column:
    """Flat array of ``make(item, index, value)`` over all items and values."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(values, lambda v: make(x, i, v))))


def period_edits() -> Column:
    """SW2: every other default period for every indicator."""
    grid = F.array(*[F.lit(p) for p in PERIODS])
    return F.flatten(
        F.transform(
            "indicators",
            lambda x, i: F.transform(
                F.filter(grid, lambda p: ~p.eqNullSafe(x["period"])),
                lambda p: _edit(PERIOD, i, num=p),
            ),
        )
    )


def threshold_edits(factors: tuple[float, ...] = FACTORS) -> Column:
    """SW3: every numeric entry threshold times every factor of the grid."""
    grid = F.array(*[F.lit(f) for f in factors])
    every = _per_item("entry.all", grid, lambda c, i, f: F.struct(c["right_num"].alias("num"), _edit(THRESHOLD, i, num=f).alias("e")))
    return F.transform(F.filter(every, lambda t: t["num"].isNotNull()), lambda t: t["e"])


def comparator_edits() -> Column:
    """SW4: the six other comparators for every conjunctive entry condition."""
    grid = F.array(*[F.lit(c) for c in COMPARATORS])
    return F.flatten(
        F.transform(
            "entry.all",
            lambda c, i: F.transform(
                F.filter(grid, lambda o: o != c["comparator"]), lambda o: _edit(COMPARATOR, i, text=o)
            ),
        )
    )


def fraction_edits() -> Column:
    """SW5: other sizing fractions below the ceiling; only for fixed-fraction sizing."""
    ceiling = F.least("position_sizing.max_position", "risk.max_position")
    grid = F.filter(F.array(*[F.lit(v) for v in FRACTIONS]), lambda v: v <= ceiling)
    other = F.filter(grid, lambda v: v != F.col("position_sizing.value"))
    chosen = F.when(F.size(other) > 0, other).otherwise(grid)
    fixed = F.col("position_sizing.method") == "fixed_fraction"
    edits = F.transform(chosen, lambda v: _edit(FRACTION, F.lit(0), num=v))
    return F.when(fixed, edits).otherwise(F.filter(edits, lambda e: F.lit(False)))


EDITS = {PERIOD: period_edits, THRESHOLD: threshold_edits, COMPARATOR: comparator_edits, FRACTION: fraction_edits}


def apply_edit(df: DataFrame) -> DataFrame:
    """Apply column ``edit`` to the spec columns, bump the version and renew the id."""
    e = F.col("edit")
    indicators = F.transform(
        "indicators",
        lambda x, i: F.when(
            (e["op"] == PERIOD) & (i == e["idx"]), x.withField("period", e["num"].cast("int"))
        ).otherwise(x),
    )
    conditions = F.transform(
        "entry.all",
        lambda c, i: F.when((e["op"] == THRESHOLD) & (i == e["idx"]), c.withField("right_num", c["right_num"] * e["num"]))
        .when((e["op"] == COMPARATOR) & (i == e["idx"]), c.withField("comparator", e["text"]))
        .otherwise(c),
    )
    sizing = F.when(
        e["op"] == FRACTION, F.col("position_sizing").withField("value", e["num"])
    ).otherwise(F.col("position_sizing"))
    out = df.withColumns(
        {
            "parent_id": F.col("strategy_id"),
            "operator": e["op"],
            "indicators": indicators,
            "entry": F.col("entry").withField("all", conditions),
            "position_sizing": sizing,
            "version": F.col("version") + 1,
        }
    ).drop("edit")
    return with_strategy_id(out)


def neighbours(specs: DataFrame, *operators: str) -> DataFrame:
    """SW2-SW5: all neighbours of every spec under the named operators."""
    lists = [EDITS[o]() for o in (operators or tuple(EDITS))]
    return apply_edit(specs.withColumn("edit", F.explode(F.concat(*lists))))


def sampled_variants(
    specs: DataFrame, samples: int | Column, seed: int = 0, operators: tuple[str, ...] = tuple(EDITS),
    key: str = "strategy_id",
) -> DataFrame:
    """``samples`` variants per spec: an applicable operator, then one of its edits, by hash draws.

    Threshold factors are continuous in [0.9, 1.1).
    """
    df = specs.withColumn(
        "ops",
        F.filter(
            F.array(*[F.struct(F.lit(o).alias("op"), EDITS[o]().alias("edits")) for o in operators]),
            lambda x: F.size(x["edits"]) > 0,
        ),
    ).where(F.size("ops") > 0)
    last = F.lit(samples - 1) if isinstance(samples, int) else samples - 1
    df = df.withColumn("sample", F.explode(F.sequence(F.lit(0), last)))
    df = df.withColumn("_op", F.get("ops", (draw(seed, key, "sample", F.lit("op")) % F.size("ops")).cast("int")))
    picked = F.get(F.col("_op.edits"), (draw(seed, key, "sample", F.lit("edit")) % F.size("_op.edits")).cast("int"))
    factor = F.lit(0.9) + F.lit(0.2) * draw(seed, key, "sample", F.lit("factor")) / F.lit(4294967296.0)
    df = df.withColumn("edit", picked)
    df = df.withColumn(
        "edit",
        F.when(F.col("edit.op") == THRESHOLD, F.col("edit").withField("num", factor)).otherwise(F.col("edit")),
    )
    return apply_edit(df.drop("ops", "_op"))


def crossover(pairs: DataFrame, specs: DataFrame, seed: int = 0) -> DataFrame:
    """SW6: children of pairs(a_id, b_id): field-wise choice, indicators merged by name, and one
    condition per signal, each decided by a hash of (seed, pair, field)."""
    a = specs.select(F.col("strategy_id").alias("a_id"), F.struct(*SPEC_FIELDS).alias("a"))
    b = specs.select(F.col("strategy_id").alias("b_id"), F.struct(*SPEC_FIELDS).alias("b"))
    df = pairs.join(a, "a_id").join(b, "b_id").where(F.col("a_id") != F.col("b_id"))

    def coin(field: str | Column) -> Column:
        return draw(seed, "a_id", "b_id", F.lit(field) if isinstance(field, str) else field) % 2 == 1

    def pick(field: str) -> Column:
        return F.when(coin(field), F.col(f"b.{field}")).otherwise(F.col(f"a.{field}"))

    a_names = F.transform("a.indicators", lambda i: i["name"])
    b_names = F.transform("b.indicators", lambda i: i["name"])
    replaced = lambda name: coin(F.concat(F.lit("indicator:"), name))
    merged = F.concat(
        F.filter("a.indicators", lambda i: ~F.array_contains(b_names, i["name"]) | ~replaced(i["name"])),
        F.filter("b.indicators", lambda i: ~F.array_contains(a_names, i["name"]) | replaced(i["name"])),
    )
    ordered = F.array_sort(merged, lambda x, y: F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))

    def signal(side: str) -> Column:
        left = F.concat(F.col(f"a.{side}.all"), F.col(f"a.{side}.any"))
        right = F.concat(F.col(f"b.{side}.all"), F.col(f"b.{side}.any"))
        use_left = (F.size(right) == 0) | ((F.size(left) > 0) & coin(side))
        chosen = F.when(use_left, left).otherwise(right)
        n = draw(seed, "a_id", "b_id", F.lit(f"{side}:condition")) % F.greatest(F.size(chosen), F.lit(1))
        one = F.get(chosen, n.cast("int"))
        none = F.filter(chosen, lambda c: F.lit(False))
        return F.when(
            F.size(left) + F.size(right) == 0, F.col(f"a.{side}")
        ).otherwise(F.struct(F.array(one).alias("all"), none.alias("any")))

    out = df.select(
        "a_id", "b_id",
        F.col("a.name").alias("name"),
        (F.greatest("a.version", "b.version") + 1).alias("version"),
        *[pick(f).alias(f) for f in ("universe", "timeframe")],
        ordered.alias("indicators"),
        signal("entry").alias("entry"),
        signal("exit").alias("exit"),
        *[pick(f).alias(f) for f in ("side", "position_sizing", "risk")],
        F.map_concat(
            F.map_filter("a.metadata", lambda k, v: k != "evolution_operator"),
            F.create_map(F.lit("evolution_operator"), F.lit("crossover")),
        ).alias("metadata"),
    )
    return with_strategy_id(out)


def hash_pairs(specs: DataFrame, seed: int, rounds: int) -> DataFrame:
    """Pairs for crossing: in each round every spec draws one other spec as its partner.

    Specs are numbered in order of id; a partner is a drawn distance ahead, never zero, so no spec is left out at any
    population size and the meeting is a join on the number.  One spec alone has no partner.
    """
    numbered = global_rank(specs.select("strategy_id").distinct(), [F.col("strategy_id")], "number").withColumn("number", F.col("number") - 1)
    total = numbered.agg(F.count(F.lit(1)).alias("n"))
    rows = numbered.join(F.broadcast(total), F.col("n") > 1)  # one row
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    ahead = F.lit(1) + draw(seed, "strategy_id", "round", F.lit("partner")) % (F.col("n") - 1)
    met = rows.select(F.col("strategy_id").alias("a_id"), F.pmod(F.col("number") + ahead, F.col("n")).alias("number"))
    return met.join(numbered.select(F.col("strategy_id").alias("b_id"), "number"), "number").select("a_id", "b_id").distinct()


def roll_count(seed: int, slots: int, rate: float) -> int:
    """How many of ``slots`` seeded rolls fall below ``rate``."""
    rolls = (int(hashlib.md5(f"{seed}:roll:{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in range(slots))
    return sum(r < rate for r in rolls)


def evolve(
    parents: DataFrame,
    lineage: DataFrame,
    target: int,
    *,
    seed: int = 0,
    crossover_rate: float = 0.5,
    mutation_rate: float = 0.5,
    elite: int = 0,
    pool_rank: str = "strategy_id",
) -> DataFrame:
    """SW7: a unique next population with lineage columns (generation, parent_ids, operator).

    ``lineage`` gives (strategy_id, generation) of the parents.  ``pool_rank`` names the column of ``parents`` that orders the
    pool, smallest first: the elites are its first members.  Rounds of draws go on until ``target`` distinct members
    exist; if 50 draws for each member do not give them, the call fails.
    """
    if target <= 0 or not 0 <= elite <= target:
        raise ValueError("target_size must be positive and elite_count between 0 and target_size")
    if not 0 <= crossover_rate <= 1 or not 0 <= mutation_rate <= 1:
        raise ValueError("rates must be between 0 and 1")
    if crossover_rate + mutation_rate <= 0 and elite < target:
        raise ValueError("at least one variation rate must be positive")
    gen = lineage.select("strategy_id", "generation")
    size = parents.select("strategy_id").distinct().count()
    if size == 0:
        raise ValueError("parent population must not be empty")
    if crossover_rate > 0 and size < 2 and mutation_rate == 0:
        raise ValueError("crossover requires at least two parents")
    kept_slots = min(elite, size)
    slots = target - kept_slots
    crossed_slots = 0 if size < 2 else roll_count(seed, slots, crossover_rate) if mutation_rate > 0 else slots
    kept = parents.dropDuplicates(["strategy_id"]).join(gen, "strategy_id").orderBy(pool_rank, "strategy_id").limit(kept_slots).select(
        "strategy_id", *SPEC_FIELDS, "generation", F.array().cast("array<string>").alias("parent_ids"), F.lit("elite").alias("operator"),
    )
    most = max(100, 50 * target)
    samples = 4 + 4 * slots // size
    while True:
        children = _children(parents, gen, samples, seed, crossover_rate > 0 and size > 1, mutation_rate > 0)
        found = {r["crossed"]: r["n"] for r in children.groupBy("crossed").agg(F.count(F.lit(1)).alias("n")).collect()}
        # What one kind cannot fill the other one does, as far as its rate allows it at all.
        crossed = min(crossed_slots, found.get(True, 0))
        mutated = min(slots - crossed, found.get(False, 0))
        crossed = min(slots - mutated, found.get(True, 0))
        if crossed + mutated == slots:
            break
        if samples * size >= most:
            raise ValueError("unable to produce a unique population with the configured variation operators")
        samples *= 2
    out = kept
    for is_crossed, n in ((True, crossed), (False, mutated)):
        first = children.where(F.col("crossed") == is_crossed).orderBy(draw(seed, "strategy_id"), "strategy_id").limit(n)
        out = out.unionByName(first.drop("crossed"))
    return out


def _children(parents: DataFrame, gen: DataFrame, samples: int, seed: int, crossing: bool, mutating: bool) -> DataFrame:
    """Distinct children that are none of the parents, written once; ``crossed`` tells the two kinds apart."""
    made = []
    if mutating:
        mutated = sampled_variants(parents, samples, seed)
        made.append(
            mutated.join(gen.withColumnRenamed("strategy_id", "parent_id"), "parent_id").select(
                "strategy_id", *SPEC_FIELDS, (F.col("generation") + 1).alias("generation"), F.array("parent_id").alias("parent_ids"),
                "operator", F.lit(False).alias("crossed"), F.col("sample").cast("string").alias("_key"),
            )
        )
    if crossing:
        crossed = crossover(hash_pairs(parents, seed, samples), parents, seed)
        made.append(
            crossed.join(gen.select(F.col("strategy_id").alias("a_id"), F.col("generation").alias("ga")), "a_id")
            .join(gen.select(F.col("strategy_id").alias("b_id"), F.col("generation").alias("gb")), "b_id")
            .select(
                "strategy_id", *SPEC_FIELDS, (F.greatest("ga", "gb") + 1).alias("generation"), F.array("a_id", "b_id").alias("parent_ids"),
                F.lit("crossover").alias("operator"), F.lit(True).alias("crossed"), F.lit("").alias("_key"),
            )
        )
    every = functools.reduce(DataFrame.unionByName, made)
    body = [c for c in every.columns if c not in ("strategy_id", "_key")]
    # A child that several draws made keeps the same one of them in every run.
    first = F.struct("crossed", "operator", "_key", "parent_ids")
    unique = every.groupBy("strategy_id").agg(F.min_by(F.struct(*body), first).alias("_c")).select("strategy_id", "_c.*")
    return cut(unique.join(parents.select("strategy_id"), "strategy_id", "left_anti"))


def spawn(work: DataFrame, population: DataFrame, seed: int = 0) -> DataFrame:
    """SW7 for work items(request_id, source_strategy_id, budget_units): at most ``budget_units`` new
    variants of the named source, out of four times as many draws."""
    src = work.join(population, F.col("source_strategy_id") == F.col("strategy_id"))
    src = src.where(F.col("budget_units") > 0).withColumn(
        "draw_key", F.concat_ws("/", "request_id", "strategy_id")
    )
    drawn = sampled_variants(src, F.col("budget_units").cast("int") * 4, seed, key="draw_key")
    new = drawn.join(population.select("strategy_id"), "strategy_id", "left_anti")
    first = new.groupBy("request_id", "strategy_id").agg(
        F.min("sample").alias("sample"), F.min("parent_id").alias("parent_id"),
        F.min_by("operator", "sample").alias("operator"), F.min("budget_units").alias("budget_units"),
    )
    w = Window.partitionBy("request_id").orderBy("sample", "strategy_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("budget_units"))


def replacement_templates(spark: SparkSession, requests: DataFrame, symbols: list[str]) -> DataFrame:
    """SW1: template candidates per request(request_id, source_strategy_id, constraints).

    Templates are a literal array exploded per request, so no join is needed.
    """
    if not symbols:
        raise ValueError("symbols cannot be empty")
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("mutation"), F.lit(k).alias("kind"), F.lit(f).alias("fast"), F.lit(s).alias("slow"))
            for n, k, f, s in TEMPLATES
        ]
    )
    allowed = F.when(
        F.array_contains(F.coalesce("constraints", F.array().cast("array<string>")), "trend_only"),
        F.filter(rows, lambda t: t["mutation"] != "sma_slow"),
    ).otherwise(rows)
    df = requests.withColumn("t", F.explode(allowed)).select(
        "request_id", F.col("source_strategy_id").alias("parent_strategy_id"), "t.*"
    )
    base = spec_table(
        spark,
        [
            spec(n, [(f"{n}_indicator", k, f), ("slow_indicator", "sma", s)],
                 [(f"{n}_indicator", ">", "slow_indicator")], [(f"{n}_indicator", "<", "slow_indicator")],
                 universe=symbols)
            for n, k, f, s in TEMPLATES
        ],
    ).drop("strategy_id").withColumnRenamed("name", "mutation")
    out = df.select("request_id", "parent_strategy_id", "mutation").join(base, "mutation").withColumn(
        "name", F.concat(F.lit("generated-"), "request_id", F.lit("-"), "mutation")
    )
    out = with_strategy_id(out)
    return out.withColumn(
        "candidate_id", content_id(["request_id", "parent_strategy_id", "mutation", "strategy_id"])
    )

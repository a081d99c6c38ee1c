"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Base patterns give spans that always stay.  Beside them generators with a high recall propose further, overlapping spans
(numbers in other layouts, written-out mail addresses, parts of runs that the base patterns take as one).  Each candidate
is described by its format and by the words around it, gradient-boosted trees score it, and it becomes a redaction if the
score reaches the threshold that was calibrated for its kind.

The trees are fitted here on a bounded sample of documents: base spans and rewritten forms of them are the positive
rows, broken forms (a wrong check digit, a byte over 255, a sum or number of an order) the negative ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
# The task's patterns, written so that no start is tried twice inside a run (possessive parts; \G: where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High recall; a generator never looks twice at a place either.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\s?[(\[]\s?at\s?[)\]]\s?|\sat\s)[A-Za-z0-9-]++(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9]|[0-9][.-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9]|[.-][0-9])"),
)
CUES = r"(?i)\b(e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|credit|ip|host|address|reach)\b"
COUNTERS = r"(?i)\b(order|invoice|total|page|isbn|version|item|no|number|id|sum|price|year)\b"
CONTEXT = 24
FEATURES = (
    "is_email is_ip is_card is_phone length digits letters groups longest dots seps parens plus at_sign written luhn octets cue counter left_word right_word".split()
)
# Documents the trees are fitted on, about (chosen by a hash of the id), and rows of the fit at most.
SAMPLE, ROWS = 20_000, 6_000
TREES, DEPTH, PRECISION = 16, 5, 0.98
SPAN = "array<struct<start:int,stop:int,value:string>>"
CHUNK = 64


def running(lengths: Column) -> Column:
    """Sums of all earlier elements, for each element; in chunks, so that long arrays do not cost their square."""
    count = F.size(lengths)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int")),
        lambda c: F.aggregate(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, x: a + x),
    )
    before = F.aggregate(chunks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.transform(
        lengths,
        lambda _, i: F.get(before, F.floor(i / CHUNK).cast("int"))
        + F.aggregate(F.slice(lengths, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK), F.lit(0), lambda a, x: a + x),
    )


def with_spans(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Add ``out``: start, stop (code points) and value of every match, leftmost and without overlaps."""
    kept = [c for c in df.columns if c != out]
    df = df.withColumn("_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
    df = df.withColumn("_g", F.when(F.size("_m") > 0, gaps))
    df = df.withColumn("_l", F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), F.col("_m"), lambda g, m: g + F.length(m)))
    df = df.withColumn("_b", F.when(F.size("_m") > 0, running(F.col("_l"))))
    made = F.transform(
        F.col("_m"),
        lambda m, i: F.struct((F.get("_b", i) + F.get("_g", i)).alias("start"), (F.get("_b", i) + F.get("_l", i)).alias("stop"), m.alias("value")),
    )
    return df.withColumn(out, F.when(F.size("_m") > 0, made).otherwise(F.array().cast(SPAN))).select(*kept, out)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    turned = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substr(turned, k, F.lit(1))) - 48
        doubled = F.when(k % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def octets(value: Column) -> Column:
    """Whether all parts between dots are at most 255."""
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def valid(kind: str, value: Column) -> Column:
    """The task's check of a base match."""
    count = F.length(digits_of(value))
    if kind == "ip":
        return octets(value)
    if kind == "card":
        return count.between(13, 19) & luhn(digits_of(value))
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def partial_valid(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["value"])


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one array of checked spans for each kind, named by the kind."""
    for kind in KINDS:
        df = with_spans(df, text, BASE[kind], kind)
        df = df.withColumn(kind, F.filter(kind, partial_valid(kind)))
    return df


def around(kind: str, text: Column) -> Callable[[Column], Column]:
    """A span with its kind and the characters on both sides."""
    return lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"),
        F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))).alias("left"),
        F.substr(text, s["stop"] + 1, F.lit(CONTEXT)).alias("right"),
    )


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: kind, place, value and the characters on both sides."""
    names = []
    for k, (kind, pattern) in enumerate(GENERATORS):
        names.append(f"_c{k}")
        df = with_spans(df, text, pattern, names[-1])
        df = df.withColumn(names[-1], F.transform(names[-1], around(kind, F.col(text))))
    return df.withColumn("candidates", F.concat(*names)).drop(*names)


def featured(df: DataFrame) -> DataFrame:
    """Add the FEATURES of the candidate in ``kind, value, left, right``; nulls give zeros."""
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    digits = digits_of(value)
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    made = {
        **{f"is_{kind}": F.col("kind") == kind for kind in KINDS},
        "length": F.length(value), "digits": F.length(digits), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "groups": F.size(groups), "longest": F.array_max(F.transform(groups, F.length)),
        "dots": F.length(F.regexp_replace(value, r"[^.]", "")), "seps": F.length(F.regexp_replace(value, r"[^ -]", "")),
        "parens": F.length(F.regexp_replace(value, r"[^()]", "")), "plus": value.startswith("+"), "at_sign": value.contains("@"),
        "written": value.rlike(r"(?i)\W(at|dot)\W"), "luhn": luhn(digits), "octets": octets(value),
        "cue": left.rlike(CUES), "counter": left.rlike(COUNTERS), "left_word": left.rlike(r"[\w.+-]$"), "right_word": right.rlike(r"^[\w%@-]"),
    }
    return df.withColumns({name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURES})


def rewritten(kind: str, value: Column) -> tuple[list[Column], list[Column]]:
    """Other forms of a true value, and broken forms."""
    d = digits_of(value)
    cut_at = lambda first, n: F.substr(d, F.lit(first), F.lit(n))
    last = lambda first, n: F.substr(d, F.length(d) - first + 1, F.lit(n))
    if kind == "email":
        written = F.regexp_replace(F.regexp_replace(value, "@", " at "), r"\.", " dot ")
        boxed = F.regexp_replace(F.regexp_replace(value, "@", " [at] "), r"\.", " [dot] ")
        name = F.regexp_extract(value, "^([A-Za-z]*)", 1)
        return [written, boxed], [F.concat(name, F.lit(" at "), F.reverse(name), F.lit(".the")), F.concat(name, F.lit(" at "), name, F.lit("."), name), F.concat(name, name, F.lit(" at "), F.reverse(name), F.lit("."), name, F.lit("ing"))]
    if kind == "ip":
        return [], [F.concat(value, F.lit("9")), F.regexp_replace(value, r"^[0-9]+", "512"), F.regexp_replace(value, r"[0-9]+$", "999")]
    if kind == "card":
        spaced = F.concat_ws(" ", cut_at(1, 4), cut_at(5, 4), cut_at(9, 4), F.substr(d, F.lit(13)))
        dotted = F.translate(spaced, " ", ".")
        wrong = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), ((last(1, 1).cast("int") + 3) % 10).cast("string"))
        return [spaced, dotted], [wrong, F.reverse(wrong), F.translate(spaced, "0123456789", "5273819640")]
    area, mid, end = last(10, 3), last(7, 3), last(4, 4)
    good = [F.format_string("(%s) %s-%s", area, mid, end), F.concat_ws("-", area, mid, end), F.concat_ws(".", area, mid, end)]
    return good, [F.concat(area, mid, end), F.concat(mid, end), F.concat_ws(" ", mid, end), F.concat(end, F.lit("-"), F.substr(area, F.lit(1), F.lit(2)), F.lit("-"), F.substr(mid, F.lit(1), F.lit(2)), F.lit("19"))]


def training_rows(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> DataFrame:
    """``kind, value, left, right, label, part`` (part 0 of 4 is for calibration); ``docs`` has ``doc_id, text``."""
    total = max(docs.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = base_spans(docs.where(draw < F.lit(sample / total)).select("text"))
    seen = F.concat(*[F.transform(kind, around(kind, F.col("text"))) for kind in KINDS])
    true = picked.select(F.explode(seen).alias("s")).select("s.kind", "s.value", "s.left", "s.right")
    order = F.xxhash64("kind", "value", "left")
    # A tenth of ROWS true values, each with its other forms: a top-k that every partition cuts to that size first.
    true = true.dropDuplicates(["kind", "value"]).orderBy(order, "kind", "value", "left").limit(rows // 10)
    forms = F.lit(None)
    for kind in KINDS:
        good, bad = rewritten(kind, F.col("value"))
        made = [F.struct(F.col("value"), F.lit(1.0).alias("label")), *[F.struct(g.alias("value"), F.lit(1.0).alias("label")) for g in good], *[F.struct(b.alias("value"), F.lit(0.0).alias("label")) for b in bad]]
        forms = F.when(F.col("kind") == kind, F.array(*made)).otherwise(forms)
    wide = true.select("kind", "left", "right", F.posexplode(forms).alias("form", "f")).select("kind", "f.value", "left", "right", "f.label", "form")
    # A third of the rows gets a telling word before it, a true one or one of other numbers.
    turn = F.pmod(F.xxhash64("value", "form"), F.lit(6))
    told = F.when((turn == 0) & (F.col("label") == 1), F.lit("contact: ")).when((turn == 1) & (F.col("label") == 0), F.lit("order no ")).when(turn == 2, F.lit("")).otherwise(F.col("left"))
    return wide.withColumn("left", told).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "kind", digits_of(F.col("value"))), F.lit(4)))


def fit(rows: DataFrame) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Trees and the threshold of each kind; None if there is nothing to tell apart.

    The threshold is the least one from which on PRECISION of the calibration rows of the kind are true; a kind without such a
    threshold gets none and adds no spans.
    """
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(rows)).select("kind", "label", "part", "features")
    # At most ROWS rows, in one partition so that every run fits the same trees.
    ready = ready.repartition(1).sortWithinPartitions("kind", "label", F.xxhash64(F.col("features").cast("string"))).cache()
    labels = {r["label"] for r in ready.where("part <> 0").select("label").distinct().collect()}
    if len(labels) < 2:
        ready.unpersist()
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(ready.where("part <> 0"))
    scored = scores(model, ready.where("part = 0")).select("kind", "label", F.floor(F.col("score") * 50).alias("step"))
    bins: dict[str, dict[int, tuple[float, int]]] = {}
    for r in scored.groupBy("kind", "step").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("all")).collect():
        bins.setdefault(r["kind"], {})[r["step"]] = (r["good"], r["all"])
    thresholds = {}
    for kind, found in bins.items():
        good, every = 0.0, 0
        for step in sorted(found, reverse=True):
            good, every = good + found[step][0], every + found[step][1]
            if good >= PRECISION * every:
                thresholds[kind] = step / 50
    ready.unpersist()
    return model, thresholds


def scores(model: GBTClassificationModel, ready: DataFrame) -> DataFrame:
    return model.transform(ready).withColumn("score", vector_to_array("probability")[1])


def numbered(k: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, all_spans`` for every row: arrays of ``kind, start, stop, value``, and how many ``added`` ones are in the second.

    Null and empty texts have no spans.  Repeated rows are judged each; other columns are not read; an empty table gives no rows.
    A selected candidate is left out where a base span of its kind contains it.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    trained = fit(training_rows(rows))
    found = base_spans(rows)
    ordered = F.concat(*[F.transform(kind, numbered(k, kind)) for k, kind in enumerate(KINDS)])
    found = with_candidates(found).withColumn("base", ordered).drop(*KINDS)
    # Candidates that a base span of their kind contains are settled.
    fresh = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] <= c["start"]) & (c["stop"] <= b["stop"])))
    found = found.select("doc_id", "base", F.array_distinct(fresh).alias("candidates"), F.monotonically_increasing_id().alias("_row"))
    if trained is None:
        return found.select("doc_id", "base", F.col("base").alias("all_spans"), F.lit(0).cast("bigint").alias("added"))
    model, thresholds = trained
    # The texts are read once: from here on a document is its spans, and one row if it has no open candidate.
    each = found.select("_row", "doc_id", "base", F.explode_outer("candidates").alias("c")).select("_row", "doc_id", "base", "c.*")
    scored = scores(model, VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(each)))
    needed = F.lit(2.0)
    for kind, threshold in thresholds.items():
        needed = F.when(F.col("kind") == kind, F.lit(threshold)).otherwise(needed)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    chosen = F.when(F.col("kind").isNotNull() & (F.col("score") >= needed), F.struct(number.alias("k"), "start", "stop", "kind", "value"))
    merged = scored.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("base").alias("base"), F.collect_list(chosen).alias("more"))
    return merged.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("all_spans"), F.size("more").cast("bigint").alias("added"))


def redact(text: Column, spans: Column, mask: str = "█") -> Column:
    """``text`` with every code point inside ``spans`` (start, stop) masked; spans may overlap."""
    piece = F.aggregate(
        F.array_sort(spans), F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["done"], F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.repeat(F.lit(mask), F.greatest(s["stop"] - F.greatest(a["at"], s["start"]), F.lit(0)))).alias("done"),
            F.greatest(a["at"], s["stop"]).alias("at"),
        ),
    )
    return F.concat(piece["done"], F.substr(text, piece["at"] + 1))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    counts: Sequence[Column] = [F.size(F.filter("base", of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), "added")

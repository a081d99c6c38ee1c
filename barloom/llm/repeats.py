"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``WINDOW`` bytes only, by passes from the most significant digit, and every pass
drops the groups of one: what is left in a group at the end are exactly the repeated windows.

* The first digit is not the first byte of a window but its anchor, the gram of GRAM bytes with the least hash in it.
  Equal windows have the same anchor at the same offset.  Neighbouring windows share their anchor, so this pass
  sorts one row for a run of about 70 windows (a family) instead of one for each.
* The second digit is the whole span of the family.  Families with equal spans are repeated as they are.
* The last digit is the single window.  Only families whose anchor occurs in another span as well get there; those of
  one anchor are compared in one task, or, above GROUP spans, as rows of single windows dealt out by their digest.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lookup, table
from barloom.llm.stored import stored

WINDOW = 200
GRAM = 48
# Windows that are worked on at once; a longer text is read in overlapping pieces.
PIECE = 1 << 20
# Distinct spans of one anchor that are compared in one task.
GROUP = 1024
STEP = 0x9E3779B97F4A7C15
UNSTEP = pow(STEP, -1, 1 << 64)
FAMILY = "row bigint, s bigint, e bigint, a bigint, h bigint, f bigint"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every position, from prefix sums of a polynomial (it only has to choose anchors)."""
    n = len(data)
    power, back = np.full(n + 1, STEP, np.uint64), np.full(n + 1, UNSTEP, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    gram = (prefix[GRAM:] - prefix[:-GRAM]) * back[: n - GRAM + 1]
    return (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def families(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First and last start of each run of windows with one anchor, and the anchor's place."""
    for base in range(0, len(text) - WINDOW + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + WINDOW - 1, len(text) - base), base)
        grams = gram_hashes(data)
        # 40 bits of hash, then the place: the first of equal grams wins, as in any other copy of the window.
        least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        wide, width = 1, WINDOW - GRAM + 1
        while 2 * wide <= width:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if width > wide:
            least = np.minimum(least[: wide - width], least[width - wide :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        yield base + first, base + np.r_[first[1:], len(place)] - 1, base + place[first]


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def family_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        h: list[int] = []
        f: list[int] = []
        for row, value in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            text = value.as_py() or b""
            for s, e, a in families(text):
                h += [digest(text[k : k + GRAM]) for k in a.tolist()]
                f += [digest(text[i : j + WINDOW], k - i) for i, j, k in zip(s.tolist(), e.tolist(), a.tolist(), strict=True)]
                rows.append(np.full(len(s), row, np.int64))
                parts.append((s, e, a))
        columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (rows, *([p[k] for p in parts] for k in range(3)))]
        yield pa.RecordBatch.from_arrays([*columns, signed(h), signed(f)], names=["row", "s", "e", "a", "h", "f"])


def window_digests(span: bytes, s: int, e: int, a: int) -> list[tuple[int, bytes]]:
    """Start and 128-bit digest (seeded with the anchor's offset) of every window of a family."""
    return [(i, xxhash.xxh3_128_digest(span[i - s : i - s + WINDOW], a - i)) for i in range(s, e + 1)]


def runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """First start and end (exclusive) of the bytes under runs of window starts, given in order."""
    first = last = None
    for start in starts:
        if last is not None and start == last + 1:
            last = start
            continue
        if last is not None:
            yield first, last + WINDOW
        first = last = start
    if last is not None:
        yield first, last + WINDOW


def group_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows among the spans of each anchor; rows come sorted by anchor."""
    group: list[tuple] = []
    out: list[tuple[int, int, int]] = []

    def done() -> None:
        owners: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, row, s, e, a, n, span) in enumerate(group):
            for start, digest in window_digests(span, s, e, a):
                owners[digest].append((number, start))
        again: dict[int, list[int]] = defaultdict(list)
        for places in owners.values():
            if len(places) > 1:
                for number, start in places:
                    again[number].append(start)
        for number, starts in again.items():
            if group[number][5] == 1:
                out.extend((group[number][1], *r) for r in runs(sorted(starts)))

    def give() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["row", "start", "stop"])
        out.clear()
        return made

    for batch in batches:
        for item in zip(*(batch.column(n).to_pylist() for n in ("h", "row", "s", "e", "a", "n", "span")), strict=True):
            if group and group[0][0] != item[0]:
                done()
                group = []
            group.append(item)
        yield give()
    if group:
        done()
        yield give()


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the families that go on to the last pass."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, todo in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("todo").to_pylist(), strict=True):
            if todo:
                whole = text.as_py()
                out += [(t["h"], row, t["s"], t["e"], t["a"], t["n"], t["spans"], whole[t["s"] : t["e"] + WINDOW]) for t in todo]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([r[k] for r in out], pa.int64()) for k in range(7)], pa.array([r[7] for r in out], pa.binary())],
            names=["h", "row", "s", "e", "a", "n", "spans", "span"],
        )


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, row, s, e, a, n, _, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = window_digests(span, s, e, a)
            halves = np.frombuffer(b"".join(d for _, d in found), "<i8").reshape(-1, 2)
            k = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, row)), pa.array(np.arange(s, e + 1)), pa.array(np.full(k, n)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["row", "start", "n", "d1", "d2"],
            )


def keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its repeated runs."""
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for value, found in zip(batch.column("text").cast(pa.large_binary()), batch.column("runs").to_pylist(), strict=True):
            text = value.as_py() or b""
            merged: list[list[int]] = []
            for r in sorted((r["start"], r["stop"]) for r in found or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            edges = [0, *(x for r in merged for x in r), len(text)]
            rest = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            for name, x in zip(out, (len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                out[name].append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
            names=["doc_id", *out],
        )


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``row, start, stop`` of repeated bytes; ``rows`` has ``row`` (a number for the row) and ``text``."""
    every = stored(rows.select("row", "text").mapInArrow(family_rows, FAMILY), "families")
    # First digit: anchors that occur once drop out.
    anchors = lookup(every, ["h"], F.count(F.lit(1)).alias("c"), F.min("f").alias("low"), F.max("f").alias("high"))
    met = anchors.where("c > 1").select("h", (F.col("low") != F.col("high")).alias("mixed"))
    twice = stored(every.join(met, "h"), "anchored")
    # Second digit: equal spans are repeated as a whole.
    spans = twice.where("mixed").groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "s", "e", "a")).alias("one"))
    spans = stored(spans, "spans")
    copied = twice.where("mixed").join(spans.where("n > 1").select("h", "f"), ["h", "f"], "left_semi")
    whole = twice.where("NOT mixed").unionByName(copied).select("row", F.col("s").alias("start"), (F.col("e") + WINDOW).alias("stop"))
    # Last digit: single windows of the spans whose anchor has another span.
    several = lookup(spans, ["h"], F.count(F.lit(1)).alias("spans")).where("spans > 1")
    last = spans.join(several, "h").select(
        F.col("one.row").alias("row"), F.struct("h", "one.s", "one.e", "one.a", F.least("n", F.lit(2).cast("bigint")).alias("n"), "spans").alias("item")
    )
    todo = last.groupBy("row").agg(F.collect_list("item").alias("todo"))
    schema = "h bigint, row bigint, s bigint, e bigint, a bigint, n bigint, spans bigint, span binary"
    # Rows that are equal in id and text share their number, so one of them is cut.
    held = rows.select("row", "text").join(todo, "row", "left").mapInArrow(cut_spans, schema).dropDuplicates(["h", "row", "s"])
    held = stored(held, "cut")
    few = held.where(F.col("spans") <= GROUP).repartition("h").sortWithinPartitions("h", "row", "s").mapInArrow(group_repeats, "row bigint, start bigint, stop bigint")
    many = held.where(F.col("spans") > GROUP).mapInArrow(single_windows, "row bigint, start bigint, n bigint, d1 bigint, d2 bigint")
    again = lookup(many, ["d1", "d2"], F.count(F.lit(1)).alias("c")).where("c > 1")
    single = many.where("n = 1").join(again, ["d1", "d2"], "left_semi").select("row", "start", (F.col("start") + WINDOW).alias("stop"))
    return whole.unionByName(few).unionByName(single)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) for every row.

    A byte goes if it is part of a 200-byte string that also starts elsewhere, in any row or the same one; repeated rows
    therefore lose everything from 200 bytes on.  Null and empty texts have no bytes; other columns are not read; an empty
    table gives no rows.  ``kept`` can end inside a character, so it is binary.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    found = repeated_runs(rows).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    schema = f"doc_id {dict(rows.dtypes)['id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return rows.join(found, "row", "left").select("id", "text", "runs").mapInArrow(keep_rest, schema)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 200-byte strings."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")

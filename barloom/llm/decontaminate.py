"""Benchmark passages in training documents, by spaced-seed hashing.

A seed is a fixed mask over a window of tokens that ignores some positions, so a window with a few other tokens
still has the hash of the original; for every two positions there is a mask that ignores both.  Two other tokens also leave
one third of a window whole, so only windows with such a third in the benchmark are masked.  Hashes of the documents that
a small Bloom filter of the benchmark lets through are joined with those of the benchmark; a hit counts once the two
whole windows agree in enough tokens.

Items shorter than a window are windows of their own length: a fifth of their tokens, rounded down, may be others, and the
masks ignore every choice of so many positions.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table

SPAN = 12
# 1: the position counts.  The positions form four groups (by the remainder of 4) and each mask ignores two of them, so every two
# positions, ends included, are ignored by one.
MASKS = ("110011001100", "101010101010", "100110011001", "011001100110", "010101010101", "001100110011")
# Tokens of a third of a window, of which two other tokens leave one whole.
THIRD = 4
# Of so many tokens one may be another: 10 of 12 agree, 8 of 10, 4 of 5, and below 5 all.
ONE_OFF = 5
# Bits of the filter: 2 MB whatever the benchmark's size.
FILTER_BITS = 1 << 24
TOKEN = re.compile(r"[^\W_]+")
BETWEEN = re.compile(r"[\W_]")
# Tokens of a block, characters read at once, and token hashes that a task remembers.
BLOCK, PIECE, MEMORY = 1 << 16, 1 << 20, 1 << 17
WINDOWS = "pos bigint, hash bigint, window array<bigint>"


def masks_of(n: int) -> list[str]:
    """Masks of windows of ``n`` tokens: every choice of n // ONE_OFF positions is ignored by one of them."""
    if n >= 2 * ONE_OFF:
        return [m[:n] for m in MASKS]
    return [("10" * n)[:n], ("01" * n)[:n]] if n >= ONE_OFF else ["1" * n]


class Hashes(dict):
    """Hashes of tokens; the frequent ones are computed once, and the memory has a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[token] = found = xxhash.xxh64_intdigest(token)
        return found


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of at least PIECE characters that do not cut a token."""
    start = 0
    while len(text) - start > PIECE:
        edge = BETWEEN.search(text, start + PIECE)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:] if start else text


def token_blocks(text: str, overlap: int, hashes: Hashes | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Start and hashes of blocks of lower-cased tokens; each repeats the last ``overlap`` tokens of the one before."""
    start, held = 0, array("Q")
    hashes = Hashes() if hashes is None else hashes
    for piece in pieces(text.lower()):
        held.extend(map(hashes.__getitem__, TOKEN.findall(piece)))
        while len(held) >= BLOCK + overlap:
            yield start, np.array(held[: BLOCK + overlap])
            start, held = start + BLOCK, held[BLOCK:]
    yield start, np.array(held)


def masked_hashes(tokens: np.ndarray, mask: str, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the masked tokens of each window, or of those that start ``at`` these places."""
    n = len(tokens) - len(mask) + 1
    total = np.full(max(n, 0) if at is None else len(at), int(mask, 2) + (len(mask) << 32), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            total = (total ^ (tokens[k : k + n] if at is None else tokens[at + k])) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return total


def slots_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64), (hashes >> np.uint64(40)).astype(np.int64) & (FILTER_BITS - 1)


def passes(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    a, b = slots_of(hashes)
    return ((known[a >> 3] >> (a & 7)) & (known[b >> 3] >> (b & 7)) & 1).astype(bool)


def promising(tokens: np.ndarray, thirds: np.ndarray) -> np.ndarray:
    """Starts of the windows of SPAN tokens of which at least one third may be in the benchmark."""
    n = max(len(tokens) - SPAN + 1, 0)
    found = passes(thirds, masked_hashes(tokens, "1" * THIRD))
    return np.flatnonzero(np.logical_or.reduce([found[k : k + n] for k in range(0, SPAN, THIRD)]))


def windows_of(texts: DataFrame, masks: Sequence[str], bits=None, thirds=None) -> DataFrame:
    """``id, pos, hash, window`` of the windows of ``texts`` (id, text); with ``bits`` and ``thirds`` only of those the filters let through."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else bits.value
        hashes_of = Hashes()
        for batch in batches:
            out: dict[str, list] = {"id": [], "pos": [], "hash": [], "window": []}
            for key, value in enumerate(batch.column("text").to_pylist()):
                for start, tokens in token_blocks(value or "", SPAN - 1, hashes_of):
                    some = None if thirds is None else promising(tokens, thirds.value)
                    for mask in masks:
                        at = some if some is not None and len(mask) == SPAN else None
                        hashes = masked_hashes(tokens, mask, at)
                        keep = np.arange(len(hashes)) if known is None else np.flatnonzero(passes(known, hashes))
                        for k, h in zip((keep if at is None else at[keep]).tolist(), hashes[keep].view(np.int64).tolist(), strict=True):
                            out["id"].append(key)
                            out["pos"].append(start + k)
                            out["hash"].append(h)
                            out["window"].append(tokens[k : k + len(mask)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(out["id"], pa.int64())), pa.array(out["pos"], pa.int64()), pa.array(out["hash"], pa.int64()), pa.array(out["window"], pa.list_(pa.int64()))],
                names=list(out),
            )

    return texts.mapInArrow(read, f"id {dict(texts.dtypes)['id']}, {WINDOWS}")


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """Packed Bloom filter of ``hash``; at most FILTER_BITS / 64 rows come to the driver."""
    second = F.shiftrightunsigned("hash", 40).bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1)), second)).alias("slot"))
    packed = slots.groupBy(F.expr("slot div 64").alias("chunk")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("mask"))
    bits = np.zeros(FILTER_BITS // 64, "<i8")
    for row in packed.toLocalIterator():
        bits[row["chunk"]] = row["mask"]
    return bits.view(np.uint8)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, n_windows`` for every document and benchmark item that share a verified window.

    Tokens are runs of letters and digits, lower-cased.  A window of 12 tokens is verified if 10 agree; an item of fewer tokens is
    one window, of which a fifth of the tokens, rounded down, may differ, so one below 5 tokens must occur whole.  Null and empty
    texts, and items without tokens, share nothing; rows that repeat an id count together; null ids are one document (or item); ids may
    have any type; other columns are not read.  The benchmark may have any size: its hashes are joined, and the filter has a
    fixed size and only spares rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text}`").alias("text"))
    count = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"))
    sized = items.withColumn("n", count)
    short = sorted(r["n"] for r in sized.where(F.col("n").between(1, SPAN - 1)).select("n").distinct().collect())
    sought = windows_of(items.where(count >= SPAN), MASKS)
    for n in short:
        sought = sought.unionByName(windows_of(sized.where(F.col("n") == n).select("id", "text"), masks_of(n)))
    bits = spark.sparkContext.broadcast(filter_bits(sought.select("hash")))
    thirds = spark.sparkContext.broadcast(filter_bits(windows_of(items.where(count >= SPAN), ["1" * THIRD]).select("hash")))
    found = windows_of(texts, [*MASKS, *(m for n in short for m in masks_of(n))], bits, thirds)
    known = sought.select(F.col("id").alias("item_id"), "hash", F.col("window").alias("original"), F.col("pos").alias("item_pos"))
    hits = found.join(known, "hash")
    equal = F.size(F.filter(F.zip_with("window", "original", lambda a, b: a == b), lambda same: same))
    needed = F.size("original") - F.floor(F.size("original") / ONE_OFF)
    verified = hits.where((F.size("window") == F.size("original")) & (equal >= needed)).select(F.col("id").alias("doc_id"), "item_id", "pos").distinct()
    return verified.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))


def verdicts(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, contaminated, n_items, n_windows, items`` (ids in order, comma-joined) for every row of ``docs``."""
    found = contaminated(docs, benchmark, **columns)
    each = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n_windows").alias("n_windows"),
        F.array_join(F.transform(F.sort_array(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("items"),
    )
    each = each.withColumnRenamed("doc_id", "found_id")
    rows = docs.select(F.col(f"`{columns.get('id_col', 'doc_id')}`").alias("doc_id"))
    joined = rows.join(each, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("n_windows", zero).alias("n_windows"), F.coalesce("items", F.lit("")).alias("items"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Without masks: windows with f = span // 5 other tokens have one of f + 1 equal pieces whole; those that share one are compared token by token.
OP7_SQL = rf"""
WITH spans AS (SELECT n AS span, n // {ONE_OFF} AS off, p, n * p // (n // {ONE_OFF} + 1) AS start, n * (p + 1) // (n // {ONE_OFF} + 1) AS stop
               FROM (SELECT n, unnest(range(n // {ONE_OFF} + 1)) AS p FROM range(1, {SPAN + 1}) t(n))),
i AS (SELECT item_id, regexp_extract_all(lower(COALESCE(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
iw AS (
  SELECT item_id, span, off, p, w[pos + 1:pos + span] AS original, w[pos + start + 1:pos + stop] AS piece
  FROM (SELECT *, unnest(range(len(w) - span + 1)) AS pos FROM i, spans WHERE span = {SPAN} AND len(w) >= {SPAN} OR span < {SPAN} AND len(w) = span)),
dw AS (
  SELECT doc_id, span, p, pos, w[pos + 1:pos + span] AS win, w[pos + start + 1:pos + stop] AS piece
  FROM (SELECT *, unnest(range(len(w) - span + 1)) AS pos FROM d, spans WHERE len(w) >= span AND span IN (SELECT span FROM iw))),
hit AS (
  SELECT DISTINCT doc_id, item_id, pos FROM dw JOIN iw USING (span, p, piece)
  WHERE len([1 FOR k IN range(1, span + 1) IF win[k] = original[k]]) >= span - off),
pair AS (SELECT doc_id, item_id, COUNT(*) AS n FROM hit GROUP BY ALL),
each AS (SELECT doc_id, COUNT(*) AS n_items, CAST(SUM(n) AS BIGINT) AS n_windows, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM pair GROUP BY doc_id)
SELECT documents.doc_id, each.doc_id IS NOT NULL AS contaminated, COALESCE(n_items, 0) AS n_items, COALESCE(n_windows, 0) AS n_windows, COALESCE(items, '') AS items
FROM documents LEFT JOIN each USING (doc_id)
"""

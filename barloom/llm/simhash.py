"""Near copies by SimHash fingerprints and deletion-variant signatures.

Fingerprints that differ in at most four bits agree in at least one of three segments but for one bit.  So each
segment is indexed once for each of its bits with that bit left out: 64 signatures, of which two linked fingerprints
share one.  Signatures meet by equality, their members are verified on all 64 bits, and each group hands on a
spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lookup, table
from barloom.llm.components import components
from barloom.session import cut

SHINGLE = 4
DISTANCE = 4
# Start and width of the segments; three of them, so that one has at most one of four differing bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fingerprints of one signature that one task compares; a larger group is split into pairs of such blocks.
BLOCK = 8192
# Groups up to this size are compared together by shifted arrays.
SMALL = 64
CHUNK = 1 << 16


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of UTF-8 text: a bit is set if it is set in over half of the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, CHUNK):
        part = words[start : min(start + CHUNK, total) + shingle - 1]
        hashes = np.array([digest(s, 42) for s in map(b" ".join, zip(*[part[k:] for k in range(shingle)], strict=False))], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed bigint) for every row; a null text has fingerprint zero, as an empty one has."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([text_fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "fp"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(read, f"id {dict(picked.dtypes)['id']}, fp bigint")


def signatures(fp: Column) -> Column:
    """The 64 signatures of a fingerprint: bit left out (upper bits) and what is left of its segment."""
    out = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        out += [segment.bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1))) + F.lit((start + bit) << 22) for bit in range(width)]
    return F.array(*out)


def forest(members: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links of at most ``distance`` bits connect among ``members``."""
    rest, queue = members[1:], [members[0]]
    while rest.size:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(rest ^ at) <= distance
        found = rest[near]
        if found.size:
            rest = rest[~near]
            queue.extend(found)
            yield np.full(found.size, at), found


def group_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups; ``group`` numbers the groups in order, ``fp`` holds the members."""
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, len(group)])
    size = np.repeat(sizes, sizes)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    small = np.flatnonzero(size <= SMALL)
    low: list[np.ndarray] = []
    high: list[np.ndarray] = []
    for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
        small = small[small + shift < len(fp)]
        small = small[group[small + shift] == group[small]]
        if not small.size:
            break
        one = small[np.bitwise_count(fp[small] ^ fp[small + shift]) <= distance]
        low.append(one)
        high.append(one + shift)
    if low:
        a, b = np.concatenate(low), np.concatenate(high)
        # A group with more links than members would hand on pairs; a spanning forest does.
        number = np.repeat(np.arange(len(heads)), sizes)
        dense = np.bincount(number[a], minlength=len(heads)) >= np.maximum(sizes, 4)
        few = ~dense[number[a]]
        left.append(fp[a[few]])
        right.append(fp[b[few]])
        walk = np.flatnonzero(dense | (sizes > SMALL))
    else:
        walk = np.flatnonzero(sizes > SMALL)
    for k in walk:
        for a, b in forest(fp[heads[k] : heads[k] + sizes[k]], distance):
            left.append(a)
            right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints that share a group; rows come sorted by group, of which the last may go on in the next batch."""
    names = ("sig", "i", "j")
    held = None

    def done(cols: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:3]:
            change[1:] |= c[1:] != c[:-1]
        a, b = group_links(np.cumsum(change), cols[3].view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in (*names, "fp")]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        last = np.ones(len(cols[0]), bool)
        for c in cols[:3]:
            last &= c == c[-1]
        start = len(last) - int(last.sum())
        if start:
            yield done([c[:start] for c in cols])
        held = [c[start:] for c in cols]
    if held is not None:
        yield done(held)


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a, b``: enough links between the distinct fingerprints ``fp`` to connect all that are linked.

    A signature shared by over ``block`` fingerprints is split into blocks, each pair of which is one group, so no task
    compares more than two blocks and no link is lost.
    """
    spread = distinct.select("fp", F.explode(signatures(F.col("fp"))).alias("sig"))
    hot = lookup(spread, ["sig"], F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = hot.select("sig", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    met = spread.join(hot, "sig", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    )
    dealt = met.select("fp", "sig", F.inline(pairs)).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "fp")
    return dealt.select("sig", "i", "j", "fp").mapInArrow(lambda batches: linked(batches, distance), "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Equal fingerprints are one node, so copies are never paired.  The component id is the smallest id reachable; null ids are
    passed over (null only if a component has no other).  Null and empty texts share fingerprint zero; rows that repeat
    are members like any other; other columns are not read; an empty table gives no rows.
    """
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("the segments find at most five differing bits")
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(distinct, distance))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = lookup(placed, ["root"], F.min("low").alias("component_id"))
    placed = placed.join(lowest, "root").select("fp", "component_id")
    return marked.join(placed, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    grouped = near_groups(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

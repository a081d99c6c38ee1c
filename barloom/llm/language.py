"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams in order of frequency.  A document is compared by
its own most frequent n-grams: each is as far out of place as its two ranks differ, and PROFILE places if the profile
lacks it.  The language with the least sum is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table

# N-grams of 1 to GRAMS characters inside words, whose ends count as one character.
GRAMS = 4
# Length of a language's profile, and of a document's list.
PROFILE = 600
TOP = 300
UNKNOWN = "und"
# Steepness of the score: mean places out of place, as a share of PROFILE, are weighed by exp(-STEEP x share).
STEEP = 40.0
PIECE = 1 << 20
# A text may be as far from its profile (share of PROFILE) as the farthest but one in a hundred of the labelled documents outside the
# learned part, at full length or cut to CUT words, and MARGIN more; one of under SHORT grams may be RELAXED farther.
CUT, QUANTILE, MARGIN = 32, 0.99, 0.1
SHORT, RELAXED = 60, 0.15
# A language with fewer such documents is not calibrated; its texts may be this far.
FEWEST, LOOSE = 30, 0.75


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def spelled(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one 0 before, between and after words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 0)
    points = np.r_[np.uint32(0), points, np.uint32(0)].astype(np.uint32)
    return points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]


def gram_starts(points: np.ndarray, size: int) -> np.ndarray:
    """Places where a gram of ``size`` characters starts that crosses no word end."""
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    fits = points[:n] != 0 if size == 1 else np.ones(n, bool)
    for k in range(1, size - 1):
        fits &= points[k : k + n] != 0
    return np.flatnonzero(fits)


def gram_codes(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and code (exact up to 3 characters, a hash beyond) of every gram of ``size`` characters."""
    starts = gram_starts(points, size)
    code = np.full(len(starts), size, np.uint64)
    for k in range(size):
        code = code * np.uint64(0x100000001B3) + points[starts + k].astype(np.uint64)
    return starts, code ^ (code >> np.uint64(31))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram codes of a text and their counts; a long text is counted piece by piece, cut between words."""
    points = spelled(text)
    total: tuple[np.ndarray, np.ndarray] | None = None
    start = 0
    while start < len(points) - 1:
        stop = min(start + PIECE, len(points) - 1)
        ends = np.flatnonzero(points[start + 1 : stop + 1] == 0)
        # A word that is longer than the piece is taken whole.
        stop = start + 1 + int(ends[-1]) if len(ends) else stop + int(np.flatnonzero(points[stop:] == 0)[0])
        codes = np.concatenate([gram_codes(points[start : stop + 1], n)[1] for n in range(1, GRAMS + 1)])
        found = np.unique(codes, return_counts=True)
        if total is not None:
            merged, at = np.unique(np.concatenate([total[0], found[0]]), return_inverse=True)
            found = merged, np.bincount(at, np.concatenate([total[1], found[1]])).astype(np.int64)
        total, start = found, stop
    return total if total is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def ranked(text: str, top: int) -> np.ndarray:
    """Codes of the ``top`` most frequent grams in order; ties in order of the code."""
    codes, counts = counted(text)
    return codes[np.argsort(-counts, kind="stable")[:top]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profile grams: ``ranks[k, j]`` is the rank of gram ``codes[j]`` in language ``names[k]``."""

    names: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(lists: dict[str, list[str]]) -> Profiles:
        names = tuple(sorted(lists))
        coded = {n: [int(gram_codes(np.array([0 if c == " " else ord(c) for c in g], np.uint32), len(g))[1][0]) for g in lists[n]] for n in names}
        codes = np.unique(np.array([c for n in names for c in coded[n]], np.uint64))
        ranks = np.full((len(names), len(codes)), PROFILE, np.int64)
        for k, n in enumerate(names):
            ranks[k, np.searchsorted(codes, np.array(coded[n], np.uint64))] = np.arange(len(coded[n]))
        return Profiles(names, codes, ranks)

    def distances(self, text: str) -> np.ndarray | None:
        """Mean places out of place for each language; None without letters or languages."""
        own = ranked(text, TOP)
        if not len(own) or not self.names:
            return None
        at = np.minimum(np.searchsorted(self.codes, own), max(len(self.codes) - 1, 0))
        known = self.codes[at] == own
        ranks = np.where(known, self.ranks[:, at], PROFILE)
        places = np.where(ranks < PROFILE, np.abs(ranks - np.arange(len(own))), PROFILE)
        return np.minimum(places, PROFILE).mean(axis=1)

    def judge(self, text: str | None, limits: dict[str, float] | None = None) -> tuple[str, float]:
        """The nearest language, first in order of name on a tie, and its share of exp(-STEEP x distance / PROFILE).

        With ``limits`` (places out of place as a share of PROFILE) a text that is farther even from the nearest is unknown.
        """
        far = self.distances(text) if text else None
        if far is None:
            return UNKNOWN, 0.0
        best = int(far.argmin())
        if limits is not None and far[best] / PROFILE > limits[self.names[best]]:
            few = far[best] / PROFILE <= limits[self.names[best]] + RELAXED and len(ranked(text, SHORT)) < SHORT
            if not few:
                return UNKNOWN, 0.0
        return self.names[best], float(1 / np.exp((far[best] - far) * STEEP / PROFILE).sum())


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of each language, for about PIECE characters of it at a time."""

    def counts_of(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        points, grams, found = np.concatenate(parts), [], []
        for size in range(1, GRAMS + 1):
            starts, codes = gram_codes(points, size)
            _, first, counts = np.unique(codes, return_index=True, return_counts=True)
            grams += ["".join(chr(c) if c else " " for c in points[at : at + size].tolist()) for at in starts[first].tolist()]
            found += counts.tolist()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(found, pa.int64())], names=["lang", "gram", "n"])

    held: dict[str, list[np.ndarray]] = {}
    size_of: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            points = spelled(text or "")
            held.setdefault(lang, []).append(points)
            size_of[lang] = size_of.get(lang, 0) + len(points)
            if size_of[lang] >= PIECE:
                yield counts_of(lang, held.pop(lang))
                size_of[lang] = 0
    for lang, parts in held.items():
        yield counts_of(lang, parts)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, gram, rank``: the profile of every language, from all of its documents outside the held-out part.

    A space stands for a word's end.  Documents without text or language are not learned from.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where((remainder(F.col("id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Counts of a batch, then of a task, then of all: the texts are not shuffled.
    counts = rows.select("lang", "text").mapInArrow(gram_counts, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank")


def profiles(learned: DataFrame) -> Profiles:
    """PROFILE rows for each language, brought to the driver."""
    lists: dict[str, list[str]] = {}
    for row in sorted(learned.collect(), key=lambda r: r["rank"]):
        lists.setdefault(row["lang"], []).append(row["gram"])
    return Profiles.of(lists)


def limits(docs: DataFrame, known: Profiles, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """How far a text of each language may be from its profile, from all labelled documents outside the learned part."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where((remainder(F.col("id")) == 2) & F.col("lang").isin(*known.names) & F.col("text").isNotNull())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float]] = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = [known.distances(t) for t in (text, " ".join(text.split()[:CUT]))]
                out += [(lang, max(float(f[known.names.index(lang)]) / PROFILE for f in found if f is not None))] if found[0] is not None else []
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["lang", "far"])

    # Distances are means of whole numbers over at most TOP grams, so their values are few, however many documents there are.
    values = rows.select("lang", "text").mapInArrow(read, "lang string, far double").groupBy("lang", "far").agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("lang").agg(F.sum("n").alias("n"), F.percentile("far", F.lit(QUANTILE), F.col("n")).alias("far"))
    near = {r["lang"]: r["far"] + MARGIN for r in found.collect() if r["n"] >= FEWEST}
    return {name: min(near.get(name, LOOSE), LOOSE) for name in known.names}


def judged(docs: DataFrame, known: Profiles, text_col: str = "text", limits: dict[str, float] | None = None) -> DataFrame:
    """All columns of ``docs`` in the struct ``doc``, with ``lang_pred`` and ``score``.

    ``und`` with score 0 for a null text, one without letters, one beyond ``limits``, and when no language is known.  Nothing but the text
    decides, so repeated rows get the same answer; an empty table gives no rows.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.judge(t, limits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc", "lang_pred", "score"]
            )

    schema = packed.schema
    out = schema.__class__([schema["doc"]]).add("lang_pred", "string").add("score", "double")
    return packed.mapInArrow(read, out)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    known = profiles(learn(docs))
    found = judged(docs.select("doc_id", "text"), known)
    return found.select("doc.doc_id", "lang_pred", "score").withColumn("held_out", remainder(F.col("doc_id")) == 2).select("doc_id", "held_out", "lang_pred", "score")

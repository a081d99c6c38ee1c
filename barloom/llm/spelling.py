"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

One edit changes the letter counts by at most two in L1: a replaced letter takes one away and adds one, a further letter adds one.
So for each pair of word lengths (equal, or one apart) the words near a word lie in a small box around its letter counts.

The tree has two levels.  A routing tree, built from a bounded sample of the vocabulary, cuts each length into cells; every word
belongs to one cell and is sent as a query to each cell that its box meets.  Inside a cell a k-d tree of all its words
is searched with all its queries at once, boxes out of reach are pruned, and the order of the letters is verified at the leaves.
How the sample falls decides only where the work is done, never which words are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.llm.stored import stored

# Fixed by the task.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
ONE_IN = 31
TIMES = 10
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Words of a cell, most cells of a length class, and words sampled for each cell of the routing tree.
CELL = 16_384
MOST_CELLS = 4096
SAMPLE = 64
# Lengths from here on share one class; inside a cell each length still has its own tree.
LONG = 64
# Words of a leaf, queries searched together, comparisons held at once, and counted words held by a task.
LEAF = 16
QUERIES = 1 << 16
HELD = 1 << 22
COUNTED = 200_000


# --- words ---


def runs_of(text: str, pattern: re.Pattern) -> dict[str, int]:
    """Lower-cased runs of a text and how often they occur."""
    found: dict[str, int] = {}
    for run, k in Counter(pattern.findall(text)).items():
        low = run.translate(LOWER)
        found[low] = found.get(low, 0) + k
    return found


def misspelt(prefix: int, run: str, one_in: int = ONE_IN) -> str:
    """The run, without one letter if its hash says so; ``prefix`` is the CRC of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the distinct words over all texts that are long and frequent enough."""
    # Greedy and leftmost: shorter runs have no match, so only those that can become a word are listed.
    pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                prefix = zlib.crc32(f"{i}:".encode())
                for run, k in runs_of(text.as_py() or "", pattern).items():
                    word = misspelt(prefix, run)
                    if len(word) >= least_length:
                        counts[word] += k
                if len(counts) >= COUNTED:
                    yield flushed()
        yield flushed()

    picked = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = picked.mapInArrow(read, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- letter counts and trees ---


def letter_table() -> np.ndarray:
    """Number of each letter by code point; all code points are below 256."""
    out = np.zeros(256, np.int16)
    letters = [c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)]
    out[[ord(c) for c in letters]] = np.arange(len(letters))
    return out


LETTER = letter_table()
DIMS = int(LETTER.max()) + 1


@dataclass
class Words:
    """Words as bytes, one letter to a byte: ``at`` holds the start of each word and, last, the end of all."""

    letters: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(values: list[str]) -> Words:
        coded = [v.encode("latin-1") for v in values]
        return Words(np.frombuffer(b"".join(coded), np.uint8), np.r_[0, np.cumsum([len(c) for c in coded], dtype=np.int64)].astype(np.int64))

    def lengths(self) -> np.ndarray:
        return np.diff(self.at)

    def counts(self) -> np.ndarray:
        """How often each letter occurs in each word."""
        n = len(self.at) - 1
        row = np.repeat(np.arange(n), self.lengths())
        return np.bincount(row * DIMS + LETTER[self.letters], minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)

    def square(self, which: np.ndarray, length: int) -> np.ndarray:
        """The letters of words of one length, a column for each word."""
        return self.letters[self.at[which] + np.arange(length)[:, None]]


@dataclass
class Tree:
    """A k-d tree: inner nodes split dimension ``dim`` after ``split``; leaves hold members (or, for routing, the number of a cell)."""

    dim: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    members: list[np.ndarray | None] = field(default_factory=list)

    def leaf(self, members: np.ndarray) -> int:
        for values, v in ((self.dim, -1), (self.split, 0), (self.low, 0), (self.high, 0), (self.left, -1), (self.right, -1), (self.members, members)):
            values.append(v)
        return len(self.dim) - 1


FAR = 1 << 30


def build(points: np.ndarray, leaf: int) -> Tree:
    """Split along the letter that divides the points most evenly until a leaf is small enough or its points are equal."""
    tree = Tree()
    # A node, its members, and the bounds that its box has so far in the dimensions that were split.
    todo = [(tree.leaf(np.arange(len(points))), {})]
    while todo:
        node, bounds = todo.pop()
        members = tree.members[node]
        if len(members) <= leaf:
            continue
        own = points[members]
        cut = np.floor(own.mean(axis=0)).astype(np.int32)
        share = np.abs((own <= cut).mean(axis=0) - 0.5)
        dim = int(share.argmin())
        if share[dim] == 0.5:
            continue
        split = int(cut[dim])
        below = own[:, dim] <= split
        low, high = bounds.get(dim, (-FAR, FAR))
        tree.dim[node], tree.split[node], tree.low[node], tree.high[node], tree.members[node] = dim, split, low, high, None
        tree.left[node], tree.right[node] = tree.leaf(members[below]), tree.leaf(members[~below])
        todo += [(tree.left[node], bounds | {dim: (low, split)}), (tree.right[node], bounds | {dim: (split + 1, high)})]
    return tree


def visits(tree: Tree, queries: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the queries that reach them: those whose box of at most ``more`` further and ``fewer`` missing letters meets the leaf's."""
    all_of = np.arange(len(queries))
    todo = [(0, all_of, np.full(len(queries), more, np.int32), np.full(len(queries), fewer, np.int32))]
    while todo:
        node, which, up, down = todo.pop()
        if not len(which):
            continue
        dim = tree.dim[node]
        if dim < 0:
            yield node, which
            continue
        have, split, low, high = queries[which, dim], tree.split[node], tree.low[node], tree.high[node]
        # What the new bound costs beyond what the old one in this dimension has cost already.
        rest = down - (np.maximum(have - split, 0) - np.maximum(have - high, 0))
        ok = rest >= 0
        todo.append((tree.left[node], which[ok], up[ok], rest[ok]))
        rest = up - (np.maximum(split + 1 - have, 0) - np.maximum(low - have, 0))
        ok = rest >= 0
        todo.append((tree.right[node], which[ok], rest[ok], down[ok]))


def in_reach(queries: np.ndarray, points: np.ndarray, more: int, fewer: int) -> np.ndarray:
    """The queries whose box meets the bounding box of the points."""
    up = np.maximum(points.min(axis=0) - queries, 0).sum(axis=1)
    down = np.maximum(queries - points.max(axis=0), 0).sum(axis=1)
    return (up <= more) & (down <= fewer)


def one_replaced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns that differ in exactly one row."""
    off = np.zeros((a.shape[1], b.shape[1]), np.int32)
    for x, y in zip(a, b, strict=True):
        off += x[:, None] != y[None, :]
    return np.nonzero(off == 1)


def one_more(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns where ``b`` is ``a`` with one letter put in."""
    shape, length = (a.shape[1], b.shape[1]), len(a)
    head, run = np.zeros(shape, np.int32), np.ones(shape, bool)
    for k in range(length):
        run &= a[k][:, None] == b[k][None, :]
        head += run
    tail, run = np.zeros(shape, np.int32), np.ones(shape, bool)
    for k in range(length - 1, -1, -1):
        run &= a[k][:, None] == b[k + 1][None, :]
        tail += run
    return np.nonzero(head + tail >= length)


def near_pairs(queries: Words, points: Words, counts: np.ndarray, asked: np.ndarray, held: np.ndarray, tree: Tree, point_counts: np.ndarray, length: int, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries and points that are one edit apart; ``longer`` is how many letters the points have more (0 or 1)."""
    more, fewer, test = (1, 0, one_more) if longer else (1, 1, one_replaced)
    for node, which in visits(tree, counts[asked], more, fewer):
        members = tree.members[node]
        which = which[in_reach(counts[asked[which]], point_counts[members], more, fewer)]
        for start in range(0, len(which), max(1, HELD // len(members))):
            part = asked[which[start : start + max(1, HELD // len(members))]]
            i, j = test(queries.square(part, length), points.square(held[members], length + longer))
            if len(i):
                yield part[i], held[members[j]]


# --- cells ---


def length_class(length: int) -> int:
    return min(length, LONG)


@dataclass
class Routes:
    """Routing trees by length class; the cells are numbered through all of them."""

    trees: dict[int, Tree]
    cells: dict[int, np.ndarray]

    def of_points(self, values: Words) -> np.ndarray:
        """The cell of each word."""
        out, counts, classes = np.zeros(len(values.at) - 1, np.int32), values.counts(), np.minimum(values.lengths(), LONG)
        for c in np.unique(classes):
            own = np.flatnonzero(classes == c)
            for node, which in visits(self.trees[int(c)], counts[own], 0, 0):
                out[own[which]] = self.cells[int(c)][node]
        return out

    def of_queries(self, values: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words and the cells where words one edit away can be: of the same length, or of one letter more."""
        counts, lengths = values.counts(), values.lengths()
        same, longer = np.minimum(lengths, LONG), np.minimum(lengths + 1, LONG)
        found = []
        for target, asked, more, fewer in ((same, np.ones(len(same), bool), 1, 1), (longer, longer != same, 1, 0)):
            for c in np.unique(target[asked]):
                tree = self.trees.get(int(c))
                if tree is None:
                    continue
                own = np.flatnonzero(asked & (target == c))
                for node, which in visits(tree, counts[own], more, fewer):
                    found.append((own[which], np.full(len(which), self.cells[int(c)][node], np.int32)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([w for w, _ in found]), np.concatenate([c for _, c in found])


def routes(vocabulary: DataFrame, cell: int = CELL) -> Routes:
    """Routing trees from about SAMPLE words for each cell, chosen by a hash; at most MOST_CELLS cells and SAMPLE times as many words."""
    kind = F.least(F.length("word"), F.lit(LONG)).alias("kind")
    sizes = {r["kind"]: r["n"] for r in vocabulary.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = max(1, min(MOST_CELLS, -(-sum(sizes.values()) // cell)))
    every = max(1, sum(sizes.values()) // (SAMPLE * cells))
    picked = vocabulary.where(F.pmod(F.xxhash64(F.lit("sample"), "word"), F.lit(every)) == 0).select("word").collect()
    by_class: dict[int, list[str]] = {c: [] for c in sizes}
    for r in picked:
        by_class[length_class(len(r["word"]))].append(r["word"])
    trees, numbers, used = {}, {}, 0
    for c, sample in sorted(by_class.items()):
        # A class without a sampled word is one cell.
        points = Words.of(sample).counts() if sample else np.zeros((1, DIMS), np.int32)
        tree = build(points, SAMPLE)
        leaves = [k for k, d in enumerate(tree.dim) if d < 0]
        number = np.full(len(tree.dim), -1, np.int32)
        number[leaves] = np.arange(used, used + len(leaves))
        used += len(leaves)
        tree.members = [None] * len(tree.dim)
        trees[c], numbers[c] = tree, number
    return Routes(trees, numbers)


class Cell:
    """The words of one cell and their trees by length."""

    def __init__(self, values: list[str], n: np.ndarray):
        self.values, self.n, self.words = values, n, Words.of(values)
        counts, lengths = self.words.counts(), self.words.lengths()
        self.trees = {}
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            self.trees[int(length)] = (own, counts[own], build(counts[own], LEAF))

    def search(self, values: list[str], n: np.ndarray) -> pa.RecordBatch:
        """For every word that has a near one here, asked or asking: how many there are and the most frequent of them."""
        queries = Words.of(values)
        counts, lengths = queries.counts(), queries.lengths()
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        turned: list[tuple[np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths):
            asked = np.flatnonzero(lengths == length)
            for longer in (0, 1):
                if int(length) + longer in self.trees:
                    held, own, tree = self.trees[int(length) + longer]
                    for i, j in near_pairs(queries, self.words, counts, asked, held, tree, own, int(length), longer):
                        pairs.append((i, j))
                        if longer:
                            turned.append((j, i))
        mine, my_n = np.array(values, object), n
        theirs, their_n = np.array(self.values, object), self.n
        parts = [best_of(pairs, mine, theirs, their_n), best_of(turned, theirs, mine, my_n)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def best_of(pairs: list[tuple[np.ndarray, np.ndarray]], words_of: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> tuple[np.ndarray, ...]:
    """``word, n_near, best_n, best`` of the first of each pair; of equally frequent words the smallest is best."""
    if not pairs:
        return np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
    used, b = np.unique(b, return_inverse=True)
    rank = np.empty(len(used), np.int64)
    rank[np.argsort(near[used], kind="stable")] = np.arange(len(used))
    order = np.lexsort((rank[b], -near_n[used][b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    best = used[b[first]]
    return words_of[a[first]], np.diff(np.r_[first, len(a)]), near_n[best], near[best]


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, block and role, the words of a cell before its queries."""
    key, cell = None, None
    points: list[pa.RecordBatch] = []
    queries: list[pa.RecordBatch] = []
    waiting = 0

    def joined(parts: list[pa.RecordBatch]) -> tuple[list[str], np.ndarray]:
        whole = pa.Table.from_batches(parts)
        return whole.column("word").to_pylist(), whole.column("n").to_numpy()

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal cell, waiting
        if queries and cell is None and points:
            cell = Cell(*joined(points))
        if queries and cell is not None:
            yield cell.search(*joined(queries))
        queries.clear()
        waiting = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in ("cell", "block", "role")]
        edge = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in now], axis=0)])
        for start, end in zip(edge, [*edge[1:], batch.num_rows], strict=True):
            here = (int(now[0][start]), int(now[1][start]))
            if here != key:
                yield from answers()
                key, cell = here, None
                points.clear()
            part = batch.slice(start, end - start).select(["word", "n"])
            if now[2][start] == 0:
                points.append(part)
            else:
                queries.append(part)
                waiting += part.num_rows
                if waiting >= QUERIES:
                    yield from answers()
    yield from answers()


def near_words(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """``word, n_near, best, best_n`` for every word of ``vocabulary`` (``word, n``) that has a word one edit away."""
    route = routes(vocabulary, cell)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = route.of_points(Words.of(batch.column("word").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "n")), pa.array(cells, pa.int32())], names=["word", "n", "cell"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, cells = route.of_queries(Words.of(batch.column("word").to_pylist()))
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in ("word", "n")), pa.array(cells, pa.int32())], names=["word", "n", "cell"])

    points = stored(vocabulary.mapInArrow(placed, "word string, n bigint, cell int"), "spelling-cells")
    # At most MOST_CELLS rows and one for each length class: cells that the sample has left too large are cut into blocks by a hash.
    blocks = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * cell)).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)
    own = points.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "word", "n")
    asked = vocabulary.mapInArrow(asking, "word string, n bigint, cell int").join(blocks, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "word", "n")
    met = own.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    found = met.mapInArrow(searched, "word string, n_near bigint, best_n bigint, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("least")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", F.col("least.best").alias("best"), (-F.col("least.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of ``forms`` (``word, form``).

    A form is several times as frequent as its word, so chains have no cycle and their length grows with the logarithm of
    the largest count; every round doubles what a word has followed.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = now.join(further, F.col("root") == F.col("_word"), "left")
        step = stored(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(vocabulary: DataFrame, times: int = TIMES, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``vocabulary``: distinct ``word`` and how often it occurs (``n``).

    Two words are near if one letter is put in, taken out or replaced.  The form of a word is its most frequent near word (of
    equals the smallest by code point) if that one occurs ``times`` as often; the root is where the forms end, or the word itself.
    Words consist of letters up to U+00FF.  An empty vocabulary gives no rows.
    """
    found = stored(vocabulary.join(near_words(vocabulary, cell), "word", "left"), "near-words")
    stands = F.col("best_n") >= times * F.col("n")
    named = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(stands, F.col("best")).alias("form"), F.when(stands, F.col("best_n")).alias("form_n"))
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of all words of ``docs``.

    Null and empty texts have no words; a null id is hashed as ``null``; rows that repeat an id and text count as often as they
    occur; other columns are not read; an empty table gives no rows.
    """
    return variants(stored(words(docs, id_col, text_col), "words"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the spelling that each is a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents"))

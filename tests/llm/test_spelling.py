"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def vocabulary():
    """Words with many one-edit neighbours, anagrams, chains of forms, long words and ties."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 11))) for _ in range(120)]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 20, 20, 300, 4000])
        for _ in range(rng.randrange(6)):
            k, c = rng.randrange(len(w)), rng.choice("abcdeéÿ")
            v = rng.choice([w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 3, 25]))
    for w in base[:30]:
        words.setdefault("".join(rng.sample(w, len(w))), 2)
    words |= {"chained": 2, "chaineds": 30, "chainedsx": 400, "chainedsxy": 5000, "x" * 70: 50, "x" * 71: 3, "x" * 69 + "y": 4, "y" * 63: 2, "y" * 64: 40}
    return words


@pytest.mark.parametrize("cell", [spelling.CELL, 8])
def test_variants(spark, cell):
    words = vocabulary()
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), cell=cell).collect()
    assert sorted(map(tuple, got)) == brute_variants(words)


def test_many_words_with_equal_counts(spark):
    # One cell cannot be cut by its letter counts: it is cut into blocks.
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefgh", 8)): 2 + k % 50 for k in range(700)}
    words |= {"".join(rng.sample("abcdefgi", 8)): 30 for _ in range(300)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), cell=16).collect()
    assert sorted(map(tuple, got)) == brute_variants(words)


def test_documents(spark):
    rng = random.Random(2)
    pool = ["Remarkable", "remarkably", "naïveté", "ÀÉÎÕÜ÷×", "another", "anothers", "short", "Straße", "wordwordword", "dépêches", "depeches"]
    rows = [(k, " ".join(rng.choice(pool) + rng.choice(["", ",", "1", "\n"]) for _ in range(150))) for k in range(120)]
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, "12 34 !"), rows[3], rows[3], (503, "remarkable " * 40_000), (504, "a" * 100_000), (505, "a" * 100_000)]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id bigint, text string, word string, n int, cell int")
    got = spelling.spelling_variants(docs).collect()
    expected = brute_variants(brute_words(rows))
    assert sorted(map(tuple, got)) == expected
    assert sum(r[1] is not None for r in expected) > 5


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_tree_reaches_all_in_the_box():
    rng = np.random.default_rng(6)
    points = rng.poisson(0.7, (600, 12)).astype(np.int32)
    tree = spelling.build(points, 4)
    for more, fewer in ((1, 1), (1, 0), (0, 0)):
        met = {(int(q), int(p)) for node, which in spelling.visits(tree, points, more, fewer) for q in which for p in tree.members[node]}
        for q, p in np.argwhere((np.maximum(points[None] - points[:, None], 0).sum(2) <= more) & (np.maximum(points[:, None] - points[None], 0).sum(2) <= fewer)):
            assert (int(q), int(p)) in met
        assert more or len(met) < 600 * 600 / 8

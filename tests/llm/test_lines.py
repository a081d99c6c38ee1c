"""Line deduplication against a loop over all lines."""

import random
from collections import Counter, defaultdict

from barloom.llm import lines

SCHEMA = "doc_id bigint, text string, pos int, keep string, h1 bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_length=20, least_docs=3):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in (r[1] or "").split("\n")] for r in rows]
    holders = defaultdict(set)
    for r, ks in zip(rows, keys, strict=True):
        for k in ks:
            if len(k) >= least_length:
                holders[k].add(-1 if r[0] is None else r[0])
    out = []
    for r, ks in zip(rows, keys, strict=True):
        own = -1 if r[0] is None else r[0]
        gone = [len(holders.get(k, ())) >= least_docs and max(holders[k]) != own for k in ks]
        text = "\n".join(x for x, g in zip((r[1] or "").split("\n"), gone, strict=True) if not g)
        out.append((r[0], len(ks), sum(gone), text))
    return out


def corpus():
    rng = random.Random(3)
    pool = [f"a line that other documents hold as well, number {k}" for k in range(40)] + ["short", "", "é" * 20, "x" * 19, "Ünlike\tthe others, with a tab inside"]
    rows = []
    for k in range(120):
        own = [rng.choice(pool) for _ in range(rng.randrange(1, 9))]
        own = [rng.choice(["", "  ", "\t\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \x0b\x0c"]) for x in own]
        rows.append((k, "\n".join([*own, "the footer line that a great many documents share"])))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(pool * 50)), (None, pool[0] + "\n" + pool[1]), (None, pool[2]), (5, pool[3]), rows[7], rows[7]]
    rows.append((204, ("the footer line that a great many documents share\n" * 5000)[:-1]))
    return [(*r, 1, "k", 2) for r in rows]


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.without_lines(docs, lines.bitmaps(docs, **more)).collect()
    return Counter(tuple(r) for r in got)


def test_lines(spark):
    rows = corpus()
    assert run(spark, rows) == Counter(brute(rows))
    assert sum(r[2] for r in brute(rows)) > 300


def test_other_limits(spark):
    rows = corpus()
    assert run(spark, rows, least_length=1, least_docs=2) == Counter(brute(rows, 1, 2))


def test_hot_key_is_cut(spark):
    # The footer is in every document: it exceeds the share of a partition and goes through the blocks.
    rows = [(k, f"a line of document {k} that nobody else has\nthe footer line that a great many documents share", 1, "k", 2) for k in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.repeated_lines(lines.line_rows(docs), shares=1).collect()
    assert sorted((r["doc_id"], r["pos"]) for r in got) == [(k, 1) for k in range(499)]


def test_bitmaps_name_only_words_that_lose_lines(spark):
    first = [f"line number {k} of a text with many lines" for k in range(1000)]
    shared = [first[3], first[700], first[701]]
    rows = [(1, "\n".join(first), 1, "k", 2), (2, "\n".join(shared), 1, "k", 2), (3, "\n".join(shared), 1, "k", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    maps = {r["doc_id"]: r for r in lines.bitmaps(docs).collect()}
    assert set(maps) == {1, 2}
    assert [(w["word"], w["keep"]) for w in maps[1]["keep"]] == [(0, ~(1 << 3)), (10, ~(3 << 60))]
    assert maps[1]["n_dropped"] == 3


def test_empty(spark):
    assert run(spark, []) == Counter()

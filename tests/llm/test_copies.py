"""Exact copies, near copies, repeats and components against loops over all rows."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from barloom.llm import exact, repeats, simhash
from barloom.llm.components import components


def table(spark, rows, schema="doc_id bigint, text string, source string"):
    return spark.createDataFrame([(*r, None)[:3] if len(r) < 3 else r for r in rows], schema)


def awkward(words):
    """Texts with ties, repeats, nulls and lengths at the edges."""
    rng = random.Random(5)
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(40):
        edited = base[k % 6].split()
        for _ in range(rng.randrange(3)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        rows.append((100 + k, " ".join(edited)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one"), (None, "one"), (205, "one"), (206, "a b c"), (207, "é" * 300)]
    rows.append((208, " ".join(rng.choice(words) for _ in range(90_000))))
    return rows


WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    return {f: find(f) for f in ordered}


def test_fingerprints_and_groups(spark):
    rows = awkward(WORDS)
    got = [tuple(r) for r in simhash.near_groups(table(spark, rows)).collect()]
    fps = {(i, t): brute_fingerprint(t) for i, t in rows}
    root = brute_components(set(fps.values()))
    low = {}
    for (i, _), f in fps.items():
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    expected = [(i, signed(fps[i, t]), low[root[fps[i, t]]]) for i, t in rows]
    assert Counter(got) == Counter(expected)


@pytest.mark.parametrize("block", [3, 16, 8192])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(block)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for _ in range(500):
        f = rng.choice(seeds)
        for _ in range(rng.randrange(1, 8)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), block=block)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    expected = brute_components(fps)
    mask = (1 << 64) - 1
    groups = {}
    for f in fps:
        groups.setdefault(found.get(signed_of(f), signed_of(f)) & mask, set()).add(f)
    theirs = {}
    for f, r in expected.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def signed_of(f):
    return f - (1 << 64) if f >> 63 else f


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 3), (3, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_groups(spark):
    rows = awkward(WORDS)
    for slots in (exact.SLOTS, 64):  # a filter that is full changes nothing
        got = [tuple(r) for r in exact.exact_groups(table(spark, rows), slots=slots).collect()]
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        norm = [(i, (t or "").translate(lower)) for i, t in rows]
        ids, size = {}, Counter(t for _, t in norm)
        for i, t in norm:
            if i is not None:
                ids[t] = max(ids.get(t, i), i)
        assert Counter(got) == Counter((i, ids[t], size[t], i == ids[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        rest = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def repeat_rows():
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh éñ\n") for _ in range(n))
    passage, line = noise(260), "the same line again. "
    rows = [(k, noise(rng.randrange(50)) + passage[rng.randrange(40) :] + noise(300)) for k in range(40)]
    rows += [(50, "ab" * 400), (51, "x" * 199), (52, "x" * 200), (53, "x" * 201), (54, None), (55, ""), (56, line * 30), (57, noise(5) + line * 12 + noise(80))]
    rows += [(58, noise(250)), (None, noise(250))]
    rows += [(59, rows[-2][1]), (60, rows[3][1][10:] + "?"), (60, rows[3][1][10:] + "?"), (61, noise(700))]
    rows.append((62, rows[-1][1][100:450] + noise(20) + rows[-1][1][350:700]))
    return rows


@pytest.mark.parametrize(("piece", "group"), [(1 << 20, 1024), (64, 1024), (1 << 20, 4)])
def test_repeats(spark, monkeypatch, piece, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = repeat_rows()
    if piece == 64:
        for (i, t), expected in zip(rows, brute_repeats([t for _, t in rows])):
            monkeypatch.setattr(repeats, "PIECE", piece)
            text = (t or "").encode()
            starts = [k for s, e, _ in repeats.families(text) for a, b in zip(s, e) for k in range(a, b + 1)]
            assert starts == list(range(max(0, len(text) - 199)))
        return
    got = [tuple(r) for r in repeats.without_repeats(table(spark, rows)).collect()]
    expected = [(i, *e) for (i, _), e in zip(rows, brute_repeats([t for _, t in rows]))]
    assert Counter((r[0], *r[1:5], bytes(r[5])) for r in got) == Counter(expected)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, fp string, hash string, row string")
    for operator in (simhash.near_groups, exact.exact_groups, repeats.without_repeats):
        assert operator(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", "x", "y", "z")], empty.schema)
    for operator in (simhash.near_groups, exact.exact_groups, repeats.without_repeats):
        assert operator(odd).count() == 1

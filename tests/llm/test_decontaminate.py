"""Tolerant windows against brute force over all windows with ten agreeing tokens, whatever the masks."""

import itertools
import random

from barloom.llm import decontaminate


def agreeing(docs, items):
    """Pairs and their number of windows, without masks."""
    out = {}
    for d, t in docs:
        w = t.split()
        for i, u in items:
            v = u.split()
            n = sum(any(sum(map(str.__eq__, w[a : a + 12], v[b : b + 12])) >= 10 for b in range(len(v) - 11)) for a in range(len(w) - 11))
            if n:
                out[d, i] = n
    return out


def test_every_two_substitutions_are_found(spark):
    rng = random.Random(9)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (12, 15, 16, 18, 30)]
    docs = []
    for n, text in items:
        choices = list(itertools.combinations(range(n), 2)) if n == 12 else [rng.sample(range(n), rng.randrange(1, 5)) for _ in range(60)]
        for places in [*choices, (0,), (n - 1,)]:
            words = text.split()
            for k in places:
                words[k] = "other"
            docs.append((len(docs), " ".join(["before"] * rng.randrange(20) + words + ["after"] * rng.randrange(20))))
    left, right = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_windows"] for r in decontaminate.contaminated(left, right).collect()}
    assert got == agreeing(docs, items)
    assert all((d, 12) in got for d in range(68))


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["Word ", "ab_c ", "é", " ", "x1", ", "]) for _ in range(4000)) + "z" * 500
    whole = next(iter(decontaminate.token_blocks(text, 11)))[1].tolist()
    for piece in (1, 7, 300, 10_000):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert "".join(decontaminate.pieces(text)) == text
        assert next(iter(decontaminate.token_blocks(text, 11)))[1].tolist() == whole
    monkeypatch.setattr(decontaminate, "MEMORY", 3)
    assert next(iter(decontaminate.token_blocks(text, 11)))[1].tolist() == whole

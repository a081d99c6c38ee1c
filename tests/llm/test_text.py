"""Personal data, language, pages and benchmark passages against plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import decontaminate, html, language, pii
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_base(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def private_rows():
    rng = random.Random(3)
    alphabet = "ab1290.+-@ ()%_é漢😀:"
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))) for k in range(300)]
    rows += [
        (1000, None), (1001, ""), (1002, "x@y.z@w.v q@r.s_a@b.c"), (1003, "1.2.3.4.5.6.7.8 256.1.1.1 00010.1.1.1 9999999999.1.1.1"), (1004, "4111 1111 1111 1111, 4111-1111-1111-1112"),
        (1005, "+1 (269) 555-3296 4524132264652876 mail me"), (1005, "+1 (269) 555-3296 4524132264652876 mail me"), (None, "+49 30 1234567"),
        (1006, "a@b" + ".c" * 30_000 + " " + "9" * 50_000 + " 1.1.1.1"), (1007, " ".join(f"user{k}@host.example" for k in range(3000))),
    ]
    rows += [(2000 + k, f"text {k} bob.{k}@mail{k % 7}.example.com and +1 ({200 + k}) 555-{1000 + k} or 10.0.{k % 200}.{k % 99}") for k in range(120)]
    return rows


def test_personal_data(spark):
    rows = private_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.personal_data(docs).collect()
    assert len(found) == len(rows)
    expected = Counter((i, tuple((k, s, e) for k in pii.KINDS for s, e in brute_base(t)[k])) for i, t in rows)
    assert Counter((r["doc_id"], tuple((s["kind"], s["start"], s["stop"]) for s in r["base"])) for r in found) == expected
    texts = dict(rows)
    for r in found:
        spans = [(s["kind"], s["start"], s["stop"], s["value"]) for s in r["all_spans"]]
        assert {(s["kind"], s["start"], s["stop"], s["value"]) for s in r["base"]} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
        assert all(texts[r["doc_id"]][s[1] : s[2]] == s[3] for s in spans if r["doc_id"] is not None)
    added = next(r for r in found if r["doc_id"] == 1005)
    assert ("phone", 0, 17) in {(s["kind"], s["start"], s["stop"]) for s in added["all_spans"]}
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([("call 123 now", [(5, 8), (6, 9)]), ("é漢x", [(1, 2)]), ("", []), ("whole", [(0, 5)])], "t string, s array<struct<start:int,stop:int>>")
    assert [r[0] for r in df.select(pii.redact(F.col("t"), F.col("s"), "#")).collect()] == ["call ####now", "é#x", "", "#####"]


def brute_ranked(text, top):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        for n in range(1, language.GRAMS + 1):
            counts.update(g for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if g != " " and not (n > 2 and " " in g[1:-1]))
    return counts


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_gram_counts(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in ("The cat, the Hat; éàü 12 the3cat", "", "a", "...", "x" * 100, " ".join(random.Random(1).choice(["ab", "ba", "abba", "éa"]) for _ in range(200))):
        codes, counts = language.counted(text)
        wanted = brute_ranked(text, 10)
        assert sorted(counts.tolist()) == sorted(wanted.values())
        code_of = {int(language.gram_codes(np.array([0 if c == " " else ord(c) for c in g], np.uint32), len(g))[1][0]): n for g, n in wanted.items()}
        assert dict(zip(codes.tolist(), counts.tolist())) == code_of


def test_language(spark):
    rng = random.Random(4)
    vocabulary = {"xx": ["the", "thing", "other", "there", "of"], "yy": ["der", "die", "und", "nicht", "schön"], "zz": ["что", "это", "как", "и"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(3, 60))), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", "zz"), (1003, "there other", None), (None, "nicht und", "yy"), (1003, "there other", None), (1004, "the " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language.learn(docs)
    assert {r["lang"] for r in learned.select("lang").distinct().collect()} == {"xx", "yy", "zz"}
    known = language.profiles(learned)
    found = language.judged(docs.withColumn("lang_pred", F.lit("clash")), known).select("doc.doc_id", "doc.text", "doc.lang", "lang_pred", "score").collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["lang_pred"] == r["lang"]
    # Labels of the held-out part are not learned from.
    blind = docs.withColumn("lang", F.when(language.remainder(F.col("doc_id")) == 2, F.lit("qq")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language.learn(blind).collect())) == sorted(map(tuple, learned.collect()))
    assert language.profiles(language.learn(docs.limit(0))).judge("text") == ("und", 0.0)
    assert language.judged(docs.limit(0), known).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now</div><article><h1>Title &amp; more</h1>{}</article><footer>&copy; x</footer></body></html>"


def page_rows():
    rng = random.Random(9)
    words = ["river", "stone", "of", "the", "walked", "home", "quiet"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4, 25))) + "."
    rows = []
    for k in range(120):
        paragraphs = [sentence() for _ in range(rng.randrange(1, 8))]
        rows.append((k, PAGE.format("".join(f"<p>{p}</p>" for p in paragraphs)), "\n".join(["Title & more", *paragraphs])))
    return rows


def test_pages(spark):
    rows = page_rows()
    extra = [(500, None, ""), (501, "", ""), (502, "<script>only</script>", ""), (503, PAGE.format("<p>one\n two<br>three<p><b>four"), "Title & more\none two three\nfour"), (503, PAGE.format("<p>a < b</p>"), "Title & more\na < b")]
    extra.append((504, PAGE.format("<p>" + "word " * 50_000 + "</p>" + "<p>x.</p>" * 3000), "Title & more\n" + ("word " * 50_000).strip() + "\n" + "\n".join(["x."] * 3000)))
    pages = spark.createDataFrame([(i, None, h) for i, h, _ in rows + extra], "page_id bigint, url string, html string")
    network = html.train(html.training_pages(pages, "page_id", "html"))
    found = html.extract(pages, network).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in found) == Counter((i, t, len(t)) for i, _, t in rows + extra)
    assert html.extract(pages.limit(0), network).count() == 0


def test_held_out_variants():
    """Blocks of pages with other names for their parts, none of which was trained on."""
    pages = [p for _, p, _ in page_rows()]
    network = html.train(pages[:80])
    rng = np.random.default_rng(5)
    read = [html.blocks_of(p) for p in pages[80:]]
    others = [b for page in read for b in page]
    made = [html.variants(page, others, rng) for page in read]
    right = [a == b for (page, wanted), got in zip(made, html.label([m[0] for m in made], network, html.Reader())) for a, b in zip(wanted, got.tolist())]
    assert np.mean(right) > 0.97


def test_gradients():
    """Back propagation against differences."""
    rng = np.random.default_rng(0)
    network = html.Network.fresh()
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    x, back, real = html.padded([rng.random((n, html.INPUT)) for n in (3, 5)])
    wanted = rng.integers(0, 2, x.shape[:2]).astype(float)
    loss = lambda: float((np.logaddexp(0, network.answers(x, back)) - wanted * network.answers(x, back))[real].sum())
    grad = network.gradients(x, back, wanted, real.astype(float))
    for name, at in (("xf", (3, 5)), ("hb", (2, 7)), ("hf", (1, 40)), ("cb", (20,)), ("out", (4,)), ("bias", (0,))):
        value = network.weights[name][at]
        network.weights[name][at] = value + 1e-3
        up = loss()
        network.weights[name][at] = value - 1e-3
        assert grad[name][at] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=1e-4)
        network.weights[name][at] = value


def texts(page):
    return [b.text for b in html.blocks_of(page)]


def test_nothing_but_scripts_and_styles_is_lost():
    assert texts('<p>One <svg class="i"/> two <svg><title>x</title><path d="M0"/></svg> more.</p><p>Three.') == ["One two x more.", "Three."]
    assert texts("<p>a <svg viewBox='0'> never closed</p><p>rest</p><title>t</title>") == ["a never closed", "rest", "t"]
    assert texts("<p>Since <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p>") == ["Since E=m holds."]
    for name in ("canvas", "object", "noscript", "iframe", "template"):
        assert texts(f"<p>Before</p><{name} id=x>fallback<p>rest of article</p><p>end") == ["Before", "fallback", "rest of article", "end"]
        assert texts(f"<div>Before<{name}>inner <b>text</b></{name}>after</div>") == ["Before", "inner text", "after"]
        assert {b.path for b in html.blocks_of(f"<article><{name}>inner</{name}>after</article>")} == {("article",)}
    assert texts("a<script>var x = '<p>no</p>';</script>b<STYLE>p{}</Style >c<script src=x>") == ["abc"]
    assert texts("<p>a<script>never closed<p>kept<style>p{}</style><style>x") == ["anever closed", "keptx"]
    assert texts("<scripts>shown</scripts><styled>too</styled>") == ["showntoo"]


# Written by hand, like pages as they are found: no ``article`` and no ``main``.  m: main text, x: something else.
HAND = [
    """<html><body><div id="top"><a href="/">Daily Paper</a> <a href="/w">World</a></div> x
<div class="wrap"><div class="story-body"><h1>Bridge reopens after ten years</h1> m
<p>The old bridge over the river was opened again on Monday, ten years after the flood.</p> m
<p>Hundreds of people walked across it in the morning, and many had brought their children.</p> m
<div class="promo"><a href="/sub">Subscribe to our newsletter</a></div> x
<p>The mayor said that the work had cost less than had been feared.</p></div> m
<div class="sidebar"><ul><li><a href="/1">Ten best walks</a></li> x
<li><a href="/2">What to eat</a></li></ul></div></div> x
<div class="footer">Copyright Daily Paper. All rights reserved.</div></body></html> x""",
    """<html><body><table><tr><td class="menu"><a href="a">Start</a></td> x
<td><div class="post"><h2>How to sharpen a knife</h2> m
<p>Hold the blade at a low angle and draw it over the stone in long even strokes.</p> m
<ul><li>Use plenty of water, never oil, on a water stone.</li> m
<li>Count the strokes so that both sides get the same.</li></ul> m
<p>When a burr can be felt along the whole edge, turn to the finer stone.</p></div></td></tr></table> m
<div class="comments"><h3>Comments</h3> x
<p>Great tips, thank you!</p> x
<form><label>Your name</label> x
<button>Send</button></form></div></body></html> x""",
    """<body><div class="cookie-banner"><p>We use cookies to improve your visit.</p> x
<button>Accept</button></div> x
<div class="navbar"><ul><li><a href="/">Home</a></li> x
<li><a href="/about">About</a></li></ul></div> x
<div class="entry-content"><h1>A week on the island</h1> m
<p>We arrived late in the evening, when the harbour was already dark and the last boats had come in.</p> m
<blockquote>Nobody locks a door here, said the old man who met us.</blockquote> m
<p>The next day we walked around the whole coast, which takes about seven hours.</p></div> m
<div class="share"><a href="#">Share this</a></div> x
<div class="related"><h3>You may also like</h3> x
<p><a href="/x">Two days in the hills</a></p></div> x
<p class="copyright">Some rights reserved.</p></body> x""",
    """<html><body><div class="masthead">The Village Blog</div> x
<section class="content"><h1>Notes on growing beans</h1> m
<pre>row 1: early, row 2: late</pre> m
<p>Beans want warm soil, so there is nothing to be gained from sowing before the middle of May.</p> m
<noscript><p>A drawing of the bed is on the next page.</p></noscript> m
<p>Water them in the morning and pick often, and they will bear until the first frost.</p></section> m
<div class="ads"><p>Buy cheap seeds now!</p></div> x
<div class="disqus"><p>First comment by a reader.</p></div></body></html> x""",
]


def hand_made():
    """Page and, for each of its blocks, whether it is main text."""
    for text in HAND:
        lines = [line.rsplit(" ", 1) for line in text.split("\n")]
        yield "\n".join(part for part, _ in lines), [mark == "m" for _, mark in lines]


def test_hand_made_pages():
    """Pages that the generator of training pages did not make; at least nine blocks in ten are told right."""
    network = html.train([p for _, p, _ in page_rows()])
    right = []
    for page, wanted in hand_made():
        read = html.blocks_of(page)
        assert len(read) == len(wanted), [b.text for b in read]
        right += [bool(a) == b for a, b in zip(html.label([read], network, html.Reader())[0], wanted, strict=True)]
    print("hand-made pages:", sum(right), "of", len(right))
    assert np.mean(right) >= 0.9


def test_broken_markup_ends():
    for page in ("<script>" * 20_000, "<style>" * 10_000 + "</style>" * 2, "<canvas>" * 20_000, "<" * 20_000, "<a " * 20_000, "<p class=\"" * 5_000, "&am", "<!--", "<script", "a<b" * 10_000):
        html.blocks_of(page)


def brute_contaminated(docs, items):
    """All windows against all windows, by the number of tokens that agree."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = tokens(t)
        for i, u in items:
            v = tokens(u)
            span = min(len(v), 12)
            if not span:
                continue
            needed = {12: 10, 11: 9, 10: 8, 9: 8, 8: 7, 7: 6, 6: 5, 5: 4}.get(span, span)
            for b in range(len(v) - span + 1):
                if any(sum(map(str.__eq__, w[a : a + span], v[b : b + span])) >= needed for a in range(len(w) - span + 1)):
                    out.add((d, i))
                    break
    return out


def test_masks_ignore_every_choice_of_positions():
    for n in range(1, 13):
        masks = decontaminate.masks_of(n) if n < 12 else decontaminate.MASKS
        for off in itertools.combinations(range(n), n // 5):
            assert any(all(m[k] == "0" for k in off) for m in masks) and all(len(m) == n and "1" in m for m in masks)


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_decontamination(spark, monkeypatch, block):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "naïve"]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((12, 15, 20, 30, 5, 7, 11, 4, 0, 3, 8, 9, 10, 6))] + [(20, None), (21, "w1 w2 w3 w4 w5 w6 w7"), (21, "w9 " * 14)]
    docs = []
    for k in range(140):
        around = [rng.choice(words) for _ in range(rng.randrange(60))]
        passage = (items[k % 14][1] or "").split()
        for _ in range(rng.randrange(4)):
            if passage:
                passage[rng.randrange(len(passage))] = "other"
        docs.append((k, " ".join([*around, ", ".join(passage).upper() if k % 3 == 0 else " ".join(passage), *around[::-1]])))
    docs += [(100, None), (101, ""), (5, docs[5][1]), (102, items[3][1]), (103, ("w3 " * 5000) + items[2][1])]
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    if block == 40:
        assert np.concatenate([t[(11 if s else 0) :] for s, t in blocks(docs[10][1] * 20, 40)]).tolist() == next(iter(decontaminate.token_blocks(docs[10][1] * 20, 11)))[1].tolist()
        return
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(left, right).collect()}
    assert got == brute_contaminated(docs, items)
    named = decontaminate.contaminated(left.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), right.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text"))
    assert {(r["doc_id"], r["item_id"]) for r in named.collect()} == {(f"d{d}", f"i{i}") for d, i in got}
    judged = decontaminate.verdicts(left, right).collect()
    assert Counter(r["doc_id"] for r in judged) == Counter(d for d, _ in docs)
    assert all(r["contaminated"] == any(d == r["doc_id"] for d, _ in got) for r in judged)
    assert decontaminate.verdicts(left.limit(0), right).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.verdicts(left, right.limit(0)).collect())


def blocks(text, size):
    saved, decontaminate.BLOCK = decontaminate.BLOCK, size
    try:
        return list(decontaminate.token_blocks(text, 11))
    finally:
        decontaminate.BLOCK = saved

"""Mixing, shards, url rules and the whole pipeline against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing, sharding, urls
from tests.llm.test_similar import jaccard, shingles
from tests.llm.test_text import brute_contaminated


def md5_share(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def brute_mix(rows):
    """doc_id, size, source_size, target, copies for rows of (doc_id, text, source)."""
    sizes = [(i, len((t or "").encode().split()), s) for i, t, s in rows]
    sources = sorted({s for _, _, s in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, x in sizes if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    capped, target = set(), {}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        shares = sum(weight[s] for s in sources if s not in capped)
        target = {s: 3 * total[s] if s in capped else rest * weight[s] / shares for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 3 * total[s] * (1 + 1e-12)}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        rate = target[s] / total[s] if total[s] else 0.0
        own = sorted(((n, i) for i, n, x in sizes if x == s), key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        tried = []
        for draw in range(mixing.OFFSETS):
            u = md5_share(f"{mixing.SEED}/{draw}/" + ("n" if s is None else "a" + s), 13) / 16**13
            copies = [int(rate * k + u) - int(rate * (k - 1) + u) for k in range(1, len(own) + 1)]
            tried.append((abs(sum(n * c for (n, _), c in zip(own, copies)) - target[s]), draw, copies))
        out += [(i, n, total[s], target[s], c) for (n, i), c in zip(own, min(tried)[2])]
    return out


def mix_rows():
    rng = random.Random(8)
    rows = []
    for k in range(600):
        source = ("hot" if k % 3 == 0 else rng.choice(["a", "b", "c", "é", "z", None, ""]))
        rows.append((k, " ".join(["w"] * rng.randrange(1, 200)), source))
    rows += [(700, None, "a"), (701, "", "b"), (702, "x " * 5000, "hot"), (5, rows[5][1], rows[5][2]), (None, "one two", "c"), (703, None, "empty")]
    return rows


def test_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = [tuple(r) for r in mixing.mix_counts(docs).collect()]
    near = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert Counter(map(near, got)) == Counter(map(near, brute_mix(rows)))
    taken, target, largest = Counter(), {}, Counter()
    for _, size, source_size, wanted, copies in got:
        assert 0 <= copies <= 3
        taken[source_size] += size * copies
        target[source_size] = wanted
        largest[source_size] = max(largest[source_size], size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    copies = Counter()
    for r in got:
        copies[r[0]] += r[4]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert mixing.mix_counts(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_shards(spark, tmp_path):
    names, size = ["x", "y", "z"], 101
    owner = sharding.lookup_table(names, size)
    # Every shard walks its permutation in turn.
    claims, turns = [-1] * size, [iter([(md5_share(f"{n}/offset", 15) % size + k * (md5_share(f"{n}/skip", 15) % (size - 1) + 1)) % size for k in range(size)]) for n in names]
    for turn in range(size):
        slot = next(s for s in turns[turn % 3] if claims[s] < 0)
        claims[slot] = turn % 3
    assert owner == claims and max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    moved = sum(a != b and a != 2 for a, b in zip(owner, sharding.lookup_table(names[:2], size)))
    assert moved < size // 3
    docs = spark.createDataFrame([(k, "t", "old") for k in range(300)] + [(None, None, None), (7, "t", "old")], "doc_id bigint, text string, shard string")
    placed = sharding.place(docs, names=names, size=size)
    rows = placed.collect()
    assert len(rows) == 302 and placed.columns.count("shard") == 1
    for r in rows:
        slot = md5_share("" if r["doc_id"] is None else str(r["doc_id"]), 15) % size
        assert (r["slot"], r["shard"]) == (slot, owner[slot])
    sharding.write_shards(docs, str(tmp_path / "out"), names=names, size=size)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 302
    assert sharding.place(docs.limit(0)).count() == 0
    for bad in ((names, 100), (["a", "a"], 7), ([], 7), (names, 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rng = random.Random(6)
    hosts = ["org", "example.org", "www.example.org", "example-x.org", "com", "a.com", "b.a.com", "COM", "notorg", "é.com", "x..com", "org:80", ""]
    urls_in = [f"{rng.choice(['http', 'https', 'x:'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/1', '/en/12', '/fr/', '/de/x', '/q'])}{rng.choice(['', '?a=/b', '#t', '?x://y/z'])}" for _ in range(400)]
    urls_in += [None, "", "nothing", "://", "http://" + "s." * 3000 + "org/es/", "a\nb://example.org/es/\n"] + ["http://hot.example.org/es/1"] * 300
    pages = spark.createDataFrame([(k % 500, u, 1) for k, u in enumerate(urls_in)], "page_id bigint, url string, key int")
    more = [("", "/q", "block"), ("a.com", "/", "block"), ("b.a.com", "/de/", "allow"), ("a.com", "/de/x", "block")]
    for rules in (list(urls.RULES), list(urls.RULES) + more):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = Counter(tuple(r) for r in urls.judge_urls(pages, table).collect())
        assert got == Counter((k % 500, *brute_url(u, rules)) for k, u in enumerate(urls_in))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge_urls(pages, none).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), table).count() == 0


def corpus():
    rng = random.Random(12)
    english = ["the", "river", "of", "stone", "walked", "home", "quiet", "and"]
    german = ["der", "fluss", "und", "stein", "ging", "nach", "hause", "schön"]
    items = [(k, " ".join(f"q{rng.randrange(500)}" for _ in range(20))) for k in range(4)]
    rows = []
    for k in range(300):
        lang = ("en", "de")[k % 2]
        text = " ".join(rng.choice((english, german)[k % 2]) + str(rng.choice(["", "s", "ed", "er"])) for _ in range(80))
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    for k in range(300, 360):
        i, text, lang, source, _ = rows[k % 40]
        if k % 2:
            words = text.split()
            words[rng.randrange(80)] = "other"
            text = " ".join(words)
        rows.append((k, text, lang, source, len(text)))
    for k in range(360, 370):
        text = rows[k - 300][1] + " " + items[k % 4][1] + " " + rows[k - 290][1]
        rows.append((k, text, "en", "s1", len(text)))
    rows += [(400, None, "en", "s0", 0), (401, "", "de", None, 0), (402, "12 34 !!", "en", "s2", 8), rows[3]]
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)

    kept = [tuple(r) for r in stages["language"](spark, docs, str(tmp_path)).collect()]
    assert Counter(kept) == Counter(r for r in rows if r[0] < 400)

    alone = stages["near_copies"](spark, spark.createDataFrame(kept, schema), str(tmp_path)).collect()
    # All pairs of five-word shingle sets; 0.8 or more is near, and of what hangs together the smallest id stays.
    sets = [shingles(r[1]) for r in kept]
    root = list(range(len(kept)))
    for j in range(len(kept)):
        for k in range(j):
            if root[j] != root[k] and jaccard(sets[j], sets[k]) >= 0.8:
                old, new = root[j], root[k]
                root = [new if x == old else x for x in root]
    groups = defaultdict(list)
    for r, at in zip(kept, root, strict=True):
        groups[at].append(r[0])
    assert sorted(r["doc_id"] for r in alone) == sorted(min(g) for g in groups.values())
    assert {tuple(r) for r in alone} <= set(kept) and len(groups) <= len(kept) - 50

    clean = stages["decontamination"](spark, spark.createDataFrame(alone, schema), str(tmp_path)).collect()
    bad = {d for d, _ in brute_contaminated([(r["doc_id"], r["text"]) for r in alone], items)}
    assert bad and sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in alone if r["doc_id"] not in bad)

    expected = Counter({r[0]: r[4] for r in brute_mix([(r["doc_id"], r["text"], r["source"]) for r in clean]) if r[4]})
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == [*docs.columns, "slot", "shard"] or set(final.columns) == {*docs.columns, "slot", "shard"}
    out = final.collect()
    assert Counter(r["doc_id"] for r in out) == expected
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]] == r["text"] and 0 <= r["shard"] < sharding.SHARDS for r in out)


def test_decontamination_hands_on_all_columns(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(14)))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(k, "clean words" if k % 2 else "so " + " ".join(f"q{k}" for k in range(14)), k, "p", 3, "d") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key bigint, print string, name int, doc string")
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == [r for r in rows if r[0] % 2]


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string"
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = spark.createDataFrame([(None, None, None, None, None, "a"), (None, "some words here now", None, None, None, None), (1, "", "en", "s", 0, "b")] * 2, schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd.limit(0), odd):
            out = stage(spark, df, str(tmp_path))
            if name != "sharding":
                assert out.columns == df.columns
            assert out.count() == {"language": 2, "near_copies": 2, "decontamination": 6, "sharding": 6}.get(name, out.count()) * (1 if df is odd else 0)

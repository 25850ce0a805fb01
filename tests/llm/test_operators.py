"""Corpus operators on small fixtures: against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, decontam, graph, licenses, mixing, ngram_join, quality, substring, topk, toxicity, urls
from tessella.llm.words import Chunk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, _at int, score string, copies string"


def docs_of(spark, texts, sources=None, ids=None):
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", s, None, 7, 1, "x", "y") for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (40, 60, 90, 200, 400, 3000)]
    out = [None, "", " \t\n", "one", "ONE", "two words", "tWo  words", *base]
    for t in base:
        words = t.split()
        for changes in (1, 3, len(words) // 40, len(words) // 12):
            w = list(words)
            for i in rng.sample(range(len(w)), changes):
                w[i] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
        out += [t, t.upper(), t + "\x85end"]
    passage = prose(rng, 60)
    out += [f"{prose(rng, 30)} {passage} {prose(rng, n)}" for n in (0, 5, 50)] + ["was " * 50, "was " * 36 + "is", prose(rng, 34), "é\x0bü\x1cz " * 20]
    return out


def brute_near(texts, ids):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return sorted(((ids[i], len(s), min(least[find(i)], default=None)) for i, s in enumerate(sets)), key=repr)


def test_near_copies_equal_brute_force(spark, texts):
    ids = list(range(len(texts)))
    ids[10], ids[11] = None, 3
    got = ngram_join.near_duplicates(spark, docs_of(spark, texts, ids=ids)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(texts, ids)


def test_many_near_copies_stay_one_component(spark):
    """A hot group whose members are pairwise near, and a chain that only neighbours link."""
    rng = random.Random(8)
    base = prose(rng, 120).split()
    hot = []
    for _ in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        hot.append(" ".join(w))
    chain, w = [], prose(rng, 100).split()
    for _ in range(14):
        chain.append(" ".join(w))
        w = w[8:] + prose(rng, 8).split()
    every = hot + chain
    ids = list(range(len(every)))
    got = ngram_join.near_duplicates(spark, docs_of(spark, every)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(every, ids)


@pytest.mark.parametrize("hot, tile, shingles", [(3, 8, 1 << 21), (2, 512, 600), (10**9, 8, 1 << 21)])
def test_near_copies_in_small_tiles(spark, texts, monkeypatch, hot, tile, shingles):
    """Hot keys and tiles of several blocks, by number and by size, in several tasks, give the same links."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", shingles)
    rng = random.Random(18)
    base = prose(rng, 120).split()
    every = list(texts)
    for i in range(70):  # from near to far, so that groups meet under one lead without all being linked
        w = list(base)
        for j in rng.sample(range(120), 1 + i % 9):
            w[j] = f"y{rng.randrange(10**6)}"
        every.append(" ".join(w[: 120 - i % 40]))
    ids = list(range(len(every)))
    got = ngram_join.near_duplicates(spark, docs_of(spark, every).repartition(5)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(every, ids)


def test_one_of_each_keeps_columns_and_one_row(spark):
    texts = ["a b c d e f"] * 3 + ["a b c d e f", "g h i j k l", None, None, ""]
    docs = docs_of(spark, texts, ids=[5, 5, 9, 4, 6, 1, 2, 3])
    kept = ngram_join.one_of_each(spark, docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 2, 3, 3, 4, 6]  # rows without words are linked with nothing
    assert ngram_join.one_of_each(spark, docs.limit(0)).count() == 0


def test_signatures_bound_differences():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64)) for n in (3, 200, 300, 400, 1000)]
    sets.append(np.sort(np.concatenate([sets[3][:380], sets[2][:20]])))
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    signs = ngram_join.Signatures(ngram_join.signatures(doc, np.concatenate(sets), np.array([len(s) for s in sets])))
    for p in range(len(sets)):
        for q in range(len(sets)):
            least = signs.differences(np.array([p]), np.array([q]))[0]
            assert 0 <= least <= len(np.setxor1d(sets[p], sets[q]))
    assert signs.differences(np.array([2]), np.array([3]))[0] > 100


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in links)}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, texts):
    docs = docs_of(spark, texts)
    got = substring.remove_repeats(spark, docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts)
    assert substring.remove_repeats(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_random_collages(spark, seed):
    """Few words, short windows: anchors tie and branch all the time."""
    rng = random.Random(seed)
    parts = [[f"{rng.randrange(6)}" for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randrange(1, 6)) for w in rng.choice(parts)) for _ in range(25)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(spark, docs_of(spark, texts), 7, 3).collect()}
    assert [got[i] for i in range(25)] == brute_repeats(texts, 7)


@pytest.mark.parametrize("bits", (14, 7, 3))
def test_repeats_with_forced_collisions(spark, texts, bits):
    """With hashes of a few bits different windows are taken for one edge; their words decide."""
    rng = random.Random(bits)
    base = [prose(rng, 70) for _ in range(6)]
    every = texts + base + [f"{prose(rng, 20)} {base[i % 6]} {prose(rng, 30)}" for i in range(9)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(spark, docs_of(spark, every), hash_bits=bits).collect()}
    assert [got[i] for i in range(len(every))] == brute_repeats(every)


def test_repeats_leave_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {passage} b", "x", 5, None), (2, f"{passage} c", "y", None, 7), (None, None, None, None, None)], "doc_id long, text string, n_words string, kept_sha256 int, _row long")
    got = substring.without_repeats(spark, docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a b", "x", 5, None), (2, "c", "y", None, 7), (None, None, None, None, None)], key=repr)
    assert substring.without_repeats(spark, docs.limit(0)).count() == 0


def test_words_are_the_contract_s(texts):
    c = Chunk([None if t is None else t.encode() for t in texts], False)
    want = [[w.encode() for w in WORD.findall(t or "")] for t in texts]
    assert [[c.data[s:e] for s, e in zip(c.start[a:b], c.end[a:b], strict=True)] for a, b in zip(c.first, c.first[1:], strict=False)] == want


def test_mix(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(300)] + [None, "", "tie tie", "tie tie"]
    sources = [["b", "a", None, "c", "é"][min(4, int(rng.expovariate(1)))] for _ in texts]
    ids = [*range(300), 300, 301, 302, 302]
    docs = docs_of(spark, texts, sources, ids)
    rows = mixing.mix(spark, docs).collect()
    assert len(rows) == len(texts) and all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies_taken"] for r in rows)
    budget, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - budget) < 1e-6
    for s in set(sources):
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - next(r["target"] for r in rows if r["source"] == s)) <= 2 * longest
    again = mixing.mix(spark, docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    taken = mixing.mixed_documents(spark, docs)
    assert taken.columns[-1] == "copies" and sum(r["copies"] > 0 for r in taken.collect()) == taken.count()


def test_shares():
    assert mixing.shares([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    assert mixing.shares([10, 1000, 0], [3, 1, 2], 3) == [30, 980, 0]
    assert mixing.shares([0], [1], 3) == [0.0] and mixing.shares([], [], 3) == []


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = [list(map(float, rng.normal(size=8))) for _ in range(260)]
    vectors[40:90] = [vectors[40]] * 50
    vectors[3], vectors[4], vectors[5], vectors[6], vectors[20] = None, [None, *vectors[4][1:]], [float("nan")] * 8, [float("inf")] * 8, [0.5] * 5
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(60, vectors[60], 2), (None, vectors[1], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = topk.top_k(spark, table, "vec_id % 20 = 0", k=7)
    q = [(i, n, np.floor(64 * np.array(v)).astype(int)) for n, (i, v, _) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    pad = lambda x: np.pad(x, (0, 8 - len(x)))
    want = []
    for i, n, v in q:
        if i % 20 == 0:
            best = sorted((-int(pad(v) @ pad(w)), j) for j, m, w in q if m != n)[:7]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = topk.top_k(spark, table.where("vec_id < 10"), "vec_id % 20 = 0", k=7)
    assert few.count() == 5
    assert topk.top_k(spark, table.limit(0), "vec_id % 20 = 0").count() == 0


def test_top_k_with_large_components(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, -2.0]), (2, [-1e12, 3.0]), (3, [0.0, 1e30])]
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", k=2, scale=1.0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3] and got[0]["score"] == topk.LONG


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a </s><text> & &lt; [x]"), (1, 1, "user", "more<sep>"), (1, 2, "assistant", "yes</s>é"), (1, 3, "assistant", None), (1, 4, None, "none"),
            (2, 1, "assistant", "later"), (2, 0, "sys<tem", "first"), (None, 0, "user", "x"), (3, 0, "assistant", ""), (4, 0, "user", "same"), (4, 0, "user", "same")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(table).select("conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
        by[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == by
    assert {r["conv_id"]: r["loss"] for r in out} == {c: "".join(x for role, x in t if role == "assistant") for c, t in by.items()}
    first = next(r for r in out if r["conv_id"] == 1)
    assert first["formatted"].count(chat.RUN) == 3 and first["formatted"].count(chat.NEXT) == 2  # adjacent turns of one role are one run
    assert chat.format_chats(table.limit(0)).count() == 0


def test_urls(spark):
    cases = [("http://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("https://x.org/en/1", "x.org", "/en/1", "org/", "allow"),
             ("http://y.com/fr/2", "y.com", "/fr/2", "com/fr/", "allow"), ("http://notcom/de/1", "notcom", "/de/1", None, None), ("http://y.com/de/", "y.com", "/de/", "com/de/", "block"),
             ("http://org", "org", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://h.net?q=/x", "h.net", "", None, None), ("http://É.NET/a\nb", "É.net", "/a\nb", None, None)]
    table = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    for r in urls.judge_urls(table).collect():
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert urls.judge_urls(table.limit(0)).count() == 0
    ties = (("block", "a.org", "/"), ("allow", "org", "/xy"), ("block", "org", "/"))
    for rules, want in ((ties, ("a.org/", "block")), ((ties[1], ties[0], ties[2]), ("org/xy", "allow"))):
        r = urls.judge_urls(spark.createDataFrame([(0, "http://a.org/xy")], "page_id long, url string"), rules=rules).first()
        assert (r["rule"], r["verdict"]) == want


def test_url_model_on_held_out_labels():
    hits = 0
    for part in range(4):
        model = urls.train([u for i, u in enumerate(urls.UNWANTED) if i % 4 != part], [u for i, u in enumerate(urls.WANTED) if i % 4 != part])
        key = lambda u: urls.UrlModel.key(*urls.split_text(u))
        hits += (model.score([key(u) for i, u in enumerate(urls.UNWANTED) if i % 4 == part]) >= 0.5).sum() + (model.score([key(u) for i, u in enumerate(urls.WANTED) if i % 4 == part]) < 0.5).sum()
    assert hits / (len(urls.UNWANTED) + len(urls.WANTED)) >= 0.8


def test_licenses(spark):
    texts = ["Released under the MIT License.\nBody text that is long enough to be no licence at all.", "licensed under the apache LICENSE version 2 0", "Licensed under CC BY-NC 4.0.", None, "", "the the the",
             "Released under the\nMIT License.", "x " * 5000, "Released under the MIT License. " * 2]
    got = sorted(tuple(r) for r in licenses.scan_licenses(docs_of(spark, texts)).collect())
    assert [(g[0], g[1], g[2]) for g in got] == [(0, 0, "MIT"), (1, 0, "Apache-2.0"), (2, 0, "CC-BY-NC-4.0"), (6, -1, "MIT"), (8, 0, "MIT")]
    assert got[0][3] == 1.0 and got[-1][3] == round(2 * 4 / (4 + 5), 6)
    assert licenses.scan_licenses(docs_of(spark, texts).limit(0)).count() == 0


def test_licenses_wrapped_and_embedded(spark):
    rng = random.Random(3)
    notice = dict(licenses.TEMPLATES)["MIT-notice"]
    wrapped = notice.replace("to any person ", "to any person\n")
    gpl = "This work is licensed under the GNU General\nPublic License, version 3."
    said = "Copyright 2020 The Authors. Released under the MIT License. See the file for details."
    lesser = "This work is licensed under the GNU Lesser\nGeneral Public License,\nversion 3."
    texts = [f"{prose(rng, 60)}\n{wrapped}\n{prose(rng, 60)}", f"{prose(rng, 60)}\n{gpl} {prose(rng, 9)}", f"{prose(rng, 70)}\n{said}\n{prose(rng, 9)}", f"{prose(rng, 40)} {lesser} {prose(rng, 40)}",
             f"Licensed under CC BY 4.0.\n{prose(rng, 30)}\n{wrapped}", f"{prose(rng, 30)} {said} {prose(rng, 30)} Released under the BSD 3-Clause License. {prose(rng, 30)}", f"{prose(rng, 300)} to any person under the {prose(rng, 30)}",
             f"x {said}\n" * 3 + prose(rng, 50), "Released under the MIT License. " * 3000, None, "", "the", "the the\n" * 50]
    got = sorted(tuple(r) for r in licenses.scan_licenses(docs_of(spark, texts)).collect())
    assert [g[:3] for g in got] == [(0, 1, "MIT-notice"), (1, 1, "GPL-3.0"), (2, 1, "MIT"), (3, 0, "LGPL-3.0"), (4, 0, "CC-BY-4.0"), (4, 2, "MIT-notice"), (5, 0, "BSD-3-Clause"), (5, 0, "MIT"), (7, 0, "MIT"), (7, 1, "MIT"), (7, 2, "MIT"), (8, 0, "MIT")]
    assert all(g[3] == 1.0 for g in got if g[0] != 8)


def test_decontamination(spark):
    rng = random.Random(9)
    item = [f"q{i}" for i in range(40)]
    worn = list(item)
    worn[7], worn[20], worn[33] = "a", "b", "c"
    texts = [f"{prose(rng, 50)} {' '.join(item)} {prose(rng, 50)}", " ".join(worn).upper(), " ".join(item[10:30]), prose(rng, 300), " ".join(item[:9]), None, "", f"{' '.join(item[:8])} {prose(rng, 30)}", "\t".join(item)]
    items = spark.createDataFrame([(1, " ".join(item), "z"), (2, "too short to find", "z"), (3, None, "z")], "item_id long, text string, doc_id string")
    docs = docs_of(spark, texts)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark, docs, items).collect()) == [(0, 1), (1, 1), (2, 1), (8, 1)]
    kept = decontam.clean_documents(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert decontam.contaminated(spark, docs.limit(0), items).count() == 0 and decontam.contaminated(spark, docs, items.limit(0)).count() == 0


def test_seeds_hit_every_accepted_span(spark):
    """All places of up to two substitutions in 11 to 24 words, then documents against alignments without any mask."""
    for n in range(decontam.SHORTEST, 25):
        for gone in combinations(range(n), 2):
            if n <= decontam.WINDOW or gone[1] - gone[0] < decontam.WINDOW:
                assert any(all(c == "0" or i + k not in gone for k, c in enumerate(m)) for m in decontam.COVER for i in range(n - len(m) + 1)), (n, gone)
    assert all(m.startswith(decontam.PAIR) and "0" in m and 5 <= m.count("1") <= 7 for m in decontam.COVER)
    rng = random.Random(21)
    items, texts = [[f"q{n}x{i}" for i in range(n)] for n in (1, 4, 10, 11, 12, 15, 17, 30)], []
    for item in items:
        for gone in [(), *combinations(range(len(item)), 1), *combinations(range(min(len(item), 17)), 2)]:
            worn = " ".join(f"z{i}" if i in gone else w for i, w in enumerate(item))
            texts += [worn, f"{prose(rng, 20)} {worn} {prose(rng, 20)}"]
    texts += [f"{' '.join(items[-1][-11:])} {prose(rng, 9)}", " ".join("z" if i in (3, 7) else w for i, w in enumerate(items[-1][-11:])) + " end", "start " + " ".join("z" if i in (3, 7) else w for i, w in enumerate(items[-1][:11]))]

    def brute(words, item):
        best = 0
        for shift in range(-len(item) + 1, len(words)):
            e = [words[shift + i] == w for i, w in enumerate(item) if 0 <= shift + i < len(words)]
            most = max(sum(e[s : s + 15]) for s in range(max(len(e) - 14, 1)))
            good = most == len(item) if len(item) < 11 else len(e) >= 11 and most >= min(len(e), 15) - 2
            best = max(best, most if good else 0)
        return best

    want = {(d, i, a) for d, t in enumerate(texts) for i, item in enumerate(items) if (a := brute(t.split(), item))}
    got = decontam.contaminated(spark, docs_of(spark, texts), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want
    few = decontam.contaminated(spark, docs_of(spark, texts), spark.createDataFrame([(7, " ".join(items[7]))], "item_id long, text string"))
    assert {tuple(r) for r in few.collect()} == {w for w in want if w[1] == 7}


def labelled(spark):
    """Documents and labels of the test tables, with some awkward rows."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-5, ""), (-6, None), (-7, "x"), (-7, "x")], "doc_id long, text string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 0), (-5, None, None)], "doc_id long, quality int, toxic int"))


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    got = quality.rank_quality(spark, docs, labels)
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> cast(score >= 0.3 as int)").count() == 0
    told = got.where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").toPandas()
    bad, good = told[told.quality == 0].score, told[told.quality == 1].score
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert (told.predicted == told.quality).mean() > 0.93
    assert quality.rank_quality(spark, docs.limit(3), labels.limit(0)).where("score = 0.3 AND predicted = 1").count() == 3
    assert quality.rank_quality(spark, docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    got = toxicity.grade_toxicity(spark, docs, labels)
    assert got.count() == docs.count() and got.where("severity IS NULL OR severity < 0 OR severity > 2").count() == 0
    told = got.where("held_out").join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("label IS NOT NULL").toPandas()
    assert (told.toxic == told.label).mean() > 0.9
    assert toxicity.grade_toxicity(spark, docs.limit(0), labels).count() == 0
    assert toxicity.grade_toxicity(spark, docs.limit(3), labels.limit(0)).count() == 3

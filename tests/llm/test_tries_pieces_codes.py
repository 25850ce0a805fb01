"""Prefix trie, piece encoding and vector codes against plain Python, with nulls, empty and long rows, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import floor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import codes, pieces, queries, trie

TURNS = "conv_id long, turn long, role string, text string, pos long, owner string, depth int, _run int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 1, 2) for r in rows], TURNS)


def ordered(rows):
    """conversation -> [(role, text)] by turn, null first, then role, then MD5 of the text."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in by.items()}


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out, totals = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, saved + sum(totals[k][1] for k in kids[p]))
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn > 2 else "user", rng.choice(["a", "b", "é" * 3]) if turn < 4 else rng.choice(["x", "y"])))
    return rows


AWKWARD = [(-7, 0, "user", "a"), (-7, 0, None, None), (-7, None, "user", "first"), (100, 1, "user", "t"), (100, 1, "user", "s"), (100, 1, "user", "s"), (None, 0, "user", "a"), (101, 0, None, ""), (102, 0, "", None), (103, 0, "user", "long " * 40_000), (104, 0, "user", "long " * 40_000), (104, 1, "b", "c")]


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = conversations(rng, 60) + AWKWARD
    got = trie.build(spark, trie.numbered(spark, turns_of(spark, rows).repartition(7))).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(ordered(rows))


def test_trie_of_one_hot_conversation_and_many_copies(spark, monkeypatch):
    """One conversation holds most rows and spans tasks; many are equal; ids of one node come in several blocks; one without turns exists."""
    monkeypatch.setattr(trie, "BLOCK_IDS", 7)
    rows = [(5, i, "user", f"t{i % 3}") for i in range(700)] + [(5000 + c, i, "user", f"t{i % 3}") for c in range(80) for i in range(3)] + [(6000 + c, i, "user", f"t{i % 3}") for c in range(40) for i in range(c)]
    turns = trie.numbered(spark, turns_of(spark, rows).repartition(9))
    numbers = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] for r in numbers)
    convs = ordered(rows) | {3: [], 8000: []}
    got = trie.build(spark, turns, spark.createDataFrame([(c,) for c in [*convs, None]], "conv_id long")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(convs)


def test_trie_of_nothing(spark):
    none = turns_of(spark, [])
    assert trie.build(spark, trie.numbered(spark, none)).count() == 0
    only = trie.build(spark, trie.numbered(spark, none), spark.createDataFrame([(4,), (2,)], "conv_id long")).collect()
    assert sorted(map(tuple, only)) == brute_trie({2: [], 4: []})


def test_trie_hangs_in_many_levels(spark):
    """Each conversation leaves the one before one turn later, so chains hang on chains, as many levels as there are conversations."""
    rows = [(c, i, "user", "same" if i < c else f"own{c}") for c in range(20, 0, -1) for i in range(c + 1)]
    got = trie.build(spark, trie.numbered(spark, turns_of(spark, rows))).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(ordered(rows))


def test_running_sums_span_tasks(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(-(2**63), 2**63), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, v long, n long").repartition(11)
    want, sums = {}, defaultdict(lambda: [0, 0])
    for g, i, v, n in sorted(rows):
        sums[g] = [(sums[g][0] + v + 2**63) % 2**64 - 2**63, sums[g][1] + n]
        want[g, i] = tuple(sums[g])
    got = trie.running(spark, df, "g", ["i"], ["v", "n"]).collect()
    assert {(r["g"], r["i"]): (r["v"], r["n"]) for r in got} == want and len(got) == 3000


def test_rebuilt_conversations_equal_brute_force(spark, tmp_path):
    rows = [r for r in conversations(random.Random(11), 90) if r[0] % 5 or r[0] % 3] + AWKWARD
    turns_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = ordered(rows)

    def rebuilt(c):
        h = zlib.crc32(str(c).encode()) % 9
        return own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:]

    got = queries.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie({c: rebuilt(c) for c in own})


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


def strings(rng):
    letters = "ab  ▁▁c<0x41>é\U0001f600中文\0\t\n</s>thing the \x85"
    made = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(300)]
    return [None, "", " ", "   ", "▁", "</s><s><unk>", "<0x41>", " " * 5000, "a" * 9000, "é" * 41, "the thing " * 30_000, *made, "same", "same"]


def test_pieces_equal_the_library(spark, model, library, monkeypatch):
    """All rows, with segments forgotten and long texts cut often, against the library, without the operator's own check."""
    monkeypatch.setattr(pieces, "PART_CHARS", 3000)
    texts = strings(random.Random(6))
    docs = spark.createDataFrame([(i, t, "old", "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, _text string").repartition(3)
    got = pieces.encode(spark, docs, model, check=False)
    assert got.columns == ["doc_id", "_text", "ids"]
    for r in got.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
    for r in pieces.decode(spark, got, model, check=False).collect():
        assert r["text"] == library.decode(library.encode(texts[r["doc_id"]] or ""))
    both = pieces.round_trip(spark, docs.withColumnRenamed("_text", "other"), model, check=False)
    assert both.columns == ["doc_id", "other", "ids", "decoded"]
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in both.collect()} == {i: (x := library.encode(t or ""), library.decode(x)) for i, t in enumerate(texts)}
    assert pieces.encode(spark, docs.limit(0), model).count() == pieces.decode(spark, got.limit(0), model).count() == 0


def test_decoding_any_ids_equals_the_library(spark, model, library):
    rng = random.Random(7)
    rows = [[rng.randrange(0, rng.choice([3, 300, 32_000])) for _ in range(rng.randrange(12))] for _ in range(400)]
    got = pieces.decode(spark, spark.createDataFrame([(i, x) for i, x in enumerate([*rows, None])], "i long, ids array<int>"), model).collect()
    assert {r["i"]: r["text"] for r in got} == dict(enumerate([library.decode(x) for x in rows] + [""]))
    with pytest.raises(Exception, match="vocabulary doesn't have"):
        pieces.decode(spark, spark.createDataFrame([([32_000],)], "ids array<int>"), model).collect()


def test_a_difference_from_the_library_is_an_error(spark, model, monkeypatch):
    voc = pieces.vocabulary(open(model, "rb").read())
    assert voc.alone("▁thing") == voc.encoded(["▁thing"])[0].tolist()
    docs = spark.createDataFrame([("some text",)], "text string")
    held = pieces._library(open(model, "rb").read())
    other = type("Other", (), {"encode": lambda self, t, num_threads: [[*x, 5] for x in held.encode(t)], "decode": lambda self, x: held.decode(x) + "!"})()
    monkeypatch.setattr(pieces, "_library", lambda data: other)
    monkeypatch.setattr(pieces, "map_arrow", lambda df, f, schema: f)
    with pytest.raises(ValueError, match="differ from the library"):
        list(pieces.encode(spark, docs, model)(iter([pa.RecordBatch.from_pydict({"_text": ["some text"]})])))
    with pytest.raises(ValueError, match="differs from the library"):
        list(pieces.decode(spark, spark.createDataFrame([([5],)], "ids array<int>"), model)(iter([pa.RecordBatch.from_pydict({"ids": pa.array([[5]], pa.list_(pa.int32()))})])))


def test_passages_are_encoded_as_whole_texts(model, library, monkeypatch):
    """What the operator compares with is what the library makes of whole texts, also where passages are very short."""
    voc = pieces.vocabulary(open(model, "rb").read())
    texts = [t or "" for t in strings(random.Random(16))] + ["a  b ", "a b ", " a", "a ▁ b c", "▁ ▁ ", "x" * 300 + " "]
    for size in (1, 7, 100):
        monkeypatch.setattr(pieces, "PASSAGE", size)
        for t in texts:
            assert [i for p in pieces._passages([t], voc) for i in library.encode(p)] == library.encode(t), t[:50]


@pytest.mark.parametrize("segment", ["thethethe" * 3, "aaaaaaaaaaaaaaaa", "▁▁▁▁▁▁▁word", "中x中"])
def test_agendas_agree(model, segment):
    """The heap's agenda and the one of many segments at once take the same steps."""
    voc = pieces.vocabulary(open(model, "rb").read())
    (rows, symbols), *_ = [x for x in voc.together([segment, segment])]
    assert symbols.tolist() == [voc.alone(segment)] * 2 and rows.tolist() == [0, 1]


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v):
            kept.append((vec_id, [floor(scale * x) for x in v], label))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, (v + [0] * parts * width)[: parts * width], label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[tuple(v[p * width : (p + 1) * width]) for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                own[nearest(p, x)[1]].append(x)
            for k, xs in own.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = []
    for vec_id, v, label in kept:
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((vec_id, label, [k for _, k in found], min(sum(d for d, _ in found), codes.LONG)))
    return sorted(out, key=repr), books


VECTORS = "vec_id long, embedding array<double>, label int, uid long, pos int, codes string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("entries, rounds", [(4, 2), (64, 2), (3, 0), (1, 5)])
def test_codes_equal_brute_force(spark, entries, rounds):
    rng = random.Random(entries)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.75]) + (rng.random() < 0.1) * rng.gauss(0, 1) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(120)]
    hot = [rng.gauss(0, 1) for _ in range(32)]
    rows += [(1000 + i, hot, 7) for i in range(60)] + [(3, hot, 2), (3, hot, 2), (None, hot, None)]
    rows += [(-5, None, 1), (-4, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-2, [float("inf")] + [0.0] * 31, 1), (-1, [0.1] * 5, 4), (-9, [], 4), (-8, [0.3] * 33, 4)]
    got, books = codes.compress(spark, vectors_of(spark, rows).repartition(5), entries=entries, rounds=rounds)
    want, wanted = brute_codes(rows, entries=entries, rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and books == wanted
    labelled = codes.with_label_errors(got).collect()
    by = defaultdict(int)
    for _, label, _, error in want:
        by[label] += error
    assert len(labelled) == len(want) and all(r["label_error"] == by[r["label"]] for r in labelled)


def test_codes_of_very_large_components(spark):
    rows = [(0, [1e300, -3.0] * 8, None), (1, [1e300, -3.5] * 8, 1), (2, [2.0**55, 1.0] * 8, 1), (3, [0.1, 0.2] * 8, 1), (4, [-1e19, 0.2] * 8, 1)]
    got, books = codes.compress(spark, vectors_of(spark, rows), entries=3)
    want, wanted = brute_codes(rows, entries=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and books == wanted
    assert {r["label_error"] for r in codes.with_label_errors(got).where("label = 1").collect()} == {codes.LONG}


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)]):
        got, books = codes.compress(spark, vectors_of(spark, rows))
        assert got.count() == codes.with_label_errors(got).count() == 0 and books == []
    assert codes.digest([]) == hashlib.sha256(b"").hexdigest()

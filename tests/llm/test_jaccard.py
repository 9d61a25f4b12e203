"""The Jaccard join against brute force on texts with copies, near copies, shared passages and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import common, jaccard, shingles


def words(text):
    folded = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, k))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve", "Ünder"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(60)
    rows = []

    def add(w):
        rows.append((len(rows) + 1, " ".join(w)))

    base = text(120)
    for _ in range(70):  # a group of near copies, some chained beyond the limit
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        add(w)
    for _ in range(60):  # a shared passage in texts that are otherwise different
        add(text(rng.randint(0, 80)) + passage + text(rng.randint(0, 80)))
    for _ in range(40):
        add(text(rng.randint(1, 200)))
    for i in rng.sample(range(len(rows)), 25):
        add(rows[i][1].upper().split(" ") if rng.random() < 0.5 else rows[i][1].split(" "))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (906, "é"), (907, "É")]
    rng.shuffle(rows)
    return rows


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 8)  # so that regions of regions are met
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "WIDE_FROM", 60)
    monkeypatch.setattr(jaccard, "FLUSH", 1000)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, cell string, x long").repartition(4)
    for k, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: r for r in jaccard.join(df, k, percent).collect()}
        want = brute(rows, k, percent)
        assert len(got) == len(rows)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(got[i]["n_shingles"] == len(shingle_set(t, k)) for i, t in rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.join(df, 4, 85).collect()), key=str)
    assert got == sorted([(5, 3, 27), (5, 3, 27), (None, None, 27), (3, 3, 27), (3, 3, 0)], key=str)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_bounds_the_difference():
    rng = np.random.default_rng(1)
    for bits in (shingles.SIGNATURE_BITS, shingles.WIDE_BITS):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 500), dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
            x, y = (int.from_bytes(shingles.signature(s, bits)) for s in (a, b))
            assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


def test_shingles_see_words_alone():
    one, two, three = shingles.sets([b"a b c d", b"A\tb\n c\x0bD  ", b"ab c d e"], 4)
    assert one.tolist() == two.tolist() != three.tolist()
    assert [len(s) for s in shingles.sets([b"", b" ", b"x"], 4)] == [0, 0, 1]


def test_chunks_of_few_words():
    for k in (4, 5):
        for n in range(1, k):
            few = " ".join("abcd"[:n]).encode()
            long = b" ".join(b"w%d" % i for i in range(200_000))
            alone = shingles.sets([few], k)
            assert [len(s) for s in alone] == [1]
            assert shingles.sets([b"", few, b""], k)[1].tolist() == shingles.sets([few, long], k)[0].tolist() == alone[0].tolist()
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([few.decode(), long.decode(), few.decode()])], ["doc_id", "text"])
            assert len(long) > 1 << 20
            got = list(shingles.of_batch(batch, k))
            assert [(i, len(s)) for i, s in got] == [(1, 1), (2, 200_000 - k + 1), (3, 1)]
            assert got[0][1].tolist() == got[2][1].tolist() == alone[0].tolist()


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = common.components(spark, spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {a: find(a) for a in root}

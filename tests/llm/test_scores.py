"""Toxicity, languages and quality rules: segments and paths against brute force, held-out rows, and odd texts."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, language, quality, toxicity

ODD = [None, "", " \n ", "12 34", "…", "x", "\x00", "𝒳 Ω"]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out(spark):
    got = spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", common.held_out().alias("h")).collect()
    assert all(r["h"] == held_out(r["doc_id"]) for r in got)


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best contiguous part, then the same to its left and right."""

    def best(a, b):
        top, at = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > top + 1e-12:
                    top, at = total, (i, j)
        if at is None:
            return []
        i, j = at
        return best(a, i) + [(i, j, top)] + best(j + 1, b)

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([rng.uniform(0.01, 0.4), -toxicity.DRIFT, -toxicity.DRIFT, -toxicity.DRIFT]) for _ in range(60)]
    got = toxicity.maximal_segments([(i, i, s) for i, s in enumerate(scores) if s > 0])
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_take_linear_time():
    """Hits at wide gaps in a long clean text never merge, which makes a search through all candidates quadratic."""
    began = time.process_time()
    got = toxicity.maximal_segments([(30 * i, 30 * i, 0.5) for i in range(100_000)])
    assert len(got) == 100_000 and time.process_time() - began < 5


def test_significant_passages_only():
    model = toxicity.Model({"vile": 2.0, "nasty": 9.0}, 1.0, 0.1, (-4.0, 1.0))
    for n in (10, 1000, 100_000):
        least = toxicity.least_score(n, model.rate, model.scale, 0.05)
        assert abs(1 - np.exp(-model.scale * n * np.exp(-model.rate * least)) - 0.05) < 1e-9


def test_toxicity_with_empty_tasks(spark):
    """Tasks without toxic, clean or any rows count nothing and must not end the query."""
    rows, labels = corpus(240)
    docs = spark.createDataFrame(sorted(rows, key=lambda r: labels[r[0]][1]), "doc_id long, text string, lang string, source string, score double, predicted int")
    docs = docs.repartitionByRange(12, "doc_id").unionByName(docs.limit(0)).withColumn("text", F.when(F.col("doc_id") < 200, F.col("text")))
    known = spark.createDataFrame([(i, y) for i, y, _ in labels], "doc_id long, toxic int").repartition(1)
    got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(got) == 240 and all(r["predicted"] == 0 for r in got if r["doc_id"] >= 200)


def test_pieces_and_long_texts():
    text = " ".join(f"w{i}" for i in range(3000)) + "\u00a0x  \n" + "y" * 5000 + " end"
    for limit in (1, 7, 100, 10**6):
        parts = list(common.pieces(text, limit))
        assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
    scanner = toxicity.Scanner({"w17": 3.0, "w2999": 2.0})
    assert scanner.scan(text) == (len(text.split()), [(17, 17, 3.0), (2999, 2999, 2.0)])


def corpus(n=900):
    rng = random.Random(1)
    clean, bad = [f"plain{i}" for i in range(200)], ["vilex", "nastyo", "grossu", "horrida"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(10, 120))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0.5, 3))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(5000 + i, t, "en", "s", 0.5, 3) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, score double, predicted int").repartition(3)
    known = spark.createDataFrame(labels + [(7777, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert len(got) == len(rows) + len(ODD)
    held = [(i, y) for i, y, _ in labels if held_out(i)]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(got[5000 + i]["predicted"] == 0 for i in range(len(ODD)))
    hit = next(i for i, y in held if y)
    spans = got[hit]["segments"]
    assert any("vilex" in (w := rows[hit][1].split())[s["first"] : s["last"] + 1] or set(w[s["first"] : s["last"] + 1]) & {"nastyo", "grossu", "horrida"} for s in spans)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_and_its_shortcut(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.normal(size=(n, 3)) * 3 for n in (1, 5, 7, 3)]

    def value(scores, path, penalty):
        return sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))

    for penalty in (0.5, 4.0):
        for scores, path in zip(texts, language.viterbi(texts, penalty), strict=True):
            top = max(value(scores, p, penalty) for p in itertools.product(range(3), repeat=len(scores)))
            assert abs(value(scores, path, penalty) - top) < 1e-9
            if (one := language._one_language(scores, penalty)) is not None:
                assert abs(scores[:, one].sum() - top) < 1e-9


def test_shortcut_sees_paths_without_the_top_language():
    scores = np.array([[0.0, 10.0, -100.0], [0.0, -100.0, 10.0]])
    assert language._one_language(scores, 12.0) is None
    assert language.viterbi([scores], 12.0)[0].tolist() == [1, 2]
    assert language._one_language(scores[:, :1], 12.0) == 0
    assert language._one_language(np.array([[5.0, 0.0, -1.0]] * 4), 12.0) == 0
    rng = np.random.default_rng(3)
    taken = 0
    for _ in range(2000):
        scores = rng.normal(size=(rng.integers(1, 6), 3)) * 12
        scores[:, 0] += 6
        if (one := language._one_language(scores, 12.0)) is not None:
            taken += 1
            assert language.viterbi([scores], 12.0)[0].tolist() == [one] * len(scores)
    assert taken > 100


def test_languages_and_mixed_spans(spark):
    rng = random.Random(2)
    syllables = {"aa": ["tha", "ing", "ou", "wer"], "bb": ["keit", "sch", "ung", "ei"], "cc": ["иж", "ова", "ны", "ст"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 60)), lang, 1, "x") for i, lang in enumerate(rng.choices(list(syllables), k=300))]
    odd = [(1000 + i, t, None, 1, "x") for i, t in enumerate(ODD)]
    mixed = [(2000, text("aa", 40) + " " + text("bb", 40), None, 1, "x")]
    df = spark.createDataFrame(rows + odd + mixed, "doc_id long, text string, lang string, spans int, score string").repartition(3)
    got = {r["doc_id"]: r for r in language.identify(df, language.learn(df)).collect()}
    held = [r for r in rows if held_out(r[0])]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, *_ in held) >= 0.97 * len(held)
    assert [got[1000 + i]["lang_pred"] for i in range(5)] == ["und"] * 5 and got[1000]["score"] == 0.0
    assert [s["lang"] for s in got[2000]["spans"]] == ["aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = spark.createDataFrame([], df.schema)
    assert language.identify(nothing, language.learn(nothing)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df, language.learn(nothing)).collect()} == {"und"}


def test_long_texts_are_labelled_as_short_ones(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["thas", "ingou"] if i % 2 else ["schung", "keitei"]) for _ in range(30)), "ab"[i % 2]) for i in range(60)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = " ".join(r[1] for r in rows[::2]) + " 12 é\n" + " ".join(r[1] for r in rows[1::2])
    whole = language.label([text], model)
    monkeypatch.setattr(language, "SLICE", 100)
    parts = language.label([text], model)
    assert parts[0][0] == whole[0][0] and abs(parts[0][1] - whole[0][1]) < 1e-9 and parts[0][2] == whole[0][2] and len(whole[0][2]) == 2


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LEARNED", 20)
    rows = [(i, "thas ingou", "common") for i in range(3000)] + [(3000 + i, "schung", "rare") for i in range(6)]
    assert language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["common", "rare"]


def test_quality_metrics(spark):
    rng = random.Random(3)
    texts = [*ODD, "Hello World", "a b c d e f g h " * 5, "x\nx\n \ny\nx", "#*$ %&|<> ok!", "日本 語\n日本 語", "w " * 3000]
    for _ in range(60):
        w = [rng.choice("abcdefgh") if rng.random() < 0.3 else rng.choice("ab") for _ in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    clashing = "doc_id long, text string, n_words string, kept_too int, _text string, _equal int, _rest int, `a.b` int"
    df = spark.createDataFrame([(i, t, "clash", 1, "x", 7, 8, 9) for i, t in enumerate(texts)], clashing).repartition(3)
    got = {r["doc_id"]: r for r in quality.apply(df).collect()}
    assert all((r["kept_too"], r["_text"], r["_equal"], r["_rest"], r["a.b"], r["text"]) == (1, "x", 7, 8, 9, texts[i]) for i, r in got.items())
    for i, text in enumerate(texts):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeated = {p for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.apply(spark.createDataFrame([], df.schema)).count() == 0

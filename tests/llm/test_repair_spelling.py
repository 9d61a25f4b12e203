"""SentencePiece encoding against the library; conversation repair and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import repair, sentencepieces, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())


PARTS = [" ", "  ", "\n", "\t", "a", "b1", "é", "ß", ".", "'s", "中", "\U0001f600", "\r\n", "<s>", "</s>", "<0x0A>", "\x00", "12", "word", "▁", "▁▁", "\xa0", "<unk>"]


def test_pieces_equal_the_library(library):
    rng, own = random.Random(1), sentencepieces.Encoder(sentencepieces.default_model())
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    for k in range(6000):
        match k % 4:
            case 0:
                text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20)))
            case 1:
                text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
            case 2:
                text = "".join(rng.choice(" abcdeinost") for _ in range(rng.randint(0, 40)))
            case _:
                text = "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(0, 8))) + chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x2FFFF)])) * rng.randint(0, 3)
        assert own.ids(text) == library.encode(text), text
    long = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    assert own.ids(long) == library.encode(long) and own.ids("a" * 30_000) == library.encode("a" * 30_000)


def test_backtracking_takes_steps_back(library):
    """Texts on which the longest pieces from the left aren't the encoding."""
    own = sentencepieces.Encoder(sentencepieces.default_model())
    rng, back = random.Random(2), 0
    for _ in range(2000):
        text = "▁" + "".join(rng.choice("abcdeinorst") for _ in range(12))
        greedy, at = [], 0
        while at < len(text):
            n = max((n for n in range(1, 17) if text[at : at + n] in own._id), default=1)
            greedy.append(own._id.get(text[at : at + n]))
            at += n
        got = own.backtracked(text)
        back += got != greedy
        assert got == own.merged(text)
    assert back > 200


def test_slices_join_to_the_whole(library):
    rng, own = random.Random(3), sentencepieces.Encoder(sentencepieces.default_model())
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        parts = list(sentencepieces.slices(text, 7))
        assert b"".join(own.packed_ids(p) for p in parts) == array("I", library.encode(text)).tobytes()
        assert " ".join(library.decode(library.encode(p)) for p in parts) == library.decode(library.encode(text))


def test_encode_and_decode(spark, library, monkeypatch):
    texts = [None, "", " ", "two  words ", "x" * 3000, "line\nline", "same", "same", " ".join(["longer"] * 2000)]
    df = spark.createDataFrame([(i % 7 or None, t, "clash", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded double").repartition(3)
    model = sentencepieces.default_model()
    got = sentencepieces.encode(df, model, decoded=True)
    want = sorted((str(r["doc_id"]), tuple(library.encode(r["text"] or "", add_bos=True, add_eos=True)), library.decode(library.encode(r["text"] or ""))) for r in df.collect())
    assert sorted((str(r["doc_id"]), tuple(array("I", bytes(r["ids"])).tolist()), r["decoded"]) for r in got.collect()) == want
    bare = sentencepieces.encode(df, model, ends=False)
    assert sorted(tuple(array("I", bytes(r["ids"])).tolist()) for r in bare.collect()) == sorted(w[1][1:-1] for w in want)
    plain = sentencepieces.decode(got.select("doc_id", "ids").unionByName(spark.createDataFrame([(5, None)], "doc_id long, ids binary")), model)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in plain.collect()) == sorted([(w[0], w[2]) for w in want] + [("5", "None")])


def cheapest(codes, start=0, goals=(0, 3), most=24):
    """Every audit of a bounded cost, letter by letter."""
    best = None
    todo = [(0, "", 0, start)]
    while todo:
        cost, audit, i, state = todo.pop()
        if i == len(codes) and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        ways = [(3, "I", i, after)]
        if i < len(codes):
            code, charge = codes[i], 3 * codes[i].isupper()
            ways.append((4, "D", i + 1, state))
            if code != "x":
                ways.append((3 + charge, "R", i + 1, after))
                fits = {"s": state == 0, "u": state in (0, 1, 3), "a": state == 2}.get(code.lower(), False)
                if fits:
                    ways.append((charge, "K", i + 1, {"s": 1, "u": 2, "a": 3}[code.lower()]))
        for more, edit, j, to in ways:
            if cost + more <= min(most, best[0] if best else most):
                todo.append((cost + more, audit + edit, j, to))
    return best


def test_cheapest_edits():
    codes = ["".join(c) for n in range(4) for c in itertools.product("xsuaoUA", repeat=n)]
    rng = random.Random(4)
    codes += ["".join(rng.choice("xsuaoSUAO") for _ in range(n)) for n in (4, 5, 6) for _ in range(60)]
    for c in codes:
        (got,) = repair.search(c).values()
        assert got == cheapest(c, most=7 * len(c) + 1), c


@pytest.mark.parametrize("size", [1, 2, 3, 7, 11])
def test_blocks_give_the_whole(size):
    rng = random.Random(size)
    for k in range(600):
        codes = "".join(rng.choice(["xsuaoSUAOuauauaUA", "ua", "xxso", "sSxu"][k % 4]) for _ in range(rng.randint(1, 30)))
        fold, parts = repair.Fold(), []
        blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
        for k, block in enumerate(blocks):
            parts += fold.step(k, block, k == len(blocks) - 1)
        assert [k for k, _ in parts] == list(range(len(blocks)))
        ((_, audit),) = repair.search(codes).values()
        assert "".join(edits for _, edits in parts) == audit


def conversations(rng):
    rows = []
    texts = ["One.", "Two!", "Three", "", " \n", "Four?  ", "None of it", None]
    for c in [*range(40), None]:
        for turn in range(rng.randint(1, 30)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [4, 256])
def test_repair(spark, block):
    rows = conversations(random.Random(5))
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place int, fault string, edits string").repartition(3)
    edited = repair.edited(repair.faulted(df), block)
    got = {r["conv_id"]: r for r in repair.summaries(edited).collect()}
    turns = {}
    for r in repair.repaired(edited).collect():
        turns.setdefault(r["conv_id"], []).append((r["n"], r["edit"], r["role"], r["text"]))
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, role or (" " if role is None else ""), " " if text is None else text) for i, t, role, text in rows if i == c))
        codes, faults, seen, illegal = "", Counter(), set(), 0
        for _, _, role, text in own:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in set("sua") else "o"
            codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        ((cost, audit),) = repair.search(codes).values()
        known = sorted({t for has, t, _, _ in own if has})
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit)
        after = sorted(turns.get(c, []))
        assert [n for n, *_ in after] == list(range(len(after))) and re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, _, role, _ in after))
        assert "".join(e for _, e, *_ in after) == audit.replace("D", "")
        whole = "\n".join(f"{role}:{text}" for *_, role, text in after)
        assert r["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        texts = [text for (_, _, _, text), edit in zip(own, audit.replace("I", ""), strict=True) if edit != "D"]
        assert [text for _, e, _, text in after if e != "I"] == texts and all(text == "" for _, e, _, text in after if e == "I")


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edited = repair.edited(repair.faulted(none))
    assert repair.summaries(edited).count() == repair.repaired(edited).count() == 0


def test_long_conversation_is_settled_on_the_way():
    """What a fold keeps of a conversation doesn't grow with it."""
    rng, fold = random.Random(6), repair.Fold()
    given = 0
    for k in range(200):
        given += len(fold.step(k, "".join(rng.choice("uaxuaUAo") for _ in range(64)), False))
        assert max(len(path) for *_, path in fold.best.values()) < 10
    assert given > 190


def test_runs_and_damage(monkeypatch):
    text = "Été ÀÉÎÿ×÷ straße naïve don't xĀy ABC" * 50 + "q" * 300
    want = Counter(w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall("[A-Za-zÀ-ÿ]+", text))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(spelling, "SLICE", size)
        assert {w.decode("latin-1"): n for w, n in spelling.runs(text).items()} == want
    assert not spelling.runs(None) and not spelling.runs("") and not spelling.runs("12 -")
    lost = 0
    for i in range(3000):
        word = "straße"
        h = zlib.crc32(f"{i}:{word}".encode())
        expected = word[: h % 6] + word[h % 6 + 1 :] if h % 31 == 0 else word
        lost += h % 31 == 0
        assert spelling.damaged(i, word.encode("latin-1")).decode("latin-1") == expected
    assert lost > 50


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_variants(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 30, 31, 400]) for _ in range(500)}
    words |= {"".join(p): 2 for p in itertools.islice(itertools.permutations("abcdefg"), 700)}  # words of the same letters
    words |= {"colouring": 5000, "coloring": 40, "colorin": 4, "colorinx": 4, "ÿ" * 5000: 2, "ÿ" * 4999: 90}
    got = {r["word"]: r.asDict() for r in spelling.variants(spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, form int").repartition(4)).collect()}
    assert set(got) == set(words)
    form = {}
    for w, n in words.items():
        near = [o for o in words if abs(len(o) - len(w)) <= 1 and one_edit(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        assert (got[w]["n"], got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (n, len(near), form[w], words.get(form[w]))
    for w in words:
        last = w
        while form[last] is not None:
            last = form[last]
        assert got[w]["root"] == last
    assert got["colorin"]["root"] == "colouring" and got["colorin"]["form"] == "coloring"


def test_counted_words(spark):
    rows = [(1, "Variant variant VARIANTS short"), (2, "variants, variant"), (3, None), (4, ""), (None, "variant")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    assert {r["word"]: r["n"] for r in spelling.counted(df).collect()} == {"variant": 4, "variants": 2}
    assert spelling.variants(spelling.counted(df.where("false"))).count() == 0
    assert spelling.variants(spelling.counted(df)).select(F.sum("n_near")).first()[0] == 2

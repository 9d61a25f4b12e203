"""Encoder, id blocks, token files and packing against direct encoding and exact round trips."""

import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, packing, token_files, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, score double, start string, part int"
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n a", " a", "a ", "it's  don't\t x", "\x1c a b", "tab\t\tx  \n  y", "<|endoftext|> x", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext|>", "<|endoftext| > <|endoftext",  "\U0001f600 \U0001f600x", "中 文 z", "a\x85 b", "x,; y.,", "é, É. 12, a1! b"]


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def digest(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def rows():
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta,", "Gamma", "x1"]) for _ in range(4000))
    texts = [*ODD, None, long, long, "short text", "short text"]
    return [(i * 3 % 101, t, 0.5, "clash", 7) for i, t in enumerate(texts)]


def test_encoder_equals_the_library(direct):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b1", "é", "ß", ".", "'s", "'ll", " ", "中", "\U0001f600", "\r\n", "<|endoftext|>", "\x00", "12", "word,"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    encoder = tokens.Encoder(tokens.default_vocabulary(), max_pieces=50)
    for _ in range(2):
        for text, ids in zip(texts, encoder.many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == direct(text), text


@pytest.mark.parametrize("max_pieces", [50, 400_000])
def test_encoder_cuts_where_the_library_does(direct, max_pieces):
    rng = random.Random(3)
    parts = [*[" "] * 12, "\n", "\n", "\n\n", "\r\n", "\r", "\x1c", "\x85", "\xa0", "à", "ª", "Word", "don't", "s", "'s", ".", ",", "…", "%%%", '."', "ʰ", "\u0301", "ɏ", "1", "<|endoftext|>"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    encoder = tokens.Encoder(tokens.default_vocabulary(), max_pieces=max_pieces)
    for size in (1, 7, 4000):
        for i in range(0, 200 if size == 1 else len(texts), size):
            some = pa.array(texts, pa.string())[i : i + size]
            for text, ids in zip(some.to_pylist(), encoder.many(some), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == direct(text), text


def test_words_are_not_pre_tokenized_one_by_one(direct, monkeypatch):
    """Distinct words are the bulk of a corpus' cost: the library's model gets many at once, its pre-tokenizer none."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghinorstué") for _ in range(rng.randint(3, 12))) for _ in range(5000)]
    texts = [" ".join(words[i : i + 50]) + ".\n" + words[i] + ", end" for i in range(0, len(words), 50)]
    encoder, given = tokens.Encoder(tokens.default_vocabulary()), []
    library = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda x: given.extend(x) or library(x))
    for text, ids in zip(texts, encoder.many(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == direct(text)
    assert set(given) <= {" ", ".", ",", "\n"}


def test_words_whose_ends_a_token_could_cross(direct, monkeypatch):
    encoder = tokens.Encoder(tokens.default_vocabulary())
    monkeypatch.setattr(encoder, "_crossing", re.compile("b" + encoder._characters[0x20]))
    text = "ab cd eb fg"
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == direct(text)
    monkeypatch.setattr(encoder, "_plain", False)
    assert np.frombuffer(encoder.ids(text + " hij"), "<u4").tolist() == direct(text + " hij")


@pytest.mark.parametrize("high", [1, 2, 3, 200, 50257, 2**32 - 1])
@pytest.mark.parametrize("n", [1, 7, 777, 4096])
def test_blocks_round_trip(high, n):
    x = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    x[:: 17] = 2**32 - 1
    assert (token_files.decode_block(token_files.encode_block(x)) == x).all()


def test_outliers_are_exceptions():
    x = np.arange(100, dtype=np.uint32)
    wide = x.copy()
    wide[5] = 2**31
    assert len(token_files.encode_block(wide)) == len(token_files.encode_block(x)) + 6


def test_token_files(spark, direct):
    data = rows()
    path = common.new_path(spark, "ids")
    token_files.write(spark.createDataFrame(data, SCHEMA).repartition(3), path, tokens.default_vocabulary())
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(data)
    at = 0
    for r, (doc_id, text, *_) in zip(got, sorted(data, key=lambda d: d[0]), strict=True):
        ids = [*direct(text), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), digest(ids))
        at += len(ids)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = common.new_path(spark, "none")
    token_files.write(none, path, tokens.default_vocabulary())
    assert token_files.digests(spark, path).count() == 0
    assert packing.pack(none, tokens.default_vocabulary()).count() == 0


def test_pack(spark, direct):
    data = rows()
    got = packing.pack(spark.createDataFrame(data, SCHEMA).repartition(3), tokens.default_vocabulary(), capacity=64).collect()
    bins, by = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"]].append(r)
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    for doc_id, text, *_ in data:
        ids, pieces = [*direct(text), 2], sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 64)))
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.asarray(ids, "<u4").tobytes()
        assert all(r["length"] == 64 for r in pieces[1:])
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 64) + 2


def test_cut_encodes_a_batch_at_once(spark, direct, monkeypatch):
    """Texts go to the encoder as Arrow data and some MB at once, so that words are looked up once for all of them."""
    encoder, calls, task = tokens.Encoder(tokens.default_vocabulary()), [], []

    class Recorder:
        def many(self, texts):
            calls.append(texts)
            return encoder.many(texts)

    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            task.append(function)

    monkeypatch.setattr(tokens, "encoder", lambda _: Recorder())
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 5)))
    packing.cut(Documents(), tokens.default_vocabulary())
    texts = ["alpha beta, gamma.\n" * 35_000, None, "delta " * 120_000, "x\n\ny"]
    batch = pa.record_batch([pa.array([4, 5, 6, 7], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    rows = [r for b in task[0](iter([batch])) for r in b.to_pylist()]
    assert len(calls) == 1 and isinstance(calls[0], pa.Array)
    for doc_id, text in zip([4, 5, 6, 7], texts, strict=True):
        assert b"".join(r["ids"] for r in rows if r["doc_id"] == doc_id) == np.asarray([*direct(text), 2], "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_once(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5.5, 1.2, 3000).astype(int), 1, 1024)
    histogram = dict(Counter(sizes.tolist()))
    runs, n = packing.plan(histogram)
    used, ranks = Counter(), defaultdict(list)
    for length, rank, count, first, offset in runs:
        ranks[length] += range(rank, rank + count)
        for i in range(count):
            assert used[first + i] == offset
            used[first + i] += length
    assert max(used.values()) <= 1024 and len(used) == n
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in histogram.items()}
    big = sum(c for k, c in histogram.items() if k > 512)
    assert n <= max(big, -(-int(sizes.sum()) // 1024)) * 1.02 + 1

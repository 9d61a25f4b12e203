"""Spelling variant grouping by anagram hashing.

A word's key is the sum of a power of each of its letters' code points, modulo 2**64, so words of the same letters have one key, and one more, one fewer or another letter changes it
by that letter's value or by the difference of two values. Words one letter apart meet in an equi-join: each word stands under its key (as the shorter one of an addition or
removal) and, for each of its letters, under its key less that letter's value (as the longer one, or as one side of an exchange: a - x = b - y if a and b differ by x - y).
The order of letters is verified on what meets. So that many words of the same letters don't all meet, a word stands under each key twice, along with its first and with its last half:
one edit leaves one of the two as it was.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, all in Latin-1.
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A word is a variant of a near one that is at least so many times as frequent.
RATIO = 10
#: Power of code points that letters count for.
POWER = 5
#: Of doc_id:word, checksums that this divides lose a letter (fixed by the contract).
DAMAGE = 31
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_BREAK = re.compile(rb"[^a-z\xc0-\xff]")
#: Characters of a text that are read at a time; words that a task counts before it gives them out.
SLICE, COUNTED = 1 << 20, 200_000


def runs(text: str | None) -> Counter[bytes]:
    """Maximal runs of letters, A-Z as a-z, in Latin-1, with their counts. Other characters count as breaks."""
    found: Counter[bytes] = Counter()
    at, size = 0, len(text or "")
    left = b""
    while at < size:
        part = left + text[at : at + SLICE].encode("latin-1", "replace").lower()
        at += SLICE
        left = b""
        if at < size:  # a run at the end may go on in the next slice
            tail = part[::-1]
            cut = len(part) - (m.start() if (m := _BREAK.search(tail)) else len(part))
            part, left = part[:cut], part[cut:]
        found.update(_RUN.findall(part))
    if left:
        found.update(_RUN.findall(left))
    return found


def damaged(doc_id: object, run: bytes) -> bytes:
    """A run without one letter, if DAMAGE divides the crc32 of UTF-8 `doc_id:run`."""
    h = zlib.crc32(run.decode("latin-1").encode("utf-8"), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, change: bool = False, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words of whole texts (with `change`: after damaged()) that have so many letters and occurrences at least. Null and empty texts have none.

    Each task adds up what it sees before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def table() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts, strict=True):
                for run, n in runs(text.as_py()).items():
                    word = damaged(doc_id, run) if change else run
                    if len(word) >= least_letters:
                        seen[word] += n
                if len(seen) >= COUNTED:
                    yield table()
        if seen:
            yield table()

    common.bound_batches(docs.sparkSession)
    words = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def places(words: DataFrame) -> DataFrame:
    """What each word (word, n) is joined under: place (of a key and a half), taken (the letter taken off, null if none), word, n.

    Of the m letters that a key stands for, h are half. Two words that are one letter apart and meet under that key have their first h or their last m - h letters in common.
    A place is a mix of both in 64 bits; that other words have it too by chance does no harm, as what meets is verified.
    """
    values = np.arange(256, dtype=np.uint64) ** np.uint64(POWER)
    every = 1 << 64

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str | None, str, int]] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters = word.encode("latin-1")
                own = int(values[np.frombuffer(letters, dtype=np.uint8)].sum(dtype=np.uint64))
                for c in (None, *sorted(set(letters))):
                    m = len(letters) - (c is not None)
                    key = own if c is None else own - int(values[c])
                    for half in (b"<" + letters[: m // 2], b">" + letters[len(letters) - (m - m // 2) :]):
                        mixed = (key * 0x9E3779B97F4A7C15 + zlib.crc32(half) * 0xC2B2AE3D27D4EB4F) % every
                        out.append((mixed - every if mixed >> 63 else mixed, None if c is None else chr(c), word, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["place", "taken", "word", "n"])

    return words.select("word", "n").mapInArrow(keys, "place long, taken string, word string, n long")


def near(words: DataFrame) -> DataFrame:
    """word, other, other_n of all pairs, both ways, that differ by exactly one inserted, deleted or replaced letter."""
    under = places(words)
    a, b = under.alias("a"), under.alias("b")
    # One side of an exchange is the word that comes first; of an addition or removal the longer one.
    exchange = (F.col("a.taken") != F.col("b.taken")) & (F.col("a.word") < F.col("b.word"))
    removal = F.col("a.taken").isNotNull() & F.col("b.taken").isNull()
    pairs = a.join(b, (F.col("a.place") == F.col("b.place")) & (exchange | removal)).where(F.levenshtein("a.word", "b.word", 1) == 1)
    # Pairs that have both halves in common meet twice.
    pairs = common.stored(pairs.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct(), "near_words")
    return pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of all words that have a form (word, form): forms are followed to the last by doubling, so the rounds grow with the logarithm of the longest chain.

    A form must be more frequent than its word, so chains end.
    """
    known = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = known.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = common.stored(known.join(then, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if not step.agg(F.max("moved")).first()[0]:
            return known


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    A word's form is the most frequent word near it (the first in code-point order of equal ones) if that is `ratio` times as frequent at least, else null; its root is the last form that forms lead to, or the word itself.
    An empty table gives no rows. Words are Latin-1 letters.
    """
    words = common.stored(words.select("word", "n"), "words")
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other"))).alias("best"))
    rows = words.join(best, "word", "left")
    frequent: Column = -F.col("best.order") >= ratio * F.col("n")
    rows = common.stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.order")).alias("form_n")), "forms")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents, of which the contract damages some."""
    return variants(counted(common.documents(spark, sf_dir), change=True))

"""Languages of whole texts and of the spans in them.

Script ranges narrow each word's candidate languages; letter n-grams score the word in each candidate; Viterbi's
algorithm, with a penalty for each change of language, labels the words, so that spans of mixed texts come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed n-grams of 1 to 3 letters; the model is a table of BUCKETS x languages.
BUCKETS = 1 << 16
#: Documents of each language that the model is learned from at most: a sample by a hash of doc_id, so that rare languages are learned as well.
MAX_LEARNED = 5_000
#: Characters of a long text whose n-grams are worked out at once.
SLICE = 1 << 18
#: Log-odds that a stretch in another language must gain over each change into or out of it.
PENALTY = 12.0
#: Share of a language's letters in a script from which the script makes it a candidate.
SCRIPT_SHARE = 0.02
#: Added to every count.
PRIOR = 0.5
UNDECIDED = "und"

# First code points of script ranges and the script from there on; 0 for letters of no listed script.
SCRIPTS = [
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7),
    (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16), (0x0E00, 17),
    (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 25), (0x18B0, 0), (0x1E00, 1),
    (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x3040, 26), (0x30A0, 27), (0x3100, 28), (0x3130, 22),
    (0x3190, 0), (0x31F0, 27), (0x3200, 0), (0x3400, 28), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 22),
    (0xD7B0, 0), (0xF900, 28), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF65, 27), (0xFFA0, 22),
    (0xFFE0, 0), (0x20000, 28), (0x32000, 0),
]
N_SCRIPTS = 29

_SCRIPT_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_NAMES = np.array([b for _, b in SCRIPTS])
_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each process."""
    if "letters" not in _tables:
        _tables["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _tables["letters"]


class Model(NamedTuple):
    languages: list[str]  # in order of code points
    table: np.ndarray  # BUCKETS x languages, float32: log p(n-gram | language)
    allowed: np.ndarray  # scripts x languages: candidates


class Words(NamedTuple):
    """The words (runs of letters) of a batch of texts and their n-grams."""

    text: np.ndarray  # of each word, its text's number
    first: np.ndarray  # place of its first letter in the text
    size: np.ndarray  # letters
    script: np.ndarray
    grams: np.ndarray  # hashed n-grams, 3 for each letter (one may repeat at a word's edge)


def take_words(texts: list[str | None]) -> Words:
    lowered = [t.lower() if t else "" for t in texts]
    # Where lower() changes the number of characters, places would shift; such letters stay as they are.
    lowered = [x if len(x) == len(t or "") else "".join(y if len(y := c.lower()) == 1 else c for c in t) for x, t in zip(lowered, texts, strict=True)]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lowered])])
    letter = letters()[codes]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(starts, first, side="right") - 1
    at = np.flatnonzero(letter)
    one = codes[at]
    gap = np.where(letter, codes, 0)
    before, after = np.concatenate([[0], gap])[at], np.concatenate([gap, [0, 0]])[at + 1]
    two, three = one + (after << 21), before + (one << 21) + (after << 42)
    grams = np.stack([_hash(one, 1), _hash(two, 2), _hash(three, 3)], axis=1)
    script = _SCRIPT_NAMES[np.searchsorted(_SCRIPT_STARTS, codes[first], side="right") - 1] if len(first) else first
    return Words(text, first - starts[text], last - first, script, grams)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def learn(docs: DataFrame, lang: str = "lang") -> Model:
    """Learn from text and non-null lang of documents that aren't held out, at most about MAX_LEARNED of each language by a hash of doc_id."""
    known = docs.select("doc_id", "text", F.col(lang).alias("lang")).where(~common.held_out()).where("lang is not null and text is not null and doc_id is not null")
    rates = common.stored(known.groupBy("lang").agg((F.lit(MAX_LEARNED) / F.count("*") * (1 << 30)).alias("below")), "rates")
    known = known.join(common.small(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, own in frame.groupby("lang"):
                texts = own["text"].tolist()
                sums = grams.setdefault(str(name), np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
                texts = [p for t in texts for p in common.pieces(t, SLICE)]
                for a, b in common.text_chunks([len(t) for t in texts], SLICE):
                    found = take_words(texts[a:b])
                    sums[:BUCKETS] += np.bincount(found.grams.ravel(), minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(found.script, weights=found.size, minlength=N_SCRIPTS).astype(np.int64)
        for name, sums in grams.items():
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": name, "bucket": some, "n": sums[some]})

    counts = known.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = counts.toPandas()  # at most BUCKETS + N_SCRIPTS rows for each language
    languages = sorted(sums["lang"].unique())
    table = np.full((BUCKETS, len(languages)), PRIOR)
    scripts = np.zeros((N_SCRIPTS, len(languages)))
    for i, name in enumerate(languages):
        own = sums[sums["lang"] == name]
        gram = own["bucket"].to_numpy() < BUCKETS
        table[own["bucket"].to_numpy()[gram], i] += own["n"].to_numpy()[gram]
        scripts[own["bucket"].to_numpy()[~gram] - BUCKETS, i] = own["n"].to_numpy()[~gram]
    table = np.log(table / np.maximum(table.sum(axis=0), 1e-9)).astype(np.float32)
    allowed = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    allowed[~allowed.any(axis=1)] = True  # a script that no learned language uses narrows nothing
    return Model(languages, table, allowed)


def word_scores(found: Words, model: Model) -> np.ndarray:
    """Words x languages: mean n-gram log-probability times letters; languages that don't write a word's script lose 20 a letter."""
    ends = np.cumsum(found.size)
    sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(model.table[found.grams].sum(axis=1, dtype=np.float64), axis=0)]) / 3
    scores = sums[ends] - sums[ends - found.size]
    return np.where(model.allowed[found.script], scores, scores - 20.0 * found.size[:, None])


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best label sequence of each text's words x languages scores; all texts advance together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([scores[i] for i in order])
    came = np.zeros(flat.shape, dtype=np.int16)
    best = np.zeros((len(order), flat.shape[1]))
    stay = np.arange(flat.shape[1])
    for t in range(sizes[0]):
        active = int(np.searchsorted(-sizes, -t, side="left"))
        at, now = starts[:active] + t, best[:active]
        top = now.argmax(axis=1)
        change = now[np.arange(active), top][:, None] - penalty
        switch = change > now
        came[at] = np.where(switch, top[:, None], stay)
        best[:active] = np.where(switch, change, now) + flat[at]
    path, state = np.zeros(len(flat), dtype=np.int16), best.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        active = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:active] + t
        path[at] = state[:active]
        state[:active] = came[at, state[:active]]
    out = [path[:0]] * len(order)
    for k, i in enumerate(order):
        out[i] = path[starts[k] : starts[k] + sizes[k]]
    return out


def _one_language(scores: np.ndarray, penalty: float) -> int | None:
    """The text's language if one language throughout is provably Viterbi's best path, else None.

    A path that uses this language pays a change for each stretch in another, so it is worse if no stretch gains the penalty. One that never
    uses it pays a change less than it has stretches; it gains no more than the best other language of each word does, so it is
    worse if these gains together are below one penalty.
    """
    whole = scores.sum(axis=0)
    top = int(whole.argmax())
    over = scores - scores[:, top : top + 1]
    gain = np.cumsum(over, axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() >= penalty:
        return None
    over[:, top] = -np.inf
    return top if over.max(axis=1).sum() < penalty else None


def label(texts: list[str | None], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: its language (that of most letters), the share of letters in it, and spans (first, end, language)."""
    if not model.languages:
        return [(UNDECIDED, 0.0, [])] * len(texts)
    if len(texts) == 1 and len(texts[0] or "") > SLICE:  # n-grams of a long text are worked out in slices; words and their scores stay
        parts, scores, at = [], [], 0
        for piece in common.pieces(texts[0], SLICE):
            part = take_words([piece])
            scores.append(word_scores(part, model).astype(np.float32))
            parts.append(part._replace(first=part.first + at, grams=part.grams[:0]))
            at += len(piece)
        found, scores = Words(*map(np.concatenate, zip(*parts, strict=True))), np.concatenate(scores)
    else:
        found = take_words(texts)
        scores = word_scores(found, model)
    if not len(found.size):
        return [(UNDECIDED, 0.0, [])] * len(texts)
    cuts = np.searchsorted(found.text, np.arange(len(texts) + 1))
    paths: dict[int, np.ndarray | int] = {}
    mixed = []
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            one = _one_language(scores[a:b], penalty)
            if one is None:
                mixed.append(i)
            else:
                paths[i] = one
    if mixed:
        paths |= dict(zip(mixed, viterbi([scores[cuts[i] : cuts[i + 1]] for i in mixed], penalty), strict=True))
    out = []
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        if b == a:
            out.append((UNDECIDED, 0.0, []))
            continue
        path = paths[i]
        if isinstance(path, int):
            out.append((model.languages[path], 1.0, [(int(found.first[a]), int(found.first[b - 1] + found.size[b - 1]), model.languages[path])]))
            continue
        sizes = np.bincount(path, weights=found.size[a:b], minlength=len(model.languages))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [b - a]])
        spans = [(int(found.first[a + x]), int(found.first[a + y - 1] + found.size[a + y - 1]), model.languages[int(path[x])]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        out.append((model.languages[int(sizes.argmax())], float(sizes.max() / sizes.sum()), spans))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label every whole text: columns keep, then lang_pred, score, spans (places in characters, end excluded, and language).

    A null text, or one without letters, is `und` with score 0 and no spans, as is every text if nothing was learned. Equal rows get equal
    results, ties between languages go to the first in code-point order, an empty table gives no rows, other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def compute(texts: list[str | None]) -> list[list]:
            found = label(texts, model, penalty)
            return [[x[0] for x in found], [x[1] for x in found], [[{"first": x, "end": y, "lang": name} for x, y, name in s] for _, _, s in found]]

        return compute

    return common.map_text(docs, "lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>", make, keep, SLICE)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = common.documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))

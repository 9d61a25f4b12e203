"""Toxic passages by maximum-scoring segments over word log-odds, calibrated by extreme-value statistics.

Model. A word's score is the log of its rate in toxic over its rate in clean training documents (documents that hold
it, so that one long text counts once). Dirichlet priors shrink it: a word's prior is centred on its 5-letter beginning,
that on its 4-letter beginning, and that on ratio 1. Words without significant evidence score -DRIFT, so that the expected
score of a clean word is negative, as segment statistics need.

Scan. Ruzzo and Tompa's linear-time algorithm finds all maximal-scoring segments of a text's words.

Calibration. In clean text of m words the number of segments that score S or more is nearly Poisson with mean
K m exp(-lambda S). lambda solves sum p(word) exp(lambda score) = 1 over clean words, K is counted on clean training documents.
A document's evidence is the least p-value of its r best segments together over all r (the sum statistic of Karlin and Altschul);
a logistic curve, fitted on counts of training documents by evidence, turns it into a score of 0 to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DRIFT = 0.05
#: Prior weight, in documents of either class, of a level's parent: words, 5-letter and 4-letter beginnings.
PRIOR = (2.0, 2.0, 4.0)
#: Toxic training documents that must hold a word or beginning before it gets evidence of its own.
LEAST_COUNT = 3
#: Standard deviations by which its log-odds must exceed 0.
LEAST_Z = 3.0
#: Ratio of a term's toxic to its clean rate from which it counts: less is a matter of topic or language.
LEAST_RATIO = 10.0
#: Labelled rows that the model is fitted on at most: a sample by a hash of doc_id, which bounds the broadcast labels and terms.
MAX_LABELLED = 200_000
THRESHOLD = 0.7
#: Probability of a segment as good somewhere in clean text of the same length, below which score() reports it as a toxic passage.
SIGNIFICANCE = 0.05
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
SEGMENTS = "array<struct<first:int,last:int,score:double>>"


class Model(NamedTuple):
    terms: dict[str, float]  # word, or beginning with a mark of its length in front: log-odds
    rate: float  # lambda
    scale: float  # K
    curve: tuple[float, float]  # logistic intercept and slope


def keys(word: str) -> tuple[str, str, str]:
    """A word's own key and those of its beginnings. Words of fewer letters have themselves as beginning."""
    return word, f"5 {word[:5]}", f"4 {word[:4]}"


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def maximal_segments(items: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence of positive runs.

    items: (first, last, score) of words that score above 0, in order; every word between them scores -DRIFT. Each candidate keeps a link
    to the last one before it whose sum to the left is smaller. A search follows links and its result is the next link, so no
    candidate is passed twice and the time is linear.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before it, total to its end, link
    total, at = 0.0, -1
    for first, last, score in items:
        left = total - DRIFT * (first - at - 1)
        total, at = left + score, last
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, last, left, total, j))
                break
            first, _, left, _, link = stack[j]
            del stack[j:]
            j = link
    return [(a, b, r - le) for a, b, le, r, _ in stack]


class Scanner:
    """Finds the segments of texts; remembers the score of up to max_words distinct words."""

    def __init__(self, terms: dict[str, float], max_words: int = 200_000):
        self._terms, self._max, self._memory = terms, max_words, {}

    def score(self, word: str) -> float:
        for key in keys(word.strip(_EDGE)):
            if key in self._terms:
                return self._terms[key]
        return -DRIFT

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and maximal-scoring segments by places of words."""
        memory, n, items = self._memory, 0, []
        for piece in common.pieces(text or ""):
            found = words(piece)
            scores = list(map(memory.get, found))
            if None in scores:
                for i, s in enumerate(scores):
                    if s is None:
                        scores[i] = s = self.score(found[i])
                        if len(memory) < self._max:
                            memory[found[i]] = s
            items += [(n + i, n + i, s) for i, s in enumerate(scores) if s > 0]
            n += len(found)
        return n, maximal_segments(items)


def evidence(segments: list[float], n_words: int, rate: float, scale: float) -> float:
    """-log of the least p-value of the r best segments together, over all r; 0 without segments."""
    best, t = 0.0, 0.0
    space = math.log(max(scale * n_words, 1e-300))
    for r, s in enumerate(sorted(segments, reverse=True), 1):
        x = rate * s - space
        if r > 1 and x <= 0:
            break
        t += x
        if t <= 0:
            break
        # P(T_r >= t) is nearly exp(-t) t**(r-1) / (r! (r-1)!)
        if r == 1:
            best = t if t > 30 else -math.log(-math.expm1(-math.exp(-t)))
        else:
            best = max(best, t - (r - 1) * math.log(max(t, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r))
    return min(best, 700.0)


def least_score(n_words: int, rate: float, scale: float, p: float) -> float:
    """Score from which a segment is significant: clean text of n_words has one as good with probability p or less."""
    return (math.log(max(scale * n_words, 1e-300)) - math.log(-math.log1p(-p))) / rate


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, text, label (0 or 1) of documents that may be learned from; at most about MAX_LABELLED by a hash of doc_id.

    A document with several labels counts as toxic if one of them says so; null labels are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = common.stored(known.where(~common.held_out()).groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    n = known.count()
    if n > MAX_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(MAX_LABELLED / n * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def document_counts(rows: DataFrame, vocabulary: dict[str, float] | None = None) -> DataFrame:
    """Number of documents that hold each word or beginning: term, n. With a vocabulary, its terms only."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for frame in frames:
            for text in frame["text"]:
                distinct = set().union(*map(words, common.pieces(text or "")))
                own = {k for w in distinct for k in keys(w.strip(_EDGE)) if w}
                seen.update(own if vocabulary is None else own & vocabulary.keys())
                if len(seen) > 500_000:
                    yield pd.DataFrame({"term": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        if seen:  # a task may have no rows, and an empty column no type
            yield pd.DataFrame({"term": list(seen.keys()), "n": list(seen.values())})

    return rows.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn terms, segment statistics and the curve. Without both labels the score is the share of toxic ones (0 if none)."""
    rows = common.stored(training_rows(docs, labels, label), "training")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model({}, 1.0, 1.0, (8.0 if toxic else -8.0, 0.0))
    # Terms in few toxic documents can't be significant; what is left is bounded by the labelled sample.
    with_toxic = {r["term"]: float(r["n"]) for r in document_counts(rows.where("label = 1")).where(f"n >= {LEAST_COUNT}").collect()}
    with_clean = {r["term"]: float(r["n"]) for r in document_counts(rows.where("label = 0"), with_toxic).collect()}

    odds: dict[str, float] = {}

    def level(term: str) -> int:
        return 2 if term.startswith("4 ") else 1 if term.startswith("5 ") else 0

    terms: dict[str, float] = {}
    for term in sorted(with_toxic, key=lambda x: (-level(x), x)):
        at = level(term)
        parents = [] if at == 2 else keys(term[2:])[2:] if at == 1 else keys(term)[1:]
        prior = next((odds[p] for p in parents if p in odds), 0.0)
        # Expected documents by the prior, split so that their ratio of rates is the parent's.
        half = PRIOR[at] / 2
        a = with_toxic[term] + half * math.exp(prior / 2)
        b = with_clean.get(term, 0.0) + half * math.exp(-prior / 2) * clean / toxic
        value = math.log(a / toxic) - math.log(b / clean)
        # Evidence of its own is measured against a neutral prior.
        a, b = with_toxic[term] + 0.5, with_clean.get(term, 0.0) + 0.5 * clean / toxic
        own, deviation = math.log(a / toxic) - math.log(b / clean), math.sqrt(1 / a + 1 / b)
        odds[term] = value
        ratio = with_toxic[term] / toxic / max(with_clean.get(term, 0.0) / clean, 1e-12)
        if own / deviation >= LEAST_Z and ratio >= LEAST_RATIO:
            terms[term] = value
        elif ratio <= 1 and any(p in terms for p in parents):
            terms[term] = -DRIFT  # its own counts deny what its beginning suggests
    scanned = common.stored(scan(rows, terms, ("doc_id", "label")), "scanned")
    # Clean words' scores: how many of them come from positive terms is counted on the words of segments.
    sums = scanned.where("label = 0").agg(F.sum("n_words").alias("m"), F.sum(F.size("segments")).alias("k"), F.sum(F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["score"])).alias("s")).first()
    m, k = max(sums["m"] or 0, 1), (sums["k"] or 0) + 1
    mean = ((sums["s"] or 0.0) + max(terms.values(), default=1.0)) / k
    share = min(k / m, 0.5)
    low, high = 1e-6, 1.0
    for _ in range(60):  # share * exp(rate * mean) + (1 - share) * exp(-rate * DRIFT) = 1
        rate = (low + high) / 2
        low, high = (rate, high) if share * math.exp(rate * mean) + (1 - share) * math.exp(-rate * DRIFT) < 1 else (low, rate)
    reference = mean / 2
    over = scanned.where("label = 0").agg(F.sum(F.size(F.filter("segments", lambda x: x["score"] >= reference))).alias("n")).first()["n"] or 0
    scale = (over + 0.5) / (m * math.exp(-rate * reference))
    bins = (
        scanned.select("label", _evidence_of(rate, scale)("n_words", F.transform("segments", lambda x: x["score"])).alias("x"))
        .groupBy("label", F.floor(F.col("x") * 4).alias("bin")).agg(F.count("*").alias("n"), F.avg("x").alias("x")).collect()
    )
    x, y, w = (np.array([float(r[c]) for r in bins]) for c in ("x", "label", "n"))
    return Model(terms, rate, scale, _logistic(x, y, w))


def _evidence_of(rate: float, scale: float):
    @F.pandas_udf("double")
    def of(n_words: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([evidence(list(s), int(n), rate, scale) for n, s in zip(n_words, scores, strict=True)], dtype=float)

    return of


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic regression in one variable, by Newton's method with a small ridge on the slope."""
    a, b = 0.0, 0.0
    x = np.minimum(x, 50.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        r, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-12)
        gradient = np.array([r.sum(), (r * x).sum() - ridge * b])
        hessian = np.array([[h.sum() + 1e-9, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + ridge]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def scan(rows: DataFrame, terms: dict[str, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_words and segments of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def make():
        scanner = Scanner(shared.value)

        def compute(texts: list[str | None]) -> list[list]:
            found = [scanner.scan(t) for t in texts]
            return [[n for n, _ in found], [[{"first": a, "last": b, "score": s} for a, b, s in x] for _, x in found]]

        return compute

    return common.map_text(rows, f"n_words long, segments {SEGMENTS}", make, keep)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), significance: float = SIGNIFICANCE) -> DataFrame:
    """Score every whole text: columns keep, then score, predicted, n_words, segments (each significant passage by places of its words).

    All maximal segments count as evidence, also those that are not significant alone. Null and empty texts have no segments and get the curve's lowest score. Equal rows get equal results, one row each; an
    empty table gives none; other columns than text and keep are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        scanner, (a, b) = Scanner(model.terms), model.curve

        def compute(texts: list[str | None]) -> list[list]:
            found = [scanner.scan(t) for t in texts]
            proof = [evidence([s for _, _, s in x], n, model.rate, model.scale) for n, x in found]
            scores = [1 / (1 + math.exp(-(a + b * min(x, 50.0)))) for x in proof]
            least = [least_score(n, model.rate, model.scale, significance) for n, _ in found]
            passages = [[{"first": a, "last": b, "score": s} for a, b, s in x if s >= t] for (_, x), t in zip(found, least, strict=True)]
            return [scores, [int(s >= THRESHOLD) for s in scores], [n for n, _ in found], passages]

        return compute

    return common.map_text(docs, f"score double, predicted int, n_words long, segments {SEGMENTS}", make, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels.toxic of those that are not held out."""
    docs = common.documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))

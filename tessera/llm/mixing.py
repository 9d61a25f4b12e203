"""Mixing sources to target weights, in fixed-length blocks of words.

Each source's words, in ascending doc_id order, are cut into blocks of `block` words. Output shards have `slots` slots each.
A source's slots in all are its target over the mean words of its blocks, so that the partial last block of a small source costs it nothing;
the fractional rests of all sources are drawn once, systematically. A shard's counts of slots by source are a multinomial draw given these totals,
that is, slots drawn without replacement (a multivariate hypergeometric law): so shards vary as independent draws do, but totals are exact.
Shards are halved recursively and each half's counts are drawn given its parent's, so that any task finds any shard's counts in log2(shards) draws.
A source's slots are numbered through all shards, and slot j takes block P(j mod n) of its n blocks, where P is a
pseudorandom permutation of the block numbers, another for each pass over the source. Blocks then join by source and number.

All draws are functions of the seed, so reruns agree, whichever tasks run them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

BLOCK = 128
SLOTS = 4096
SEED = 20_240_501
#: Slots up to which counts are drawn (numpy's bound is 10**9).
LARGE = 500_000_000
#: Slots that a task works out.
TASK_SLOTS = 100_000
#: Fixed by the contract: weights of sources in code-point order, repeating; share of all words; bound on repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
_WORD = re.compile(common.WORD_PATTERN.encode())


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, _hash (of the text), size: words of each whole text (null: 0); and _row, if docs are numbered."""
    rows = [c for c in docs.columns if c == common.ROW]
    keep = ("doc_id", "source", "_hash", *rows)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("_hash"), *rows, "text")
    return common.map_text(ids, "size long", lambda: lambda texts: [[common.count_words(t) for t in texts]], keep)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """source, source_size, weight, target: water-filling of share * all words by weight, no source above repeats times its size.

    Sources rise together in proportion to their weights until they reach their caps; sorted by cap over weight, the first sources are
    full and the rest share what remains. One row for each source passes through one window, counts of words having been summed before.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(n)) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(repeats))
    every = Window.partitionBy()
    budget = F.least(F.sum("source_size").over(every) * float(share), F.sum("cap").over(every))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full_before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (budget - full_before) / weight_left  # if this source and all after it share the rest
    sources = sources.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # Sources that aren't full share one level, that of the first such source.
    rest = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(every)
    return sources.withColumn("rest", rest).select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("rest") * F.col("weight"))).alias("target"))


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places x: four Feistel rounds on the least even number of bits, walked back into range."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            h = (right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(29)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo[todo] = out[todo] >= np.uint64(n)
    return out.astype(np.int64)


def drawn(counts: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many of n slots, drawn without replacement from counts by source, each source gets.

    Beyond LARGE slots a draw differs from proportion by less than one in ten thousand, and gives way to it.
    """
    total = int(counts.sum())
    if total <= LARGE:
        return np.random.default_rng(seed).multivariate_hypergeometric(counts, n, method="marginals")
    share = counts * (n / total)
    out = np.floor(share).astype(np.int64)
    out[np.argsort(out - share, kind="stable")[: n - int(out.sum())]] += 1
    return out


def shard_counts(counts: np.ndarray, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot number and number of slots of each source in a shard."""
    total = int(counts.sum())
    low, high, first = 0, -(-total // slots), np.zeros(len(counts), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(counts, (middle - low) * slots, [seed, low, high])
        if shard < middle:
            high, counts = middle, left
        else:
            low, first, counts = middle, first + left, counts - left
    return first, counts


def draws(plan: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """shard, source_no, first, n: how many slots each shard gives to each source, and their first number within the source.

    plan: source_no, source_size, target. A source's slots in all are its target over the mean words of its blocks (the last one is partial),
    rounded up or down by one systematic draw for all sources. A shard's counts depend on the slots of all sources: two numbers for
    each source are collected and broadcast, so ten million sources are 160 MB. A source never gets more than REPEATS slots for each of its blocks.
    """
    rows = plan.orderBy("source_no").select("source_no", "source_size", "target").toArrow()
    numbers, sizes, target = (rows[c].to_numpy() for c in ("source_no", "source_size", "target"))
    blocks = -(-sizes // block)
    want = np.minimum(target * blocks / np.maximum(sizes, 1), REPEATS * blocks)
    counts = np.floor(want + 1e-9).astype(np.int64)
    rests = np.concatenate([[0.0], np.cumsum(np.maximum(want - counts, 0.0))])
    counts += np.diff(np.floor(rests + np.random.default_rng(seed).random())).astype(np.int64)
    spark = plan.sparkSession
    shared = spark.sparkContext.broadcast((numbers, counts))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, counts = shared.value
        for frame in frames:
            for shard in frame["id"]:
                first, n = shard_counts(counts, int(shard), slots, seed)
                yield pd.DataFrame({"shard": int(shard), "source_no": numbers, "first": first, "n": n})[n > 0]

    # Stored, as else the stage that takes blocks would run two Python workers for each task.
    shards = -(-int(counts.sum()) // slots)
    return common.stored(spark.range(shards).mapInPandas(draw, "shard long, source_no long, first long, n long"), "draws")


def slots_of(drawn: DataFrame, plan: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """shard, slot, source_no, block_no: the block that each slot takes."""
    total = drawn.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(drawn.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    with_size = drawn.join(common.small(plan.select("source_no", "source_size")), "source_no").repartition(parts, "shard", "source_no")

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                n = -(-int(r.source_size) // block)
                at = np.arange(r.first, r.first + r.n)
                out = np.empty(len(at), dtype=np.int64)
                for turn in np.unique(at // n):
                    own = at // n == turn
                    out[own] = permuted(at[own] % n, n, (seed << 20) ^ (int(r.source_no) << 8) ^ int(turn))
                yield pd.DataFrame({"shard": r.shard, "slot": at, "source_no": r.source_no, "block_no": out})

    return with_size.mapInPandas(take, "shard long, slot long, source_no long, block_no long")


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: doc_id, source, size, source_size, target of every row; spans: what the mix takes, as
    shard, slot, source, block_no, doc_id, row, first_word, n_words, in which a document is repeated as often as its blocks are.

    Null texts, and texts without words, have size 0 and are never taken; null sources are one source, the last. Equal rows count as rows
    of their own (row tells them apart: it is _row of numbered docs, else a number that only this result has). An empty table gives no rows;
    columns other than doc_id, text, source and _row aren't read.
    """
    keyed = common.ROW in docs.columns
    # Rows that share an id go by their texts' hashes, so that reruns agree; rows that share both are alike.
    sizes = common.prefix_sums(sized(docs), {"size": "begin"}, ["doc_id", "_hash", common.ROW] if keyed else ["doc_id", "_hash"], ["source"]).drop("_hash")
    sizes = sizes.withColumnRenamed(common.ROW, "row") if keyed else sizes.withColumn("row", F.monotonically_increasing_id())
    sizes = common.stored(sizes, "sizes")
    plan = targets(sizes)
    plan = common.stored(plan.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")), "targets")
    rows = sizes.alias("d").join(common.small(plan).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.source_no")
    taken = slots_of(draws(plan, block, slots, seed), plan, block, seed)
    # Each document's part of each block it reaches into; a long text reaches into many.
    parts = rows.where("size > 0").select("doc_id", "row", "source", "source_no", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block_no"))
    low, high = F.greatest("begin", F.col("block_no") * block), F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * block)
    parts = parts.select("source_no", "block_no", "source", "doc_id", "row", (low - F.col("begin")).alias("first_word"), (high - low).alias("n_words"))
    # Both sides grow with the corpus: neither is broadcast.
    spans = taken.hint("merge").join(parts, ["source_no", "block_no"])
    spans = spans.select("shard", "slot", "source", "block_no", "doc_id", "row", "first_word", "n_words")
    return rows.drop("source_no", "begin"), spans


def mixed_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The mix as rows of docs' columns: for each span, its document's row with text cut to the span's words and, if there is one, n_chars set.

    Words keep the white space between them. Documents are found by _row, if docs were numbered (common.numbered) before mix(); else by
    doc_id, and docs with null or repeated ids are refused. _row isn't among the columns of the result.
    """
    apart = [c for c in ("doc_id", "text", "n_chars", common.ROW) if c in docs.columns]
    whole = common.packed(docs, apart).withColumn("doc_id", F.col("doc_id").cast("long")).drop("n_chars")
    if common.ROW in docs.columns:
        key, cuts = common.ROW, spans.withColumnRenamed("row", common.ROW)
    else:
        key, cuts = "doc_id", spans
        if not whole.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
            raise ValueError("documents with null or repeated ids: number them with common.numbered before mix")
    cuts = cuts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("shard", "slot", "first_word", "n_words"))).alias("cuts"))
    rows = whole.join(cuts, key).select("doc_id", "_rest", "cuts", "text")
    schema = StructType([*rows.select("doc_id", "_rest").schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = [], []
            for i, (cuts, text) in enumerate(zip(batch.column("cuts").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                data = text.encode("utf-8")
                words = [m.span() for m in _WORD.finditer(data)]
                for c in cuts:
                    taken = words[c["first_word"] : c["first_word"] + c["n_words"]]
                    if taken:
                        at.append(i)
                        texts.append(data[taken[0][0] : taken[-1][1]].decode("utf-8"))
                if len(texts) >= 2000:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("_rest").take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)
                    at, texts = [], []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("_rest").take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    taken = rows.mapInArrow(run, schema)
    return taken.select(*(c for c, name in zip(common.unpacked(docs.columns, apart), docs.columns, strict=True) if name != common.ROW))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    rows, spans = mix(common.documents(spark, sf_dir))
    taken = spans.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

"""Likely duplicates: all pairs above a threshold, and the best matches of given targets.

Both compare every fingerprint with every other (or with the targets) by definition. Rows are dealt to blocks of bounded size, a row each, which are stored once; tasks read the
blocks that meet in them, so no side is copied to a shuffle or broadcast. Within two blocks numpy bounds all scores at once and compares what may reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nearness
from ..functions.numbering import numbered
from ..functions.rounding import half_even
from ..session import cut_lineage

if TYPE_CHECKING:
    import pyarrow as pa

THRESHOLD = 0.55


def most_differing_bits(threshold: float = THRESHOLD) -> int:
    """Largest hash distance at which the score can still reach the threshold (colours give 0.45 at most; beyond 32 bits shape gives 0)."""
    if threshold <= 0.45 + 1e-9:  # colours alone can reach it
        return 64
    return math.floor(32 * (1 - max(0.0, (threshold - 0.45) / 0.55)) + 1e-9)


#: Most fingerprints in a block, and fewest where there are enough for FEW blocks.
ROWS, LEAST_ROWS, FEW = 4096, 256, 16


def blocks_for(prints: DataFrame) -> int:
    """Blocks for a count of fingerprints."""
    n = prints.count()
    return max(1, math.ceil(n / ROWS), min(FEW, math.ceil(n / LEAST_ROWS)))


def _blocks(prints: DataFrame, blocks: int | None = None) -> DataFrame:
    """prints (id, hi, lo, histogram) dealt to blocks and stored, a row a block: its number, ids in order, and the columns of numbers as bytes.

    All histograms of a block are of one length. Fingerprints that lack a part are like nothing and left out.
    """
    blocks = blocks or blocks_for(prints)
    whole = prints.select("id", F.col("hi").cast("long").alias("hi"), F.col("lo").cast("long").alias("lo"), F.col("histogram").cast("array<double>").alias("histogram"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        batches = list(batches)  # of one part of the table: some ROWS rows
        if not batches:
            return
        rows = pa.Table.from_batches(batches).drop_null().combine_chunks()
        values = rows["histogram"].combine_chunks()
        lacking = pc.unique(values.value_parent_indices().filter(values.flatten().is_null()))
        rows = rows.filter(pc.invert(pc.is_in(pa.array(range(len(rows))), lacking)))
        rows = rows.take(pc.sort_indices(rows["id"]))
        lengths = pc.list_value_length(rows["histogram"])
        block = TaskContext.get().partitionId()
        for length in pc.unique(lengths).to_pylist():
            alike = rows.filter(pc.equal(lengths, length))
            for at in range(0, len(alike), 2 * ROWS):
                some = alike.slice(at, 2 * ROWS).combine_chunks()
                ids, values = some["id"].combine_chunks(), some["histogram"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                numbers = {"hi": some["hi"].to_numpy(), "lo": some["lo"].to_numpy(), "bins": values}
                columns = {"block": pa.array([block], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids)}
                yield pa.RecordBatch.from_pydict(columns | {k: pa.array([v.tobytes()], pa.binary()) for k, v in numbers.items()})
                block += blocks

    kind = whole.schema["id"].dataType.simpleString()
    return cut_lineage(whole.repartition(blocks).mapInArrow(pack, f"block long, ids array<{kind}>, hi binary, lo binary, bins binary"))


def _mean(blocks: DataFrame) -> float:
    """A usual bin of a table of blocks: one over the bins of a histogram (bounds hold for any value)."""
    bins, n = blocks.agg(F.sum(F.octet_length("bins")), F.sum(F.octet_length("hi"))).first()
    return n / bins if bins else 1.0


def _met(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Pairs of blocks a, b. A Cartesian product: each task reads its two parts of the stored blocks, and nothing is copied to a shuffle or to all executors."""
    parts = ("block", "ids", "hi", "lo", "bins")
    sides = [df.select(*(F.col(c).alias(f"{side}_{c}") for c in parts)) for df, side in ((left, "a"), (right, "b"))]
    return sides[0].hint("shuffle_replicate_nl").join(sides[1], on)


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[tuple[int, int, pa.Array, pa.Array, nearness.Block, nearness.Block]]:
    """Numbers, ids and blocks of the rows of _met; a block that comes again at once is set up once."""
    import numpy as np

    kept: dict[str, tuple] = {}

    def side(row: pa.RecordBatch, name: str) -> tuple:
        number = row[f"{name}_block"][0].as_py()
        if kept.get(name, (None,))[0] != number:
            ids = row[f"{name}_ids"].flatten()
            hi, lo, bins = (np.frombuffer(row[f"{name}_{c}"][0].as_buffer(), t) for c, t in (("hi", np.int64), ("lo", np.int64), ("bins", np.float64)))
            kept[name] = number, ids, nearness.Block(ids.to_numpy(zero_copy_only=False), hi, lo, bins.reshape(len(hi), -1), mean)
        return kept[name]

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            (i, ids_a, a), (j, ids_b, b) = side(row, "a"), side(row, "b")
            yield i, j, ids_a, ids_b, a, b


def similar_pairs(prints: DataFrame, threshold: float = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """id_a < id_b, score (3 digits) of all pairs whose unrounded score reaches the threshold. prints: id, hi, lo, histogram.

    Every unordered pair of blocks meets once, as (a, b) or as (b, a) by turns, so that tasks have even shares.
    """
    stored = _blocks(prints, blocks)
    mean = _mean(stored)
    kind = prints.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for i, j, ids_a, ids_b, a, b in _pairs_of_blocks(batches, mean):
            for p, q, score in nearness.near(a, b, threshold, i == j):
                yield pa.RecordBatch.from_pydict({"a": ids_a.take(pa.array(p)), "b": ids_b.take(pa.array(q)), "score": pa.array(score)})

    once = "a_block = b_block or (a_block < b_block) = ((a_block + b_block) % 2 = 0)"
    found = _met(stored, stored, F.expr(once)).mapInArrow(compare, f"a {kind}, b {kind}, score double").where("a <> b")
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), half_even(F.col("score"), 3).alias("score"))


def best_matches(targets: DataFrame, prints: DataFrame, k: int = 3, threshold: float = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """id, match_id, rank, score: the k best others of each target; only scores that reach the threshold.

    A task carries the k best scores of a block of targets from one block to the next and gives out what was among the best when it was met; the best of that are ranked.
    """
    asked, stored = _blocks(targets, blocks), _blocks(prints, blocks)
    mean = _mean(stored)
    kinds = [df.schema["id"].dataType.simpleString() for df in (targets, prints)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        at, best = None, None
        for i, _, ids_a, ids_b, a, b in _pairs_of_blocks(batches, mean):
            if i != at:
                at, best = i, nearness.no_scores(a, k, threshold)
            p, q, score = nearness.nearest(a, b, best)
            yield pa.RecordBatch.from_pydict({"id": ids_a.take(pa.array(p)), "match_id": ids_b.take(pa.array(q)), "score": pa.array(score)})

    found = _met(asked, stored, F.lit(True)).mapInArrow(compare, f"id {kinds[0]}, match_id {kinds[1]}, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.col("match_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("id", "match_id", "rank", half_even(F.col("score"), 3).alias("score"))


def ranked_pairs(pairs: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """rank (from 1, by score, then ids) and score of pairs, with the given fields of both records (id, ...) as <field>_a and <field>_b: one join a side.

    Pairs are stored before they are numbered, which reads them twice; so are the few columns of the records, whose size then is known where the joins are planned.
    """
    order = [F.col("_neg").asc(), F.col("id_a").asc(), F.col("id_b").asc()]
    rows = numbered(cut_lineage(pairs).withColumn("_neg", -F.col("score")), order, "rank").drop("_neg")
    records = cut_lineage(records.select("id", *fields))
    for side in ("a", "b"):
        rows = rows.join(records.select(F.col("id").alias(f"id_{side}"), *(F.col(f).alias(f"{f}_{side}") for f in fields)), f"id_{side}")
    return rows.select("rank", "id_a", "id_b", *(f"{f}_{s}" for f in fields for s in ("a", "b")), "score")


def without_fingerprint(items: DataFrame, crops: DataFrame) -> DataFrame:
    """Approved items that have a crop but no fingerprint yet: what a backfill must do. items: id, status, fingerprint, crop_path; crops: crop_path."""
    missing = items.where("status = 'approved'").where(F.coalesce(F.col("fingerprint"), F.lit("{}")) == "{}")
    return missing.join(crops.select("crop_path").distinct(), "crop_path", "left_semi")


def flag_lookalikes(pending: DataFrame, matches: DataFrame) -> DataFrame:
    """pending (id, flags) with possible_duplicate added, and similar_to and similarity of the best match, where there is one."""
    top = matches.where("rank = 1").select("id", F.col("match_id").alias("similar_to"), F.col("score").alias("similarity"))
    rows = pending.join(top, "id", "left")
    marked = F.array_sort(F.array_union("flags", F.array(F.lit("possible_duplicate"))))
    return rows.withColumn("flags", F.when(F.col("similar_to").isNotNull(), marked).otherwise(F.col("flags")))

"""Best-fit packing of token sequences by a linear grouping scheme.

The plan is made on the histogram of piece lengths, which has at most `capacity` entries whatever the corpus:

1. Large lengths (over a half, third or quarter of the capacity), in falling order, form groups of equal cardinality; each counts as its group's largest.
2. Configurations of the few group sizes are optimised as a linear program by column generation, rounded down.
3. Actual lengths take the configurations' slots, group by group, so that what rounding up had wasted becomes free again.
4. What is left (rounding rests and small lengths) goes, longest first, where it fits best.

Where large lengths begin decides how much room rounding leaves for small ones, so a few groupings are planned and the
one that needs the fewest sequences is used.

The plan is a list of runs: the items of one length with ranks r..r+n-1 go to sequences b..b+n-1 at one offset. Spark
ranks the pieces within their length and looks up each one's run; nothing else is gathered anywhere.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
#: Groupings that are tried: number of groups, and the share of the capacity above which a length is large (1 / n).
GROUPINGS = ((8, 2), (48, 3), (32, 4))
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local long"
#: Rank bases (a row for each input partition and length) are broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 200_000


Run = tuple[int, int, int, int, int]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Gilmore-Gomory column generation: patterns (counts by size) and how often the linear program uses each."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    amount, length = np.array(demand, dtype=float), np.array(sizes)
    for _ in range(rounds):
        price = np.maximum(np.linalg.solve(basis, np.ones(k)), 0)
        # Unbounded knapsack over the capacity: value[c] of the best pattern within c, take[c] its last item.
        value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(length.min()), capacity + 1):
            worth = value[c - np.minimum(length, c)] + np.where(length <= c, price, -1)
            i = int(worth.argmax())
            value[c], take[c] = (worth[i], i) if worth[i] > value[c - 1] + 1e-12 else (value[c - 1], -1)
        if value[capacity] <= 1 + 1e-7:
            break
        pattern, c = np.zeros(k), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                pattern[take[c]] += 1
                c -= sizes[take[c]]
        solved = np.linalg.solve(basis.T, np.column_stack([amount, pattern]))
        use, along = solved[:, 0], solved[:, 1]
        ratio = np.where(along > 1e-9, np.maximum(use, 0) / np.where(along > 1e-9, along, 1), np.inf)
        basis[int(np.argmin(ratio))] = pattern
    use = np.linalg.solve(basis.T, amount)
    return [(basis[j].astype(int).tolist(), float(max(0, use[j]))) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groupings: tuple[tuple[int, int], ...] = GROUPINGS) -> tuple[list[Run], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every item, and the number of sequences."""
    return min((grouped(histogram, capacity, *g) for g in groupings), key=lambda x: x[1])


def grouped(histogram: dict[int, int], capacity: int, groups: int, share: int) -> tuple[list[Run], int]:
    """A plan for one grouping; see the module's text."""
    runs: list[Run] = []
    ranks: dict[int, int] = defaultdict(int)
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    sequences = 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: segments (first sequence, count) of alike sequences

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, ranks[length], count, first, offset))
        ranks[length] += count
        left[length] -= count

    if left.get(capacity):
        n = left[capacity]
        place(capacity, n, 0, 0)
        sequences = n
    large = sorted((n for n in left if capacity // share < n < capacity and left[n]), reverse=True)
    total = sum(left[n] for n in large)
    if total > 4 * groups:
        stacks: list[list[list[int]]] = []  # of each group: [length, count], longest first
        room = 0
        for n in large:
            count = left[n]
            while count:
                if not room:
                    stacks.append([])
                    room = -(-total // groups)
                took = min(room, count)
                stacks[-1].append([n, took])
                room, count = room - took, count - took
        sizes, demand = [s[0][0] for s in stacks], [sum(c for _, c in s) for s in stacks]
        merged: dict[int, int] = {}
        for i, n in enumerate(sizes):  # equal sizes (one length that fills several groups) count as one
            first = merged.setdefault(n, i)
            if first != i:
                demand[first] += demand[i]
                stacks[first] += stacks[i]
        keep = sorted(merged.values())
        sizes, demand, stacks = [sizes[i] for i in keep], [demand[i] for i in keep], [stacks[i] for i in keep]
        # Patterns with the most room for unlike lengths first, each filled slot by slot.
        for pattern, times in configurations(sizes, demand, capacity):
            count = min([int(times + 1e-6), *(sum(c for _, c in stacks[g]) // a for g, a in enumerate(pattern) if a)])
            if count < 1:
                continue
            segments = [(sequences, count, 0)]  # first sequence, count, used tokens
            sequences += count
            for g, a in enumerate(pattern):
                for _ in range(a):
                    after = []
                    for first, n, used in segments:
                        while n:
                            length, there = stacks[g][0]
                            took = min(n, there)
                            place(length, took, first, used)
                            after.append((first, took, used + length))
                            first, n = first + took, n - took
                            stacks[g][0][1] -= took
                            if not stacks[g][0][1]:
                                stacks[g].pop(0)
                    segments = after
            for first, n, used in segments:
                if used < capacity:
                    free[capacity - used].append((first, n))
    rooms = sorted(free)
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                count = -(-left[length] // (capacity // length))
                rooms.append(capacity)
                free[capacity] = [(sequences, count)]
                sequences += count
            room = rooms[i]
            first, n = free[room].pop()
            took = min(n, left[length])
            place(length, took, first, capacity - room)
            if took < n:
                free[room].append((first + took, n - took))
            if not free[room]:
                del free[room], rooms[i]
            if room > length:
                if room - length not in free:
                    bisect.insort(rooms, room - length)
                free[room - length].append((first, took))
    return runs, sequences


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and cut ids that exceed the capacity; the first piece may be shorter.

    Besides the piece's ids, gives the task that made it (part) and its rank among that task's pieces of equal length (local).
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = tokens.encoder(vocabulary), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in common.text_chunks(common.byte_lengths(texts), tokens.CHUNK):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], encoder.many(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    ends = [*range(n % capacity or capacity, n, capacity), n]
                    for piece, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                        rows.append((doc_id, piece, x, y - x, ids[4 * x : 4 * y], part, seen[y - x]))
                        seen[y - x] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "local"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids, sequence_id, offset (gapless from 0 in each sequence).

    A null or empty text has its end id alone. Equal ids and equal rows are packed as rows of their own; an empty table gives
    no rows. Other columns are not read. Pieces are written once to the shared folder, so that ranks and placement read the same files.
    """
    spark = docs.sparkSession
    pieces = common.stored(cut(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), "pieces")
    counts = common.stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = counts.count() <= BROADCAST_ROWS
    ranked = pieces.join(F.broadcast(bases) if few else bases, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("local")).alias("rank"))
    plan_table = spark.sparkContext.broadcast((keys, table))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = plan_table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(length) else table[:0]
            columns = [*batch.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens; ids_crc32 is the digest of the packed ids."""
    rows = pack(common.documents(spark, sf_dir), tokens.default_vocabulary())
    return rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

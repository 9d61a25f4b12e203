"""N-gram Jaccard join: an exact similarity self-join in the metric space of shingle sets under Jaccard distance.

Cells. Two sets within distance eps = 1 - t share a shingle among the first n - ceil(t n) + 1 of either, in any common order of shingles. So
shingles of these prefixes are coarse cells in which every near pair meets; sets that meet in none are too far apart and are never
compared. The common order puts shingles that are frequent in some part of the corpus last, by a fixed-size table. Cells of equal members count once.

Regions. Each cell elects its most central member as pivot: the one that shares most of its prefix with others, so that a group of near sets elects
the same pivot nearly everywhere. Cells of one pivot form its region, and a pair is compared once in a region however many cells it shares.

Recursion. A region of bounded size is joined in one task: pivot after pivot, most central first, where the triangle inequality
|d(x, p) - d(y, p)| <= d(x, y) and common components rule members out. A larger region elects many pivots, which are compared with all its members in
blocks of bounded size. Its members go to the Voronoi region of their nearest pivot (pivots closer than 4 eps share one; members beyond 3 eps
of all go to an outer region), and those whose distance to another region's pivot is within the window min(d(nearest) + 2 eps, 4 eps) are
replicated to it. Pivots are done by then and leave; regions that links have made one component are done as well. Regions join
recursively until they are bounded. New pivots come from members outside a region's largest component only, so that a large group of
near copies costs a few rounds and not a comparison of all its pairs.

Before full sets are shuffled, sizes and parity signatures, which bound distances from below, rule out members that can't be near any other of their
region. Every link is confirmed on the full sets of shingles, as 64-bit hashes: two different shingles are taken for one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles

#: Classes of the fixed-size table that orders shingles by frequency.
ORDER_CLASSES = 1 << 20
#: Occurrences within one flush of one task from which a shingle counts as frequent.
FREQUENT = 2
FLUSH = 3_000_000
#: Bounds of a region, or a block of one, that a task joins: members, and shingles of all its sets together.
MEMBERS = 2048
SHINGLES = 2_000_000
#: Pivots of a larger region in its first round; each further round elects twice as many, up to MEMBERS.
PIVOTS = 64
#: Shingles of the HOT_LEVELS highest orders of magnitude (and of 2**LEAST_HOT occurrences or more) are hot: their cells' entries are spread over SALTS.
HOT_LEVELS, LEAST_HOT, SALTS = 6, 10, 4096
#: Sets of more shingles have a wide signature too, as 1024 bits say little about them.
WIDE_FROM = 2000


def survey(docs: DataFrame, k: int) -> DataFrame:
    """One pass over the texts: a row for each document (size, digest and signatures of its set), and rows of frequent shingles."""
    names = ["doc_id", "n", "fp1", "fp2", "shingle", "times", "signature", "wide"]
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0

        def frequent() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(gathered or [np.zeros(0, np.uint64)]), return_counts=True)
            some = times >= FREQUENT
            gathered.clear()
            seen.clear()
            return batch_of(int(some.sum()), {"shingle": values[some].view(np.int64), "times": times[some]})

        def batch_of(n: int, columns: dict) -> pa.RecordBatch:
            arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            rows = []
            for doc_id, own in shingles.of_batch(batch, k):
                fp = shingles.fingerprint(own) if len(own) else (None, None)
                wide = shingles.signature(own, shingles.WIDE_BITS) if len(own) > WIDE_FROM else None
                rows.append((doc_id, len(own), *fp, shingles.signature(own) if len(own) else None, wide))
                if len(own) and fp[0] not in seen:  # copies in one task count once
                    seen.add(fp[0])
                    gathered.append(own)
                    total += len(own)
                    if total > FLUSH:
                        yield frequent()
                        total = 0
            yield batch_of(len(rows), dict(zip(["doc_id", "n", "fp1", "fp2", "signature", "wide"], zip(*rows, strict=True), strict=False)))
        yield frequent()

    schema = "doc_id long, n long, fp1 long, fp2 long, shingle long, times long, signature binary, wide binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def order_table(surveyed: DataFrame) -> np.ndarray:
    """For each class of shingle hashes the order of magnitude of its most frequent shingle: ORDER_CLASSES bytes, whatever the corpus."""
    totals = surveyed.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    levels = totals.groupBy((F.col("shingle").bitwiseAND(ORDER_CLASSES - 1)).cast("int").alias("class")).agg(F.max(F.floor(F.log2("times"))).cast("int").alias("level"))
    rows = levels.toArrow()  # at most ORDER_CLASSES rows, as columns
    table = np.zeros(ORDER_CLASSES, dtype=np.uint8)
    table[rows["class"].to_numpy()] = rows["level"].to_numpy()
    return table


def _prefix_length(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def prefixes(docs: DataFrame, k: int, similarity: int, table: np.ndarray) -> DataFrame:
    """Cell entries: shingle, fp1 of each set's prefix, and a salt: 0, or of the most frequent shingles a number from 1 by the set.

    Sets that a task has met before are left out.
    """
    top = int(table.max()) - HOT_LEVELS
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            cells, owners, salts = [], [], []
            for _, own in shingles.of_batch(batch, k):
                if not len(own) or (fp := shingles.fingerprint(own)[0]) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(fp)
                level = table[(own & np.uint64(ORDER_CLASSES - 1)).astype(np.int64)]
                order = np.argsort((level.astype(np.uint64) << np.uint64(58)) | (own >> np.uint64(6)), kind="stable")
                first = order[: _prefix_length(len(own), similarity)]
                cells.append(own[first])
                owners.append(np.full(len(first), fp, dtype=np.int64))
                salts.append(np.where(level[first] >= max(LEAST_HOT, top), 1 + fp % SALTS, 0))
            if cells:
                columns = [np.concatenate(cells).view(np.int64), np.concatenate(owners), np.concatenate(salts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "fp1", "salt"])

    return docs.select("doc_id", "text").mapInArrow(run, "cell long, fp1 long, salt int")


def coarse_regions(entries: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """region (its pivot), x, apart of all members: regions in which every near pair meets.

    entries: cell, fp1, salt; nodes: fp1, x, n. apart orders members, the most central ones (those with the largest share of their prefix in cells of
    others) first. One shuffle finds the cells of several sets, and digests of their members: of cells with the same members one stays. Entries of
    the most frequent cells, which surely have several, are spread by their salt, and those cells all stay.
    """
    cell = Window.partitionBy("cell", "salt")
    digest = [F.bit_xor(F.xxhash64("fp1", F.lit(i))).over(cell) for i in range(2)]
    met = entries.repartition("cell", "salt").distinct().withColumn("n", F.count("*").over(cell)).where("salt > 0 or n > 1")
    met = met.select("cell", "fp1", "salt", digest[0].alias("a"), digest[1].alias("b"), (F.col("fp1") == F.min("fp1").over(cell)).alias("first"))
    met = common.stored(met, "met")
    kept = common.stored(met.where("salt = 0 and first").groupBy("a", "b").agg(F.min("cell").alias("cell")).select("cell"), "cells")
    length = F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1
    # Ten bits of the share that isn't met elsewhere, then a hash.
    share = F.least(F.floor(1000 * (1 - F.col("cells") / length)), F.lit(1000)).cast("long")
    apart = F.shiftleft(F.greatest(share, F.lit(0)), 52).bitwiseOR(F.xxhash64("x").bitwiseAND((1 << 52) - 1))
    central = met.groupBy("fp1").agg(F.count("*").alias("cells")).join(nodes, "fp1").select("fp1", "x", apart.alias("apart"))
    entries = met.where("salt = 0").join(common.small(kept), "cell").select("cell", "fp1").unionByName(met.where("salt > 0").select("cell", "fp1"))
    members = common.stored(entries.join(central, "fp1").select("cell", "x", "apart"), "members")
    pivots = common.stored(members.groupBy("cell").agg(F.min_by("x", "apart").alias("region")), "pivots")
    return common.stored(members.join(common.small(pivots), "cell").select("region", "x", "apart").distinct(), "regions")


def node_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """x, n, shingles (ascending 64-bit hashes as bytes) of the documents whose ids x are given; equal sets of one id once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("x"), "text").join(common.small(common.stored(ids, "needed")), "x", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x, len(s), shingles.fingerprint(s)[0], s.tobytes()) for x, s in shingles.of_batch(batch, k) if len(s)]
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["x", "n", "fp1", "shingles"])

    sets = common.stored(texts.mapInArrow(run, "x long, n long, fp1 long, shingles binary"), "sets")
    if not sets.groupBy("x", "fp1").count().where("count > 1").isEmpty():
        sets = common.stored(sets.dropDuplicates(["x", "fp1"]), "sets")
    return sets.drop("fp1")


class Family:
    """Some sets and their exact Jaccard distances."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        values, self.places = np.unique(np.concatenate(sets), return_inverse=True)
        self.mask = np.zeros(len(values), dtype=bool)
        times = np.bincount(self.places)
        #: Mean number of the family's sets that hold a shingle of the set: the most central sets have the most.
        self.central = np.add.reduceat(times[self.places], self.starts) / self.sizes

    def compare(self, i: int, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of all sets to set i, and which of them are near it."""
        own = self.places[self.starts[i] : self.ends[i]]
        self.mask[own] = True
        shared = np.add.reduceat(self.mask[self.places], self.starts, dtype=np.int64)
        self.mask[own] = False
        union = self.sizes + self.sizes[i] - shared
        return 1 - shared / union, 100 * shared >= similarity * union


def _join_labels(labels: np.ndarray, near: np.ndarray) -> None:
    """Give all sets of the components that `near` touches one label."""
    some = np.unique(labels[near])
    if len(some) > 1:
        labels[np.isin(labels, some)] = some[0]


def _stars(ids: np.ndarray, labels: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of every id to the least one of its component."""
    least = np.full(len(labels), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, ids)
    to = least[labels]
    return ids[ids != to].tolist(), to[ids != to].tolist()


def join_region(ids: np.ndarray, sets: list[np.ndarray], similarity: int) -> tuple[list[int], list[int]]:
    """Links that connect whatever sets of a bounded region near pairs connect: pivot after pivot, the most central first.

    A pivot is compared only if some set of another component is inside the windows of all pivots before it.
    """
    eps, n = 1 - similarity / 100, len(ids)
    labels = np.arange(n)
    if n == 2:
        _join_labels(labels, Family(sets).compare(0, similarity)[1])
        return _stars(ids, labels)
    family = Family(sets)
    lower = np.zeros((n, n)) if n <= 64 else None  # the best bound of each pair's distance, or (of many sets) some pivots' distances
    known: list[np.ndarray] = []
    for i in np.argsort(-family.central, kind="stable"):
        other = labels != labels[i]
        if not other.any():
            if (labels == labels[0]).all():
                break
            continue
        other &= 100 * np.minimum(family.sizes, family.sizes[i]) >= similarity * np.maximum(family.sizes, family.sizes[i])
        if lower is not None:
            other &= lower[i] <= eps + 1e-9
        else:
            for d in known:
                other &= np.abs(d - d[i]) <= eps + 1e-9
        if not other.any():
            continue
        distances, near = family.compare(i, similarity)
        _join_labels(labels, near)
        if lower is not None:
            np.maximum(lower, np.abs(distances[:, None] - distances), out=lower)
        elif len(known) < 32:
            known.append(distances)
    return _stars(ids, labels)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows that are equal in the first `keys` columns, as (key, values of the other columns)."""
    key, rows = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.stack([batch.column(c).to_numpy() for c in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1).tolist(), len(heads)]
        columns = [batch.column(c).to_pylist() for c in range(keys, batch.num_columns)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(heads[a].tolist())
            if now != key:
                if rows is not None:
                    yield key, rows
                key, rows = now, [[] for _ in columns]
            for kept, column in zip(rows, columns, strict=True):
                kept += column[a:b]
    if rows is not None:
        yield key, rows


def _arrays(values: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.uint64) for v in values]


def _may_be_near(sizes: np.ndarray, signatures: list[bytes | None], similarity: int) -> np.ndarray:
    """Which of some sets may be near another one: |A xor B| = u - i and |A| + |B| = u + i, so a lower bound of the former bounds i / u from above.

    Sizes and, of pairs that both have one, signatures bound it.
    """
    known = np.array([v is not None for v in signatures])
    bits = np.zeros((len(sizes), max((len(v) for v in signatures if v is not None), default=8) // 8), dtype=np.uint64)
    for i in np.flatnonzero(known):
        bits[i] = np.frombuffer(signatures[i], dtype=np.uint64)
    found = np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes) - 1):
        total, rest = sizes[i] + sizes[i + 1 :], slice(i + 1, None)
        differ = abs(sizes[rest] - sizes[i])
        if known[i]:
            differ = np.maximum(differ, np.where(known[rest], np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64), 0))
        near = np.flatnonzero((total - differ) * 100 >= (total + differ) * similarity)
        if len(near):
            found[i] = True
            found[i + 1 + near] = True
    return found


def plausible(regions: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The rows of regions without members that, by sizes and signatures, can't be near any other of their region. Large regions stay whole.

    nodes: x, n, signature (null: its size alone counts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region,), (x, apart, n, signature) in _groups(batches, 1):
            if len(x) > 1:
                at = np.flatnonzero(_may_be_near(np.array(n, dtype=np.int64), signature, similarity))
                if len(at):
                    columns = [[region] * len(at), [x[i] for i in at], [apart[i] for i in at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["region", "x", "apart"])

    sizes = common.stored(regions.groupBy("region").agg(F.count("*").alias("members")), "region_sizes")
    large = sizes.where(f"members > {MEMBERS}").select("region")
    some = not large.isEmpty()
    bounded = regions.join(large, "region", "left_anti") if some else regions
    rows = nodes.join(common.small(bounded), "x").select("region", "x", "apart", "n", "signature")
    checked = rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region long, x long, apart long")
    return checked.unionByName(regions.join(large, "region").select("region", "x", "apart")) if some else checked


def bounded_links(regions: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """x, y: links within regions (region, x) of bounded size, each in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, values) in _groups(batches, 1):
            if len(ids) > 1:
                links = join_region(np.array(ids, dtype=np.int64), _arrays(values), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links], ["x", "y"])

    rows = sets.join(common.small(regions), "x").select("region", "x", "shingles").repartition("region").sortWithinPartitions("region")
    return rows.mapInArrow(run, "x long, y long")


def divided(rows: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: int, turn: int) -> DataFrame:
    """One round over large regions: links (x, y; region null) and members (region, x, apart, n; y null) of their Voronoi regions.

    rows: region, x, apart, n, outside (may be a pivot); sizes: region, members, shingles, outsiders. Pivots are the first by apart of as many hash
    buckets, and are sent to all blocks of their region; together their sets are no larger than a block on average. If all outsiders are pivots
    the region is done and gives links only.
    """
    eps = 1 - similarity / 100
    pivots = F.greatest(F.least(F.lit(min(PIVOTS << min(turn, 20), MEMBERS)), F.floor(SHINGLES * F.col("members") / F.col("shingles"))), F.lit(1)).cast("long")
    sizes = sizes.withColumn("pivots", pivots).withColumn("last", F.col("outsiders") <= F.col("pivots"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("members") / MEMBERS, F.col("shingles") / SHINGLES)).cast("long"))
    rows = rows.join(sizes.select("region", "pivots", "last", "blocks"), "region")
    bucket = F.when(F.col("last"), F.col("x")).otherwise(F.pmod(F.xxhash64("x", F.lit(turn)), F.col("pivots")))
    chosen = rows.where("outside").groupBy("region", bucket.alias("bucket"), "last", "blocks").agg(F.min_by("x", "apart").alias("x"), F.min("apart").alias("apart"))
    chosen = chosen.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "last", "x", "apart")
    members = rows.select("region", F.pmod(F.xxhash64("x", F.lit("block")), F.col("blocks")).alias("block"), F.lit(1).alias("role"), "last", "x", "apart")
    both = chosen.unionByName(members).join(sets.select("x", "shingles"), "x").select("region", "block", "role", "last", "x", "apart", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), (role, last, x, apart, values) in _groups(batches, 2):
            ids, family, p = np.array(x, dtype=np.int64), Family(_arrays(values)), role.count(0)  # pivots are sorted before members
            labels, far = np.arange(len(ids)), np.ones((p, len(ids)))
            for i in range(p):
                far[i], near = family.compare(i, similarity)
                _join_labels(labels, near)
            links = [pa.array(c, pa.int64()) for c in _stars(ids, labels)]
            none = pa.nulls(len(links[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, links[0], none, none, links[1]], ["region", "x", "apart", "n", "y"])
            if last[0]:
                continue
            centre = np.array([int(np.flatnonzero(far[: i + 1, i] <= 4 * eps)[0]) for i in range(p)])  # the first pivot this close, at the latest itself
            nearest = far.min(axis=0)
            stays = ~np.isin(ids, ids[:p])
            stays[:p] = False
            for c in [*np.unique(centre).tolist(), -1]:
                if c < 0:
                    here = nearest > 3 * eps
                else:
                    here = (distance := far[centre == c].min(axis=0)) <= np.minimum(nearest + 2 * eps, 4 * eps) + 1e-9
                at = np.flatnonzero(here & stays)
                if len(at):
                    name = (region * 0x9E3779B97F4A7C15 + (c + 2) * 0xBF58476D1CE4E5B9 + turn + 1) % 2**63
                    columns = [[name] * len(at), ids[at], [apart[j] for j in at], family.sizes[at], [None] * len(at)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["region", "x", "apart", "n", "y"])

    both = both.repartition("region", "block").sortWithinPartitions("region", "block", "role")
    return both.mapInArrow(run, "region long, x long, apart long, n long, y long")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.count_if("outside").alias("outsiders"))


def near_links(regions: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """x, y: links that connect whatever near pairs connect, of regions of any size."""
    rows = regions.join(sets.select("x", "n"), "x").withColumn("outside", F.lit(True))
    links: list[DataFrame] = []
    turn = 0
    while True:
        sizes = common.stored(_sizes(rows), "sizes")
        bounded = f"members <= {MEMBERS} and shingles <= {SHINGLES}"
        large = sizes.where(f"not ({bounded})")
        some = not large.isEmpty()
        small = rows.join(sizes.where(bounded).select("region"), "region") if some else rows
        links.append(common.stored(bounded_links(small.select("region", "x"), sets, similarity), "links"))
        if not some:
            return _union(links)
        rows = rows.join(large.select("region"), "region")
        found = common.stored(divided(rows, large, sets, similarity, turn), "divided")
        links.append(found.where("y is not null").select("x", "y"))
        rows = found.where("y is null").select("region", "x", "apart", "n")
        # What links have joined needs no comparison any more: new pivots come from outside a region's largest component.
        labels = common.components(rows.sparkSession, _union(links), "x", "y").withColumnRenamed("node", "x")
        rows = common.stored(_labelled(rows, labels), "labelled")
        parts = rows.groupBy("region", "component").agg(F.count("*").alias("n"))
        largest = parts.groupBy("region").agg(F.count("*").alias("parts"), F.max_by("component", "n").alias("largest")).where("parts > 1")
        rows = common.stored(rows.join(largest, "region").select("region", "x", "apart", "n", (F.col("component") != F.col("largest")).alias("outside")), "rows")
        turn += 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component of x; nodes without links, which labels don't hold, are their own."""
    return rows.join(labels, "x", "left").withColumn("component", F.coalesce("component", "x"))


def join(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """Join documents whose shingle sets have Jaccard similarity of at least `similarity` percent: doc_id, n_shingles, class_id, component_id.

    Words are runs of non-white-space with A-Z as a-z; a text of fewer than k words has one shingle. class_id is the least doc_id of equal sets,
    component_id the least that links reach. Null and empty texts, and texts of white space, have no shingles and are
    their own component; so are rows with a null doc_id, whose ids stay null. Equal rows stay rows of their own; an empty table gives none.
    Columns other than doc_id and text are not read. Texts are read whole, three times; a long one is hashed in slices.
    """
    surveyed = common.stored(survey(docs, k), "survey")
    rows = surveyed.where("shingle is null").select("doc_id", "n", "fp1", "fp2", "signature", "wide")
    usable: Column = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    nodes = common.stored(rows.where(usable).groupBy("fp1", "fp2").agg(F.min("doc_id").alias("x"), *(F.first(c).alias(c) for c in ("n", "signature", "wide"))), "nodes")
    known = docs.where("doc_id is not null")
    # A node is found by half of its digest; should halves agree, both nodes take part.
    regions = coarse_regions(prefixes(known, k, similarity, order_table(surveyed)), nodes.select("fp1", "x", "n"), similarity)
    regions = common.stored(plausible(regions, nodes.select("x", "n", "signature"), similarity), "plausible")
    wide = nodes.where(F.col("wide").isNotNull()).select("x", F.col("wide").alias("signature"))
    regions = common.stored(plausible(regions, nodes.select("x", "n").join(wide, "x", "left"), similarity), "plausible")
    sets = node_sets(known, regions.select("x").distinct(), k)
    links = near_links(regions, sets, similarity)
    labels = common.components(docs.sparkSession, links, "x", "y").withColumnRenamed("node", "x")
    classes = _labelled(nodes.select("fp1", "fp2", "x"), labels)
    linked = rows.where(usable).join(classes, ["fp1", "fp2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("x").alias("class_id"), F.col("component").alias("component_id"))
    alone = rows.where(~usable).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 4-word shingle sets with similarity of 85 percent or more."""
    return join(common.documents(spark, sf_dir), k=4, similarity=85).select("doc_id", "n_shingles", "component_id", "class_id")

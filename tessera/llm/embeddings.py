"""Near-duplicate vectors by an inverted-list index with product-quantised residuals and exact cosine rerank.

Vectors on the unit sphere go to the inverted list of their nearest coarse centroid, coded by subspace codewords of the residual.
A vector probes every list whose bounding hyperplane is near enough (see PROBE). In a probed list, distances come from lookup tables
of the query's residual against the codewords; since a member's own coding error e is stored, |y - x| >= |y - coded x| - e, and filtering
by that bound loses nothing. What passes is reranked by cosine in double precision.

Equal vectors of one label are one entry with a multiplicity. Lists of any size are cut into blocks of at most BLOCK rows and each pair of
blocks is one group; groups return counts of links and a spanning forest of them, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SUBSPACES = 8
CODEWORDS = 64
#: Vectors that the centroids and codewords are fitted on at most: a sample by a hash of the vector's id.
MAX_FITTED = 20_000
BLOCK = 2048
#: A list is probed if the hyperplane between it and the query's own list is within PROBE standard deviations of the largest linked
#: distance r, projected on a random direction (r / sqrt(dimensions)). Dimensions are the vector's own, and no more than those in which residuals
#: of the fitted sample vary in effect.
PROBE = 4.0


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from a seeded sample of the rows; empty clusters keep their place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=k)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centroids and residual codewords for unit vectors of up to `dims` components (shorter ones are padded with zeros)."""

    def __init__(self, sample: np.ndarray, n_vectors: int, seed: int = 1):
        dims = -(-sample.shape[1] // SUBSPACES) * SUBSPACES
        self.dims = dims
        sample = self.padded(sample)
        # The number of lists grows with the square root of the vectors, as far as the sample can hold them apart.
        lists = int(min(max(1, round(n_vectors**0.5 / 4)), max(1, len(sample) // 8)))
        self.centres = kmeans(sample, lists, seed)
        gaps = ((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2) if lists <= 512 else None
        self.gaps = np.sqrt(gaps) if gaps is not None else None
        rest = sample - self.centres[nearest(sample, self.centres)]
        spread = rest.T @ rest
        self.effective = max(1.0, float(np.trace(spread) ** 2 / max((spread**2).sum(), 1e-300)))
        words = min(CODEWORDS, len(sample))
        self.words = np.stack([kmeans(part, words, seed + 1 + s) for s, part in enumerate(np.split(rest, SUBSPACES, axis=1))])

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.dims - x.shape[1])))

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of padded unit vectors."""
        home = nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.stack([nearest(part, self.words[s]) for s, part in enumerate(np.split(rest, SUBSPACES, axis=1))], axis=1).astype(np.uint8)
        coded = np.concatenate([self.words[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
        return home, codes, np.sqrt(((rest - coded) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, home: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """Of each vector, the lists whose hyperplane against its own list is within its reach; its own is always among them."""
        out = []
        for i in range(0, len(x), 1024):
            part, own = x[i : i + 1024], home[i : i + 1024]
            far = ((part**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1)) - 2 * part @ self.centres.T
            if self.gaps is not None:
                gap = self.gaps[own]
            else:
                mine = self.centres[own]
                gap = np.sqrt(np.maximum((mine**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * mine @ self.centres.T, 0))
            across = (far - far[np.arange(len(part)), own][:, None]) <= 2 * reach[i : i + 1024, None] * gap
            across[np.arange(len(part)), own] = True
            out += [np.flatnonzero(row) for row in across]
        return out

    def estimates(self, y: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded members of one list, summed from lookup tables."""
        rest = y - self.centres[list_no]
        total = np.zeros((len(y), len(codes)))
        for s, part in enumerate(np.split(rest, SUBSPACES, axis=1)):
            words = self.words[s]
            table = (part**2).sum(axis=1)[:, None] + (words**2).sum(axis=1) - 2 * part @ words.T
            total += table[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def _unit(column: pd.Series) -> np.ndarray:
    """Rows of equal or unequal length as unit vectors in double precision, padded with zeros."""
    rows = [np.asarray(v, dtype=np.float64) for v in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v / np.linalg.norm(v)
    return out


def _forest(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> list[tuple[int, int]]:
    """A spanning forest of the bipartite graph of (row, column) links."""
    root = list(range(n_rows + n_columns))
    kept = []
    for a, b in zip(rows.tolist(), (columns + n_rows).tolist(), strict=True):
        x, y = a, b
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[y] = x
            kept.append((a, b - n_rows))
    return kept


def fit(entries: DataFrame, id_col: str = "x") -> Index | None:
    """Fit an index on a bounded sample of the entries; None if there are none."""
    n = entries.count()
    if not n:
        return None
    sample = entries.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(min(1.0, MAX_FITTED / n) * (1 << 30))) if n > MAX_FITTED else entries
    rows = sample.orderBy(id_col).select("embedding").toPandas()
    if rows.empty:
        rows = entries.orderBy(id_col).limit(1).select("embedding").toPandas()
    longest = entries.agg(F.max(F.size("embedding")).alias("n")).first()["n"]
    unit = _unit(rows["embedding"])
    return Index(np.pad(unit, ((0, 0), (0, longest - unit.shape[1]))), n)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked to it), component_id (least vec_id that links reach), kept.

    Vectors link if their labels are equal and not null (any, without label_col), their lengths are equal and their cosine is at least
    `cosine`. Null, empty and zero vectors, and those with null or non-finite components, link with nothing; so do rows with a null id. Equal rows
    count as different vectors. An empty table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("usable", usable)
    entries = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("x"), F.count("*").alias("times"))
    entries = common.stored(entries, "entries")
    index = fit(entries)
    single = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if index is None:
        return single
    shared = spark.sparkContext.broadcast(index)
    distance = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for frame in frames:
            if len(frame):
                unit = index.padded(_unit(frame["embedding"]))
                home, codes, error = index.code(unit)
                reach = distance * np.minimum(1.0, PROBE / np.sqrt(np.minimum(frame["dims"].to_numpy(), index.effective)))
                yield frame.assign(list_no=home, codes=[c.tobytes() for c in codes], error=error, probes=index.probes(unit, home, reach))

    coded = entries.select("x", "label", "times", "embedding", F.size("embedding").alias("dims"))
    coded = coded.mapInPandas(assign, coded.schema.simpleString()[7:-1].replace(",embedding", ", embedding") + ",list_no int,codes binary,error double,probes array<int>")
    coded = common.stored(coded, "coded")
    place = ["label", "dims", "list_no"]
    asked = coded.withColumn("own_list", F.col("list_no")).withColumn("list_no", F.explode("probes"))
    sizes = coded.groupBy(*place).agg(F.count("*").alias("members")).join(asked.groupBy(*place).agg(F.count("*").alias("askers")), place)
    sizes = sizes.select(*place, F.ceil(F.col("members") / BLOCK).cast("int").alias("m_blocks"), F.ceil(F.col("askers") / BLOCK).cast("int").alias("q_blocks"))
    sizes = common.stored(sizes, "sizes")
    some = F.xxhash64("x")
    columns = ["role", *place, "i", "j", "x", "times", "own_list", "embedding", "codes", "error", "probes"]
    members = coded.withColumn("own_list", F.col("list_no")).join(sizes, place).withColumn("role", F.lit(0)).withColumn("i", F.pmod(some, F.col("m_blocks")).cast("int"))
    members = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select(*columns)
    askers = asked.join(sizes, place).withColumn("role", F.lit(1)).withColumn("j", F.pmod(some, F.col("q_blocks")).cast("int"))
    askers = askers.withColumn("codes", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("double")).withColumn("probes", F.lit(None).cast("array<int>"))
    askers = askers.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1))).select(*columns)

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        m, q = frame[frame["role"] == 0], frame[frame["role"] == 1]
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        if len(m) and len(q):
            list_no = int(m["list_no"].iloc[0])
            x, y = index.padded(_unit(m["embedding"])), index.padded(_unit(q["embedding"]))
            x_id, y_id, x_times, y_times = m["x"].to_numpy(), q["x"].to_numpy(), m["times"].to_numpy(), q["times"].to_numpy()
            codes = np.frombuffer(b"".join(m["codes"]), dtype=np.uint8).reshape(len(m), SUBSPACES)
            y_list = q["own_list"].to_numpy()
            asks = np.zeros((len(m), len(index.centres)), dtype=bool)
            for row, lists in enumerate(m["probes"]):
                asks[row, np.asarray(lists)] = True
            x_count, y_count, found = np.zeros(len(m), np.int64), np.zeros(len(q), np.int64), []
            for a in range(0, len(q), 512):
                r, c = np.nonzero(index.estimates(y[a : a + 512], list_no, codes) <= distance + m["error"].to_numpy() + 1e-9)
                r += a
                # A pair whose members ask each other's lists is met twice (or, within a list, in both orders): one of them counts.
                once = (y_id[r] < x_id[c]) | ((y_list[r] != list_no) & ~asks[c, y_list[r]])
                r, c = r[once], c[once]
                for p in range(0, len(r), 1 << 15):
                    s = slice(p, p + (1 << 15))
                    near = np.einsum("ij,ij->i", y[r[s]], x[c[s]]) >= cosine
                    rr, cc = r[s][near], c[s][near]
                    np.add.at(y_count, rr, x_times[cc])
                    np.add.at(x_count, cc, y_times[rr])
                    found += _forest(rr, cc, len(q), len(m))
            for ids, n in ((x_id, x_count), (y_id, y_count)):
                for one, k in zip(ids[n > 0].tolist(), n[n > 0].tolist(), strict=True):
                    counts[one] = counts.get(one, 0) + k
            edges = [(int(y_id[a]), int(x_id[b])) for a, b in set(found)]
        ids = [*counts, *[a for a, _ in edges]]
        return pd.DataFrame({"x": ids, "n": [*counts.values(), *[None] * len(edges)], "y": [*[None] * len(counts), *[b for _, b in edges]]}).astype({"x": "Int64", "n": "Int64", "y": "Int64"})

    found = common.stored(members.unionByName(askers).groupBy(*place, "i", "j").applyInPandas(links, "x long, n long, y long"), "found")
    counts = found.where("n is not null").groupBy("x").agg(F.sum("n").alias("n"))
    labels = common.components(spark, found.where("y is not null"), "x", "y").withColumnRenamed("node", "x")
    whole = entries.join(counts, "x", "left").join(labels, "x", "left")
    whole = whole.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("component", "x").alias("component_id"))
    linked = rows.where("usable").join(whole, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(single)


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings with equal labels and a cosine of 0.93 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

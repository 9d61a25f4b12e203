"""Look-alikes by blocks: best matches and pairs against plain Python, what their plans copy, and how often pairs are worked out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import nearness
from tessera.operators import lookalikes

PRINT = "id long, hi long, lo long, histogram array<double>"


def drawn(n, seed, bins=13, first=0):
    """Hashes near a few centres; every third histogram like that of the one before, some with a number that isn't one."""
    rng, rows = random.Random(seed), []
    centres = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(4)]
    for i in range(n):
        hi, lo = centres[i % 4]
        for _ in range(rng.randrange(20)):
            hi, lo = hi ^ 1 << rng.randrange(32), lo ^ 1 << rng.randrange(32)
        values = [rng.random() ** 2 for _ in range(bins)]
        histogram = rows[-1][3] if i % 3 == 2 else [v / sum(values) for v in values]
        if i % 50 == 49:
            histogram = [math.nan, *histogram[1:]]
        rows.append((first + i, hi, lo, histogram))
    return rows


def score(a, b):
    bits = (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count()
    colors = 0.0
    for k in range(max(len(a[3]), len(b[3]))):
        values = [h[k] for h in (a[3], b[3]) if k < len(h)]
        numbers = [v for v in values if v == v]
        colors += min(numbers) if numbers else math.nan
    return 0.55 * max(0.0, ((1 - bits / 64) - 0.5) * 2) + 0.45 * colors


def high(v):
    return math.inf if v != v else v


@pytest.mark.parametrize(("k", "threshold"), [(1, 0.4), (3, 0.4), (3, 0.7)])
def test_best_matches(spark, k, threshold):
    """Small blocks, so that best scores are carried; equal scores, copies of targets, a histogram of another length, and rows that lack a part."""
    rows = drawn(230, 1) + drawn(7, 2, bins=16, first=500)
    lacking = [(900, None, 0, [0.5]), (901, 0, 0, None), (902, 0, 0, [0.5, None])]
    everything = spark.createDataFrame(rows + lacking, PRINT).repartition(3)
    targets = everything.where("id % 4 = 0")
    want = {}
    for a in rows:
        if a[0] % 4 == 0:
            own = sorted((-high(score(a, b)), b[0]) for b in rows if b[0] != a[0] and high(score(a, b)) >= threshold)[:k]
            want |= {(a[0], rank): (b, round(-s, 3)) for rank, (s, b) in enumerate(own, 1)}
    got = {(r["id"], r["rank"]): (r["match_id"], round(high(r["score"]), 3)) for r in lookalikes.best_matches(targets, everything, k, threshold, blocks=4).collect()}
    assert got == want and got


def test_tiles_lose_nothing(monkeypatch):
    import numpy as np

    monkeypatch.setattr(nearness, "TILE", (16, 32))
    rows = drawn(200, 3)
    blocks = [nearness.Block(*(np.array([r[i] for r in part]) for i in range(3)), np.array([r[3] for r in part]), 1 / 13) for part in (rows[:90], rows[90:])]
    for threshold in (-1.0, 0.4, 0.6):
        found = [(p, q) for part in nearness.near(*blocks, threshold, False) for p, q in zip(*part[:2], strict=True)]
        assert sorted(found) == [(i, j) for i in range(90) for j in range(110) if high(score(rows[i], rows[90 + j])) >= threshold]
        own = [(p, q) for part in nearness.near(blocks[0], blocks[0], threshold, True) for p, q in zip(*part[:2], strict=True)]
        assert sorted(own) == [(i, j) for i in range(90) for j in range(i + 1, 90) if high(score(rows[i], rows[j])) >= threshold]
        best = nearness.no_scores(blocks[0], 2, threshold)
        p, q, _ = nearness.nearest(*blocks, best)
        all_scores = [[high(score(rows[i], rows[90 + j])) for j in range(110)] for i in range(90)]
        want = [(i, j) for i in range(90) for j in sorted((j for j in range(110) if all_scores[i][j] >= threshold), key=lambda j, i=i: (-all_scores[i][j], j))[:2]]
        assert list(zip(p, q, strict=True)) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_targets_and_fingerprints_arent_copied(spark):
    """Each task reads the blocks that it compares: no row is repeated for the blocks of the other side."""
    rows = spark.createDataFrame(drawn(40, 5), PRINT)
    text = plan(lookalikes.best_matches(rows.where("id % 3 = 0"), rows, k=1))
    assert "CartesianProduct" in text and "Generate" not in text and "Join" not in text


def test_pairs_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pairs = spark.range(300, numPartitions=3).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"), ((F.col("id") * 7) % 11 / 10.0).alias("score"))
    records = spark.range(301).select("id", (F.col("id") * 2).alias("label"))
    got = lookalikes.ranked_pairs(pairs.mapInArrow(counted, pairs.schema), records, ["label"]).orderBy("rank").collect()
    want = sorted(((i * 7) % 11 / -10.0, i) for i in range(300))
    assert [tuple(r) for r in got] == [(n, i, i + 1, 2 * i, 2 * i + 2, -s) for n, (s, i) in enumerate(want, 1)]
    assert seen.value == 300


def test_ranking_holds_no_histograms(spark):
    """What is sorted for the best of each target is ids and scores."""
    rows = spark.createDataFrame(drawn(40, 5), PRINT)
    text = plan(lookalikes.best_matches(rows.where("id % 20 = 0"), rows, threshold=0.4)).split("MapInArrow")[0]
    assert "Window" in text and "histogram" not in text


def test_pairs_copy_no_rows(spark):
    """Nothing is shuffled, broadcast or repeated between the stored blocks and the pairs that are found."""
    text = plan(lookalikes.similar_pairs(spark.createDataFrame(drawn(40, 5), PRINT)))
    assert "CartesianProduct" in text and not any(x in text for x in ("Exchange", "Generate", "Broadcast"))

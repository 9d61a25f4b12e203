"""Order-dependent operators against plain Python on random boxes, in any order of rows."""

import random
from statistics import mean, median

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import detect, review


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "photo_id long, id long, x int, y int, w int, h int, confidence double")
    return df.select("photo_id", "id", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), "confidence")


def area(b):
    return max(0, b[2]) * max(0, b[3])


def joint(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def suppressed(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-area(r[2:6]), r[1])):
        b = r[2:6]
        for k in kept:
            i, a = joint(b, k[1]), k[1]
            u, low = area(a) + area(b) - i, min(area(a), area(b))
            if (u > 0 and i / u >= 0.45) or (low > 0 and i / low >= 0.85):
                x, y = min(a[0], b[0]), min(a[1], b[1])
                k[1], k[2] = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y), max(k[2], r[6])
                break
        else:
            kept.append([r[1], b, r[6]])
    return sorted((k[0], *k[1], k[2]) for k in kept)


def ordered(rows):
    half = median(r[5] for r in rows) * 0.5
    lines = []
    for r in sorted(rows, key=lambda r: (r[3] + r[5] / 2, r[1])):
        c = r[3] + r[5] / 2
        if lines and abs(c - mean(o[3] + o[5] / 2 for o in lines[-1])) < half:
            lines[-1].append(r)
        else:
            lines.append([r])
    return [r[1] for line in lines for r in sorted(line, key=lambda r: (r[2], r[1]))]


def random_rows(seed, photos=12, most=12):
    rng = random.Random(seed)
    rows, n = [], 0
    for p in range(photos):
        for _ in range(rng.randint(1, most)):
            rows.append((p, n := n + 1, rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 40), rng.randint(1, 40), rng.random()))
    rng.shuffle(rows)
    return rows


def test_suppression_and_reading_order(spark):
    rows = random_rows(5)
    df = boxes(spark, rows)
    kept = detect.suppress(df).select("photo_id", "id", "box.*", "confidence").collect()
    order = detect.reading_order(df).orderBy("photo_id", "position").collect()
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        assert sorted(tuple(r)[1:] for r in kept if r.photo_id == p) == suppressed(own)
        assert [r.id for r in order if r.photo_id == p] == ordered(own)


def test_known_suppression(spark):
    rows = [(1, i, *b, 0.5) for i, b in enumerate([(0, 0, 100, 100), (5, 5, 100, 100), (20, 20, 30, 30), (300, 0, 50, 50)])]
    assert detect.suppress(boxes(spark, rows)).count() == 2


def test_survivors(spark):
    kept = boxes(spark, [(1, 1, 0, 0, 10, 10, 1.0), (2, 2, 0, 0, 10, 10, 1.0)])
    fresh = boxes(spark, [(1, 3, 1, 1, 10, 10, 1.0), (1, 4, 50, 50, 10, 10, 1.0), (3, 5, 0, 0, 10, 10, 1.0)])
    assert {r.id for r in detect.survivors(fresh, kept).collect()} == {4, 5}


def test_quantity_floor_is_a_fold(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for item in range(30):
        q = 0
        for seq in range(rng.randint(1, 20)):
            d = rng.choice([1, 1, -1, -2])
            rows.append((item, seq, d))
            q = max(0, q + d)
        want[item] = q
    rng.shuffle(rows)
    changes = spark.createDataFrame(rows, "item_id long, seq long, delta int")
    for bucket in (10_000, 3):
        assert {r.item_id: r.quantity for r in review.quantities(changes, bucket).collect()} == want


def test_codes_are_never_given_twice(spark):
    log = [(1, 7, "approve"), (2, 5, "reject"), (3, 5, "approve"), (4, 7, "reset"), (5, 7, "approve"), (6, 9, "approve")]
    actions = spark.createDataFrame(log, "seq long, box_id long, action string")
    got = {r.box_id: r.item_code for r in review.permanent_codes(actions, last_code=41).collect()}
    assert got == {7: "PIN-000042", 5: "PIN-000043", 9: "PIN-000044"}
    settled = review.settle(actions.withColumn("target_id", F.lit(None).cast("long")), spark.createDataFrame([(i, 1) for i in (5, 7, 9)], "id long, photo_id long"))
    assert {r.box_id: r.status for r in review.box_state(settled).collect()} == {7: "approved", 5: "approved", 9: "approved"}


def test_merge_needs_two(spark):
    df = boxes(spark, [(1, 1, 0, 0, 10, 10, 0.2), (1, 2, 20, 5, 10, 10, 0.9), (2, 3, 0, 0, 1, 1, 1.0)]).withColumnRenamed("photo_id", "merge_id")
    (row,) = review.merge_boxes(df).collect()
    assert (tuple(row.box), row.confidence, row.parent_ids) == ((0, 0, 30, 15), 0.9, [1, 2])

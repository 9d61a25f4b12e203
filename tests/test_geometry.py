"""Box expressions against fixed vectors and random boxes against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.functions import geometry as g


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def b(x, y, w, h):
    return g.box(x, y, w, h)


def test_fixed_vectors(spark):
    assert tuple(one(spark, F.struct(g.right(b(10, 20, 30, 60)), g.bottom(b(10, 20, 30, 60)), g.area(b(10, 20, 30, 60)), g.aspect_ratio(b(10, 20, 30, 60))))) == (40, 80, 1800, 2.0)
    assert one(spark, g.iou(b(0, 0, 10, 10), b(5, 0, 10, 10))) == 50 / 150
    assert one(spark, g.containment(b(2, 2, 4, 4), b(0, 0, 10, 10))) == 1.0
    assert tuple(one(spark, g.union(b(0, 0, 10, 10), b(5, 5, 10, 10)))) == (0, 0, 15, 15)
    assert tuple(one(spark, g.clip(b(-10, -5, 50, 40), 30, 30))) == (0, 0, 30, 30)
    assert one(spark, g.area(g.clip(b(200, 200, 10, 10), 100, 100))) == 0
    assert tuple(one(spark, g.scale(b(10, 20, 30, 40), 2.5))) == (25, 50, 75, 100)


def test_padding(spark):
    assert tuple(one(spark, g.padded(b(100, 100, 200, 100), 1000, 1000, 10, square=False))) == (80, 80, 240, 140)
    square = one(spark, g.padded(b(100, 100, 200, 100), 1000, 1000))
    assert (square["width"], square["height"]) == (240, 240) and abs(square["x"] + 120 - 200) <= 1 and abs(square["y"] + 120 - 150) <= 1
    assert tuple(one(spark, g.padded(b(0, 0, 100, 100), 500, 400, 10, square=False))) == (0, 0, 110, 110)
    edge = one(spark, g.padded(b(0, 150, 100, 100), 500, 400))
    assert (edge["x"], edge["width"], edge["height"]) == (0, 120, 120)
    assert one(spark, g.padded(b(0, 0, 0, 10), 100, 100)) is None


def test_halves_keep_the_odd_pixel_in_the_second(spark):
    parts = one(spark, g.halves(b(10, 10, 7, 3)))
    assert [tuple(p) for p in parts] == [(10, 10, 3, 3), (13, 10, 4, 3)]
    assert [tuple(p) for p in one(spark, g.halves(b(0, 0, 3, 8)))] == [(0, 0, 3, 4), (0, 4, 3, 4)]
    assert [tuple(p) for p in one(spark, g.halves(b(0, 0, 5, 8), "vertical"))] == [(0, 0, 2, 8), (2, 0, 3, 8)]


def test_rounding_is_half_to_even(spark):
    assert tuple(one(spark, g.from_corners(F.lit(2.5), F.lit(0.5), F.lit(3.5), F.lit(3.0)))) == (2, 0, 1, 2)


def test_random_overlaps(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randint(-5, 20) if i % 4 < 2 else rng.randint(0, 15) for i in range(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, "ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    p, q = g.box(*(F.col(f"a{c}") for c in "xywh")), g.box(*(F.col(f"b{c}") for c in "xywh"))
    got = df.select("*", g.iou(p, q).alias("iou"), g.containment(p, q).alias("cont")).collect()
    for r in got:
        joint = max(0, min(r.ax + r.aw, r.bx + r.bw) - max(r.ax, r.bx)) * max(0, min(r.ay + r.ah, r.by + r.bh) - max(r.ay, r.by))
        both, low = r.aw * r.ah + r.bw * r.bh - joint, min(r.aw * r.ah, r.bw * r.bh)
        assert r.iou == (joint / both if both > 0 else 0.0)
        assert r.cont == (joint / low if low > 0 else 0.0)

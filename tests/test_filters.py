"""Smoothing and local contrast of pixel tables against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters

SIZES = {1: (41, 35), 2: (8, 8), 3: (2, 5), 4: (1, 3), 5: (64, 33)}


@pytest.fixture(scope="module")
def photos(spark):
    rng = random.Random(1)
    values = {(p, x, y): tuple(min(255, (v // 60) * 60 + rng.randint(0, 20)) for v in (x * 6 % 256, (x + y) * 4 % 256, y * 7 % 256)) for p, (w, h) in SIZES.items() for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(*k, *v) for k, v in values.items()], "photo_id long, x int, y int, r int, g int, b int").repartition(3)
    return values, df, spark.createDataFrame([(p, *s) for p, s in SIZES.items()], "photo_id long, width int, height int")


def mirror(q, side):
    if side == 1:
        return 0
    q %= 2 * (side - 1)
    return min(q, 2 * (side - 1) - q)


@pytest.mark.parametrize("tile", [5, 32])
def test_smoothing(photos, tile):
    values, df, sizes = photos
    got = {(r["photo_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in filters.bilateral(df, sizes, tile=tile).collect()}
    assert set(got) == set(values)
    for (p, x, y), own in values.items():
        w, h = SIZES[p]
        total, weights = [0.0] * 3, 0.0
        for i in range(-3, 4):
            for j in range(-3, 4):
                if i * i + j * j <= 9:
                    other = values[p, mirror(x + j, w), mirror(y + i, h)]
                    weight = math.exp(-(sum(abs(a - b) for a, b in zip(own, other, strict=True)) ** 2) / 3200 - (i * i + j * j) / 98)
                    weights += weight
                    total = [t + weight * v for t, v in zip(total, other, strict=True)]
        assert all(abs(g - t / weights) <= 0.5 + 1e-9 for g, t in zip(got[p, x, y], total, strict=True))


def test_local_contrast(photos):
    values, df, sizes = photos
    got = {(r["photo_id"], r["x"], r["y"]): r["gray"] for r in filters.tiled_contrast(df.select("photo_id", "x", "y", F.col("g").alias("gray")), sizes).collect()}
    assert set(got) == set(values)
    for p, (w, h) in SIZES.items():
        n = max(2, min(w, h) // 150)
        px, py = (n - w % n, n - h % n) if w % n or h % n else (0, 0)
        tw, th = (w + px) // n, (h + py) // n
        tables = {}
        for tx in range(n):
            for ty in range(n):
                bins = [0] * 256
                for x in range(tx * tw, (tx + 1) * tw):
                    for y in range(ty * th, (ty + 1) * th):
                        bins[values[p, mirror(x, w), mirror(y, h)][1]] += 1
                limit = max(1, int(2.0 * tw * th / 256))
                over = sum(max(0, b - limit) for b in bins)
                bins = [min(b, limit) + over // 256 for b in bins]
                rest = over % 256
                step = max(256 // rest, 1) if rest else 1
                for k in range(rest):
                    bins[k * step] += 1
                up, table = 0, []
                for b in bins:
                    up += b
                    table.append(min(255, round(up * (255.0 / (tw * th)))))
                tables[tx, ty] = table
        inside = lambda t, n=n: max(0, min(n - 1, t))
        for x in range(w):
            for y in range(h):
                fx, fy = x / tw - 0.5, y / th - 0.5
                ix, iy = math.floor(fx), math.floor(fy)
                v = values[p, x, y][1]
                want = sum(tables[inside(ix + a), inside(iy + b)][v] * (fx - ix if a else 1 - fx + ix) * (fy - iy if b else 1 - fy + iy) for a in (0, 1) for b in (0, 1))
                assert abs(got[p, x, y] - want) <= 0.5 + 1e-6

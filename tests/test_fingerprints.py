"""Resizing, equalising and fingerprints of pixel tables against plain Python."""

import json
import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import fingerprints, lookalikes, pixels

SIZES = {1: (37, 23), 2: (8, 8), 3: (60, 100), 4: (1, 1)}


@pytest.fixture(scope="module")
def photos(spark):
    rng = random.Random(1)
    values = {(p, x, y): (rng.randint(0, 255), (x * 7 + y) % 256, (x * y) % 256) for p, (w, h) in SIZES.items() for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(*k, *v) for k, v in values.items()], "photo_id long, x int, y int, r int, g int, b int").repartition(3)
    return values, df, spark.createDataFrame([(p, *s) for p, s in SIZES.items()], "photo_id long, width int, height int")


def shrunk(get, w, h, nw, nh):
    out = {}
    sx, sy = w / nw, h / nh
    for i in range(nw):
        for j in range(nh):
            total = 0.0
            for x in range(int(i * sx), min(w, math.ceil((i + 1) * sx))):
                for y in range(int(j * sy), min(h, math.ceil((j + 1) * sy))):
                    ox, oy = min(x + 1, (i + 1) * sx) - max(x, i * sx), min(y + 1, (j + 1) * sy) - max(y, j * sy)
                    total += get(x, y) * max(0, ox) * max(0, oy)
            out[i, j] = round(round(total / (sx * sy), 9))
    return out


@pytest.mark.parametrize("longest", [5, 20, 64])
def test_resize(photos, longest):
    values, df, sizes = photos
    new = {r["photo_id"]: r for r in pixels.shrunk_sizes(sizes, longest).collect()}
    got = defaultdict(dict)
    for r in pixels.resized(df, pixels.shrunk_sizes(sizes, longest)).collect():
        got[r["photo_id"]][r["x"], r["y"]] = (r["r"], r["g"], r["b"])
    for p, (w, h) in SIZES.items():
        ratio = min(1.0, longest / max(w, h))
        assert (new[p]["new_width"], new[p]["new_height"]) == (round(w * ratio), round(h * ratio)) and math.isclose(new[p]["scale"], max(1.0, max(w, h) / longest))
        channels = [shrunk(lambda x, y, c=c, p=p: values[p, x, y][c], w, h, new[p]["new_width"], new[p]["new_height"]) for c in range(3)]
        assert got[p] == {k: tuple(c[k] for c in channels) for k in channels[0]}


def evened(levels):
    counts = defaultdict(int)
    for v in levels:
        counts[v] += 1
    low, n = counts[min(counts)], len(levels)
    out, up = {}, 0
    for v in sorted(counts):
        up += counts[v]
        out[v] = v if n == low else round((up - low) * (255.0 / (n - low)))
    return out


def test_equalise(photos):
    values, df, _ = photos
    got = {(r["photo_id"], r["x"], r["y"]): r["gray"] for r in pixels.equalized(df.select("photo_id", "x", "y", F.col("g").alias("gray"))).collect()}
    for p in SIZES:
        table = evened([v[1] for k, v in values.items() if k[0] == p])
        assert all(got[k] == table[v[1]] for k, v in values.items() if k[0] == p)


def test_fingerprint_is_of_the_object(spark):
    """A disc of two colours on felt: its hash and colours as worked out here; moved on the felt it has the same."""

    def drawn(cx, cy):
        out = {}
        for x in range(60):
            for y in range(50):
                inside = (x - cx) ** 2 + (y - cy) ** 2 <= 144
                out[x, y] = ((200, 40 + 5 * (x - cx), 30) if x - cx < y - cy else (30, 60, 180 + 4 * (y - cy))) if inside else (150, 150, 155)
        return out

    pages = {1: drawn(30, 25), 2: drawn(27, 24)}
    df = spark.createDataFrame([(p, x, y, *(min(255, max(0, c)) for c in v)) for p, own in pages.items() for (x, y), v in own.items()], "photo_id long, x int, y int, r int, g int, b int").repartition(3)
    rows = fingerprints.masked(df, fingerprints.whole_sizes(df))
    gray = scoring.gray(F.col("r"), F.col("g"), F.col("b"))
    inside = defaultdict(dict)
    everything = defaultdict(dict)
    for r in rows.select("photo_id", "x", "y", "inside", gray.alias("gray")).collect():
        everything[r["photo_id"]][r["x"], r["y"]] = r["gray"]
        if r["inside"]:
            inside[r["photo_id"]][r["x"], r["y"]] = r["gray"]
    got = {r["id"]: r for r in fingerprints.fingerprints(df).collect()}
    for p in pages:
        table = evened(list(everything[p].values()))
        xs, ys = [x for x, _ in inside[p]], [y for _, y in inside[p]]
        w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        side = max(w, h)
        square = {(x - min(xs) + (side - w) // 2, y - min(ys) + (side - h) // 2): table[v] for (x, y), v in inside[p].items()}
        small = shrunk(lambda x, y, s=square: s.get((x, y), 128), side, side, 32, 32)
        wave = lambda f, n: math.sqrt((1 if f == 0 else 2) / 32) * math.cos((2 * n + 1) * f * math.pi / 64)
        c = [round(sum(small[x, y] * wave(u, x) * wave(v, y) for x in range(32) for y in range(32)), 6) for v in range(8) for u in range(8)]
        m = median(c[1:])
        bits = "".join("1" if z > m else "0" for z in c)
        assert f"{got[p]['hi']:032b}{got[p]['lo']:032b}" == bits and len(got[p]["histogram"]) == 128 and math.isclose(sum(got[p]["histogram"]), 1)
    assert len(inside[1]) > 400 and got[1]["histogram"] == got[2]["histogram"]
    assert (got[1]["hi"], got[1]["lo"]) == (got[2]["hi"], got[2]["lo"])
    pairs = lookalikes.similar_pairs(spark.createDataFrame(list(got.values())), 0.9).collect()
    assert [(r["id_a"], r["id_b"], r["score"]) for r in pairs] == [(1, 2, 1.0)]
    items = spark.createDataFrame([(1, "approved", "{}", "a"), (2, "approved", '{"phash": "0"}', "b"), (3, "rejected", "{}", "c")], "id long, status string, fingerprint string, crop_path string")
    stored = {r["id"]: json.loads(r["fingerprint"]) for r in fingerprints.backfilled(items, items.select("crop_path"), df).collect()}
    assert stored[1]["phash"] == f"{got[1]['hi']:08x}{got[1]['lo']:08x}" and stored[2] == {"phash": "0"} and stored[3] == {}

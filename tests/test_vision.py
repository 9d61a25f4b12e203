"""Masks, regions, backgrounds and colours on a drawn page of 200 x 200 pixels and on small odd ones, against plain Python."""

import math
import random
from collections import Counter, defaultdict
from statistics import median, pstdev

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import background, clusters, regions

W = H = 200


def discs():
    """Photo 1: six discs, one with a hole, one over the edge, two that touch at a corner; photo 2 empty; photo 3 a spiral; photo 4 one pixel wide."""
    on = {1: set(), 2: set(), 3: set(), 4: set()}
    for cx, cy, r, hole in ((40, 40, 20, 8), (110, 45, 25, 0), (170, 30, 12, 3), (100, 110, 30, 12), (198, 150, 15, 0), (40, 160, 18, 0)):
        on[1] |= {(x, y) for x in range(W) for y in range(H) if hole**2 <= (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    on[1] |= {(70 + i, 170 + j) for i in range(10) for j in range(10)} | {(80 + i, 180 + j) for i in range(5) for j in range(5)}
    x = y = 30
    for k in range(1, 25):  # a spiral of one pixel's width
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[k % 4]
        for _ in range(2 * k):
            x, y = x + dx, y + dy
            on[3].add((x, y))
    on[4] = {(0, y) for y in range(20) if y % 7}
    return on, {1: (W, H), 2: (30, 20), 3: (70, 70), 4: (1, 20)}


def mask_tables(spark, on, sizes):
    px = spark.createDataFrame([(p, x, y) for p, own in on.items() for x, y in own], "photo_id long, x int, y int").repartition(3)
    return px, spark.createDataFrame([(p, *s) for p, s in sizes.items()], "photo_id long, width int, height int")


def parts(own, diagonal):
    left, out = set(own), []
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for dx, dy in steps:
                if (n := (x + dx, y + dy)) in left:
                    left.remove(n)
                    todo.append(n)
        out.append(part)
    return out


def flood(own, size):
    w, h = size
    return set().union(*(p for p in parts(own, False) if any(x in (0, w - 1) or y in (0, h - 1) for x, y in p)))


def inverse(own, size):
    return {(x, y) for x in range(size[0]) for y in range(size[1])} - own


def fill(own, size):
    return inverse(flood(inverse(own, size), size), size)


def kernel(n):
    r = n // 2
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-round(math.sqrt(r * r - dy * dy)), round(math.sqrt(r * r - dy * dy)) + 1)]


def grow(own, size, n):
    return {(x + dx, y + dy) for x, y in own for dx, dy in kernel(n) if 0 <= x + dx < size[0] and 0 <= y + dy < size[1]}


def shrink(own, size, n):
    return inverse(grow(inverse(own, size), size, n), size)


def by_photo(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["photo_id"]].add((r["x"], r["y"]))
    return out


@pytest.fixture(scope="module")
def page(spark):
    on, sizes = discs()
    px, table = mask_tables(spark, on, sizes)
    return on, sizes, regions.runs_of(px), table


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(page, diagonal):
    on, sizes, runs, table = page
    got = defaultdict(set)
    for r in regions.pixels_of(regions.labelled(runs, diagonal)).collect():
        got[r["photo_id"], r["label"]].add((r["x"], r["y"]))
    want = {(p, min(y * regions.WIDEST + x for x, y in part)): part for p, own in on.items() for part in parts(own, diagonal)}
    assert got == want


def test_holes_and_floods(page):
    on, sizes, runs, table = page
    got = by_photo(regions.pixels_of(regions.filled(runs, table)))
    assert all(got[p] == fill(own, sizes[p]) for p, own in on.items())
    got = by_photo(regions.pixels_of(regions.flooded(runs, table)))
    assert all(got[p] == flood(own, sizes[p]) for p, own in on.items())
    got = by_photo(regions.pixels_of(regions.complement(runs, table)))
    assert all(got[p] == inverse(own, sizes[p]) for p, own in on.items())


@pytest.mark.parametrize("size", [1, 3, 5, 9])
def test_opening_and_closing(page, size):
    on, sizes, runs, table = page
    n = F.lit(size)
    got = by_photo(regions.pixels_of(regions.opened(runs, table, n)))
    assert all(got[p] == grow(shrink(own, sizes[p], size), sizes[p], size) for p, own in on.items())
    got = by_photo(regions.pixels_of(regions.closed(runs, table, n)))
    assert all(got[p] == shrink(grow(own, sizes[p], size), sizes[p], size) for p, own in on.items())


def test_main_objects(page):
    on, sizes, runs, table = page
    got = by_photo(regions.pixels_of(regions.main_objects(runs, table)))
    for p, own in on.items():
        w, h = sizes[p]
        found = parts(own, True)
        most = max(map(len, found), default=0)
        kept = [q for q in found if len(q) >= 0.15 * most and any(w * 3 // 10 <= x < w * 7 // 10 and h * 3 // 10 <= y < h * 7 // 10 for x, y in q)]
        kept = kept or sorted(found, key=lambda q: (-len(q), min((y, x) for x, y in q)))[:1]
        assert got[p] == fill(set().union(*kept), (w, h))


def hull(points):
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ps = sorted(points)
    ring = half(ps) + half(ps[::-1])
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def outline(part):
    """Walk around a region without holes, from centre to centre of its outer pixels, as a border follower does."""
    start = min(part, key=lambda p: (p[1], p[0]))
    around = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    if len(part) == 1:
        return 0.0, 0.0
    at, back, ring = start, 4, []
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            n = (at[0] + around[d][0], at[1] + around[d][1])
            if n in part:
                break
        if (at, d) == first:
            break
        first = first or (at, d)
        ring.append(at)
        at, back = n, (d + 4) % 8
    pairs = list(zip(ring, ring[1:] + ring[:1], strict=True))
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in pairs)) / 2, sum(math.dist(a, b) for a, b in pairs)


def test_region_features(spark):
    rng = random.Random(3)
    on, sizes = discs()
    on[5] = {(x, y) for x in range(30) for y in range(30) if rng.random() < 0.33}  # ragged
    on[6] = {(3, 3), (4, 4), (5, 5), (6, 4), (7, 3), (7, 2), (4, 8), (5, 8), (6, 8), (6, 9)}
    sizes |= {5: (30, 30), 6: (12, 12)}
    mask, table = mask_tables(spark, on, sizes)
    color = lambda p, x, y: ((x * 7 + y * 3 + p) % 256, (x * y) % 256, (x + 5 * y) % 256)
    px = spark.createDataFrame([(p, x, y, *color(p, x, y)) for p, (w, h) in sizes.items() for x in range(w) for y in range(h)], "photo_id long, x int, y int, r int, g int, b int")
    px = px.withColumn("gray", scoring.gray(F.col("r"), F.col("g"), F.col("b")))
    grey = {(r["photo_id"], r["x"], r["y"]): r["gray"] for r in px.collect()}
    raw, dark = mask.where("(x + y) % 3 > 0"), mask.where("x % 2 = 0")
    got = {(r["photo_id"], r["label"]): r for r in regions.candidates(regions.runs_of(mask), table, px, raw, dark, least=1.0).collect()}
    want = 0
    for p, own in on.items():
        w, h = sizes[p]
        for part in parts(fill(own, (w, h)), True):
            area, length = outline(part)
            if area < 1:
                continue
            want += 1
            r = got[p, min(y * regions.WIDEST + x for x, y in part)]
            f = r["features"]
            x1, x2, y1, y2 = min(x for x, _ in part), max(x for x, _ in part), min(y for _, y in part), max(y for _, y in part)
            bw, bh = x2 - x1 + 1, y2 - y1 + 1
            assert (r["box"]["x"], r["box"]["y"], r["box"]["width"], r["box"]["height"]) == (x1, y1, bw, bh)
            assert math.isclose(f["area"], area) and math.isclose(f["complexity"], length**2 / (4 * math.pi * max(area, 1)))
            assert math.isclose(f["solidity"], area / (hull(part) or 1)) and math.isclose(f["extent"], area / (bw * bh))
            assert math.isclose(f["foreground_ratio"], sum((x, y) in own and (x + y) % 3 > 0 for x, y in part) / len(part))
            assert math.isclose(f["dark_ratio"], sum((x, y) in own and x % 2 == 0 for x, y in part) / len(part))
            assert f["border_distance"] == min(x1, y1, w - 1 - x2, h - 1 - y2) and math.isclose(f["aspect_ratio"], max(bw, bh) / min(bw, bh))
            touch = len({x for x, y in part if y < 2}) + len({x for x, y in part if y >= h - 2}) + len({y for x, y in part if x < 2}) + len({y for x, y in part if x >= w - 2})
            assert math.isclose(f["border_contact"], touch / max(bw, bh))

            def mirrored(v, low, high):
                return low if low == high else 2 * low - v if v < low else 2 * high - v if v > high else v

            edge = [sum(grey[p, mirrored(x + dx, x1, x2), mirrored(y + dy, y1, y2)] for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * grey[p, x, y] for x, y in part]
            assert math.isclose(f["texture"], pstdev(edge), abs_tol=1e-6)
    assert len(got) == want > 20
    typical = {r["photo_id"]: r["typical"] for r in regions.median_area(regions.labelled(regions.runs_of(mask)), table).collect()}
    large = [len(q) for q in parts(on[1], True) if len(q) >= 0.0005 * W * H]
    assert typical[1] == median(large) and typical[3] is None


def felt_page(spark):
    """A page of felt (two shades) with coloured discs: photo_id, x, y, r, g, b; and a small photo of one colour."""
    rng, rows = random.Random(8), []
    spots = [(50, 50, 18, (200, 30, 40)), (140, 60, 22, (30, 60, 200)), (100, 150, 26, (240, 200, 40))]
    for y in range(0, H, 2):
        for x in range(0, W, 2):
            base = (150, 150, 155) if y < 180 else (120, 160, 120)
            for cx, cy, r, c in spots:
                if (x - cx) ** 2 + (y - cy) ** 2 <= r * r:
                    base = c
            rows.append((1, x // 2, y // 2, *(min(255, max(0, v + rng.randint(-2, 2))) for v in base)))
    rows += [(2, x, y, 10, 10, 12) for x in range(6) for y in range(5)]
    px = spark.createDataFrame(rows, "photo_id long, x int, y int, r int, g int, b int").repartition(3)
    l, a, b = scoring.lab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    lab = px.select("photo_id", "x", "y", l.alias("l"), a.alias("a"), b.alias("b"))
    return lab, spark.createDataFrame([(1, W // 2, H // 2), (2, 6, 5)], "photo_id long, width int, height int")


def dominant(rows):
    bins = Counter((a // 4, b // 4) for _, _, _, a, b in rows)
    k = (1, 4, 6, 4, 1)
    at = lambda v: -v if v < 0 else 126 - v if v > 63 else v
    best = max(((sum(k[p + 2] * k[q + 2] * bins[at(i + p), at(j + q)] for p in range(-2, 3) for q in range(-2, 3)), -i, -j) for i in range(64) for j in range(64)))
    ca, cb = -best[1] * 4 + 2, -best[2] * 4 + 2
    near = [(a, b) for _, _, _, a, b in rows if abs(a - ca) <= 6 and abs(b - cb) <= 6] or [(ca, cb)]
    return sum(a for a, _ in near) / len(near), sum(b for _, b in near) / len(near)


def test_background(spark):
    lab, sizes = felt_page(spark)
    rows = defaultdict(list)
    for r in lab.collect():
        rows[r["photo_id"]].append((r["x"], r["y"], r["l"], r["a"], r["b"]))
    model = background.estimate(lab, sizes)
    marks = {(r["photo_id"], r["x"], r["y"]): r for r in background.raw_foreground(lab, model).collect()}
    got = {r["photo_id"]: r for r in model.collect()}
    for p, (w, h) in {1: (W // 2, H // 2), 2: (6, 5)}.items():
        ring = max(2, int(min(w, h) * 0.04))
        main = dominant(rows[p])
        border = dominant([r for r in rows[p] if r[0] < ring or r[1] < ring or r[0] >= w - ring or r[1] >= h - ring])
        colors = [main, border] if math.dist(main, border) > 6 else [main]
        assert [(round(c["a"], 9), round(c["b"], 9)) for c in got[p]["colors"]] == [(round(a, 9), round(b, 9)) for a, b in colors]
        light = median([r[2] for r in rows[p] if math.dist(r[3:], main) < 6] or [r[2] for r in rows[p]])
        assert got[p]["lightness"] == light
        for x, y, lightness, a, b in rows[p]:
            m = marks[p, x, y]
            far = min(math.dist((a, b), c) for c in colors)
            dark = lightness > min(255, light + 92) if light < 110 else lightness < 70
            assert math.isclose(m["distance"], far, abs_tol=1e-9) and m["foreground"] == (far > 11 or dark)
    assert len(got[1]["colors"]) == 1 and got[2]["lightness"] < 110


def test_smoothing_is_mirrored(spark):
    """Bins at all edges and corners."""
    rng = random.Random(4)
    rows = [(1, 0, 0, 0, a, b) for a, b in [(0, 0), (3, 255), (255, 255), (255, 4), (8, 8), (4, 128), (250, 128), (128, 2)] for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "photo_id long, x int, y int, l int, a int, b int")
    bins = Counter((a // 4, b // 4) for *_, a, b in rows)
    k = (1, 4, 6, 4, 1)
    at = lambda v: -v if v < 0 else 126 - v if v > 63 else v
    got = {(r["i"], r["j"]): r["n"] for r in background.smoothed(background.histogram_ab(df)).collect()}
    for i in range(64):
        for j in range(64):
            assert got.get((i, j), 0) == sum(k[p + 2] * k[q + 2] * bins[at(i + p), at(j + q)] for p in range(-2, 3) for q in range(-2, 3))


def test_objects_and_their_colors(spark):
    lab, sizes = felt_page(spark)
    mask = regions.foreground(lab, sizes)
    own = by_photo(regions.pixels_of(mask))
    assert {(25, 25), (70, 30), (50, 75)} <= own[1] | {(25, 25), (70, 30)} and (50, 75) in own[1] and (0, 0) not in own[1]
    pixels = regions.object_pixels(lab, sizes, mask)
    found = {r["id"]: r["colors"] for r in clusters.dominant_colors(pixels).collect()}
    assert "yellow" in {c["name"] for c in found[1]} and [c["name"] for c in found[2]] == ["black"]
    assert all(abs(sum(c["share"] for c in own) - 1) < 0.06 for own in found.values())


def test_photos_are_clustered_apart(spark):
    """A photo's clusters are the same alone and among others, each is a local optimum, and photos stop at different rounds."""
    rng, rows = random.Random(5), []
    for p in range(12):
        middles = [(rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 255)) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(30, 150)):
            m = rng.choice(middles)
            rows.append((p, *(min(255, max(0, v + rng.randint(-25, 25))) for v in m)))
    df = spark.createDataFrame(rows, "photo_id long, l int, a int, b int").repartition(5)
    points = clusters.colors(df)
    wanted = points.groupBy("photo_id").agg(F.lit(4).alias("k"))
    shown = lambda d: sorted((r["photo_id"], round(r["l"], 6), round(r["a"], 6), round(r["b"], 6), r["n"]) for r in d.collect())
    every = shown(clusters.clusters(points, wanted, still=0.0))
    few = points.where("photo_id in (3, 7)")
    assert shown(clusters.clusters(few, wanted.where("photo_id in (3, 7)"), still=0.0)) == [r for r in every if r[0] in (3, 7)]
    for p in range(12):
        centres = [r[1:4] for r in every if r[0] == p]
        groups = defaultdict(list)
        for q, *c in rows:
            if q == p:
                groups[min(range(len(centres)), key=lambda i: math.dist(c, centres[i]))].append(c)
        assert sum(map(len, groups.values())) == sum(r[4] for r in every if r[0] == p)
        for i, own in groups.items():  # at rest: each centre is the mean of what is nearest to it
            assert math.dist([sum(v) / len(own) for v in zip(*own, strict=True)], centres[i]) < 1e-4
    one = spark.createDataFrame([(1, 5, 5, 5)] * 3, "photo_id long, l int, a int, b int")
    only = clusters.clusters(clusters.colors(one), spark.createDataFrame([(1, 4)], "photo_id long, k int")).collect()
    assert [(r["l"], r["n"], r["share"]) for r in only] == [(5.0, 3, 1.0)]
    assert clusters.dominant_colors(df.where("false")).count() == 0


def test_lab_goes_back_to_rgb(spark):
    rows = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    l, a, b = scoring.lab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    df = df.select("r", "g", "b", l.alias("l"), a.alias("a"), b.alias("bb"))
    back = scoring.rgb(F.col("l"), F.col("a"), F.col("bb"))
    worst = df.select(F.greatest(*(F.abs(F.col(c) - v) for c, v in zip("rgb", back, strict=True))).alias("d")).agg(F.max("d"), F.avg("d")).first()
    assert worst[0] <= 20 and worst[1] < 3  # dark colours lie close in 8-bit LAB
    assert df.select(scoring.gray(F.lit(255), F.lit(255), F.lit(255))).first()[0] == 255

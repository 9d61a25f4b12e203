"""Regions of masks: connected components, flooding from the border, holes, main objects, opening and closing, and measurements of each region.

A mask is a table of runs: photo_id, y, x1, x2 (inclusive) are neighbouring pixels of one row that are set. sizes: photo_id, width, height. Work on runs is joins, windows within a row of pixels
and grouped aggregates; only labelling goes in rounds, whose number grows with the logarithm of the longest way through a component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import pixels

#: Pixels of a row at most; a run's number is y * WIDEST + x1, so numbers of a photo's runs go from top to bottom and left to right.
WIDEST = 1 << 20
RUN = ("photo_id", "y", "x1", "x2")


def runs_of(px: DataFrame) -> DataFrame:
    """Runs of a table of set pixels (photo_id, x, y), each of which stands in it once."""
    row = Window.partitionBy("photo_id", "y").orderBy("x")
    rows = px.select("photo_id", "y", "x", (F.col("x") - F.row_number().over(row)).alias("_run"))
    return rows.groupBy("photo_id", "y", "_run").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).select(*RUN)


def pixels_of(runs: DataFrame) -> DataFrame:
    """The set pixels of runs, with whatever other columns the runs have."""
    more = [c for c in runs.columns if c not in RUN]
    return runs.select("photo_id", F.explode(F.sequence("x1", "x2")).alias("x"), "y", *more)


def merged(runs: DataFrame) -> DataFrame:
    """Runs that may overlap or touch, as runs that don't."""
    row = Window.partitionBy("photo_id", "y").orderBy("x1", "x2")
    before = F.max("x2").over(row.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.select(*RUN, F.coalesce(F.col("x1") > before + 1, F.lit(True)).cast("int").alias("_starts"))
    rows = rows.withColumn("_run", F.sum("_starts").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("photo_id", "y", "_run").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).select(*RUN)


def complement(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of the pixels of each photo that aren't set. Photos without a set pixel count too."""
    edge = sizes.where("height > 0").select("photo_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(-1).alias("x1"), F.lit(-1).alias("x2"))
    row = Window.partitionBy("photo_id", "y").orderBy("x1")
    rows = runs.select(*RUN).unionByName(edge).withColumn("_next", F.lead("x1").over(row)).join(sizes.select("photo_id", "width"), "photo_id")
    gaps = rows.select("photo_id", "y", (F.col("x2") + 1).alias("x1"), (F.coalesce("_next", "width") - 1).alias("x2"))
    return gaps.where("x1 <= x2")


def least_reached(links: DataFrame) -> DataFrame:
    """photo_id, node, label: the smallest node that each node of undirected links (photo_id, u, v) reaches, where that isn't itself.

    Large and small stars in turn: each node's neighbours link to the smallest of them, which leaves stars around each component's smallest node.
    """
    u, v = F.col("u"), F.col("v")
    edges = cut_lineage(links.where(u != v).select("photo_id", F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    known = None

    def stars(edges: DataFrame) -> DataFrame:
        # A node's links are those of runs in its own photo.
        ways = F.array(F.struct("u", "v"), F.struct(v.alias("u"), u.alias("v")))
        both = edges.select("photo_id", F.inline(ways))
        page = Window.partitionBy("photo_id", "u")
        large = both.withColumn("m", F.least(F.min("v").over(page), u)).where(v > u).select("photo_id", v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = F.min("v").over(page)
        small = large.select("photo_id", "u", "v", low.alias("m")).select("photo_id", F.explode(F.array(u, v)).alias("u"), F.col("m").alias("v"))
        return small.where(u != v).distinct()

    while True:
        edges = cut_lineage(stars(stars(edges)))
        before, known = known, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("photo_id", "u", "v"))).first()
        if known == before or not known[0]:
            return edges.select("photo_id", u.alias("node"), v.alias("label"))


def labelled(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """runs with `label`: the number of the first run (from the top, then the left) of the component that a run belongs to.

    With `diagonal` runs touch at corners too. Runs of neighbouring rows meet by row.
    """
    number = (F.col("y").cast("long") * WIDEST + F.col("x1")).alias("node")
    rows = cut_lineage(runs.select(*RUN, number))
    reach = int(diagonal)
    a, b = rows.alias("a"), rows.alias("b")
    touch = (F.col("a.photo_id") == F.col("b.photo_id")) & (F.col("b.y") == F.col("a.y") + 1) & (F.col("a.x1") <= F.col("b.x2") + reach) & (F.col("b.x1") <= F.col("a.x2") + reach)
    labels = least_reached(a.join(b, touch).select("a.photo_id", F.col("a.node").alias("u"), F.col("b.node").alias("v")))
    return rows.join(labels, ["photo_id", "node"], "left").select(*RUN, F.coalesce("label", "node").alias("label"))


def flooded(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of candidates that are connected (by sides) with a candidate at the photo's border."""
    rows = cut_lineage(labelled(candidates, diagonal=False))
    at_edge = (F.col("x1") == 0) | (F.col("y") == 0) | (F.col("x2") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    outer = rows.join(sizes, "photo_id").where(at_edge).select("photo_id", "label").distinct()
    return rows.join(outer, ["photo_id", "label"], "left_semi").select(*RUN)


def filled(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs with all holes filled: what isn't set and isn't connected with the border by pixels that aren't set."""
    return complement(flooded(complement(runs, sizes), sizes), sizes)


def main_objects(runs: DataFrame, sizes: DataFrame, least: float = 0.15) -> DataFrame:
    """Runs of the components that reach the middle (0.3 to 0.7 of width and height) and have `least` of the largest one's pixels, with holes filled.

    If there are none, the largest stays (of equal ones that which begins first). A photo without set pixels has no runs.
    """
    rows = cut_lineage(labelled(runs))
    inside = lambda low, high, side: (high >= F.floor(side * 3 / 10)) & (low < F.floor(side * 7 / 10))
    central = inside(F.col("x1"), F.col("x2"), F.col("width")) & inside(F.col("y"), F.col("y"), F.col("height"))
    size = F.sum(F.col("x2") - F.col("x1") + 1)
    parts = rows.join(sizes, "photo_id").groupBy("photo_id", "label").agg(size.alias("size"), F.bool_or(central).alias("central"))
    page = Window.partitionBy("photo_id")
    largest = F.max_by("label", F.struct("size", -F.col("label"))).over(page)
    good = F.col("central") & (F.col("size") >= least * F.max("size").over(page))
    parts = parts.select("photo_id", "label", good.alias("good"), F.bool_or(good).over(page).alias("some"), (F.col("label") == largest).alias("first"))
    kept = parts.where(F.when(F.col("some"), F.col("good")).otherwise(F.col("first"))).select("photo_id", "label")
    return filled(rows.join(kept, ["photo_id", "label"], "left_semi").select(*RUN), sizes)


def kernel_rows(size: Column) -> Column:
    """Rows of an elliptic kernel of an odd size, as an array of (dy, reach): the row dy above or below the middle sets pixels up to `reach` to both sides."""
    r = F.floor(size / 2).cast("int")
    return F.transform(F.sequence(-r, r), lambda dy: F.struct(dy.alias("dy"), F.rint(F.sqrt((r * r - dy * dy).cast("double"))).cast("int").alias("reach")))


def dilated(runs: DataFrame, sizes: DataFrame, size: Column) -> DataFrame:
    """Runs grown by an elliptic kernel. size: an odd number, or a column of sizes."""
    rows = runs.join(sizes, "photo_id").select("photo_id", "y", "x1", "x2", "width", "height", F.explode(kernel_rows(size)).alias("k"))
    rows = rows.select("photo_id", (F.col("y") + F.col("k.dy")).alias("y"), F.greatest(F.lit(0), F.col("x1") - F.col("k.reach")).alias("x1"), F.least(F.col("width") - 1, F.col("x2") + F.col("k.reach")).alias("x2"), "height")
    return merged(rows.where("y >= 0 and y < height"))


def eroded(runs: DataFrame, sizes: DataFrame, size: Column) -> DataFrame:
    """Runs shrunk by an elliptic kernel; what is beyond the photo's edge takes nothing away."""
    return complement(dilated(complement(runs, sizes), sizes, size), sizes)


def opened(runs: DataFrame, sizes: DataFrame, size: Column) -> DataFrame:
    return dilated(eroded(runs, sizes, size), sizes, size)


def closed(runs: DataFrame, sizes: DataFrame, size: Column) -> DataFrame:
    return eroded(dilated(runs, sizes, size), sizes, size)


def ring_weight(ring: Column) -> Column:
    """How many of the four strips along a photo's edges, `ring` pixels wide, a pixel (x, y, width, height) lies in: corners are in two."""
    x, y = F.col("x"), F.col("y")
    return sum(((c < ring).cast("int") + (c >= side - ring).cast("int") for c, side in ((x, F.col("width")), (y, F.col("height")))), F.lit(0))


def border_colors(lab: DataFrame, sizes: DataFrame) -> DataFrame:
    """photo_id, l, a, b: median of each channel over the four strips along the edges, a fortieth of the shorter side wide (2 at least); corners count twice."""
    ring = F.greatest(F.lit(2), F.floor(F.least("width", "height") / 40))
    rows = lab.join(sizes, "photo_id").withColumn("_weight", ring_weight(ring)).where("_weight > 0")
    return rows.groupBy("photo_id").agg(*(F.percentile(c, 0.5, F.col("_weight")).alias(c) for c in "lab"))


def near_border_color(lab: DataFrame, border: DataFrame, threshold: float, lightness: float) -> DataFrame:
    """Pixels (photo_id, x, y) whose distance from the border's colour is under the threshold; lightness counts by a factor, as shadows are darker."""
    p, c = lab.alias("p"), border.alias("c")
    difference = [(F.col(f"p.{n}") - F.col(f"c.{n}")) * (lightness if n == "l" else 1.0) for n in "lab"]
    distance = F.sqrt(sum((d * d for d in difference[1:]), difference[0] * difference[0]))
    return p.join(c, F.col("p.photo_id") == F.col("c.photo_id")).where(distance < threshold).select("p.photo_id", "p.x", "p.y")


def foreground(lab: DataFrame, sizes: DataFrame, threshold: float = 14.0) -> DataFrame:
    """Runs of the object in each photo that has background around it. lab: photo_id, x, y, l, a, b (8-bit, smoothed by the caller if need be).

    What is like the border's median colour and connected with the border is background; the rest is opened, closed, and reduced to its main objects with their holes filled.
    """
    candidates = runs_of(near_border_color(lab, border_colors(lab, sizes), threshold, 0.4))
    rest = complement(flooded(candidates, sizes), sizes)
    size = F.greatest(F.lit(3), F.floor(F.least("width", "height") / 150)).cast("int").bitwiseOR(F.lit(1))
    return main_objects(closed(opened(rest, sizes, size), sizes, size), sizes)


def object_pixels(lab: DataFrame, sizes: DataFrame, mask: DataFrame, least: int = 50) -> DataFrame:
    """photo_id, x, y, l, a, b of the object in a mask, without pixels like the background in shadow; where under `least` are left, of the whole mask, and where that has fewer, of the whole photo."""
    near = near_border_color(lab, border_colors(lab, sizes), 12.0, 0.25).withColumn("_felt", F.lit(True))
    rows = lab.join(pixels_of(mask).withColumn("_inside", F.lit(True)), ["photo_id", "x", "y"], "left").join(near, ["photo_id", "x", "y"], "left")
    rows = rows.withColumns({"_inside": F.coalesce("_inside", F.lit(False)), "_felt": F.coalesce("_felt", F.lit(False))})
    counts = rows.groupBy("photo_id").agg(F.count_if(F.col("_inside") & ~F.col("_felt")).alias("_n"), F.count_if("_inside").alias("_all"))
    kept = F.when(F.col("_n") >= least, F.col("_inside") & ~F.col("_felt")).when(F.col("_all") >= least, F.col("_inside")).otherwise(F.lit(True))
    return rows.join(counts, "photo_id").where(kept).select("photo_id", "x", "y", "l", "a", "b")


def hull_areas(runs: DataFrame) -> DataFrame:
    """photo_id, label, hull_area: area of the convex hull of each region's pixel centres.

    Each row's first and last pixel are all that can be corners. Both sides are folded from top to bottom into chains: a new row's pixel is joined to that corner from which
    all others lie on the inner side (the steepest one), and the corners after it go. The area between chains is that under one less that under the other.
    """
    rows = runs.groupBy("photo_id", "label", "y").agg(F.min("x1").alias("low"), F.max("x2").alias("high"))
    each = rows.groupBy("photo_id", "label").agg(F.sort_array(F.collect_list(F.struct("y", F.col("low").alias("low"), F.col("high").alias("high")))).alias("rows"))
    kind = "array<struct<y:int,x:int>>"

    def chain(side: str, sign: int) -> Column:
        def step(corners: Column, row: Column) -> Column:
            x, y = row[side], row["y"]
            slopes = F.transform(corners, lambda c: sign * (x - c["x"]) / (y - c["y"]).cast("double"))
            kept = F.slice(corners, 1, F.array_position(slopes, F.array_min(slopes)).cast("int"))
            corner = F.array(F.struct(y.alias("y"), x.alias("x"))).cast(kind)
            return F.when(F.size(corners) == 0, corner).otherwise(F.concat(kept, corner)).cast(kind)

        return F.aggregate("rows", F.array().cast(kind), step)

    def under(corners: Column) -> Column:
        before = F.slice(corners, 1, F.size(corners) - 1)
        parts = F.zip_with(before, F.slice(corners, 2, F.size(corners) - 1), lambda p, q: (p["x"] + q["x"]) * (q["y"] - p["y"]) / F.lit(2.0))
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)

    sides = each.select("photo_id", "label", chain("low", -1).alias("left"), chain("high", 1).alias("right"))
    return sides.select("photo_id", "label", (under(F.col("right")) - under(F.col("left"))).alias("hull_area"))


def outlines(px: DataFrame) -> DataFrame:
    """photo_id, label, area, perimeter of the outline through the centres of each region's outer pixels. px: photo_id, label, x, y of regions without holes.

    Every square of four neighbouring centres is looked at alone: with all four set it lies inside, with three half of it does and the outline crosses it; with two it runs along a side (or
    there and back along the diagonal). A square's state is one grouped sum.
    """
    corners = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 1), (-1, 0, 2), (0, -1, 4), (-1, -1, 8)))))
    squares = px.select("photo_id", "label", "x", "y", corners.alias("c")).groupBy("photo_id", "label", (F.col("x") + F.col("c.dx")).alias("sx"), (F.col("y") + F.col("c.dy")).alias("sy")).agg(F.sum("c.bit").alias("state"))
    n = F.bit_count("state")
    diagonal = F.col("state").isin(9, 6)
    area = F.when(n == 4, 1.0).when(n == 3, 0.5).otherwise(0.0)
    straight, crossing = F.when((n == 2) & ~diagonal, 1).otherwise(0), F.when(n == 3, 1).when(diagonal, 2).otherwise(0)
    sums = squares.groupBy("photo_id", "label").agg(F.sum(area).alias("area"), F.sum(straight).alias("straight"), F.sum(crossing).alias("crossing"))
    return sums.select("photo_id", "label", "area", (F.col("straight") + F.col("crossing") * F.sqrt(F.lit(2.0))).alias("perimeter"))


def textures(px: DataFrame, regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """photo_id, label, texture: spread of the Laplacian (four neighbours) of `gray` over each region's pixels, mirrored at the region's box.

    px: photo_id, x, y, gray; regions: photo_id, label, x, y; boxes: photo_id, label, x1, y1, x2, y2 (inclusive). Each pixel of a box gives its grey to the neighbours, twice to those whose
    other neighbour is beyond the edge, so that no neighbour is looked up.
    """
    lines = boxes.select("photo_id", "label", "x1", "x2", "y1", "y2", F.explode(F.sequence("y1", "y2")).alias("y"))
    inside = px.select("photo_id", "x", "y", F.col("gray").cast("double").alias("gray")).join(lines, ["photo_id", "y"]).where((F.col("x") >= F.col("x1")) & (F.col("x") <= F.col("x2")))

    def given(at: str, low: str, high: str, step: int) -> Column:
        to = F.col(at) + step
        fits = (to >= F.col(low)) & (to <= F.col(high))
        mirrored = to == (F.col(low) if step < 0 else F.col(high))
        return F.when(fits, F.when(mirrored, 2).otherwise(1))

    flat = lambda low, high: F.when(F.col(low) == F.col(high), 2).otherwise(0)  # noqa: E731 - a single row or column mirrors itself
    shares = [F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), (flat("x1", "x2") + flat("y1", "y2") - 4).alias("k"))]
    shares += [F.struct(F.lit(s).alias("dx"), F.lit(0).alias("dy"), given("x", "x1", "x2", s).alias("k")) for s in (-1, 1)]
    shares += [F.struct(F.lit(0).alias("dx"), F.lit(s).alias("dy"), given("y", "y1", "y2", s).alias("k")) for s in (-1, 1)]
    sums = inside.select("photo_id", "label", "x", "y", "gray", F.explode(F.array(*shares)).alias("s")).where("s.k is not null")
    sums = sums.groupBy("photo_id", "label", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).agg(F.sum(F.col("gray") * F.col("s.k")).alias("edge"))
    return regions.join(sums, ["photo_id", "label", "x", "y"]).groupBy("photo_id", "label").agg(F.stddev_pop("edge").alias("texture"))


def border_contacts(runs: DataFrame, boxes: DataFrame, sizes: DataFrame, margin: int = 2) -> DataFrame:
    """photo_id, label, contact: how many columns and rows of each region touch the `margin` along the photo's four edges, as a share of the longer side of its box."""
    rows = runs.join(sizes, "photo_id")
    across = lambda test: rows.where(test).select("photo_id", "label", F.explode(F.sequence("x1", "x2")).alias("at")).distinct().groupBy("photo_id", "label").count()
    down = lambda test: rows.where(test).select("photo_id", "label", "y").distinct().groupBy("photo_id", "label").count()
    sides = [across(F.col("y") < margin), across(F.col("y") >= F.col("height") - margin), down(F.col("x1") < margin), down(F.col("x2") >= F.col("width") - margin)]
    touching = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]).groupBy("photo_id", "label").agg(F.sum("count").alias("n"))
    longest = F.greatest(F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1)
    return boxes.join(touching, ["photo_id", "label"], "left").select("photo_id", "label", (F.coalesce("n", F.lit(0)) / longest).alias("contact"))


def candidates(mask: DataFrame, sizes: DataFrame, px: DataFrame, raw: DataFrame, dark: DataFrame, least: float = 16.0) -> DataFrame:
    """photo_id, label, box, features of each region of a mask whose outline holds `least` square pixels; holes are filled, and regions within others are part of them.

    px: photo_id, x, y, r, g, b, gray; raw and dark: pixels (photo_id, x, y) of the foreground before it was cleaned, and of what is very dark. features has area, area_fraction, solidity, extent,
    complexity, aspect_ratio, foreground_ratio, dark_ratio, colorfulness, texture, hue_diversity, border_distance, border_contact.
    """
    runs = cut_lineage(labelled(filled(mask, sizes)))
    own = pixels_of(runs)
    shapes = cut_lineage(outlines(own).where(F.col("area") >= least))
    runs = runs.join(shapes.select("photo_id", "label"), ["photo_id", "label"], "left_semi")
    own = cut_lineage(pixels_of(runs).select("photo_id", "label", "x", "y"))
    boxes = cut_lineage(runs.groupBy("photo_id", "label").agg(F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), F.max("y").alias("y2")))
    marked = own.join(px, ["photo_id", "x", "y"])
    for name, pixels_ in (("raw", raw), ("dark", dark)):
        marked = marked.join(pixels_.select("photo_id", "x", "y", F.lit(1).alias(name)), ["photo_id", "x", "y"], "left")
    key = F.struct("photo_id", "label").alias("photo_id")
    marked = cut_lineage(marked.select("photo_id", "label", "x", "y", "r", "g", "b", "raw", "dark"))
    shares = marked.groupBy("photo_id", "label").agg((F.count("raw") / F.count("*")).alias("foreground_ratio"), (F.count("dark") / F.count("*")).alias("dark_ratio"))
    keyed = marked.select(key, "r", "g", "b")
    unkeyed = lambda df, name: df.select("photo_id.photo_id", "photo_id.label", name)
    rows = shapes.join(boxes, ["photo_id", "label"]).join(hull_areas(runs), ["photo_id", "label"]).join(shares, ["photo_id", "label"])
    rows = rows.join(unkeyed(pixels.colorfulness(keyed), "colorfulness"), ["photo_id", "label"]).join(unkeyed(pixels.hue_diversity(keyed), "hue_diversity"), ["photo_id", "label"])
    rows = rows.join(textures(px, own, boxes), ["photo_id", "label"]).join(border_contacts(runs, boxes, sizes), ["photo_id", "label"]).join(sizes, "photo_id")
    w, h = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    area = F.col("area")
    hull = F.when(F.col("hull_area") == 0, 1.0).otherwise(F.col("hull_area"))
    features = {
        "area": area, "area_fraction": area / (F.col("width") * F.col("height")), "solidity": area / hull, "extent": area / (w * h), "complexity": F.col("perimeter") * F.col("perimeter") / (4 * F.pi() * F.greatest(area, F.lit(1.0))),
        "aspect_ratio": F.greatest(w, h) / F.least(w, h), "foreground_ratio": F.col("foreground_ratio"), "dark_ratio": F.col("dark_ratio"), "colorfulness": F.col("colorfulness"), "texture": F.col("texture"), "hue_diversity": F.col("hue_diversity"),
        "border_distance": F.least("x1", "y1", F.col("width") - 1 - F.col("x2"), F.col("height") - 1 - F.col("y2")).cast("double"), "border_contact": F.col("contact"),
    }
    box = F.struct(F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    return rows.select("photo_id", "label", box.alias("box"), F.struct(*(v.alias(n) for n, v in features.items())).alias("features"))


def median_area(runs: DataFrame, sizes: DataFrame, least: float = 0.0005, rows: int = 3) -> DataFrame:
    """photo_id, typical: median of pixels of labelled runs' components that hold `least` of the photo; null if under `rows` do."""
    areas = runs.groupBy("photo_id", "label").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("n")).join(sizes, "photo_id")
    large = areas.where(F.col("n") >= least * F.col("width") * F.col("height"))
    return large.groupBy("photo_id").agg(F.when(F.count("*") >= rows, F.median(F.col("n").cast("double"))).alias("typical"))

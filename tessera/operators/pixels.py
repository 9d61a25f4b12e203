"""Colour statistics of images as tables of pixels: photo_id, x, y, r, g, b (0-255). All are grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def colorfulness(px: DataFrame) -> DataFrame:
    """photo_id, colorfulness: spread and mean of the opponent channels (Hasler and Suesstrunk)."""
    rg, yb = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    by = px.groupBy("photo_id").agg(F.var_pop(rg).alias("vr"), F.var_pop(yb).alias("vy"), F.avg(rg).alias("mr"), F.avg(yb).alias("my"))
    return by.select("photo_id", (F.sqrt(F.col("vr") + F.col("vy")) + 0.3 * F.sqrt(F.col("mr") ** 2 + F.col("my") ** 2)).alias("colorfulness"))


def gray_world(px: DataFrame, strength: float = 0.6) -> DataFrame:
    """Pixels with each channel moved towards the photo's mean grey by `strength`."""
    means = px.groupBy("photo_id").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"))
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3
    gain = lambda c: 1 + strength * (grey / F.greatest(F.col(f"m{c}"), F.lit(1.0)) - 1)
    return px.join(means, "photo_id").select("photo_id", "x", "y", *(F.least(F.lit(255.0), F.col(c) * gain(c)).alias(c) for c in "rgb"))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0-180, saturation and value 0-255."""
    high, spread = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    degrees = F.when(spread == 0, 0.0).when(high == r, (60.0 * (g - b) / spread + 360) % 360).when(high == g, 60.0 * (b - r) / spread + 120).otherwise(60.0 * (r - g) / spread + 240)
    return degrees / 2, F.when(high == 0, 0.0).otherwise(255.0 * spread / high), high


def histogram(px: DataFrame, bins: tuple[int, int, int] = (8, 4, 4)) -> DataFrame:
    """photo_id, hue_bin, sat_bin, val_bin, share of the photo's pixels; only bins that have some."""
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    at = lambda c, top, n: F.least(F.lit(n - 1), F.floor(c / (top / n))).cast("int")
    by = px.groupBy("photo_id", at(h, 180, bins[0]).alias("hue_bin"), at(s, 256, bins[1]).alias("sat_bin"), at(v, 256, bins[2]).alias("val_bin")).agg(F.count("*").alias("n"))
    total = px.groupBy("photo_id").agg(F.count("*").alias("total"))
    return by.join(total, "photo_id").select("photo_id", "hue_bin", "sat_bin", "val_bin", (F.col("n") / F.col("total")).alias("share"))


def hue_diversity(px: DataFrame) -> DataFrame:
    """photo_id, hue_diversity: share of 12 hue bins that hold over max(5, 2 %) of the saturated pixels; 0 under 20 such pixels."""
    h, s, _ = hsv(F.col("r"), F.col("g"), F.col("b"))
    by = px.groupBy("photo_id", F.floor(h / 15).alias("bin")).agg(F.count_if(s >= 60).alias("n"))
    by = by.groupBy("photo_id").agg(F.sum("n").alias("total"), F.collect_list("n").alias("all"))
    full = F.size(F.filter("all", lambda n: n > F.greatest(F.lit(5.0), F.col("total") * 0.02)))
    return by.select("photo_id", F.when(F.col("total") < 20, 0.0).otherwise(full / 12).alias("hue_diversity"))


def cell_shares(place: Column, cell: Column, cells: Column) -> Column:
    """An array of (to, share): the target cells, `cell` source pixels wide, that a source pixel lies in, and how much of each cell it fills."""
    first, last = F.floor(place / cell).cast("int"), F.least(cells - 1, F.ceil((place + 1) / cell).cast("int") - 1)
    overlap = lambda i: F.least(place + 1.0, (i + 1) * cell) - F.greatest(place * 1.0, i * cell)
    shares = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.struct(i.alias("to"), (overlap(i) / cell).alias("share")))
    return F.filter(shares, lambda s: s["share"] > 1e-12)


def resized(px: DataFrame, sizes: DataFrame, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Pixels of each photo at another size: every new pixel is the mean of the old ones under it, weighted by the area that they share, rounded half to even.

    sizes: photo_id, width, height, new_width, new_height. Each old pixel gives its share to the few new ones that it lies under (four, if photos shrink); a grouped sum does the rest.
    """
    rows = px.select("photo_id", "x", "y", *values).join(sizes.select("photo_id", "width", "height", "new_width", "new_height"), "photo_id")
    across = cell_shares(F.col("x"), F.col("width") / F.col("new_width"), F.col("new_width"))
    down = cell_shares(F.col("y"), F.col("height") / F.col("new_height"), F.col("new_height"))
    rows = rows.select("photo_id", *values, across.alias("_across"), down.alias("_down"))
    rows = rows.select("photo_id", *values, F.explode("_across").alias("_i"), "_down").select("photo_id", *values, "_i", F.explode("_down").alias("_j"))
    share = F.col("_i.share") * F.col("_j.share")
    means = rows.groupBy("photo_id", F.col("_i.to").alias("x"), F.col("_j.to").alias("y")).agg(*(F.sum(F.col(v) * share).alias(v) for v in values))
    # Sums of shares may miss a half by a hair, so they are rounded to nine digits first.
    return means.select("photo_id", "x", "y", *(F.rint(F.round(v, 9)).cast("int").alias(v) for v in values))


def shrunk_sizes(sizes: DataFrame, longest: int) -> DataFrame:
    """sizes with new_width, new_height, scale: of photos whose longer side is over `longest`, that side as long; others stay. scale leads back to the old size."""
    side = F.greatest("width", "height")
    over = side > longest
    ratio = F.lit(longest) / side
    new = lambda c: F.when(over, F.rint(F.col(c) * ratio).cast("int")).otherwise(F.col(c))
    return sizes.select("photo_id", "width", "height", new("width").alias("new_width"), new("height").alias("new_height"), F.when(over, side / longest).otherwise(1.0).alias("scale"))


def equalized(gray: DataFrame) -> DataFrame:
    """photo_id, x, y, gray with each photo's histogram spread over 0-255: a level becomes the share of pixels up to it, without those of the lowest level. A photo of one level stays as it is."""
    by = gray.groupBy("photo_id", "gray").agg(F.count("*").alias("n"))
    page = Window.partitionBy("photo_id")
    up = page.orderBy("gray").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = F.first("n").over(page.orderBy("gray").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = by.select("photo_id", "gray", F.sum("n").over(up).alias("up"), F.sum("n").over(page).alias("total"), lowest.alias("low"))
    new = F.when(F.col("total") == F.col("low"), F.col("gray")).otherwise(F.rint((F.col("up") - F.col("low")) * (255.0 / (F.col("total") - F.col("low")))).cast("int"))
    return gray.join(levels.select("photo_id", "gray", new.alias("_new")), ["photo_id", "gray"]).select("photo_id", "x", "y", F.col("_new").alias("gray"))


def perceptual_hash(gray: DataFrame, side: int = 32, size: int = 8, level: float = 0.0) -> DataFrame:
    """photo_id, bits: `size` squared frequency coefficients of a side x side table (photo_id, x, y, gray), each compared with the median of all but the first, to six digits.

    gray counts from `level`, and pixels that aren't in the table have just that; it only changes the first coefficient.

    The cosine transform is separable: a grouped sum over x, then one over y, each against constant factors.
    """
    def factor(frequency: Column, place: Column) -> Column:
        scale = F.when(frequency == 0, math.sqrt(1 / side)).otherwise(math.sqrt(2 / side))
        return scale * F.cos((2 * place + 1) * frequency * math.pi / (2 * side))

    frequencies = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    rows = gray.select("photo_id", "y", "x", "gray", frequencies.alias("u")).groupBy("photo_id", "y", "u").agg(F.sum(F.col("gray") * factor(F.col("u"), F.col("x"))).alias("s"))
    both = rows.select("photo_id", "u", "y", "s", frequencies.alias("v")).groupBy("photo_id", "u", "v").agg(F.sum(F.col("s") * factor(F.col("v"), F.col("y"))).alias("c"))
    both = both.withColumn("c", F.round(F.col("c") + F.when((F.col("u") == 0) & (F.col("v") == 0), level * side).otherwise(0.0), 6))
    ordered = both.groupBy("photo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "u", "c"))), lambda z: z["c"]).alias("c"))
    middle = F.element_at(F.array_sort(F.slice("c", 2, size * size - 1)), size * size // 2)
    return ordered.select("photo_id", F.array_join(F.transform("c", lambda z: F.when(z > middle, "1").otherwise("0")), "").alias("bits"))

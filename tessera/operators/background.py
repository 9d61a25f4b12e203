"""Background colours of photos: the most common pair of colour channels from a smoothed sparse histogram, what lies far from it, and what is dark or light against it.

Pixels are tables photo_id, x, y, l, a, b (8-bit LAB). All is grouped aggregates and joins by photo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bins of a channel, the smoothing kernel's middle and sides (in sixteenths), half a neighbourhood in bins, distances of merged colours and of the lightness sample.
BINS = 64
KERNEL = (6, 4, 1)
NEAR_BINS = 1.5
MERGE_DISTANCE = 6.0
DARK_FELT = 110
RING = 0.04


def histogram_ab(lab: DataFrame) -> DataFrame:
    """photo_id, i, j, n: pixels by bin of a and b; only bins that have some."""
    at = lambda c: F.floor(F.col(c) / (256 // BINS)).cast("int")
    return lab.groupBy("photo_id", at("a").alias("i"), at("b").alias("j")).agg(F.count("*").alias("n"))


def smoothed(histogram: DataFrame) -> DataFrame:
    """photo_id, i, j, n of a histogram after the 5 x 5 kernel (in 256ths, whole numbers), mirrored at its edges without the edge bin.

    Each bin scatters to its neighbours, so that empty bins cost nothing.
    """

    def weight(distance: Column) -> Column:
        d = F.abs(distance)
        return F.when(d == 0, KERNEL[0]).when(d == 1, KERNEL[1]).when(d == 2, KERNEL[2]).otherwise(0)

    def targets(c: str) -> Column:
        k = F.col(c)

        def entry(to: Column) -> Column:
            mirrored = F.when(k > 0, weight(-k - to)).otherwise(0) + F.when(k < BINS - 1, weight(2 * (BINS - 1) - k - to)).otherwise(0)
            return F.struct(to.alias("to"), (weight(k - to) + mirrored).alias("w"))

        return F.explode(F.transform(F.sequence(F.greatest(F.lit(0), k - 2), F.least(F.lit(BINS - 1), k + 2)), entry))

    rows = histogram.select("photo_id", "j", "n", targets("i").alias("s")).groupBy("photo_id", F.col("s.to").alias("i"), "j").agg(F.sum(F.col("n") * F.col("s.w")).alias("n"))
    rows = rows.select("photo_id", "i", "n", targets("j").alias("s")).groupBy("photo_id", "i", F.col("s.to").alias("j")).agg(F.sum(F.col("n") * F.col("s.w")).alias("n"))
    return rows


def dominant_ab(lab: DataFrame) -> DataFrame:
    """photo_id, a, b: mean of the pixels within one and a half bins of the middle of the smoothed histogram's fullest bin (the first of equal ones), or that middle if there are none."""
    size = 256 / BINS
    peaks = smoothed(histogram_ab(lab)).groupBy("photo_id").agg(F.max_by(F.struct("i", "j"), F.struct("n", -F.col("i"), -F.col("j"))).alias("top"))
    peaks = peaks.select("photo_id", ((F.col("top.i") + 0.5) * size).alias("_a"), ((F.col("top.j") + 0.5) * size).alias("_b"))
    near = (F.abs(F.col("a") - F.col("_a")) <= NEAR_BINS * size) & (F.abs(F.col("b") - F.col("_b")) <= NEAR_BINS * size)
    means = lab.join(peaks, "photo_id").groupBy("photo_id").agg(*(F.avg(F.when(near, F.col(c))).alias(c) for c in "ab"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return means.select("photo_id", F.coalesce("a", "_a").alias("a"), F.coalesce("b", "_b").alias("b"))


def border_ring(sizes: DataFrame) -> DataFrame:
    """sizes with `ring`: pixels of the border ring, a share of the shorter side, two at least."""
    return sizes.withColumn("ring", F.greatest(F.lit(2), F.floor(F.least("width", "height") * RING)).cast("int"))


def estimate(lab: DataFrame, sizes: DataFrame, merge_distance: float = MERGE_DISTANCE) -> DataFrame:
    """photo_id, colors (array of a, b), lightness: the photo's dominant pair, and its border's too if that is further off; median lightness of the pixels near the first (of all, if none is)."""
    ring = border_ring(sizes)
    x, y, r = F.col("x"), F.col("y"), F.col("ring")
    edge = lab.join(ring, "photo_id").where((x < r) | (y < r) | (x >= F.col("width") - r) | (y >= F.col("height") - r)).select(*lab.columns)
    main, border = dominant_ab(lab), dominant_ab(edge).select("photo_id", F.col("a").alias("_a"), F.col("b").alias("_b"))
    both = main.join(border, "photo_id")
    far = F.hypot(F.col("_a") - F.col("a"), F.col("_b") - F.col("b")) > merge_distance
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    colors = both.select("photo_id", F.when(far, F.array(pair("a", "b"), pair("_a", "_b"))).otherwise(F.array(pair("a", "b"))).alias("colors"))
    first = colors.select("photo_id", "colors", F.col("colors")[0].alias("m"))
    near = F.hypot(F.col("a") - F.col("m.a"), F.col("b") - F.col("m.b")) < 6
    value = F.col("l").cast("double")
    lightness = lab.join(first.select("photo_id", "m"), "photo_id").groupBy("photo_id").agg(F.coalesce(F.median(F.when(near, value)), F.median(value)).alias("lightness"))
    return colors.join(lightness, "photo_id")


def chroma_distances(lab: DataFrame, model: DataFrame) -> DataFrame:
    """Pixels with `distance`: to the nearest of their photo's background colours, in units of a and b. model: as of estimate()."""
    rows = lab.join(model, "photo_id")
    distance = F.array_min(F.transform("colors", lambda c: F.hypot(F.col("a") - c["a"], F.col("b") - c["b"])))
    return rows.withColumn("distance", distance)


def raw_foreground(lab: DataFrame, model: DataFrame, distance: float = 11.0, dark: int = 70) -> DataFrame:
    """Pixels (photo_id, x, y, distance, foreground, dark): far from the background's colours or, on light felt, darker than `dark`; on dark felt much lighter than it."""
    felt = F.col("lightness") < DARK_FELT
    rows = chroma_distances(lab, model)
    contrast = F.when(felt, F.col("l") > F.least(F.lit(255), F.col("lightness") + (255 - dark) // 2)).otherwise(F.col("l") < dark)
    very = F.when(felt, F.col("l") > F.col("lightness") + 60).otherwise(F.col("l") < dark)
    return rows.select("photo_id", "x", "y", "distance", ((F.col("distance") > distance) | contrast).alias("foreground"), very.alias("dark"))

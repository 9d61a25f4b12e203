"""Fingerprints of the objects in photos, from pixel tables: a perceptual hash of the object alone on grey, and a histogram of its colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import likeness, scoring
from ..session import cut_lineage
from . import filters, lookalikes, pixels, regions

# Longest side, share of the photo under which a mask doesn't count, grey around the object, side of the hashed square, bins of hue, saturation and value.
LONGEST, LEAST, GREY, SIDE, BINS = 256, 0.05, 128, 32, (8, 4, 4)


def whole_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("photo_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def masked(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """px (photo_id, x, y, r, g, b) with `inside`: in the photo's object or, where that is under LEAST of the photo, everywhere."""
    l, a, b = scoring.lab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    mask = regions.pixels_of(regions.foreground(filters.bilateral(px, sizes).select("photo_id", "x", "y", l.alias("l"), a.alias("a"), b.alias("b")), sizes))
    rows = px.join(mask.withColumn("inside", F.lit(True)), ["photo_id", "x", "y"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    enough = rows.groupBy("photo_id").agg((F.count_if("inside") >= LEAST * F.count("*")).alias("_enough"))
    return rows.join(enough, "photo_id").withColumn("inside", F.col("inside") | ~F.col("_enough")).drop("_enough")


def hashes(rows: DataFrame) -> DataFrame:
    """photo_id, hi, lo: the hash of the equalised grey of masked() pixels, centred on a square of grey that the object just fits in.

    Only what differs from grey is resized and transformed: both are sums, and grey pixels add nothing to any coefficient but the first.
    """
    gray = scoring.gray(F.col("r"), F.col("g"), F.col("b"))
    even = pixels.equalized(rows.select("photo_id", "x", "y", gray.alias("gray")))
    inside = rows.where("inside").select("photo_id", "x", "y").join(even, ["photo_id", "x", "y"])
    box = inside.groupBy("photo_id").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    wide, high = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    squares = box.select("photo_id", "x1", "y1", F.greatest(wide, high).alias("side"), wide.alias("w"), high.alias("h"))
    put = inside.join(squares, "photo_id").select(
        "photo_id", (F.col("x") - F.col("x1") + F.floor((F.col("side") - F.col("w")) / 2)).alias("x"), (F.col("y") - F.col("y1") + F.floor((F.col("side") - F.col("h")) / 2)).alias("y"), (F.col("gray") - GREY).alias("gray")
    )
    sizes = squares.select("photo_id", F.col("side").alias("width"), F.col("side").alias("height"), F.lit(SIDE).alias("new_width"), F.lit(SIDE).alias("new_height"))
    found = pixels.perceptual_hash(pixels.resized(put, sizes, ("gray",)), SIDE, level=GREY)
    values = F.transform(F.filter(F.split("bits", ""), lambda c: c != ""), lambda c: c.cast("int"))
    return found.select("photo_id", likeness.hash_bits(values, 0).alias("hi"), likeness.hash_bits(values, 32).alias("lo"))


def fingerprints(px: DataFrame) -> DataFrame:
    """id, hi, lo, histogram (of hue, saturation and value, shares of the object's pixels) of each photo's object. px: photo_id, x, y, r, g, b."""
    sizes = pixels.shrunk_sizes(whole_sizes(px), LONGEST)
    small = px.join(sizes.where("scale = 1").select("photo_id"), "photo_id", "left_semi").select("photo_id", "x", "y", "r", "g", "b")
    small = small.unionByName(pixels.resized(px, sizes.where("scale > 1")))
    now = sizes.select("photo_id", F.col("new_width").alias("width"), F.col("new_height").alias("height"))
    rows = cut_lineage(masked(cut_lineage(small), now))
    by = pixels.histogram(rows.where("inside").select("photo_id", "r", "g", "b"), BINS)
    place = F.col("hue_bin") * (BINS[1] * BINS[2]) + F.col("sat_bin") * BINS[2] + F.col("val_bin")
    each = by.groupBy("photo_id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("place"), "share"))).alias("bins"))
    every = F.sequence(F.lit(0), F.lit(BINS[0] * BINS[1] * BINS[2] - 1))
    histogram = F.transform(every, lambda i: F.coalesce(F.try_element_at("bins", i), F.lit(0.0)))
    return hashes(rows).join(each, "photo_id").select(F.col("photo_id").alias("id"), "hi", "lo", histogram.alias("histogram"))


def backfilled(items: DataFrame, crops: DataFrame, px: DataFrame) -> DataFrame:
    """items with fingerprints where approved ones with a crop have none yet (lookalikes.without_fingerprint); px: photo_id (the item's id), x, y, r, g, b of crops. fingerprint: JSON as it is stored."""
    todo = lookalikes.without_fingerprint(items, crops).select("id")
    made = fingerprints(px.join(todo.withColumnRenamed("id", "photo_id"), "photo_id", "left_semi"))
    made = made.select(F.col("id").alias("_id"), F.to_json(likeness.encoded(F.col("hi"), F.col("lo"), F.col("histogram"))).alias("_made"))
    return items.join(made, F.col("id") == F.col("_id"), "left").withColumn("fingerprint", F.coalesce("_made", "fingerprint")).select(*items.columns)

"""What follows detection: duplicate suppression and reading order as ordered folds per photo, survivors of a new detection, scores.

A photo's boxes are folded as one array. That group is one page, not a share of the table; everything else is joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scoring
from ..functions.numbering import numbered
from ..functions.rounding import half_even
from ..functions.scoring import LIMITS, Limits


def scored(candidates: DataFrame, features: str = "features", limits: Limits = LIMITS) -> DataFrame:
    """Adds confidence and rejected_reason (null: accepted)."""
    rows = candidates.withColumn("confidence", scoring.confidence(F.col(features), limits))
    return rows.withColumn("rejected_reason", scoring.rejection(F.col(features), F.col("confidence"), limits))


def suppress(boxes: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """photo_id, id, box, confidence of the boxes kept: largest first (ties by id), each box that overlaps the first matching kept
    one by iou, or lies in it by containment, is absorbed into it: that grows to the union and takes the higher confidence."""
    entry = F.struct((-g.area(F.col("box"))).alias("order"), "id", "box", F.col("confidence").cast("double").alias("confidence"))
    pages = boxes.groupBy("photo_id").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    kind = "array<struct<id:bigint,box:struct<x:int,y:int,width:int,height:int>,confidence:double>>"

    def same(kept: Column, new: Column) -> Column:
        return (g.iou(new["box"], kept["box"]) >= limits.iou) | (g.containment(new["box"], kept["box"]) >= limits.containment)

    def step(kept: Column, new: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: same(k, new)), F.lit(True))
        grown = F.transform(
            kept,
            lambda k, i: F.when(
                i == at - 1, F.struct(k["id"].alias("id"), g.union(k["box"], new["box"]).alias("box"), F.greatest(k["confidence"], new["confidence"]).alias("confidence"))
            ).otherwise(k),
        )
        return F.when(at > 0, grown).otherwise(F.array_append(kept, F.struct(new["id"].alias("id"), new["box"].alias("box"), new["confidence"].alias("confidence")))).cast(kind)

    return pages.select("photo_id", F.inline(F.aggregate("all", F.array().cast(kind), step)))


def reading_order(boxes: DataFrame) -> DataFrame:
    """photo_id, id, position (from 1): rows of boxes from top to bottom, each from left to right.

    In order of centre heights (ties by id) a box joins the current row if it is within half the median height of the mean of that row's centres so far.
    """
    centre = F.col("box.y") + F.col("box.height") / 2
    entry = F.struct(centre.alias("cy"), "id", F.col("box.x").alias("x"))
    pages = boxes.groupBy("photo_id").agg(F.sort_array(F.collect_list(entry)).alias("all"), F.median(F.col("box.height").cast("double")).alias("typical"))
    places = "array<struct<row:int,x:int,place:int,id:bigint>>"
    kind = f"struct<row:int,total:double,n:int,out:{places}>"
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast(places).alias("out")).cast(kind)

    def step(s: Column, b: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(b["cy"] - s["total"] / F.greatest(s["n"], F.lit(1))) < F.col("typical") * 0.5)
        row = F.when(joins, s["row"]).otherwise(s["row"] + 1)
        total = F.when(joins, s["total"] + b["cy"]).otherwise(b["cy"])
        # Equal x in a row keep the order of centres.
        out = F.array_append(s["out"], F.struct(row.alias("row"), b["x"].alias("x"), F.size(s["out"]).alias("place"), b["id"].alias("id")))
        return F.struct(row.alias("row"), total.alias("total"), F.when(joins, s["n"] + 1).otherwise(1).alias("n"), out.alias("out")).cast(kind)

    folded = pages.select("photo_id", F.sort_array(F.aggregate("all", start, step)["out"]).alias("order"))
    return folded.select("photo_id", F.posexplode("order").alias("p", "b")).select("photo_id", F.col("b.id").alias("id"), (F.col("p") + 1).alias("position"))


def assembled(kept: DataFrame, photos: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """photo_id, position, box, confidence (3 digits), flags of a detection run: boxes found at a smaller scale, in reading order, scaled up and clipped.

    kept: photo_id, id, box, confidence, foreground; photos: photo_id, scale, width, height. Flags compare with the median area of the run, however few boxes it has.
    """
    rows = kept.join(reading_order(kept), ["photo_id", "id"]).join(photos, "photo_id")
    rows = rows.withColumn("box", g.clip(g.scale(F.col("box"), F.col("scale")), F.col("width"), F.col("height")))
    typical = rows.groupBy("photo_id").agg(F.median(g.area(F.col("box")).cast("double")).alias("typical"))
    marks = scoring.flags(F.col("box"), F.col("width"), F.col("height"), F.col("typical"), F.col("foreground"), F.col("confidence"), limits)
    return rows.join(typical, "photo_id").select("photo_id", "position", "box", half_even(F.col("confidence").cast("double"), 3).alias("confidence"), marks.alias("flags"))


def appended(boxes: DataFrame, found: DataFrame, first_id: int) -> DataFrame:
    """boxes (id, photo_id, box, status, origin, confidence, flags) with assembled ones as pending and automatic, ids from first_id in order of photo and position."""
    new = numbered(found, ["photo_id", "position"], "id", first_id)
    new = new.withColumns({"status": F.lit("pending"), "origin": F.lit("auto")})
    return boxes.unionByName(new.select(*boxes.columns))


def survivors(fresh: DataFrame, kept: DataFrame, iou: float = 0.3, containment: float = 0.7) -> DataFrame:
    """New boxes that overlap no kept box of the same photo by iou or containment: an anti join on the photo with the overlap as residual."""
    new, old = fresh.alias("n"), kept.alias("k")
    overlap = (g.iou(F.col("n.box"), F.col("k.box")) >= iou) | (g.containment(F.col("n.box"), F.col("k.box")) >= containment)
    return new.join(old, (F.col("n.photo_id") == F.col("k.photo_id")) & overlap, "left_anti")


def redetected(boxes: DataFrame, items: DataFrame, fresh: DataFrame) -> DataFrame:
    """A photo's boxes after a new detection: pending automatic ones without an item go, survivors of the new ones come."""
    replaced = boxes.where("status = 'pending' and origin = 'auto'").join(items.select(F.col("box_id").alias("id")), "id", "left_anti")
    rest = boxes.join(replaced.select("id"), "id", "left_anti")
    return rest.unionByName(survivors(fresh, rest.where(~F.col("status").isin("merged", "split"))))

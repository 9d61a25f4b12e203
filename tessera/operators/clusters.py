"""Very many small clusterings in one job: k-means++ and Lloyd's iterations by key, as grouped aggregates.

Points (key, l, a, b, n) are distinct colours with their counts. Each key is clustered `attempts` times at once, from other first centres; each (key, attempt) stops on its own, when its
centres move no more than `still`, and only those that go on are read again. Random numbers are digests of the point and the step, so that results don't depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.rounding import half_even
from ..session import cut_lineage
from . import catalog

ATTEMPTS, ROUNDS, STILL = 3, 30, 1.0
CENTRE = "struct<l:double,a:double,b:double>"


def colors(px: DataFrame) -> DataFrame:
    """Pixels (photo_id, l, a, b) as points: photo_id, l, a, b, n."""
    return px.groupBy("photo_id", "l", "a", "b").agg(F.count("*").alias("n"))


def _distance(point: Column | None, centre: Column) -> Column:
    """Squared distance of a row's colour and a centre."""
    d = [F.col(c) - centre[c] for c in "lab"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _least(centres: str = "centres") -> Column:
    return F.array_min(F.transform(centres, lambda c: _distance(None, c)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the digest of values."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def first_centres(points: DataFrame, wanted: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """photo_id, attempt, centres: k-means++. Each round takes one colour for each key, with a chance in proportion to its pixels times its squared distance from the centres so far.

    The draw is a grouped minimum of waiting times: that of a colour is exponential with this weight as rate. wanted: photo_id, k. Keys with fewer colours than k get as many centres as they have colours.
    """
    attempt = F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt")
    rows = cut_lineage(points.join(wanted, "photo_id").select("photo_id", "k", "l", "a", "b", "n", attempt))
    most = wanted.agg(F.max("k")).first()[0] or 0
    centres = None
    for turn in range(most):
        waiting = -F.log(uniform(F.lit(turn), F.col("attempt"), F.col("l"), F.col("a"), F.col("b")))
        if centres is None:
            weight = F.col("n").cast("double")
            open_ = rows
        else:
            open_ = rows.join(centres, ["photo_id", "attempt"]).where(F.col("k") > turn)
            weight = F.col("n") * _least()
            open_ = open_.where(_least() > 0)
        color = F.struct(*(F.col(c).cast("double").alias(c) for c in "lab"))
        drawn = open_.groupBy("photo_id", "attempt").agg(F.min_by(color, F.struct(waiting / weight, "l", "a", "b")).alias("drawn"))
        if centres is None:
            centres = drawn.select("photo_id", "attempt", F.array("drawn").alias("centres"))
        else:
            more = F.when(F.col("drawn").isNotNull(), F.array("drawn")).otherwise(F.array().cast(f"array<{CENTRE}>"))
            centres = centres.join(drawn, ["photo_id", "attempt"], "left").select("photo_id", "attempt", F.concat("centres", more).alias("centres"))
        centres = cut_lineage(centres)
    if centres is None:
        return rows.select("photo_id", "attempt", F.array().cast(f"array<{CENTRE}>").alias("centres")).distinct()
    return centres


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with their key's centres, the nearest one's place (the first of equal ones) and the squared distance from it."""
    rows = points.join(centres, "photo_id").withColumn("_all", F.transform("centres", lambda c: _distance(None, c)))
    return rows.withColumn("distance", F.array_min("_all")).withColumn("place", F.array_position("_all", F.col("distance")).cast("int") - 1).drop("_all")


def settled(points: DataFrame, start: DataFrame, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """photo_id, attempt, centres after Lloyd's iterations: each key goes on until no centre moves more than `still`, or for `rounds` rounds. A centre that loses all its points stays where it is."""
    points = cut_lineage(points)
    done: list[DataFrame] = []
    going = start
    for turn in range(rounds):
        by = assigned(points, going).groupBy("photo_id", "attempt", "place").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "lab"))
        new = by.groupBy("photo_id", "attempt").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct(*(F.col(c).cast("double").alias(c) for c in "lab"))))).alias("new"))
        rows = going.join(new, ["photo_id", "attempt"]).withColumn("moved", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("new", i), c)))
        step = F.zip_with("centres", "moved", lambda p, q: (p["l"] - q["l"]) * (p["l"] - q["l"]) + (p["a"] - q["a"]) * (p["a"] - q["a"]) + (p["b"] - q["b"]) * (p["b"] - q["b"]))
        rows = cut_lineage(rows.select("photo_id", "attempt", F.col("moved").alias("centres"), (F.coalesce(F.array_max(step), F.lit(0.0)) <= still * still).alias("rests")))
        done.append(rows.where("rests").drop("rests"))
        going = rows.where("not rests").drop("rests")
        if turn == rounds - 1 or going.isEmpty():
            done.append(going)
            break
    return cut_lineage(reduce(DataFrame.unionByName, done))


def clusters(points: DataFrame, wanted: DataFrame, attempts: int = ATTEMPTS, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """photo_id, place, l, a, b, n, share: the centres of each key's best attempt (least sum of squared distances, the first of equal ones) with how many pixels are nearest to each."""
    points = cut_lineage(points)
    centres = settled(points, first_centres(points, wanted, attempts), rounds, still)
    rows = assigned(points, centres)
    sums = rows.groupBy("photo_id", "attempt", "place").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("distance")).alias("spread"), F.first(F.get("centres", F.col("place"))).alias("c"))
    each = sums.groupBy("photo_id", "attempt").agg(F.sum("spread").alias("spread"), F.sum("n").alias("total"), F.collect_list(F.struct("place", "c", "n")).alias("all"))
    best = each.groupBy("photo_id").agg(F.min_by(F.struct("all", "total"), F.struct(half_even(F.col("spread"), 6), F.col("attempt"))).alias("best"))
    flat = best.select("photo_id", F.col("best.total").alias("total"), F.explode("best.all").alias("e"))
    return flat.select("photo_id", "e.place", "e.c.l", "e.c.a", "e.c.b", "e.n", (F.col("e.n") / F.col("total")).alias("share"))


def dominant_colors(px: DataFrame, count: int = 6, least: float = 0.05) -> DataFrame:
    """id, colors (hex, name, share, largest first): the main colours of each photo's object. px: photo_id, l, a, b of its pixels (regions.object_pixels).

    There are `count` clusters, fewer where there are under 20 pixels for each; clusters of one name add up; names with less than `least` go.
    """
    points = cut_lineage(colors(px))
    wanted = points.groupBy("photo_id").agg(F.least(F.lit(count), F.greatest(F.lit(1), F.floor(F.sum("n") / 20))).cast("int").alias("k"))
    rows = clusters(points, wanted)
    whole = {c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c)))).cast("int") for c in "lab"}
    rgb = scoring.rgb(whole["l"], whole["a"], whole["b"])
    hexed = F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(c)), 2, "0") for c in rgb))
    name = scoring.lab_color_name(F.col("l") * 100 / 255, F.col("a") - 128, F.col("b") - 128)
    return catalog.color_shares(rows.select(F.col("photo_id").alias("id"), hexed.alias("hex"), name.alias("name"), "share"))

"""Filters of pixel tables: edge-preserving smoothing over tiles with halos, and local contrast by tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a tile that one task smooths at a time.
TILE = 32


def mirrored(place: Column, side: Column) -> Column:
    """A place beyond a row of pixels as the place inside it that stands for it: mirrored at the edge pixels, which don't repeat."""
    period = F.greatest(F.lit(1), 2 * (side - 1))
    at = F.pmod(place, period)
    return F.when(side == 1, F.lit(0)).otherwise(F.least(at, period - at))


def stands_for(place: Column, side: Column, before: int, after: Column | int) -> Column:
    """All places from -before to side + after - 1 that a pixel stands for. In rows longer than the halo these are itself and its two mirror images."""
    last = side - 1 + after
    every = F.filter(F.sequence(F.lit(-before), last), lambda q: mirrored(q, side) == place)
    near = F.array_distinct(F.filter(F.array(place, -place, 2 * (side - 1) - place), lambda q: (q >= -before) & (q <= last)))
    return F.when((side > before) & (side > after), near).otherwise(every)


def bilateral(px: DataFrame, sizes: DataFrame, diameter: int = 7, sigma_color: float = 40.0, sigma_space: float = 7.0, tile: int = TILE) -> DataFrame:
    """photo_id, x, y, r, g, b: each pixel as the mean of those within half the diameter, weighted by how near they are and how alike their colours (sum of differences), rounded half to even.

    A tile and the pixels around it are one group, bounded whatever the photo, so neighbours meet once and not by a join for each offset; edges are mirrored. sizes: photo_id, width, height.
    """
    halo = diameter // 2
    offsets = [(i, j) for i in range(-halo, halo + 1) for j in range(-halo, halo + 1) if i * i + j * j <= halo * halo]
    rows = px.select("photo_id", "x", "y", "r", "g", "b").join(sizes.select("photo_id", "width", "height"), "photo_id")
    rows = rows.select("photo_id", "width", "height", "r", "g", "b", F.explode(stands_for(F.col("x"), F.col("width"), halo, halo)).alias("x"), "y")
    rows = rows.select("photo_id", "width", "height", "r", "g", "b", "x", F.explode(stands_for(F.col("y"), F.col("height"), halo, halo)).alias("y"))

    def tiles(place: str, side: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(place) - halo) / tile))
        return F.explode(F.sequence(first, F.least(F.floor((F.col(side) - 1) / tile), F.floor((F.col(place) + halo) / tile))).cast("array<int>"))

    rows = rows.withColumn("_tx", tiles("x", "width")).withColumn("_ty", tiles("y", "height"))

    def smooth(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).to_numpy()
        tx, ty, width, height = (int(get(c)[0]) for c in ("_tx", "_ty", "width", "height"))
        wide, high = min(tile, width - tx * tile), min(tile, height - ty * tile)
        cells = np.zeros((high + 2 * halo, wide + 2 * halo, 3))
        cells[get("y") - ty * tile + halo, get("x") - tx * tile + halo] = np.column_stack([get(c) for c in "rgb"])
        middle = cells[halo : halo + high, halo : halo + wide]
        total, weights = np.zeros_like(middle), np.zeros((high, wide, 1))
        for i, j in offsets:
            other = cells[halo + i : halo + i + high, halo + j : halo + j + wide]
            apart = np.abs(other - middle).sum(axis=2, keepdims=True)
            weight = np.exp(-(apart**2) / (2 * sigma_color**2) - (i * i + j * j) / (2 * sigma_space**2))
            total += other * weight
            weights += weight
        out = np.rint(total / weights).astype(np.int32)
        y, x = np.mgrid[ty * tile : ty * tile + high, tx * tile : tx * tile + wide]
        photo = pa.array([group.column("photo_id")[0].as_py()] * (wide * high), pa.int64())
        return pa.table([photo, *(pa.array(a.ravel().astype(np.int32)) for a in (x, y, out[..., 0], out[..., 1], out[..., 2]))], names=["photo_id", "x", "y", "r", "g", "b"])

    return rows.groupBy("photo_id", "_tx", "_ty").applyInArrow(smooth, "photo_id long, x int, y int, r int, g int, b int")


def tile_grid(sizes: DataFrame) -> DataFrame:
    """sizes with `tiles` (to a side: one for 150 pixels of the shorter side, two at least), `tile_w`, `tile_h`, `pad_x`, `pad_y`: if a side isn't a multiple of the tiles, both are padded to the next one."""
    n = F.greatest(F.lit(2), F.floor(F.least("width", "height") / 150)).cast("int")
    odd = (F.col("width") % n != 0) | (F.col("height") % n != 0)
    rows = sizes.select("photo_id", "width", "height", n.alias("tiles"), F.when(odd, n - F.col("width") % n).otherwise(0).alias("pad_x"), F.when(odd, n - F.col("height") % n).otherwise(0).alias("pad_y"))
    return rows.withColumns({"tile_w": ((F.col("width") + F.col("pad_x")) / n).cast("int"), "tile_h": ((F.col("height") + F.col("pad_y")) / n).cast("int")})


def tile_levels(gray: DataFrame, grid: DataFrame, clip: float = 2.0) -> DataFrame:
    """photo_id, tx, ty, level, value: what each grey level becomes by a tile's own histogram.

    A level holds at most `clip` times an even share of the tile's pixels; what is cut off is dealt out evenly over all levels, and the rest of that one by one at even steps.
    """
    rows = gray.join(grid, "photo_id")
    rows = rows.select("photo_id", "tile_w", "tile_h", "height", "pad_y", "gray", "y", F.explode(stands_for(F.col("x"), F.col("width"), 0, F.col("pad_x"))).alias("x"))
    rows = rows.select("photo_id", "tile_w", "tile_h", "gray", "x", F.explode(stands_for(F.col("y"), F.col("height"), 0, F.col("pad_y"))).alias("y"))
    tile = ["photo_id", F.floor(F.col("x") / F.col("tile_w")).cast("int").alias("tx"), F.floor(F.col("y") / F.col("tile_h")).cast("int").alias("ty")]
    counts = rows.groupBy(*tile, "gray").agg(F.count("*").alias("n"), F.first(F.col("tile_w") * F.col("tile_h")).alias("total"))
    limit = F.greatest(F.lit(1), F.floor(clip * F.col("total") / 256))
    counts = counts.withColumn("_limit", limit)
    cut = counts.groupBy("photo_id", "tx", "ty").agg(F.first("total").alias("total"), F.sum(F.greatest(F.lit(0), F.col("n") - F.col("_limit"))).alias("over"))
    every = cut.select("photo_id", "tx", "ty", "total", F.floor(F.col("over") / 256).alias("batch"), (F.col("over") % 256).alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    kept = counts.select("photo_id", "tx", "ty", F.col("gray").alias("level"), F.least("n", "_limit").alias("_n"))
    dense = every.join(kept, ["photo_id", "tx", "ty", "level"], "left")
    up = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("photo_id", "tx", "ty").orderBy("level"))
    step = F.greatest(F.lit(1), F.floor(256 / F.greatest(F.lit(1), F.col("rest"))))
    dealt = F.col("batch") * (F.col("level") + 1) + F.least("rest", F.floor(F.col("level") / step) + 1)
    value = F.least(F.lit(255), F.rint((up + dealt) * (255.0 / F.col("total"))).cast("int"))
    return dense.select("photo_id", "tx", "ty", "level", value.alias("value"))


def tiled_contrast(gray: DataFrame, sizes: DataFrame, clip: float = 2.0) -> DataFrame:
    """photo_id, x, y, gray with its contrast evened out locally: each pixel's level goes by the levels of the four tiles whose middles are around it, weighted by nearness."""
    grid = tile_grid(sizes)
    levels = tile_levels(gray.select("photo_id", "x", "y", "gray"), grid, clip)

    def sides(place: str, size: str) -> Column:
        at = F.col(place) / F.col(size) - 0.5
        low = F.floor(at).cast("int")
        inside = lambda i: F.greatest(F.lit(0), F.least(F.col("tiles") - 1, i))
        return F.array(F.struct(inside(low).alias("t"), (1 - (at - low)).alias("w")), F.struct(inside(low + 1).alias("t"), (at - low).alias("w")))

    rows = gray.join(grid, "photo_id").select("photo_id", "x", "y", "gray", F.explode(sides("x", "tile_w")).alias("i"), sides("y", "tile_h").alias("j"))
    rows = rows.select("photo_id", "x", "y", "gray", "i", F.explode("j").alias("j")).select("photo_id", "x", "y", F.col("gray").alias("level"), F.col("i.t").alias("tx"), F.col("j.t").alias("ty"), (F.col("i.w") * F.col("j.w")).alias("w"))
    met = rows.join(levels, ["photo_id", "tx", "ty", "level"])
    return met.groupBy("photo_id", "x", "y").agg(F.sum(F.col("value") * F.col("w")).alias("v")).select("photo_id", "x", "y", F.rint(F.round("v", 6)).cast("int").alias("gray"))

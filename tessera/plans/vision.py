"""Named queries on pixel tables: masks, regions, backgrounds and colours of the photos that the embeddings paint, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import background, clusters, detect, filters, fingerprints, pixels, regions
from . import views as v
from .edits import ORACLES, QUERIES
from .more import _BENT, _LINEAR, _NAME, _PLAIN, _POLAR, _ROW
from .queries import query

__all__ = ["ORACLES", "QUERIES"]  # with the queries of this module added

#: A painted photo is 8 x 8 pixels: small values are felt, others an object, red if positive and dark if negative.
SIDE = 8


def _lab(name: str, source: str) -> str:
    """SQL of pixels in LAB, and grey."""
    return f"""{name}_li AS (SELECT *, {_LINEAR.format(c="r")} AS lr, {_LINEAR.format(c="g")} AS lg, {_LINEAR.format(c="b")} AS lb FROM {source}), {name}_bent AS (SELECT *, {_BENT.format(v=_ROW[0])} AS fx, {_BENT.format(v=_ROW[1])} AS fy, {_BENT.format(v=_ROW[2])} AS fz FROM {name}_li),
    {name} AS (SELECT photo_id, x, y, r, g, b AS blue, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS gray, least(255, greatest(0, round_even((fy * 116 - 16) * 2.55, 0)))::INTEGER AS l, least(255, greatest(0, round_even((fx - fy) * 500 + 128, 0)))::INTEGER AS a, least(255, greatest(0, round_even((fy - fz) * 200 + 128, 0)))::INTEGER AS b FROM {name}_bent)"""


_PAINTED = f"""WITH RECURSIVE raw AS (SELECT vec_id AS photo_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, embedding[i]::DOUBLE AS v, CAST(floor(abs(embedding[i % 64 + 1]::DOUBLE) * 1000) AS INTEGER) % 40 AS w FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    px AS (SELECT photo_id, x, y, CASE WHEN abs(v) < 0.1 THEN 150 + w % 7 WHEN v > 0 THEN 200 + w ELSE 40 + w END AS r, CASE WHEN abs(v) < 0.1 THEN 150 WHEN v > 0 THEN 40 + w ELSE 45 END AS g, CASE WHEN abs(v) < 0.1 THEN 155 WHEN v > 0 THEN 60 ELSE 40 + w // 2 END AS b FROM raw),
    {_lab("lab", "px")}"""


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, x, y, r, g, b of painted photos."""
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), "embedding", F.posexplode("embedding").alias("k", "value"))
    w = (F.floor(F.abs(F.get("embedding", (F.col("k") + 1) % 64).cast("double")) * 1000) % 40).cast("int")
    e = e.select("photo_id", (F.col("k") % SIDE).alias("x"), F.floor(F.col("k") / SIDE).cast("int").alias("y"), F.col("value").cast("double").alias("v"), w.alias("w"))
    felt, red = F.abs("v") < 0.1, F.col("v") > 0
    r = F.when(felt, 150 + F.col("w") % 7).when(red, 200 + F.col("w")).otherwise(40 + F.col("w"))
    g = F.when(felt, 150).when(red, 40 + F.col("w")).otherwise(45)
    b = F.when(felt, 155).when(red, 60).otherwise(40 + F.floor(F.col("w") / 2))
    return e.select("photo_id", "x", "y", *(c.cast("int").alias(n) for n, c in zip("rgb", (r, g, b), strict=True)))


def in_lab(px: DataFrame) -> DataFrame:
    l, a, b = scoring.lab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return px.select("photo_id", "x", "y", l.alias("l"), a.alias("a"), b.alias("b"))


def sizes_of(px: DataFrame) -> DataFrame:
    return px.groupBy("photo_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _flood(name: str, lab: str) -> str:
    """SQL of what is like the border's median colour and connected with the border; <name>_edge has that colour."""
    return f"""{name}_ring AS (SELECT *, (x < 2)::INT + (x >= 6)::INT + (y < 2)::INT + (y >= 6)::INT AS n FROM {lab}), {name}_spread AS (SELECT r.* FROM {name}_ring r, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= n), {name}_edge AS (SELECT photo_id, median(l::DOUBLE) AS el, median(a::DOUBLE) AS ea, median(b::DOUBLE) AS eb FROM {name}_spread GROUP BY photo_id),
    {name}_cand AS (SELECT photo_id, x, y FROM {lab} JOIN {name}_edge USING (photo_id) WHERE sqrt(pow((l - el) * 0.4, 2) + pow(a - ea, 2) + pow(b - eb, 2)) < 14),
    {name} AS (SELECT photo_id, x, y FROM {name}_cand WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT c.photo_id, c.x, c.y FROM {name} f JOIN {name}_cand c ON c.photo_id = f.photo_id AND abs(c.x - f.x) + abs(c.y - f.y) = 1)"""


_FLOOD = _PAINTED + ", " + _flood("flood", "lab")
_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_SMOOTH = f"""off AS (SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j <= 9),
    met AS (SELECT p.photo_id, p.x, p.y, n.r, n.g, n.b, exp(-pow(abs(n.r - p.r) + abs(n.g - p.g) + abs(n.b - p.b), 2) / 3200.0::DOUBLE - (i * i + j * j) / 98.0::DOUBLE) AS w FROM px p, off, px n WHERE n.photo_id = p.photo_id AND n.x = {_MIRROR.format("p.x + j")} AND n.y = {_MIRROR.format("p.y + i")}),
    sm AS (SELECT photo_id, x, y, round_even(sum(r * w) / sum(w), 0)::INTEGER AS r, round_even(sum(g * w) / sum(w), 0)::INTEGER AS g, round_even(sum(b * w) / sum(w), 0)::INTEGER AS b FROM met GROUP BY photo_id, x, y)"""


@query(_FLOOD + " SELECT photo_id, x, y FROM flood")
def flooded_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = painted(spark, sf_dir)
    lab, sizes = in_lab(px), sizes_of(px)
    near = regions.near_border_color(lab, regions.border_colors(lab, sizes), 14.0, 0.4)
    return regions.pixels_of(regions.flooded(regions.runs_of(near), sizes))


def _cross(name: str, source: str, grow: bool) -> str:
    """SQL of a mask grown or shrunk by the 3 x 3 cross."""
    near = f"EXISTS (SELECT 1 FROM {source} m WHERE m.photo_id = p.photo_id AND abs(m.x - p.x) + abs(m.y - p.y) <= 1)"
    if grow:
        return f"{name} AS (SELECT photo_id, x, y FROM px p WHERE {near})"
    return f"{name}_out AS (SELECT photo_id, x, y FROM px ANTI JOIN {source} USING (photo_id, x, y)), {name} AS (SELECT photo_id, x, y FROM px p WHERE NOT {near.replace(f'FROM {source} m', f'FROM {name}_out m')})"


def _parts(name: str, source: str) -> str:
    """SQL of a mask's pixels with the number of the first pixel of their component (corners touch)."""
    return f"""{name}_reach AS (SELECT photo_id, x, y, y * 8 + x AS first FROM {source} UNION SELECT m.photo_id, m.x, m.y, r.first FROM {name}_reach r JOIN {source} m ON m.photo_id = r.photo_id AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1 AND m.y * 8 + m.x > r.first),
    {name} AS (SELECT photo_id, x, y, min(first) AS label FROM {name}_reach GROUP BY photo_id, x, y)"""


def _fill(name: str, source: str) -> str:
    """SQL of a mask with its holes filled."""
    return f"""{name}_rest AS (SELECT photo_id, x, y FROM px ANTI JOIN {source} USING (photo_id, x, y)),
    {name}_sea AS (SELECT photo_id, x, y FROM {name}_rest WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT c.photo_id, c.x, c.y FROM {name}_sea f JOIN {name}_rest c ON c.photo_id = f.photo_id AND abs(c.x - f.x) + abs(c.y - f.y) = 1),
    {name} AS (SELECT photo_id, x, y FROM px ANTI JOIN {name}_sea USING (photo_id, x, y))"""


_MASK = _FLOOD + f""", {_SMOOTH}, {_lab("soft", "sm")}, {_flood("sea", "soft")}, rest AS (SELECT photo_id, x, y FROM px ANTI JOIN sea USING (photo_id, x, y)), {_cross("thin", "rest", False)}, {_cross("wide", "thin", True)}, {_cross("grown", "wide", True)}, {_cross("shut", "grown", False)}, {_parts("part", "shut")},
    sized AS (SELECT photo_id, label, count(*) AS n, bool_or(x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4) AS central FROM part GROUP BY photo_id, label), fit AS (SELECT *, central AND n >= 0.15 * max(n) OVER (PARTITION BY photo_id) AS good FROM sized),
    picked AS (SELECT photo_id, label FROM fit QUALIFY good OR (NOT bool_or(good) OVER (PARTITION BY photo_id) AND row_number() OVER (PARTITION BY photo_id ORDER BY n DESC, label) = 1)), kept AS (SELECT photo_id, x, y FROM part SEMI JOIN picked USING (photo_id, label)), {_fill("mask", "kept")}"""


@query(_MASK + " SELECT photo_id, x, y FROM mask")
def foreground_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = painted(spark, sf_dir)
    sizes = sizes_of(px)
    return regions.pixels_of(regions.foreground(in_lab(filters.bilateral(px, sizes)), sizes))


@query(_PAINTED + f", {_SMOOTH} SELECT * FROM sm")
def smoothed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = painted(spark, sf_dir)
    return filters.bilateral(px, sizes_of(px))


# Two tiles a side, of 16 pixels each: a level holds one at most.
@query(
    _PAINTED + """, tile AS (SELECT photo_id, x // 4 AS tx, y // 4 AS ty, gray, count(*) AS n FROM lab GROUP BY ALL), cut AS (SELECT photo_id, tx, ty, sum(greatest(0, n - 1)) AS over FROM tile GROUP BY ALL),
    dense AS (SELECT c.photo_id, c.tx, c.ty, level, over % 256 AS rest, over // 256 AS batch, sum((t.n IS NOT NULL)::INT) OVER (PARTITION BY c.photo_id, c.tx, c.ty ORDER BY level) AS up FROM cut c CROSS JOIN (SELECT unnest(range(0, 256)) AS level) LEFT JOIN tile t ON t.photo_id = c.photo_id AND t.tx = c.tx AND t.ty = c.ty AND t.gray = level),
    lut AS (SELECT photo_id, tx, ty, level, least(255, round_even((up + batch * (level + 1) + least(rest, level // greatest(1, 256 // greatest(1, rest)) + 1)) * (255.0::DOUBLE / 16), 0)) AS value FROM dense),
    side AS (SELECT photo_id, x, y, gray, floor(x / 4.0::DOUBLE - 0.5)::INT AS ix, floor(y / 4.0::DOUBLE - 0.5)::INT AS iy, x / 4.0::DOUBLE - 0.5 AS fx, y / 4.0::DOUBLE - 0.5 AS fy FROM lab)
    SELECT s.photo_id, s.x, s.y, round_even(round(sum(value * (CASE WHEN a = 1 THEN fx - ix ELSE 1 - (fx - ix) END) * (CASE WHEN b = 1 THEN fy - iy ELSE 1 - (fy - iy) END)), 6), 0)::INTEGER AS gray FROM side s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), lut
    WHERE lut.photo_id = s.photo_id AND lut.level = s.gray AND lut.tx = greatest(0, least(1, ix + a)) AND lut.ty = greatest(0, least(1, iy + b)) GROUP BY s.photo_id, s.x, s.y"""
)
def local_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey of painted photos with its contrast evened out by tiles."""
    px = painted(spark, sf_dir)
    gray = px.select("photo_id", "x", "y", scoring.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))
    return filters.tiled_contrast(gray, sizes_of(px))


_DOMINANT = """{0}_h AS (SELECT photo_id, a // 4 AS i, b // 4 AS j, count(*) AS n FROM {1} GROUP BY ALL), {0}_k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]) AS w),
    {0}_near AS (SELECT DISTINCT photo_id, i + k.d AS i, j + m.d AS j FROM {0}_h, {0}_k k, {0}_k m WHERE i + k.d BETWEEN 0 AND 63 AND j + m.d BETWEEN 0 AND 63),
    {0}_s AS (SELECT t.photo_id, t.i, t.j, sum(h.n * k.w * m.w) AS n FROM {0}_near t, {0}_k k, {0}_k m, {0}_h h WHERE h.photo_id = t.photo_id AND h.i = CASE WHEN t.i + k.d > 63 THEN 126 - t.i - k.d ELSE abs(t.i + k.d) END AND h.j = CASE WHEN t.j + m.d > 63 THEN 126 - t.j - m.d ELSE abs(t.j + m.d) END GROUP BY ALL),
    {0}_top AS (SELECT photo_id, i * 4 + 2 AS ca, j * 4 + 2 AS cb FROM {0}_s QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY n DESC, i, j) = 1),
    {0} AS (SELECT photo_id, coalesce(avg(p.a) FILTER (WHERE abs(p.a - ca) <= 6 AND abs(p.b - cb) <= 6), any_value(ca)) AS a, coalesce(avg(p.b) FILTER (WHERE abs(p.a - ca) <= 6 AND abs(p.b - cb) <= 6), any_value(cb)) AS b FROM {1} p JOIN {0}_top USING (photo_id) GROUP BY photo_id)"""
_MODEL = _PAINTED + f""", rim AS (SELECT * FROM lab WHERE x < 2 OR y < 2 OR x >= 6 OR y >= 6), {_DOMINANT.format("main", "lab")}, {_DOMINANT.format("side", "rim")},
    model AS (SELECT photo_id, main.a AS a1, main.b AS b1, CASE WHEN sqrt(pow(side.a - main.a, 2) + pow(side.b - main.b, 2)) > 6 THEN side.a END AS a2, side.b AS b2 FROM main JOIN side USING (photo_id)),
    light AS (SELECT photo_id, coalesce(median(l::DOUBLE) FILTER (WHERE sqrt(pow(a - a1, 2) + pow(b - b1, 2)) < 6), median(l::DOUBLE)) AS lightness FROM lab JOIN model USING (photo_id) GROUP BY photo_id),
    judged AS (SELECT photo_id, x, y, gray, r, g, blue, l, lightness, a1, b1, a2, b2, least(sqrt(pow(a - a1, 2) + pow(b - b1, 2)), coalesce(sqrt(pow(a - a2, 2) + pow(b - b2, 2)), 1e9)) AS distance FROM lab JOIN model USING (photo_id) JOIN light USING (photo_id)),
    raw_px AS (SELECT *, distance > 11 OR (CASE WHEN lightness < 110 THEN l > least(255, lightness + 92) ELSE l < 70 END) AS fore, CASE WHEN lightness < 110 THEN l > lightness + 60 ELSE l < 70 END AS dark FROM judged)"""


@query(_MODEL + """ SELECT photo_id, 1 + (any_value(a2) IS NOT NULL)::INTEGER AS n_colors, round(any_value(a1), 6) AS a, round(any_value(b1), 6) AS b, any_value(lightness) AS lightness, count_if(fore) AS n_foreground, count_if(dark) AS n_dark, round(sum(distance), 6) AS total FROM raw_px GROUP BY photo_id""")
def background_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = painted(spark, sf_dir)
    lab = in_lab(px)
    model = background.estimate(lab, sizes_of(px))
    counts = background.raw_foreground(lab, model).groupBy("photo_id").agg(F.count_if("foreground").alias("n_foreground"), F.count_if("dark").alias("n_dark"), F.round(F.sum("distance"), 6).alias("total"))
    first = F.col("colors")[0]
    return model.join(counts, "photo_id").select("photo_id", F.size("colors").alias("n_colors"), F.round(first["a"], 6).alias("a"), F.round(first["b"], 6).alias("b"), "lightness", "n_foreground", "n_dark", "total")


# Outlines from squares of four centres; hulls from the widest chord over each row; the Laplacian by looking at the four neighbours.
_REGIONS = _MODEL + f""", fore AS (SELECT photo_id, x, y FROM raw_px WHERE fore), {_fill("solid", "fore")}, {_parts("own", "solid")},
    squares AS (SELECT photo_id, label, x - dx AS sx, y - dy AS sy, sum(bit) AS state, count(*) AS n FROM own, (SELECT unnest([0, 1, 0, 1]) AS dx, unnest([0, 0, 1, 1]) AS dy, unnest([1, 2, 4, 8]) AS bit) GROUP BY ALL),
    shape AS (SELECT photo_id, label, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS area, count_if(n = 2 AND state NOT IN (6, 9)) + (count_if(n = 3) + 2 * count_if(state IN (6, 9))) * sqrt(2) AS perimeter FROM squares GROUP BY photo_id, label HAVING area >= 4),
    box AS (SELECT photo_id, label, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM own SEMI JOIN shape USING (photo_id, label) GROUP BY ALL),
    line AS (SELECT photo_id, label, y, min(x) AS low, max(x) AS high FROM own GROUP BY ALL),
    chord AS (SELECT t.photo_id, t.label, t.y, min(a.low + (b.low - a.low) * coalesce((t.y - a.y) / nullif(b.y - a.y, 0)::DOUBLE, 0)) AS low, max(a.high + (b.high - a.high) * coalesce((t.y - a.y) / nullif(b.y - a.y, 0)::DOUBLE, 0)) AS high
        FROM line t JOIN line a ON a.photo_id = t.photo_id AND a.label = t.label AND a.y <= t.y JOIN line b ON b.photo_id = t.photo_id AND b.label = t.label AND b.y >= t.y GROUP BY ALL),
    hull AS (SELECT p.photo_id, p.label, sum((p.high - p.low + q.high - q.low) / 2) AS hull_area FROM chord p JOIN chord q ON q.photo_id = p.photo_id AND q.label = p.label AND q.y = p.y + 1 GROUP BY ALL),
    inside AS (SELECT o.label, x1, y1, x2, y2, p.* FROM own o JOIN box USING (photo_id, label) JOIN raw_px p USING (photo_id, x, y)),
    around AS (SELECT i.photo_id, i.label, i.x, i.y, any_value(i.gray) AS gray, sum(n.gray) AS near FROM inside i, (SELECT unnest([-1, 1, 0, 0]) AS dx, unnest([0, 0, -1, 1]) AS dy) d, raw_px n WHERE n.photo_id = i.photo_id
        AND n.x = CASE WHEN x1 = x2 THEN i.x WHEN i.x + dx < x1 THEN x1 + 1 WHEN i.x + dx > x2 THEN x2 - 1 ELSE i.x + dx END AND n.y = CASE WHEN y1 = y2 THEN i.y WHEN i.y + dy < y1 THEN y1 + 1 WHEN i.y + dy > y2 THEN y2 - 1 ELSE i.y + dy END GROUP BY i.photo_id, i.label, i.x, i.y),
    grain AS (SELECT photo_id, label, stddev_pop(near - 4 * gray) AS texture FROM around GROUP BY ALL),
    hues AS (SELECT photo_id, label, greatest(r, g, blue) AS top, greatest(r, g, blue) - least(r, g, blue) AS c, r, g, blue FROM inside),
    tones AS (SELECT photo_id, label, CASE WHEN c = 0 THEN 0 WHEN top = r THEN ((60.0::DOUBLE * (g - blue) / c) + 360) % 360 WHEN top = g THEN 60.0::DOUBLE * (blue - r) / c + 120 ELSE 60.0::DOUBLE * (r - g) / c + 240 END / 2 AS hue FROM hues WHERE top > 0 AND 255.0::DOUBLE * c / top >= 60),
    bins AS (SELECT photo_id, label, floor(hue / 15) AS bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY photo_id, label) AS total FROM tones GROUP BY photo_id, label, bin), variety AS (SELECT photo_id, label, CASE WHEN any_value(total) < 20 THEN 0 ELSE count_if(n > greatest(5, total * 0.02)) / 12 END AS hue_diversity FROM bins GROUP BY ALL),
    looks AS (SELECT photo_id, label, count_if(fore) / count(*) AS foreground_ratio, count_if(dark) / count(*) AS dark_ratio, sqrt(var_pop(r - g) + var_pop((r + g) / 2 - blue)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg((r + g) / 2 - blue), 2)) AS colorfulness FROM inside GROUP BY ALL),
    contact AS (SELECT photo_id, label, (count(DISTINCT x) FILTER (WHERE y < 2) + count(DISTINCT x) FILTER (WHERE y >= 6) + count(DISTINCT y) FILTER (WHERE x < 2) + count(DISTINCT y) FILTER (WHERE x >= 6)) / greatest(any_value(x2 - x1), any_value(y2 - y1)) + 0 AS raw_contact, count(DISTINCT x) FILTER (WHERE y < 2) + count(DISTINCT x) FILTER (WHERE y >= 6) + count(DISTINCT y) FILTER (WHERE x < 2) + count(DISTINCT y) FILTER (WHERE x >= 6) AS n FROM inside GROUP BY ALL)
    SELECT photo_id, label, x1 AS x, y1 AS y, x2 - x1 + 1 AS width, y2 - y1 + 1 AS height, area, round(area / CASE WHEN coalesce(hull_area, 0) = 0 THEN 1 ELSE hull_area END, 6) AS solidity, round(area / ((x2 - x1 + 1) * (y2 - y1 + 1)), 6) AS extent, round(perimeter * perimeter / (4 * pi() * greatest(area, 1)), 6) AS complexity,
        round(foreground_ratio, 6) AS foreground_ratio, round(dark_ratio, 6) AS dark_ratio, round(colorfulness, 6) AS colorfulness, round(texture, 6) AS texture, round(coalesce(hue_diversity, 0), 6) AS hue_diversity, least(x1, y1, 7 - x2, 7 - y2)::DOUBLE AS border_distance, round(n / greatest(x2 - x1 + 1, y2 - y1 + 1), 6) AS border_contact
    FROM shape JOIN box USING (photo_id, label) LEFT JOIN hull USING (photo_id, label) JOIN grain USING (photo_id, label) LEFT JOIN variety USING (photo_id, label) JOIN looks USING (photo_id, label) JOIN contact USING (photo_id, label)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = painted(spark, sf_dir)
    lab, sizes = in_lab(px), sizes_of(px)
    judged = background.raw_foreground(lab, background.estimate(lab, sizes))
    raw = judged.where("foreground")
    with_gray = px.withColumn("gray", scoring.gray(F.col("r"), F.col("g"), F.col("b")))
    return regions.candidates(regions.runs_of(raw), sizes, with_gray, raw, judged.where("dark"), least=4.0)


@query(_REGIONS)
def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A painted photo is small, so regions of four square pixels count."""
    rows = _candidates(spark, sf_dir)
    plain = ("area", "border_distance")
    rounded = ("solidity", "extent", "complexity", "foreground_ratio", "dark_ratio", "colorfulness", "texture", "hue_diversity", "border_contact")
    # The SQL numbers runs by 8 pixels a row.
    number = (F.floor(F.col("label") / regions.WIDEST) * SIDE + F.col("label") % regions.WIDEST).alias("label")
    return rows.select("photo_id", number, "box.*", *(f"features.{n}" for n in plain), *(F.round(f"features.{n}", 6).alias(n) for n in rounded))


@query()
def detected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of painted photos with confidence and the reason for which they are rejected, from what was measured on them."""
    rows = detect.scored(_candidates(spark, sf_dir))
    return rows.select("photo_id", "label", "box.*", F.round("confidence", 6).alias("confidence"), "rejected_reason")


_D2 = "pow(p.l - c.l, 2) + pow(p.a - c.a, 2) + pow(p.b - c.b, 2)"
_DRAW = "(('0x' || md5(concat_ws(':', {turn}, attempt, p.l, p.a, p.b))[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656"
_MEAN = ", ".join(f"{c} := list_sum(list_transform(list_filter(pts, lambda p, i: near[i] = j), lambda p: p.{c} * p.n)) / list_sum(list_transform(list_filter(pts, lambda p, i: near[i] = j), lambda p: p.n))" for c in "lab")
_CUBE = "CASE WHEN {f} > 6.0::DOUBLE / 29 THEN {f} * {f} * {f} ELSE ({f} - 16.0::DOUBLE / 116) / 7.787::DOUBLE END"
_BACK = "lpad(lower(hex(least(255, greatest(0, round_even((CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92::DOUBLE ELSE pow(greatest({v}, 0), 1.0::DOUBLE / 2.4::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END) * 255, 0)))::INTEGER)), 2, '0')"
_RGB = [f"(cx * {row[0] * scoring.WHITE[0]!r}::DOUBLE + cy * {row[1]!r}::DOUBLE + cz * {row[2] * scoring.WHITE[2]!r}::DOUBLE)" for row in scoring.RGB]
# k-means++ and Lloyd's iterations on lists: three attempts for each photo, each until it rests.
_CLUSTERED = _MASK + f""", seen AS (SELECT photo_id, x, y, l, a, b, m.photo_id IS NOT NULL AS object, sqrt(pow((l - el) * 0.25, 2) + pow(a - ea, 2) + pow(b - eb, 2)) < 12 AS felt FROM lab JOIN flood_edge USING (photo_id) LEFT JOIN mask m USING (photo_id, x, y)),
    enough AS (SELECT photo_id, count_if(object AND NOT felt) AS n, count_if(object) AS whole FROM seen GROUP BY photo_id), taken AS (SELECT photo_id, l::DOUBLE AS l, a::DOUBLE AS a, b::DOUBLE AS b FROM seen JOIN enough USING (photo_id) WHERE CASE WHEN n >= 50 THEN object AND NOT felt WHEN whole >= 50 THEN object ELSE true END),
    points AS (SELECT photo_id, l, a, b, count(*) AS n FROM taken GROUP BY ALL),
    keyed AS (SELECT photo_id, list(struct_pack(l := l, a := a, b := b, n := n) ORDER BY l, a, b) AS pts, least(6, greatest(1, sum(n) // 20)) AS k FROM points GROUP BY photo_id), tried AS (SELECT * FROM keyed, (SELECT unnest([0, 1, 2]) AS attempt)),
    chosen AS (SELECT photo_id, attempt, 1 AS turn, [list_sort(list_transform(pts, lambda p: struct_pack(w := -ln({_DRAW.format(turn=0).replace("p.l, p.a, p.b", "p.l::INT, p.a::INT, p.b::INT")}) / p.n, l := p.l, a := p.a, b := p.b)))[1]] AS centres FROM tried UNION ALL
        SELECT photo_id, attempt, turn + 1, list_concat(centres, list_sort(list_transform(list_filter(pts, lambda p: list_min(list_transform(centres, lambda c: {_D2})) > 0),
            lambda p: struct_pack(w := -ln({_DRAW.format(turn="turn").replace("p.l, p.a, p.b", "p.l::INT, p.a::INT, p.b::INT")}) / (p.n * list_min(list_transform(centres, lambda c: {_D2}))), l := p.l, a := p.a, b := p.b)))[1:1]) FROM chosen JOIN tried USING (photo_id, attempt) WHERE turn < k),
    started AS (SELECT photo_id, attempt, list_transform(arg_max(centres, turn), lambda c: struct_pack(l := c.l, a := c.a, b := c.b)) AS centres FROM chosen GROUP BY photo_id, attempt),
    lloyd AS (SELECT photo_id, attempt, 0 AS round, centres, false AS rests FROM started UNION ALL
        SELECT photo_id, attempt, round + 1, moved, coalesce(list_max(list_transform(moved, lambda q, i: pow(q.l - centres[i].l, 2) + pow(q.a - centres[i].a, 2) + pow(q.b - centres[i].b, 2))), 0) <= 1 FROM
        (SELECT *, list_transform(range(1, len(centres) + 1), lambda j: CASE WHEN list_contains(near, j) THEN struct_pack({_MEAN}) ELSE centres[j] END) AS moved FROM
        (SELECT y.*, t.pts, list_transform(t.pts, lambda p: list_position(list_transform(y.centres, lambda c: {_D2}), list_min(list_transform(y.centres, lambda c: {_D2})))) AS near FROM lloyd y JOIN tried t USING (photo_id, attempt) WHERE NOT rests AND round < 30))),
    rested AS (SELECT photo_id, attempt, arg_max(centres, round) AS centres FROM lloyd GROUP BY photo_id, attempt),
    placed AS (SELECT photo_id, attempt, centres, p.n AS n, list_min(list_transform(centres, lambda c: {_D2})) AS d, list_position(list_transform(centres, lambda c: {_D2}), list_min(list_transform(centres, lambda c: {_D2}))) AS j FROM (SELECT r.*, unnest(t.pts) AS p FROM rested r JOIN tried t USING (photo_id, attempt))),
    best AS (SELECT photo_id, arg_min(attempt, (round_even(spread, 6), attempt)) AS attempt FROM (SELECT photo_id, attempt, sum(n * d) AS spread FROM placed GROUP BY photo_id, attempt) GROUP BY photo_id),
    sharing AS (SELECT photo_id AS id, any_value(centres[j].l) AS l, any_value(centres[j].a) AS ca, any_value(centres[j].b) AS cb, sum(n) / any_value(total) AS share FROM placed JOIN best USING (photo_id, attempt) JOIN (SELECT photo_id, sum(n) AS total FROM points GROUP BY photo_id) USING (photo_id) GROUP BY photo_id, j),
    bits AS (SELECT *, (floor(l) / 2.55::DOUBLE + 16) / 116.0::DOUBLE AS fy, (floor(l) / 2.55::DOUBLE + 16) / 116.0::DOUBLE + (floor(ca) - 128) / 500.0::DOUBLE AS fx, (floor(l) / 2.55::DOUBLE + 16) / 116.0::DOUBLE - (floor(cb) - 128) / 200.0::DOUBLE AS fz FROM sharing),
    cubes AS (SELECT *, {_CUBE.format(f="fx")} AS cx, {_CUBE.format(f="fy")} AS cy, {_CUBE.format(f="fz")} AS cz FROM bits),
    mixed AS (SELECT id, share, '#' || {_BACK.format(v=_RGB[0])} || {_BACK.format(v=_RGB[1])} || {_BACK.format(v=_RGB[2])} AS hex, l * 100 / 255 AS l, ca - 128 AS a, cb - 128 AS b FROM cubes),
    polar AS (SELECT *, {_POLAR} FROM mixed), named AS (SELECT *, {_PLAIN} AS plain FROM polar), called AS (SELECT id, share, hex, {_NAME} AS name FROM named),
    summed AS (SELECT id, name, sum(share) AS total, arg_max(hex, (share, hex)) AS hex, max(share) AS most FROM called GROUP BY id, name HAVING sum(share) >= 0.05)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round_even(total, 3) DESC, most DESC, name) - 1 AS INTEGER) AS position, name, hex, round_even(total, 3) AS share FROM summed"""


@query(_CLUSTERED)
def object_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main colours of each painted photo's object."""
    px = painted(spark, sf_dir)
    lab, sizes = in_lab(px), sizes_of(px)
    found = clusters.dominant_colors(regions.object_pixels(lab, sizes, regions.foreground(in_lab(filters.bilateral(px, sizes)), sizes)))
    return found.select("id", F.posexplode("colors").alias("position", "c")).select("id", "position", "c.name", "c.hex", "c.share")


@query(_PAINTED + """, cells AS (SELECT photo_id, i, j, r, g, b, (least(x + 1, (i + 1) * 1.6::DOUBLE) - greatest(x, i * 1.6::DOUBLE)) / 1.6::DOUBLE * ((least(y + 1, (j + 1) * 1.6::DOUBLE) - greatest(y, j * 1.6::DOUBLE)) / 1.6::DOUBLE) AS share
        FROM px, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j) WHERE least(x + 1, (i + 1) * 1.6::DOUBLE) - greatest(x, i * 1.6::DOUBLE) > 1e-9 AND least(y + 1, (j + 1) * 1.6::DOUBLE) - greatest(y, j * 1.6::DOUBLE) > 1e-9)
    SELECT photo_id, i AS x, j AS y, round_even(round(sum(r * share), 9), 0)::INTEGER AS r, round_even(round(sum(g * share), 9), 0)::INTEGER AS g, round_even(round(sum(b * share), 9), 0)::INTEGER AS b FROM cells GROUP BY photo_id, i, j""")  # fmt: skip
def resized_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted photos with a longest side of five pixels."""
    px = painted(spark, sf_dir)
    return pixels.resized(px, pixels.shrunk_sizes(sizes_of(px), 5))


_FACTOR = "(CASE WHEN {f} = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END * cos((2 * {p} + 1) * {f} * pi() / 64))"


@query(
    _MASK + f""", area AS (SELECT photo_id, count(*) AS n FROM mask GROUP BY photo_id), shown AS (SELECT p.photo_id, p.x, p.y, p.r, p.g, p.b, l.gray, coalesce(n, 0) < 3.2 OR m.photo_id IS NOT NULL AS inside FROM px p JOIN lab l USING (photo_id, x, y) LEFT JOIN area USING (photo_id) LEFT JOIN mask m USING (photo_id, x, y)),
    levels AS (SELECT photo_id, gray, count(*) AS n FROM shown GROUP BY ALL), spread2 AS (SELECT photo_id, gray, sum(n) OVER (PARTITION BY photo_id ORDER BY gray) AS up, first_value(n) OVER (PARTITION BY photo_id ORDER BY gray) AS low FROM levels),
    even AS (SELECT photo_id, gray, CASE WHEN low = 64 THEN gray ELSE round_even((up - low) * (255.0::DOUBLE / (64 - low)), 0)::INTEGER END AS level FROM spread2), own AS (SELECT * FROM shown JOIN even USING (photo_id, gray) WHERE inside),
    square AS (SELECT photo_id, min(x) AS x1, min(y) AS y1, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS side FROM own GROUP BY photo_id),
    put AS (SELECT photo_id, x - x1 + (side - w) // 2 AS x, y - y1 + (side - h) // 2 AS y, level - 128 AS v, side / 32.0::DOUBLE AS cell FROM own JOIN square USING (photo_id)),
    cells AS (SELECT photo_id, i, j, round_even(round(sum(v * ((least(x + 1, (i + 1) * cell) - greatest(x, i * cell)) / cell) * ((least(y + 1, (j + 1) * cell) - greatest(y, j * cell)) / cell)), 9), 0) AS v FROM put, (SELECT unnest(range(0, 32)) AS i), (SELECT unnest(range(0, 32)) AS j)
        WHERE least(x + 1, (i + 1) * cell) - greatest(x, i * cell) > 1e-9 AND least(y + 1, (j + 1) * cell) - greatest(y, j * cell) > 1e-9 GROUP BY photo_id, i, j),
    across AS (SELECT photo_id, j, u, sum(v * {_FACTOR.format(f="u", p="i")}) AS s FROM cells, (SELECT unnest(range(0, 8)) AS u) GROUP BY photo_id, j, u),
    waves AS (SELECT photo_id, u, w, round(sum(s * {_FACTOR.format(f="w", p="j")}) + CASE WHEN u = 0 AND w = 0 THEN 4096 ELSE 0 END, 6) AS c FROM across, (SELECT unnest(range(0, 8)) AS w) GROUP BY photo_id, u, w),
    middle AS (SELECT photo_id, list_sort(list(c))[32] AS m FROM waves WHERE u + w > 0 GROUP BY photo_id), bits AS (SELECT photo_id, string_agg(CASE WHEN c > m THEN '1' ELSE '0' END, '' ORDER BY w, u) AS bits FROM waves JOIN middle USING (photo_id) GROUP BY photo_id),
    tint AS (SELECT photo_id, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS c, r, g, b FROM own), tone AS (SELECT photo_id, CASE WHEN c = 0 THEN 0 WHEN v = r THEN ((60.0::DOUBLE * (g - b) / c) + 360) % 360 WHEN v = g THEN 60.0::DOUBLE * (b - r) / c + 120 ELSE 60.0::DOUBLE * (r - g) / c + 240 END / 2 AS hue, CASE WHEN v = 0 THEN 0 ELSE 255.0::DOUBLE * c / v END AS s, v FROM tint),
    bins AS (SELECT photo_id, least(7, floor(hue / 22.5))::INTEGER * 16 + least(3, floor(s / 64))::INTEGER * 4 + floor(v / 64)::INTEGER AS place, count(*) AS n, sum(count(*)) OVER (PARTITION BY photo_id) AS total FROM tone GROUP BY photo_id, place)
    SELECT photo_id AS id, any_value(bits) AS bits, string_agg(place || ':' || round_even(n / total * 100000, 0)::BIGINT, ',' ORDER BY place) AS colors FROM bins JOIN bits USING (photo_id) GROUP BY photo_id"""
)
def object_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each painted photo's object: the hash bit by bit, and the bins that have some of its colours in 100,000ths."""
    rows = fingerprints.fingerprints(painted(spark, sf_dir))
    bits = F.concat(*(F.lpad(F.conv(F.col(half).cast("string"), 10, 2), 32, "0") for half in ("hi", "lo")))
    each = F.transform("histogram", lambda v, i: F.when(v > 0, F.concat(i.cast("string"), F.lit(":"), F.rint(v * 100000).cast("long").cast("string"))))
    return rows.select("id", bits.alias("bits"), F.array_join(F.array_compact(each), ",").alias("colors"))

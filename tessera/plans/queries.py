"""Named queries on the catalogue views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import likeness, scoring
from ..functions import text as t
from ..functions.numbering import numbered
from ..operators import catalog, detect, lookalikes, pixels, review
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str, recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = v.with_views(sql, *names, recursive=recursive) if names else sql
        return f

    return add


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.master(v.items(spark, sf_dir), v.photos(spark, sf_dir), v.boxes(spark, sf_dir))


_MASTER = """, master AS (SELECT i.*, p.filename AS source_filename, p.page_label AS source_page, b.x, b.y, b.w, b.h
    FROM items i JOIN photos p ON p.id = i.photo_id JOIN boxes b ON b.id = i.box_id) """
_BASE = ("boxes", "items", "photos")
_FOUND = """(lower(item_code) LIKE '%{q}%' OR lower(title) LIKE '%{q}%' OR lower(description) LIKE '%{q}%' OR lower(notes) LIKE '%{q}%' OR lower(subcategory) LIKE '%{q}%'
    OR coalesce(lower(category) LIKE '%{q}%', false) OR lower(source_filename) LIKE '%{q}%' OR len(list_filter(tags, lambda g: lower(g) LIKE '%{q}%')) > 0)"""


@query(_MASTER + f"SELECT item_code, title, category, source_filename, quantity, x, y, array_to_string(tags, ',') AS tags FROM master WHERE status = 'approved' AND {_FOUND.format(q='ring')}", *_BASE)
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.search(_master(spark, sf_dir), catalog.ItemFilter(q=" Ring "))
    return rows.select("item_code", "title", "category", "source_filename", "quantity", F.col("source_box.x").alias("x"), F.col("source_box.y").alias("y"), F.array_join("tags", ",").alias("tags"))


@query(
    _MASTER + """SELECT item_code, category, status, photo_id FROM master WHERE status = 'rejected' AND list_contains(tags, 'cold') AND list_contains(colors, 'cold')
    UNION ALL SELECT item_code, category, status, photo_id FROM master WHERE lower(category) = 'brand#17'""",
    *_BASE,
)
def catalog_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _master(spark, sf_dir)
    by_tag = catalog.search(rows, catalog.ItemFilter(status="rejected", tag="COLD", color="Cold"), ordered=False)
    by_category = catalog.search(rows, catalog.ItemFilter(status="all", category="bRAND#17"), ordered=False)
    return by_tag.unionByName(by_category).select("item_code", "category", "status", "photo_id")


@query(
    _MASTER + """SELECT item_code, title FROM master WHERE (lower(item_code || ' ' || title || ' ' || description || ' ' || coalesce(category, '') || ' ' || subcategory || ' ' || array_to_string(tags, ' ') || ' ' || coalesce(source_page, source_filename, ''))) LIKE '%in%'
    AND (lower(item_code || ' ' || title || ' ' || description || ' ' || coalesce(category, '') || ' ' || subcategory || ' ' || array_to_string(tags, ' ') || ' ' || coalesce(source_page, source_filename, ''))) LIKE '%page%'""",
    *_BASE,
)
def search_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_words(_master(spark, sf_dir), "IN  page").select("item_code", "title")


@query(
    """SELECT (SELECT count(*) FROM photos) AS source_photos, (SELECT max(imported_at) FROM photos) AS last_import, (SELECT count(*) FROM photos WHERE status = 'error') AS errors,
    (SELECT count(*) FROM boxes WHERE status = 'pending') AS pending, (SELECT count(*) FROM boxes WHERE status = 'approved') AS approved, (SELECT count(*) FROM boxes WHERE status = 'rejected') AS rejected,
    (SELECT count(*) FROM items WHERE status = 'approved') AS catalog_items, (SELECT CAST(coalesce(sum(quantity), 0) AS BIGINT) FROM items WHERE status = 'approved') AS total_quantity""",
    *_BASE,
)
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dashboard(v.photos(spark, sf_dir), v.boxes(spark, sf_dir), v.items(spark, sf_dir))


_COUNTS = """SELECT p.id, p.filename, coalesce(count_if(b.status = 'pending'), 0) AS pending_count, coalesce(count_if(b.status = 'approved'), 0) AS approved_count,
    coalesce(count_if(b.status = 'rejected'), 0) AS rejected_count, coalesce(count_if(b.status NOT IN ('merged', 'split')), 0) AS detection_count
    FROM photos p LEFT JOIN boxes b ON b.photo_id = p.id GROUP BY p.id, p.filename"""


@query(_COUNTS, "boxes", "photos")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.photo_counts(v.photos(spark, sf_dir), v.boxes(spark, sf_dir))


@query(f", counts AS ({_COUNTS}) SELECT coalesce(min(CASE WHEN pending_count > 0 THEN id END), min(id)) AS next_id FROM counts", "boxes", "photos")
def next_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.next_photo(source_counts(spark, sf_dir))


@query("SELECT id, lag(id) OVER (ORDER BY id) AS previous_id, lead(id) OVER (ORDER BY id) AS next_id FROM photos", "photos")
def photo_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.neighbours(v.photos(spark, sf_dir))


@query(
    """SELECT DISTINCT 'category' AS kind, category AS value FROM items WHERE category IS NOT NULL UNION SELECT DISTINCT 'tag', unnest(tags) FROM items
    UNION SELECT DISTINCT 'color', unnest(colors) FROM items WHERE status = 'approved'""",
    "boxes", "items",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facets(v.items(spark, sf_dir))


@query(
    _MASTER + """SELECT item_code AS pin_code, title, description, coalesce(category, '') AS category, subcategory, array_to_string(list_distinct(colors), ', ') AS colors_, array_to_string(tags, ', ') AS tags,
    quantity, CASE WHEN selling_price IS NULL THEN '' ELSE printf('%.2f', selling_price) END AS price, '' AS purchase_price, notes, source_filename, coalesce(source_page, '') AS source_page, '' AS crop_path,
    '' AS transparent_path, CASE WHEN width_px = 0 THEN '' ELSE CAST(width_px AS VARCHAR) END AS width_px, '' AS height_px, created_at, status FROM master WHERE status = 'approved'""".replace(
        "array_to_string(list_distinct(colors), ', ') AS colors_", "CASE WHEN len(colors) > 1 AND colors[1] <> colors[2] THEN colors[1] || ', ' || colors[2] ELSE colors[1] END AS colors"
    ),
    *_BASE,
)
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.flat_record(_master(spark, sf_dir).where("status = 'approved'"))


@query(
    _MASTER + """SELECT item_code, item_code AS code, coalesce(source_page, source_filename) AS page, '2024-05-01' AS added, quantity, selling_price AS price, selling_price IS NOT NULL AS has_price, false AS has_notes, len(tags) AS n_tags
    FROM master WHERE status = 'approved'""",
    *_BASE,
)
def export_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.public_record(_master(spark, sf_dir).where("status = 'approved'"))
    j = F.from_json("record", "code string, page string, added string, quantity int, price double, notes string, tags array<string>")
    has = lambda key: F.array_contains(F.json_object_keys("record"), key)
    rows = rows.withColumn("j", j)
    return rows.select("item_code", "j.code", "j.page", "j.added", "j.quantity", "j.price", has("price").alias("has_price"), has("notes").alias("has_notes"), F.size("j.tags").cast("long").alias("n_tags"))


@query(
    """SELECT item_code, h % 6 AS card_class, (CAST(floor((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) / 8.0) AS BIGINT) % 7 - 3) * 0.5 AS tilt
    FROM (SELECT item_code, CAST(list_sum(list_transform(range(1, 11), lambda i: ascii(item_code[i]) * CAST(pow(31, 10 - i) AS HUGEINT))) % 4294967296 AS BIGINT) AS h FROM items)""",
    "boxes", "items",
)
def card_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    style, tilt = t.card_style(F.col("item_code"))
    return v.items(spark, sf_dir).select("item_code", style.alias("card_class"), tilt.alias("tilt"))


@query("SELECT id, row_number() OVER (ORDER BY id) + 41 AS number, printf('PIN-%06d', row_number() OVER (ORDER BY id) + 41) AS item_code FROM boxes", "boxes")
def item_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(v.boxes(spark, sf_dir).select("id"), ["id"], start=42)
    return rows.select("id", "number", t.item_code(F.col("number")).alias("item_code"))


_PAIR = """, pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh FROM boxes a JOIN boxes b ON a.photo_id = b.photo_id AND a.id < b.id),
    m AS (SELECT *, CAST(greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) AS BIGINT) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS joint FROM pairs) """


@query(
    _PAIR + """SELECT id_a, id_b, joint AS intersection, joint / (aw * ah + bw * bh - joint) AS iou, joint / least(aw * ah, bw * bh) AS containment, least(ax, bx) AS ux, greatest(ax + aw, bx + bw) - least(ax, bx) AS uw,
    greatest(aw, ah) / least(aw, ah) AS aspect, CAST(round_even(ax * 0.5, 0) AS INTEGER) AS half_x, CAST(round_even((ax + aw) * 0.5 - ax * 0.5, 0) AS INTEGER) AS half_w,
    least(ax + aw, 500) - least(ax, 500) AS clipped_w, (ax <= 4 OR ay <= 4 OR ax + aw >= 1016 OR ay + ah >= 836) AS at_border FROM m""",
    "boxes",
)
def box_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.boxes(spark, sf_dir).select("id", "photo_id", "box")
    a, c = b.alias("a"), b.alias("b")
    rows = a.join(c, (F.col("a.photo_id") == F.col("b.photo_id")) & (F.col("a.id") < F.col("b.id")))
    x, y = F.col("a.box"), F.col("b.box")
    half = g.scale(x, 0.5)
    return rows.select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), g.intersection(x, y).cast("long").alias("intersection"), g.iou(x, y).alias("iou"), g.containment(x, y).alias("containment"),
        g.union(x, y)["x"].alias("ux"), g.union(x, y)["width"].alias("uw"), g.aspect_ratio(x).alias("aspect"), half["x"].alias("half_x"), half["width"].alias("half_w"),
        g.clip(x, 500, 10_000)["width"].alias("clipped_w"), g.touches_border(x, 1020, 840, 4).alias("at_border"),
    )


@query(
    """, typical AS (SELECT photo_id, CASE WHEN count(*) >= 3 THEN median(CAST(w * h AS DOUBLE)) END AS typical FROM boxes WHERE status IN ('pending', 'approved') GROUP BY photo_id)
    SELECT id, array_to_string(list_filter([CASE WHEN x <= 3 OR y <= 3 OR x + w >= 1017 OR y + h >= 837 THEN 'touches_border' END, CASE WHEN typical > 0 AND w * h < typical / 2.5 THEN 'small' WHEN typical > 0 AND w * h > typical * 2.5 THEN 'large' END,
    CASE WHEN greatest(w, h) / least(w, h) > 2.5 THEN 'extreme_aspect' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END], lambda f: f IS NOT NULL), ',') AS flags FROM boxes LEFT JOIN typical USING (photo_id)""",
    "boxes",
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.boxes(spark, sf_dir)
    rows = b.join(catalog.typical_area(b), "photo_id", "left")
    return rows.select("id", F.array_join(scoring.flags(F.col("box"), 1020, 840, F.col("typical"), sure=F.col("confidence")), ",").alias("flags"))


def _features() -> F.Column:
    k = F.col("p_partkey")
    parts = {
        "area_fraction": (k % 250) / 1000.0, "aspect_ratio": 1 + (k % 37) / 10.0, "solidity": 0.3 + (k % 71) / 100.0, "extent": 0.4 + (k % 61) / 100.0, "foreground_ratio": (k % 101) / 100.0,
        "dark_ratio": (k % 31) / 100.0, "colorfulness": (k % 53) * 1.0, "texture": (k % 29) * 1.0, "hue_diversity": (k % 41) / 100.0, "border_distance": (k % 13) * 1.0, "border_contact": (k % 47) / 150.0,
    }
    return F.struct(*(c.alias(n) for n, c in parts.items()))


_FEATURES = """, f AS (SELECT p_partkey AS id, (p_partkey % 250) / 1000.0::DOUBLE AS area_fraction, 1 + (p_partkey % 37) / 10.0::DOUBLE AS aspect_ratio, 0.3::DOUBLE + (p_partkey % 71) / 100.0::DOUBLE AS solidity, 0.4::DOUBLE + (p_partkey % 61) / 100.0::DOUBLE AS extent,
    (p_partkey % 101) / 100.0::DOUBLE AS foreground_ratio, (p_partkey % 31) / 100.0::DOUBLE AS dark_ratio, (p_partkey % 53) * 1.0::DOUBLE AS colorfulness, (p_partkey % 29) * 1.0::DOUBLE AS texture, (p_partkey % 41) / 100.0::DOUBLE AS hue_diversity,
    (p_partkey % 13) * 1.0::DOUBLE AS border_distance, (p_partkey % 47) / 150.0::DOUBLE AS border_contact FROM part),
    r AS (SELECT *, 0.4::DOUBLE * (1 - least(1, greatest(0, (foreground_ratio - 0.175::DOUBLE) / (0.56::DOUBLE - 0.175::DOUBLE)))) + 0.3::DOUBLE * (1 - least(1, greatest(0, (colorfulness - 6) / 24::DOUBLE)))
        + 0.15::DOUBLE * (1 - least(1, greatest(0, (hue_diversity - 0.05::DOUBLE) / 0.25::DOUBLE))) + 0.15::DOUBLE * least(1, greatest(0, (extent - 0.6::DOUBLE) / 0.3::DOUBLE)) AS slot,
        0.35::DOUBLE * least(1, greatest(0, (foreground_ratio - 0.21::DOUBLE) / 0.54::DOUBLE)) + 0.3::DOUBLE * least(1, greatest(0, (colorfulness - 7.2::DOUBLE) / 32.8::DOUBLE)) + 0.2::DOUBLE * least(1, greatest(0, (solidity - 0.35::DOUBLE) / 0.45::DOUBLE))
        + 0.15::DOUBLE * least(1, greatest(0, (texture - 3) / 12::DOUBLE)) AS base FROM f),
    c AS (SELECT *, least(1, greatest(0, base * (1 - greatest(0, slot - 0.4::DOUBLE)))) AS sure FROM r) """


@query(
    "WITH dummy AS (SELECT 1)" + _FEATURES + f"""SELECT id, round(sure, 6) AS confidence, CASE WHEN area_fraction < 0.0015 THEN '{scoring.TOO_SMALL}' WHEN area_fraction > 0.2::DOUBLE THEN '{scoring.TOO_LARGE}' WHEN aspect_ratio > 4 THEN '{scoring.TOO_LONG}'
    WHEN solidity < 0.45::DOUBLE THEN '{scoring.IRREGULAR}' WHEN border_distance <= 1 AND colorfulness < 24 THEN '{scoring.AT_EDGE}' WHEN border_contact > 0.25 THEN '{scoring.ALONG_EDGE}'
    WHEN foreground_ratio < 0.35::DOUBLE AND colorfulness < 24 THEN '{scoring.EMPTY_SLOT}' WHEN colorfulness < 12 AND hue_diversity < 0.1::DOUBLE AND dark_ratio < 0.15::DOUBLE THEN '{scoring.GREY_SLOT}'
    WHEN colorfulness < 12 AND texture < 15 THEN '{scoring.PLAIN_GREY}' WHEN sure < 0.3::DOUBLE THEN '{scoring.UNSURE}' END AS rejected_reason FROM c"""
)
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _features().alias("features"))
    return detect.scored(rows).select("id", F.round("confidence", 6).alias("confidence"), "rejected_reason")


@query(
    """SELECT photo_id AS merge_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, max(confidence)::DOUBLE AS confidence, array_to_string(list_sort(list(id)), ',') AS parents
    FROM boxes WHERE status IN ('pending', 'rejected') GROUP BY photo_id HAVING count(*) >= 2""",
    "boxes",
)
def merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = v.boxes(spark, sf_dir).where(F.col("status").isin("pending", "rejected")).withColumnRenamed("photo_id", "merge_id")
    return review.merge_boxes(chosen).select("merge_id", "box.*", "confidence", F.array_join("parent_ids", ",").alias("parents"))


@query(
    """SELECT id, part, CASE WHEN w >= h THEN x + part * (w // 2) ELSE x END AS x, CASE WHEN w >= h THEN y ELSE y + part * (h // 2) END AS y, CASE WHEN w < h THEN w WHEN part = 0 THEN w // 2 ELSE w - w // 2 END AS width,
    CASE WHEN w >= h THEN h WHEN part = 0 THEN h // 2 ELSE h - h // 2 END AS height FROM boxes, (SELECT unnest([0, 1]) AS part) WHERE status = 'pending'""",
    "boxes",
)
def split_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.split_boxes(v.boxes(spark, sf_dir).where("status = 'pending'")).select("id", "part", "box.*")


_SURVIVES = """NOT EXISTS (SELECT 1 FROM (SELECT k.*, greatest(0, least(n.x + n.w, k.x + k.w) - greatest(n.x, k.x)) * greatest(0, least(n.y + n.h, k.y + k.h) - greatest(n.y, k.y)) AS j FROM boxes k WHERE k.photo_id = n.photo_id AND k.status IN ('approved', 'rejected')) k
    WHERE j / (n.w * n.h + k.w * k.h - j) >= 0.3 OR j / least(n.w * n.h, k.w * k.h) >= 0.7)"""


@query(f"SELECT n.id, n.photo_id FROM boxes n WHERE n.status = 'pending' AND {_SURVIVES}", "boxes")
def redetect_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.boxes(spark, sf_dir)
    return detect.survivors(b.where("status = 'pending'"), b.where(F.col("status").isin("approved", "rejected"))).select("id", "photo_id")


_SAME = "(j / (q.w * q.h + o.w * o.h - j) >= 0.45 OR j / least(q.w * q.h, o.w * o.h) >= 0.85)".replace(
    "j", "(greatest(0, least(q.x + q.w, o.x + o.w) - greatest(q.x, o.x)) * greatest(0, least(q.y + q.h, o.y + o.h) - greatest(q.y, o.y)))"
)


@query(
    f""", o AS (SELECT photo_id, id, x, y, w, h, confidence::DOUBLE AS c, row_number() OVER (PARTITION BY photo_id ORDER BY w * h DESC, id) AS k FROM boxes),
    fold AS (SELECT photo_id, 1::BIGINT AS k, [struct_pack(id := id, x := x, y := y, w := w, h := h, c := c)] AS kept FROM o WHERE k = 1 UNION ALL
        SELECT photo_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(kept, struct_pack(id := id, x := x, y := y, w := w, h := h, c := c)) ELSE list_transform(kept, lambda q, i: CASE WHEN i = hit THEN struct_pack(id := q.id, x := least(q.x, x), y := least(q.y, y),
            w := greatest(q.x + q.w, x + w) - least(q.x, x), h := greatest(q.y + q.h, y + h) - least(q.y, y), c := greatest(q.c, c)) ELSE q END) END
        FROM (SELECT o.*, f.kept, list_position(list_transform(f.kept, lambda q: {_SAME}), true) AS hit FROM fold f JOIN o ON o.photo_id = f.photo_id AND o.k = f.k + 1)),
    last AS (SELECT photo_id, unnest(arg_max(kept, k)) AS b FROM fold GROUP BY photo_id) SELECT photo_id, b.id AS id, b.x AS x, b.y AS y, b.w AS width, b.h AS height, b.c AS confidence FROM last""",
    "boxes", recursive=True,
)
def suppress_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.suppress(v.boxes(spark, sf_dir)).select("photo_id", "id", "box.*", "confidence")


@query(
    """, o AS (SELECT photo_id, id, x, y + h / 2 AS cy, row_number() OVER (PARTITION BY photo_id ORDER BY y + h / 2, id) AS k FROM boxes), typical AS (SELECT photo_id, median(CAST(h AS DOUBLE)) AS t FROM boxes GROUP BY photo_id),
    fold AS (SELECT photo_id, id, x, k, 1 AS row_no, cy AS total, 1 AS n FROM o WHERE k = 1 UNION ALL
        SELECT o.photo_id, o.id, o.x, o.k, CASE WHEN abs(o.cy - f.total / f.n) < t * 0.5 THEN f.row_no ELSE f.row_no + 1 END, CASE WHEN abs(o.cy - f.total / f.n) < t * 0.5 THEN f.total + o.cy ELSE o.cy END,
        CASE WHEN abs(o.cy - f.total / f.n) < t * 0.5 THEN f.n + 1 ELSE 1 END FROM fold f JOIN o ON o.photo_id = f.photo_id AND o.k = f.k + 1 JOIN typical ON typical.photo_id = o.photo_id)
    SELECT photo_id, id, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY row_no, x, k) AS INTEGER) AS position FROM fold""",
    "boxes", recursive=True,
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.reading_order(v.boxes(spark, sf_dir))


@query(
    """WITH c AS (SELECT p_partkey AS id, (p_partkey % 100) * 1.0::DOUBLE AS l, CAST((p_partkey * 7) % 161 AS DOUBLE) - 80 AS a, CAST((p_partkey * 13) % 161 AS DOUBLE) - 80 AS b FROM part),
    h AS (SELECT *, sqrt(a * a + b * b) AS chroma, CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END AS hue FROM c),
    n AS (SELECT *, CASE WHEN hue < 20 THEN 'pink' WHEN hue < 45 THEN 'red' WHEN hue < 85 THEN 'orange' WHEN hue < 112 THEN 'yellow' WHEN hue < 175 THEN 'green' WHEN hue < 215 THEN 'teal' WHEN hue < 310 THEN 'blue' WHEN hue < 340 THEN 'purple' ELSE 'pink' END AS plain FROM h)
    SELECT id, CASE WHEN chroma < 7 THEN CASE WHEN l < 22 THEN 'black' WHEN l < 45 THEN 'dark gray' WHEN l < 80 THEN 'gray' ELSE 'white' END WHEN hue >= 30 AND hue < 90 AND l < 50 THEN 'brown' WHEN hue >= 55 AND hue < 115 AND chroma < 26 AND l >= 68 THEN 'beige'
    WHEN plain = 'red' AND l >= 62 THEN CASE WHEN hue < 36 THEN 'pink' ELSE 'orange' END WHEN plain = 'red' AND l < 35 THEN 'dark red' WHEN plain = 'blue' AND l < 25 THEN 'navy' WHEN plain = 'blue' AND l >= 65 THEN CASE WHEN hue >= 285 THEN 'lavender' ELSE 'light blue' END
    WHEN plain = 'purple' AND l >= 65 THEN 'lavender' WHEN plain = 'green' AND l < 35 THEN 'dark green' ELSE plain END AS name FROM n"""
)
def color_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = scoring.lab_color_name((k % 100) * 1.0, ((k * 7) % 161).cast("double") - 80, ((k * 13) % 161).cast("double") - 80)
    return v.table(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"))


_SCORE = """, pairs AS (SELECT a.id AS id_a, b.id AS id_b, 0.55::DOUBLE * greatest(0, ((1 - (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))) / 64.0::DOUBLE) - 0.5::DOUBLE) * 2)
    + 0.45::DOUBLE * list_sum(list_transform(list_zip(a.histogram, b.histogram), lambda z: least(z[1], z[2]))) AS score FROM prints a JOIN prints b ON {on}) """


@query(_SCORE.format(on="a.id < b.id") + "SELECT id_a, id_b, round_even(score, 3) AS score FROM pairs WHERE score >= 0.55", "prints")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.similar_pairs(v.fingerprints(spark, sf_dir))


@query(
    _SCORE.format(on="a.id % 20 = 0 AND a.id <> b.id") + "SELECT id_a AS id, id_b AS match_id, CAST(row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS INTEGER) AS rank, round_even(score, 3) AS score FROM pairs WHERE score >= 0.4 QUALIFY rank <= 3",
    "prints",
)
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = v.fingerprints(spark, sf_dir)
    return lookalikes.best_matches(prints.where("id % 20 = 0"), prints, threshold=0.4)


@query("SELECT sha256(text) AS sha256, min('doc_' || doc_id) AS name, count(*) - 1 AS duplicates FROM documents GROUP BY sha256(text)")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import photos

    return photos.first_copies(v.files(spark, sf_dir)).select("sha256", "name", "duplicates")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.settle(v.actions(spark, sf_dir), v.reviewed_boxes(spark, sf_dir))


@query(
    """SELECT box_id, coalesce(status, 'pending') AS status, CASE WHEN mark >= 0 THEN mark END AS copy_of FROM (SELECT DISTINCT box_id FROM log) LEFT JOIN (SELECT box_id, arg_max(CASE action WHEN 'approve' THEN 'approved' WHEN 'reset' THEN 'pending' WHEN 'merge' THEN 'merged' WHEN 'split' THEN 'split' ELSE 'rejected' END, seq) AS status
    FROM settled WHERE reason IS NULL GROUP BY box_id) USING (box_id) LEFT JOIN (SELECT box_id, arg_max(CASE action WHEN 'copy' THEN target_id ELSE -1 END, seq) AS mark FROM settled WHERE reason IS NULL AND action IN ('copy', 'reset') GROUP BY box_id) USING (box_id)""",
    "log", "settled", recursive=True,
)
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.box_state(_settled(spark, sf_dir))


@query("SELECT seq, box_id, action, reason FROM settled WHERE reason IS NOT NULL", "log", "settled", recursive=True)
def rejected_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).where("reason is not null").select("seq", "box_id", "action", "reason")


_QUANTITY = """, d AS (SELECT item_id, delta, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS i FROM (SELECT target_id AS item_id, seq, 1 AS delta FROM counted UNION ALL SELECT target_id, seq, -1 FROM undone)),
    fold AS (SELECT box_id AS item_id, 0::BIGINT AS i, 1::BIGINT AS q FROM codes UNION ALL SELECT d.item_id, d.i, greatest(0, f.q + d.delta) FROM fold f JOIN d ON d.item_id = f.item_id AND d.i = f.i + 1),
    amounts AS (SELECT item_id, arg_max(q, i) AS quantity FROM fold GROUP BY item_id) """


@query(
    _QUANTITY + """SELECT box_id, item_code, CASE WHEN (SELECT arg_max(d.action, d.seq) FROM decided d WHERE d.box_id = codes.box_id) = 'approve' THEN 'approved' ELSE 'rejected' END AS status, quantity FROM codes JOIN amounts ON item_id = box_id""",
    "log", "settled", recursive=True,
)
def item_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.item_state(_settled(spark, sf_dir))


@query(_QUANTITY + "SELECT item_id, quantity FROM amounts", "log", "settled", recursive=True)
def copy_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.item_state(_settled(spark, sf_dir)).select(F.col("box_id").alias("item_id"), "quantity")


@query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'New ' || id ELSE title END AS title, CASE WHEN id % 2 <> 0 THEN category WHEN id % 4 = 0 THEN NULL ELSE 'Farm' END AS category, CASE WHEN id % 2 = 0 THEN NULL ELSE selling_price END AS selling_price, quantity FROM items""",
    "boxes", "items",
)
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = v.items(spark, sf_dir)
    changes = items.where("id % 2 = 0").select(
        "id", F.concat(F.lit("  New "), F.col("id").cast("string"), F.lit(" ")).alias("title"), F.when(F.col("id") % 4 == 0, "").otherwise(" Farm ").alias("category"), F.lit(9.5).alias("selling_price"), F.lit(True).alias("clear_selling_price")
    )
    return review.apply_changes(items, changes).select("id", "title", "category", "selling_price", "quantity")


@query(
    """, w AS (SELECT id, split_part(title, ' ', 1) AS a, split_part(title, ' ', 2) AS b FROM items), c AS (SELECT id, [lower(a), lower(b), lower(a), left(repeat(lower(a || b), 9), 60), lower(a || ' ' || b)] AS all FROM w)
    SELECT id, array_to_string(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN list_contains(all[1:i - 1], all[i]) THEN '' ELSE all[i] END), lambda g: g <> ''), ',') AS tags FROM c""".replace("all", "tried"),
    "boxes", "items",
)
def clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case, repeats, spaces, empty ones and a long one, in all rows."""
    a, b = F.split_part("title", F.lit(" "), F.lit(1)), F.split_part("title", F.lit(" "), F.lit(2))
    tags = F.array(F.concat(F.lit("  "), F.upper(a)), b, F.lit("   "), F.concat(a, F.lit(" ")), F.repeat(F.concat(a, b), F.lit(9)), F.concat(a, F.lit(" \t "), F.upper(b)))
    return v.items(spark, sf_dir).select("id", F.array_join(t.clean_tags(tags), ",").alias("tags"))


_PIXELS = """WITH px AS (SELECT vec_id AS photo_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(floor(abs(embedding[i]::DOUBLE) * 1000) AS INTEGER) % 256 AS r, CAST(floor(abs(embedding[i % 64 + 1]::DOUBLE) * 1000) AS INTEGER) % 256 AS g,
    CAST(floor(abs(embedding[(i + 1) % 64 + 1]::DOUBLE) * 1000) AS INTEGER) % 256 AS b FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) """


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), "embedding", F.posexplode("embedding").alias("k", "value"))
    level = lambda shift: (F.floor(F.abs(F.get("embedding", (F.col("k") + shift) % 64).cast("double")) * 1000) % 256).cast("int")
    return e.select("photo_id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


@query(_PIXELS + "SELECT photo_id, round(sqrt(var_pop(r - g) + var_pop((r + g) / 2 - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg((r + g) / 2 - b), 2)), 6) AS colorfulness FROM px GROUP BY photo_id")
def colorfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.colorfulness(_pixels(spark, sf_dir)).select("photo_id", F.round("colorfulness", 6).alias("colorfulness"))


@query(
    _PIXELS + """, m AS (SELECT photo_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (avg(r) + avg(g) + avg(b)) / 3 AS mean FROM px GROUP BY photo_id)
    SELECT photo_id, x, y, round(least(255, r * (1 + 0.6 * (mean / greatest(mr, 1) - 1))), 6) AS r, round(least(255, g * (1 + 0.6 * (mean / greatest(mg, 1) - 1))), 6) AS g, round(least(255, b * (1 + 0.6 * (mean / greatest(mb, 1) - 1))), 6) AS b FROM px JOIN m USING (photo_id)"""
)
def gray_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.gray_world(_pixels(spark, sf_dir)).select("photo_id", "x", "y", *(F.round(c, 6).alias(c) for c in "rgb"))


@query(
    _PIXELS + """, h AS (SELECT photo_id, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS c, r, g, b FROM px), k AS (SELECT photo_id, CASE WHEN c = 0 THEN 0 WHEN v = r THEN ((60.0::DOUBLE * (g - b) / c) + 360) % 360 WHEN v = g THEN 60.0::DOUBLE * (b - r) / c + 120 ELSE 60.0::DOUBLE * (r - g) / c + 240 END / 2 AS hue,
    CASE WHEN v = 0 THEN 0 ELSE 255.0::DOUBLE * c / v END AS s, v FROM h)
    SELECT photo_id, CAST(least(7, floor(hue / 22.5)) AS INTEGER) AS hue_bin, CAST(least(3, floor(s / 64)) AS INTEGER) AS sat_bin, CAST(floor(v / 64) AS INTEGER) AS val_bin, round(count(*) / 64.0::DOUBLE, 6) AS share FROM k GROUP BY ALL"""
)
def color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.histogram(_pixels(spark, sf_dir)).withColumn("share", F.round("share", 6))

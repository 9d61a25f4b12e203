"""Named queries on boxes that reviewers draw, split and edit, on metadata changes and on import reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..functions.numbering import numbered
from ..operators import catalog, detect, review
from ..sources import photos as sources
from . import views as v
from .more import ORACLES, QUERIES
from .queries import _BASE, _MASTER, query

__all__ = ["ORACLES", "QUERIES"]  # with the queries of this module added

_FLAGS = """array_to_string(list_filter([CASE WHEN x <= 3 OR y <= 3 OR x + w >= 1017 OR y + h >= 837 THEN 'touches_border' END, CASE WHEN typical > 0 AND w * h < typical / 2.5 THEN 'small' WHEN typical > 0 AND w * h > typical * 2.5 THEN 'large' END,
    CASE WHEN greatest(w, h) / greatest(1, least(w, h)) > 2.5 THEN 'extreme_aspect' END], lambda f: f IS NOT NULL), ',')"""
_TYPICAL = "typical AS (SELECT photo_id, CASE WHEN count(*) >= 3 THEN median(CAST(w * h AS DOUBLE)) END AS typical FROM boxes WHERE status IN ('pending', 'approved') GROUP BY photo_id)"


def _page_sizes(boxes: DataFrame) -> DataFrame:
    return boxes.select("photo_id").distinct().select("photo_id", F.lit(1020).alias("width"), F.lit(840).alias("height"))


@query(
    f""", {_TYPICAL}, drawn AS (SELECT photo_id, x + 40 AS x, y - 5 AS y, w, h FROM boxes WHERE status = 'pending' AND id % 3 = 0), cut AS (SELECT photo_id, least(x, 1020) AS x, least(y, 840) AS y, least(x + w, 1020) - least(x, 1020) AS w, least(y + h, 840) - least(y, 840) AS h FROM drawn WHERE y >= 0),
    fine AS (SELECT *, 1999999999 + row_number() OVER (ORDER BY photo_id, x, y, w, h) AS id FROM cut WHERE w >= 4 AND h >= 4)
    SELECT id, photo_id, x, y, w AS width, h AS height, status, origin, NULL AS flags FROM boxes UNION ALL SELECT id, photo_id, x, y, w, h, 'pending', 'manual', {_FLAGS} FROM fine LEFT JOIN typical USING (photo_id)""",
    "boxes",
)
def manual_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes drawn by hand beside pending ones, some of them beyond the photo."""
    b = v.boxes(spark, sf_dir).withColumn("flags", F.lit(None).cast("array<string>"))
    box = F.col("box")
    drawn = b.where("status = 'pending' and id % 3 = 0").select("photo_id", g.box(box["x"] + 40, box["y"] - 5, box["width"], box["height"]).alias("box"))
    after = review.with_manual(b, drawn, 2_000_000_000, _page_sizes(b))
    return after.select("id", "photo_id", "box.*", "status", "origin", F.array_join("flags", ",").alias("flags"))


@query(
    f""", parent AS (SELECT * FROM boxes WHERE status IN ('pending', 'rejected') AND id % 4 = 0), half AS (SELECT id AS parent_id, part, photo_id, CASE WHEN w >= h THEN x + part * (w // 2) ELSE x END AS x, CASE WHEN w >= h THEN y ELSE y + part * (h // 2) END AS y,
        CASE WHEN w < h THEN w WHEN part = 0 THEN w // 2 ELSE w - w // 2 END AS w, CASE WHEN w >= h THEN h WHEN part = 0 THEN h // 2 ELSE h - h // 2 END AS h, confidence FROM parent, (SELECT unnest([0, 1]) AS part)),
    seen AS (SELECT n.parent_id, n.part, b.w * b.h AS size FROM half n JOIN boxes b ON b.photo_id = n.photo_id AND b.id <> n.parent_id AND b.status IN ('pending', 'approved') UNION ALL SELECT n.parent_id, n.part, f.w * f.h FROM half n JOIN half f ON f.parent_id = n.parent_id AND f.part < n.part),
    typical AS (SELECT parent_id, part, CASE WHEN count(*) >= 3 THEN median(size::DOUBLE) END AS typical FROM seen GROUP BY parent_id, part)
    SELECT photo_id, x, y, w AS width, h AS height, CASE WHEN id IN (SELECT id FROM parent) THEN 'split' ELSE status END AS status, origin, confidence::DOUBLE AS confidence, NULL AS flags FROM boxes
    UNION ALL SELECT photo_id, x, y, w, h, 'pending', 'split', confidence::DOUBLE, {_FLAGS} FROM half LEFT JOIN typical USING (parent_id, part)""",
    "boxes",
)
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes after a fourth of those that may be split are cut in halves."""
    b = v.boxes(spark, sf_dir).withColumn("flags", F.lit(None).cast("array<string>"))
    after = review.with_new_boxes(b, review.split_in_halves(b.where("id % 4 = 0")), "split", 3_000_000_000, _page_sizes(b))
    return after.select("photo_id", "box.*", "status", "origin", "confidence", F.array_join("flags", ",").alias("flags"))


# A double rounded half to even by its exact value: the product's error (by halves of 26 digits) decides where the product looks like a half.
_EXACT = "CASE WHEN o > 0.5 OR (o = 0.5 AND (e > 0 OR (e = 0 AND k % 2 = 1))) THEN k + 1 ELSE k END / 100"


@query(
    f""", c AS (SELECT id, title, category, 2.005::DOUBLE + (id % 500) / 100.0::DOUBLE AS v FROM items), p AS (SELECT *, v * 100 AS p, 134217729.0::DOUBLE * v - (134217729.0::DOUBLE * v - v) AS hi FROM c), q AS (SELECT *, (hi * 100 - p) + (v - hi) * 100 AS e, floor(p) AS k, p - floor(p) AS o FROM p)
    SELECT id, 'New ' || id AS title, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'Farm' ELSE category END AS category, {_EXACT} AS selling_price FROM q""",
    "boxes", "items",
)
def stripped_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose texts have tabs, line ends and wide spaces at their ends, and prices that look like halves of a cent."""
    items = v.items(spark, sf_dir)
    n = F.col("id")
    category = F.when(n % 3 == 0, F.lit("\t\n")).when(n % 3 == 1, F.lit("　Farm\r\n"))
    changes = items.select("id", F.concat(F.lit("\t New "), n.cast("string"), F.lit(" \n")).alias("title"), category.alias("category"), (F.lit(2.005) + (n % 500) / 100.0).alias("selling_price"))
    return review.apply_changes(items, changes).select("id", "title", "category", "selling_price")


@query(
    """WITH f AS (SELECT 'doc_' || doc_id AS name, doc_id % 7 <> 0 AS fine, doc_id, sha256(CASE WHEN doc_id % 7 <> 0 THEN 'FFD8FF' ELSE '' END || coalesce(text, '')) AS h FROM documents), k AS (SELECT h, min('old_' || doc_id) AS original FROM f WHERE doc_id % 50 = 0 GROUP BY h),
    o AS (SELECT f.*, original, CASE WHEN original IS NOT NULL THEN 'duplicate' WHEN NOT fine THEN 'error' WHEN row_number() OVER (PARTITION BY h ORDER BY lower(name), name) = 1 THEN 'imported' ELSE 'duplicate' END AS outcome, first_value(name) OVER (PARTITION BY h ORDER BY lower(name), name) AS own FROM f LEFT JOIN k USING (h)),
    r AS (SELECT *, outcome = 'imported' AND doc_id % 13 = 5 AS failed, doc_id % 13 <> 5 AND doc_id % 11 = 3 AS waits FROM o)
    SELECT name, CASE WHEN failed THEN 'error' ELSE outcome END AS outcome, CASE WHEN failed THEN 'Imported, but detection failed: no pixels' WHEN outcome = 'duplicate' THEN 'Already imported as ''' || coalesce(original, own) || '''.' WHEN outcome = 'error' THEN 'Not a readable image.' WHEN waits THEN '' ELSE doc_id % 4 || ' candidate pins' END AS message,
        CASE WHEN outcome = 'imported' AND NOT failed AND NOT waits THEN doc_id % 4 ELSE 0 END::BIGINT AS detections, CASE WHEN failed THEN 'error' WHEN outcome = 'imported' THEN CASE WHEN waits THEN 'pending' ELSE 'processed' END END AS status, CASE WHEN failed THEN 'no pixels' END AS error_message FROM r"""
)
def import_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, message and status of every file; detection fails on some, and hasn't run on others."""
    n = F.col("doc_id")
    rows = v.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), n.cast("string")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    content = F.when(n % 7 != 0, F.concat(F.unhex(F.lit("FFD8FF")), F.col("body"))).otherwise(F.col("body"))
    files = rows.select("doc_id", "name", content.alias("content"))
    known = sources.hashed(files.where("doc_id % 50 = 0")).select("sha256", F.concat(F.lit("old_"), n.cast("string")).alias("name"))
    runs = files.where("doc_id % 13 = 5 or doc_id % 11 <> 3").select("name", (n % 4).alias("detections"), F.when(n % 13 == 5, "no pixels").alias("error"))
    return sources.with_detections(sources.reported(files.select("name", "content"), known), runs).drop("sha256")


def _dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items with category_id, categories, tags and the bridge between items and tags: the same catalogue, normalised."""
    items = v.items(spark, sf_dir)
    categories = numbered(items.where("category is not null").select(F.col("category").alias("name")).distinct(), ["name"], "id").select("id", "name")
    tags = numbered(items.select(F.explode("tags").alias("name")).distinct(), ["name"], "id").select("id", "name")
    bridge = items.select(F.col("id").alias("item_id"), F.explode("tags").alias("name")).join(tags, "name").select("item_id", F.col("id").alias("tag_id")).distinct()
    keyed = items.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category", "left").drop("category")
    return keyed, categories, tags, bridge


@query(_MASTER + "SELECT item_code, category, source_filename FROM master WHERE status = 'approved' AND list_contains(tags, 'cold')", *_BASE)
def normalised_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved items with one tag: categories from their table by a left join, tags by a semi join with the bridge."""
    keyed, categories, tags, bridge = _dimensions(spark, sf_dir)
    rows = catalog.tagged(catalog.with_categories(keyed.where("status = 'approved'"), categories), bridge, tags, "COLD")
    return catalog.master(rows, v.photos(spark, sf_dir), v.boxes(spark, sf_dir)).select("item_code", "category", "source_filename")


@query(
    """, c AS (SELECT coalesce(category, 'None & "none"') AS category, count(*) AS n, min(title) AS first FROM items GROUP BY ALL)
    SELECT category, '<h1>' || replace(replace(category, '&', '&amp;'), '"', '&quot;') || '</h1><p>' || n || ' items, first ' || replace(first, chr(39), '&#x27;') || '</p>{{REST}}' AS page FROM c""",
    "boxes", "items",
)
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each category from one template."""
    name = F.coalesce("category", F.lit('None & "none"'))
    by = v.items(spark, sf_dir).groupBy(name.alias("category")).agg(F.count("*").alias("n"), F.min("title").alias("first"))
    template = F.lit("<h1>{{NAME}}</h1><p>{{COUNT}} items, first {{FIRST}}</p>{{REST}}")
    return by.select("category", t.filled(template, {"NAME": F.col("category"), "COUNT": F.col("n"), "FIRST": F.col("first")}).alias("page"))


@query(
    """, kept AS (SELECT * FROM boxes WHERE status = 'pending' AND photo_id % 3 = 0), found AS (SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY id) AS position, x, y, w, h, confidence FROM kept)
    SELECT id, photo_id, x, y, w AS width, h AS height, status, origin, confidence::DOUBLE AS confidence FROM boxes UNION ALL SELECT 3999999999 + row_number() OVER (ORDER BY photo_id, position), photo_id, x + 1, y, w, h, 'pending', 'auto', confidence::DOUBLE FROM found""",
    "boxes",
)
def appended_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a new run's detections, numbered in order of photo and place."""
    b = v.boxes(spark, sf_dir)
    box = F.col("box")
    place = F.row_number().over(Window.partitionBy("photo_id").orderBy("id"))
    found = b.where("status = 'pending' and photo_id % 3 = 0").select("photo_id", place.alias("position"), g.box(box["x"] + 1, box["y"], box["width"], box["height"]).alias("box"), "confidence")
    return detect.appended(b, found, 4_000_000_000).select("id", "photo_id", "box.*", "status", "origin", F.col("confidence").cast("double").alias("confidence"))

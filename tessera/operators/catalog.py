"""Catalogue queries: master join, filtered search, counts, facets and export records.

Tables: photos(id, filename, imported_at, status, page_label), boxes(id, photo_id, box, status, origin), items(id, item_code, box_id, photo_id,
title, description, category, subcategory, colors, notes, quantity, selling_price, purchase_price, tags, width_px, height_px, crop_path,
transparent_path, created_at, status).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.rounding import half_even

SUPERSEDED = ("merged", "split")


@dataclass(frozen=True)
class ItemFilter:
    """Unset fields restrict nothing; a status other than approved or rejected means all."""

    status: str = "approved"
    q: str = ""
    category: str = ""
    tag: str = ""
    color: str = ""
    photo_id: int | None = None


def master(items: DataFrame, photos: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items with their photo's name and label and their box; items without either drop out."""
    photos = photos.select(F.col("id").alias("photo_id"), F.col("filename").alias("source_filename"), F.col("page_label").alias("source_page"))
    return items.join(photos, "photo_id").join(boxes.select(F.col("id").alias("box_id"), F.col("box").alias("source_box")), "box_id")


def with_categories(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Items (category_id) with `category`, the name from categories(id, name); null for items without one and for unknown ids."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return items.drop("category").join(names, "category_id", "left")


def tagged(items: DataFrame, item_tags: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """Items that have a tag of this name in any case of A-Z: a semi join with the bridge item_tags(item_id, tag_id), whose tag is looked up in tags(id, name)."""
    wanted = tags.where(t.nocase(F.col("name")) == t.nocase(F.lit(name))).select(F.col("id").alias("tag_id"))
    ids = item_tags.join(wanted, "tag_id").select(F.col("item_id").alias("id"))
    return items.join(ids, "id", "left_semi")


def search(rows: DataFrame, want: ItemFilter, ordered: bool = True) -> DataFrame:
    """Rows of master() that pass every predicate that is set, in order of code (a caller that goes on with them can spare the sort)."""
    tests: list[Column] = []
    if want.status in ("approved", "rejected"):
        tests.append(F.col("status") == want.status)
    if q := want.q.strip():
        fields = ("item_code", "title", "description", "notes", "subcategory", "category", "source_filename")
        found = F.exists("tags", lambda tag: t.contains_nocase(tag, q))
        for name in fields:
            found = found | F.coalesce(t.contains_nocase(F.col(name), q), F.lit(False))
        tests.append(found)
    if want.category:
        tests.append(t.nocase(F.col("category")) == t.nocase(F.lit(want.category)))
    if want.tag:
        tests.append(F.exists("tags", lambda tag: t.nocase(tag) == t.nocase(F.lit(want.tag))))
    if want.color:
        tests.append(t.contains_nocase(stored_colors(F.col("colors")), f'"name": "{want.color}"'))
    if want.photo_id:
        tests.append(F.col("photo_id") == want.photo_id)
    for test in tests:
        rows = rows.where(test)
    return rows.orderBy("item_code") if ordered else rows


def stored_colors(colors: Column) -> Column:
    """The colours as the text that patterns are matched with, so that % and _ in a colour filter are wildcards."""
    one = lambda c: F.format_string('{"hex": "%s", "name": "%s", "share": %s}', c["hex"], c["name"], c["share"].cast("string"))
    return F.concat(F.lit("["), F.array_join(F.transform(colors, one), ", "), F.lit("]"))


def get(rows: DataFrame, key: str, value: int | str) -> DataFrame:
    """The row with this id, or item code in any case; LookupError if there is none."""
    found = rows.where(F.col(key) == (value.upper() if isinstance(value, str) else value))
    if found.isEmpty():
        raise LookupError(f"no {key} {value}")
    return found


def with_tags(items: DataFrame, item_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Items with their tags' names in order, from the bridge item_tags(item_id, tag_id) and tags(id, name)."""
    names = item_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("item_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))
    rows = items.drop("tags").join(names.withColumnRenamed("item_id", "id"), "id", "left")
    return rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def names_in_order(dimension: DataFrame) -> DataFrame:
    """id, name, position of a dimension by name in any case of A-Z, then by name."""
    from ..functions.numbering import numbered

    key = t.nocase(F.col("name"))
    return numbered(dimension.select("id", "name"), [key, F.col("name")], "position").orderBy("position")


def gallery_facets(items: DataFrame) -> DataFrame:
    """kind, value, position: what a gallery of approved items can be filtered by, each kind in order of UTF-16 code units, as a browser sorts."""
    shown = items.where("status = 'approved'")
    found = facets(shown).where("value <> ''")
    units = F.hex(F.encode("value", "UTF-16BE"))
    return found.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(units)))


def review_queue(boxes: DataFrame) -> DataFrame:
    """Each live box of a photo with its position, the photo's total and pending boxes, and the next pending box after it, going round (null if there is none).

    Windows hold a photo's boxes: one page.
    """
    page = Window.partitionBy("photo_id")
    order = page.orderBy("id")
    waits = F.when(F.col("status") == "pending", F.col("id"))
    after = F.first(waits, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = boxes.where(~F.col("status").isin(*SUPERSEDED))
    return rows.select(
        "photo_id", "id", F.row_number().over(order).alias("position"), F.count("*").over(page).alias("total"), F.count(waits).over(page).alias("pending"), F.coalesce(after, F.min(waits).over(page)).alias("next_pending")
    )


def color_shares(clusters: DataFrame, least: float = 0.05) -> DataFrame:
    """id, colors (hex, name, share, largest first) from clusters(id, hex, name, share): clusters of one name add up and keep the largest one's hex; rare names go."""
    by = clusters.groupBy("id", "name").agg(F.sum("share").alias("share"), F.max_by("hex", F.struct("share", "hex")).alias("hex"), F.max("share").alias("most"))
    entry = F.struct((-half_even(F.col("share"), 3)).alias("_order"), (-F.col("most")).alias("_most"), "name", "hex", half_even(F.col("share"), 3).alias("share"))
    lists = by.where(F.col("share") >= least).groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return lists.select("id", F.transform("all", lambda c: F.struct(c["hex"].alias("hex"), c["name"].alias("name"), c["share"].alias("share"))).alias("colors"))


def search_words(rows: DataFrame, q: str) -> DataFrame:
    """Every word of q is somewhere in code, title, description, category, subcategory, tags or page, in any case."""
    hay = F.lower(F.concat_ws(" ", "item_code", "title", "description", F.coalesce("category", F.lit("")), "subcategory", F.array_join("tags", " "), F.coalesce("source_page", "source_filename", F.lit(""))))
    for word in q.lower().split():
        rows = rows.where(F.contains(hay, F.lit(word)))
    return rows


def dashboard(photos: DataFrame, boxes: DataFrame, items: DataFrame) -> DataFrame:
    """One row of totals; each table is scanned once and reduced to a row before the three meet."""
    p = photos.agg(F.count("*").alias("source_photos"), F.max("imported_at").alias("last_import"), F.count_if(F.col("status") == "error").alias("errors"))
    b = boxes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")))
    approved = F.col("status") == "approved"
    i = items.agg(F.count_if(approved).alias("catalog_items"), F.coalesce(F.sum(F.when(approved, F.col("quantity"))), F.lit(0)).alias("total_quantity"))
    return p.crossJoin(b).crossJoin(i)  # one row each


def photo_counts(photos: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each photo with its boxes by status and those not superseded; 0 where there are none."""
    by = boxes.groupBy("photo_id").agg(
        *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pending", "approved", "rejected")), F.count_if(~F.col("status").isin(*SUPERSEDED)).alias("detection_count")
    )
    names = ("pending_count", "approved_count", "rejected_count", "detection_count")
    rows = photos.join(by, photos["id"] == by["photo_id"], "left")
    return rows.select(photos["id"], photos["filename"], *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def next_photo(counts: DataFrame) -> DataFrame:
    """The first photo with pending boxes, else the first one: column next_id (null without photos)."""
    return counts.agg(F.coalesce(F.min(F.when(F.col("pending_count") > 0, F.col("id"))), F.min("id")).alias("next_id"))


def neighbours(photos: DataFrame, bucket: int = 10_000) -> DataFrame:
    """id, previous_id, next_id in order of id.

    lag and lead run within buckets of ids; a bucket's edge rows look at the nearest bucket that has rows, of which only first and last ids are windowed.
    """
    rows = photos.select("id", F.floor(F.col("id") / bucket).alias("_b"))
    inner = Window.partitionBy("_b").orderBy("id")
    edges = rows.groupBy("_b").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    across = Window.orderBy("_b")
    edges = edges.select("_b", F.lag("_high").over(across).alias("_before"), F.lead("_low").over(across).alias("_after"))
    near = rows.withColumn("_p", F.lag("id").over(inner)).withColumn("_n", F.lead("id").over(inner)).join(edges, "_b")
    return near.select("id", F.coalesce("_p", "_before").alias("previous_id"), F.coalesce("_n", "_after").alias("next_id"))


def facets(items: DataFrame) -> DataFrame:
    """Distinct values to filter by: kind (category, tag, color), value; categories and tags of all items, colours of approved ones."""
    categories = items.where("category is not null").select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    tags = items.select(F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    colors = items.where("status = 'approved'").select(F.lit("color").alias("kind"), F.explode("colors.name").alias("value")).where("value <> ''")
    return categories.unionByName(tags).unionByName(colors).distinct()


def typical_area(boxes: DataFrame, least: int = 3, without: DataFrame | None = None) -> DataFrame:
    """photo_id, typical: exact median area of pending and approved boxes, without given ones (id); null under `least` of them."""
    live = boxes.where(F.col("status").isin("pending", "approved"))
    if without is not None:
        live = live.join(without.select("id"), "id", "left_anti")
    size = F.col("box.width") * F.col("box.height")
    return live.groupBy("photo_id").agg(F.when(F.count("*") >= least, F.median(size)).alias("typical"))


def color_names(colors: Column) -> Column:
    """Unique names in order of prominence."""
    return F.filter(F.array_distinct(F.transform(colors, lambda c: c["name"])), lambda n: n.isNotNull() & (n != ""))


def flat_record(rows: DataFrame) -> DataFrame:
    """The 19 export columns of rows of master(), all shown as a reader of CSV expects: blanks for nulls, prices with two digits."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pixels = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, "").otherwise(F.col(c).cast("string"))
    return rows.select(
        F.col("item_code").alias("pin_code"), "title", "description", blank("category").alias("category"), "subcategory",
        F.array_join(color_names(F.col("colors")), ", ").alias("colors"), F.array_join("tags", ", ").alias("tags"), "quantity",
        t.price(F.col("selling_price")).alias("price"), t.price(F.col("purchase_price")).alias("purchase_price"), "notes",
        blank("source_filename").alias("source_filename"), blank("source_page").alias("source_page"), blank("crop_path").alias("crop_path"), blank("transparent_path").alias("transparent_path"),
        pixels("width_px").alias("width_px"), pixels("height_px").alias("height_px"), "created_at", "status",
    )


@dataclass(frozen=True)
class Privacy:
    quantity: bool = True
    selling_price: bool = True
    purchase_price: bool = False
    notes: bool = False


def public_record(rows: DataFrame, privacy: Privacy = Privacy()) -> DataFrame:
    """item_code and the public JSON of each row; keys that privacy hides, and null prices or empty notes, are left out."""
    hidden = F.lit(None).cast("string")
    fields = [
        F.col("item_code").alias("code"), F.col("title"), F.col("description"), F.coalesce("category", F.lit("")).alias("category"), F.col("subcategory"), F.col("tags"),
        F.transform("colors", lambda c: F.struct(c["hex"].alias("hex"), c["name"].alias("name"))).alias("colors"),
        F.coalesce(F.nullif("source_page", F.lit("")), "source_filename", F.lit("")).alias("page"), F.substring("created_at", 1, 10).alias("added"),
        (F.col("quantity") if privacy.quantity else hidden).alias("quantity"), (F.col("selling_price") if privacy.selling_price else hidden).alias("price"),
        (F.col("purchase_price") if privacy.purchase_price else hidden).alias("purchase_price"), (F.nullif("notes", F.lit("")) if privacy.notes else hidden).alias("notes"),
    ]
    return rows.select("item_code", F.to_json(F.struct(*fields)).alias("record"))

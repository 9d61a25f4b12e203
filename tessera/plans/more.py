"""More named queries on the catalogue views with their SQL: lookups, facets, queues, edits, colours, ingestion and detection runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, likeness, scoring
from ..functions import geometry as g
from ..functions import text as t
from ..operators import catalog, detect, lookalikes, pixels, review
from ..sources import photos as sources
from . import views as v
from .queries import _BASE, _MASTER, _PIXELS, _SCORE, _SURVIVES, ORACLES, QUERIES, _master, _pixels, query

__all__ = ["ORACLES", "QUERIES"]  # with the queries of this module added


@query(_MASTER + "SELECT item_code, title, source_filename FROM master WHERE item_code = 'PIN-000043'", *_BASE)
def item_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.get(_master(spark, sf_dir), "item_code", "pin-000043").select("item_code", "title", "source_filename")


@query(_MASTER + "SELECT item_code, photo_id, status FROM master WHERE photo_id = 42", *_BASE)
def items_of_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_master(spark, sf_dir), catalog.ItemFilter(status="all", photo_id=42)).select("item_code", "photo_id", "status")


@query(
    _MASTER + """SELECT item_code, status FROM master WHERE lower('[' || array_to_string(list_transform(colors, lambda c: '{"hex": "#808080", "name": "' || c || '", "share": 0.5}'), ', ') || ']') LIKE '%"name": "_o%d"%'""", *_BASE
)
def color_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_master(spark, sf_dir), catalog.ItemFilter(status="all", color="_O%d")).select("item_code", "status")


@query(
    """, f AS (SELECT 'category' AS kind, category AS value FROM items WHERE status = 'approved' AND category <> '' UNION SELECT 'tag', unnest(tags) FROM items WHERE status = 'approved' UNION SELECT 'color', unnest(colors) FROM items WHERE status = 'approved')
    SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS INTEGER) AS position FROM f""",
    "boxes", "items",
)
def gallery_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.gallery_facets(v.items(spark, sf_dir))


@query("SELECT min(id) AS id, name, row_number() OVER (ORDER BY lower(name), name) AS position FROM (SELECT id, unnest([title[1:3], upper(title[1:3])]) AS name FROM items) GROUP BY name", "boxes", "items")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring("title", 1, 3)
    names = v.items(spark, sf_dir).select("id", F.explode(F.array(word, F.upper(word))).alias("name")).groupBy("name").agg(F.min("id").alias("id"))
    return catalog.names_in_order(names)


@query(
    """, old AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT unnest(tags) AS name FROM items WHERE id % 50 = 0)), words AS (SELECT DISTINCT id AS item_id, upper(unnest(tags)) AS name FROM items),
    new AS (SELECT 999 + row_number() OVER (ORDER BY lower(name)) AS id, name FROM (SELECT DISTINCT name FROM words) WHERE lower(name) NOT IN (SELECT lower(name) FROM old)), dim AS (SELECT * FROM old UNION ALL SELECT * FROM new)
    SELECT i.id, (SELECT string_agg(dim.name, ',' ORDER BY dim.name) FROM words JOIN dim ON lower(dim.name) = lower(words.name) WHERE words.item_id = i.id) AS tags, (SELECT sum(dim.id)::BIGINT FROM words JOIN dim ON lower(dim.name) = lower(words.name) WHERE words.item_id = i.id) AS id_sum FROM items i""",
    "boxes", "items",
)
def tag_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbering import numbered

    items = v.items(spark, sf_dir)
    old = items.where("id % 50 = 0").select(F.explode("tags").alias("name")).distinct()
    old = numbered(old, ["name"], "id").select("id", "name")
    words = items.select(F.col("id").alias("item_id"), F.explode("tags").alias("word")).select("item_id", F.upper("word").alias("name")).distinct()
    tags = review.upsert_names(old, words.select("name"), 1000)
    bridge = words.join(tags.select(F.col("id").alias("tag_id"), t.nocase(F.col("name")).alias("key")), t.nocase(words["name"]) == F.col("key")).select("item_id", "tag_id")
    sums = bridge.groupBy("item_id").agg(F.sum("tag_id").alias("id_sum"))
    return catalog.with_tags(items.select("id"), bridge, tags).join(sums, F.col("id") == F.col("item_id"), "left").select("id", F.array_join("tags", ",").alias("tags"), "id_sum")


@query(
    _SCORE.format(on="a.id < b.id") + """, p AS (SELECT id_a, id_b, round_even(score, 3) AS score FROM pairs WHERE score >= 0.45)
    SELECT row_number() OVER (ORDER BY score DESC, id_a, id_b) AS rank, id_a, id_b, a.label AS label_a, b.label AS label_b, score FROM p JOIN embeddings a ON a.vec_id = id_a JOIN embeddings b ON b.vec_id = id_b""",
    "prints",
)
def similar_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return lookalikes.ranked_pairs(lookalikes.similar_pairs(v.fingerprints(spark, sf_dir), threshold=0.45), records, ["label"])


@query(
    _SCORE.format(on="a.id % 3 = 0 AND b.id % 3 <> 0") + """, top AS (SELECT id_a, id_b, round_even(score, 3) AS score FROM pairs WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) = 1)
    SELECT id, CASE WHEN id_b IS NULL THEN CASE WHEN id % 2 = 0 THEN 'small' ELSE '' END ELSE CASE WHEN id % 2 = 0 THEN 'possible_duplicate,small' ELSE 'possible_duplicate' END END AS flags, id_b AS similar_to, score AS similarity FROM prints LEFT JOIN top ON id_a = id WHERE id % 3 = 0""",
    "prints",
)
def flagged_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = v.fingerprints(spark, sf_dir)
    pending = prints.where("id % 3 = 0")
    matches = lookalikes.best_matches(pending, prints.where("id % 3 <> 0"), k=1, threshold=0.4)
    flags = F.when(F.col("id") % 2 == 0, F.array(F.lit("small"))).otherwise(F.array().cast("array<string>"))
    return lookalikes.flag_lookalikes(pending.select("id", flags.alias("flags")), matches).select("id", F.array_join("flags", ",").alias("flags"), "similar_to", "similarity")


@query("SELECT id FROM items WHERE status = 'approved' AND id % 2 = 0 AND id % 3 <> 0", "boxes", "items")
def missing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("crops/"), F.col("id").cast("string"))
    items = v.items(spark, sf_dir).withColumn("crop_path", path).withColumn("fingerprint", F.when(F.col("id") % 2 == 0, "{}").otherwise('{"phash": "0"}'))
    return lookalikes.without_fingerprint(items, items.where("id % 3 <> 0").select("crop_path")).select("id")


@query("SELECT id, lower(printf('%08x', hi) || printf('%08x', lo)) AS phash, round_even(histogram[2], 5) AS second, hi, lo FROM prints", "prints")
def fingerprint_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.fingerprints(spark, sf_dir).select("id", likeness.encoded(F.col("hi"), F.col("lo"), F.col("histogram")).alias("stored"))
    hi, lo, histogram = likeness.decoded(F.col("stored"))
    return rows.select("id", "stored.phash", F.get(histogram, F.lit(1)).alias("second"), hi.alias("hi"), lo.alias("lo"))


@query(
    """, live AS (SELECT * FROM boxes WHERE status NOT IN ('merged', 'split')), waits AS (SELECT photo_id, list(id ORDER BY id) AS ids FROM live WHERE status = 'pending' GROUP BY photo_id)
    SELECT l.photo_id, l.id, CAST(row_number() OVER (PARTITION BY l.photo_id ORDER BY l.id) AS INTEGER) AS position, count(*) OVER (PARTITION BY l.photo_id) AS total, coalesce(len(ids), 0)::BIGINT AS pending, coalesce(list_filter(ids, lambda i: i > l.id)[1], ids[1]) AS next_pending FROM live l LEFT JOIN waits w ON w.photo_id = l.photo_id""",
    "boxes",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.review_queue(v.boxes(spark, sf_dir))


_FLAGGED = """, typical AS (SELECT photo_id, CASE WHEN count(*) >= 3 THEN median(CAST(w * h AS DOUBLE)) END AS typical FROM boxes WHERE status IN ('pending', 'approved') GROUP BY photo_id),
    flagged AS (SELECT id, (x <= 3 OR y <= 3 OR x + w >= 1017 OR y + h >= 837) OR coalesce(typical > 0 AND (w * h < typical / 2.5 OR w * h > typical * 2.5), false) OR greatest(w, h) / least(w, h) > 2.5 OR confidence < 0.5 AS bad FROM boxes LEFT JOIN typical USING (photo_id))"""


def _ordered(source: str) -> str:
    return f""", o AS (SELECT photo_id, id, x, y + h / 2 AS cy, row_number() OVER (PARTITION BY photo_id ORDER BY y + h / 2, id) AS k FROM {source}), heights AS (SELECT photo_id, median(CAST(h AS DOUBLE)) AS t FROM {source} GROUP BY photo_id),
    fold AS (SELECT photo_id, id, x, k, 1 AS row_no, cy AS total, 1 AS n FROM o WHERE k = 1 UNION ALL
        SELECT o.photo_id, o.id, o.x, o.k, CASE WHEN abs(o.cy - f.total / f.n) < t * 0.5 THEN f.row_no ELSE f.row_no + 1 END, CASE WHEN abs(o.cy - f.total / f.n) < t * 0.5 THEN f.total + o.cy ELSE o.cy END,
        CASE WHEN abs(o.cy - f.total / f.n) < t * 0.5 THEN f.n + 1 ELSE 1 END FROM fold f JOIN o ON o.photo_id = f.photo_id AND o.k = f.k + 1 JOIN heights ON heights.photo_id = o.photo_id),
    placed AS (SELECT photo_id, id, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY row_no, x, k) AS INTEGER) AS position FROM fold) """


@query(_FLAGGED + _ordered("boxes") + "SELECT b.id, printf('PIN-%06d', 100 + row_number() OVER (ORDER BY b.photo_id, position)) AS item_code FROM boxes b JOIN flagged USING (id) JOIN placed p ON p.id = b.id WHERE status = 'pending' AND NOT bad", "boxes", recursive=True)
def approve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbering import numbered

    b = v.boxes(spark, sf_dir)
    marked = b.join(catalog.typical_area(b), "photo_id", "left").withColumn("flags", scoring.flags(F.col("box"), 1020, 840, F.col("typical"), sure=F.col("confidence")))
    ready = review.to_approve(marked).select("photo_id", "id").join(detect.reading_order(b), ["photo_id", "id"])
    return numbered(ready, ["photo_id", "position"], start=101).select("id", t.item_code(F.col("number"), strict=True).alias("item_code"))


@query(
    """, a AS (SELECT id, x - 100 AS x, y, w - 30 AS w, h FROM boxes), c AS (SELECT *, least(greatest(x, 0), 700) AS cx, least(greatest(y, 0), 600) AS cy, least(greatest(x + w, 0), 700) AS x2, least(greatest(y + h, 0), 600) AS y2 FROM a)
    SELECT id, cx AS x, cy AS y, greatest(0, x2 - cx) AS width, greatest(0, y2 - cy) AS height, CASE WHEN x < 0 OR y < 0 THEN 'negative corner' WHEN w <= 0 OR h <= 0 THEN 'no width or height' WHEN x2 - cx < 4 OR y2 - cy < 4 THEN 'too small' END AS error FROM c""",
    "boxes",
)
def checked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    moved = v.boxes(spark, sf_dir).select("id", g.box(b["x"] - 100, b["y"], b["width"] - 30, b["height"]).alias("box"))
    return review.checked_boxes(moved, F.lit(700), F.lit(600)).select("id", "box.*", "error")


@query(
    """SELECT id, array_to_string(list_filter([CASE WHEN length(notes) > 5000 THEN 'notes' END, CASE WHEN quantity - 10 < 0 THEN 'quantity' END, CASE WHEN selling_price - 1200 < 0 THEN 'selling_price' END, CASE WHEN length(title) * (id % 30) > 300 THEN 'title' END], lambda e: e IS NOT NULL), ',') AS errors FROM items""",
    "boxes", "items",
)
def invalid_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = v.items(spark, sf_dir).select("id", "notes", (F.col("quantity") - 10).alias("quantity"), (F.col("selling_price") - 1200).alias("selling_price"), F.repeat("title", (F.col("id") % 30).cast("int")).alias("title"))
    return review.change_errors(changes).select("id", F.array_join("errors", ",").alias("errors"))


@query(
    """, e AS (SELECT min(id) AS id FROM boxes WHERE status <> 'merged' GROUP BY photo_id), now AS (SELECT b.*, e.id IS NOT NULL AS edited, CASE WHEN e.id IS NULL THEN w ELSE w * 2 END AS w2 FROM boxes b LEFT JOIN e USING (id)),
    typical AS (SELECT photo_id, CASE WHEN count(*) >= 3 THEN median(CAST(w * h AS DOUBLE)) END AS typical FROM now WHERE status IN ('pending', 'approved') AND NOT edited GROUP BY photo_id)
    SELECT id, w2 AS width, array_to_string(list_filter([CASE WHEN x <= 3 OR y <= 3 OR x + w2 >= 1017 OR y + h >= 837 THEN 'touches_border' END, CASE WHEN typical > 0 AND w2 * h < typical / 2.5 THEN 'small' WHEN typical > 0 AND w2 * h > typical * 2.5 THEN 'large' END,
    CASE WHEN greatest(w2, h) / least(w2, h) > 2.5 THEN 'extreme_aspect' END], lambda f: f IS NOT NULL), ',') AS flags FROM now LEFT JOIN typical USING (photo_id) WHERE edited""",
    "boxes",
)
def edited_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.boxes(spark, sf_dir)
    first = b.where("status <> 'merged'").groupBy("photo_id").agg(F.min("id").alias("id"))
    wide = F.col("box")
    edits = b.join(first.select("id"), "id").select("id", g.box(wide["x"], wide["y"], wide["width"] * 2, wide["height"]).alias("box"))
    rows = review.edited(b, edits).join(edits.select("id"), "id").join(catalog.typical_area(b, without=edits), "photo_id", "left")
    return rows.select("id", "box.width", F.array_join(scoring.flags(F.col("box"), 1020, 840, F.col("typical")), ",").alias("flags"))


@query(
    """, chosen AS (SELECT * FROM boxes WHERE status IN ('pending', 'rejected') AND photo_id % 5 = 0), m AS (SELECT photo_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, max(confidence)::DOUBLE AS confidence FROM chosen GROUP BY photo_id HAVING count(*) >= 2)
    SELECT id, photo_id, x, y, w AS width, h AS height, CASE WHEN id IN (SELECT c.id FROM chosen c JOIN m USING (photo_id)) THEN 'merged' ELSE status END AS status, origin, confidence::DOUBLE AS confidence FROM boxes
    UNION ALL SELECT 999999999 + row_number() OVER (ORDER BY photo_id), photo_id, x, y, width, height, 'pending', 'merge', confidence FROM m""",
    "boxes",
)
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.boxes(spark, sf_dir)
    chosen = b.where(F.col("status").isin("pending", "rejected") & (F.col("photo_id") % 5 == 0))
    merged = review.merge_boxes(chosen.withColumnRenamed("photo_id", "merge_id")).withColumnRenamed("merge_id", "photo_id")
    after = review.with_new_boxes(b, merged, "merged", 1_000_000_000)
    return after.select("id", "photo_id", "box.*", "status", "origin", "confidence")


@query(
    """, n AS (SELECT id + 1000000000 AS id, photo_id, x + 5 AS x, y, w, h FROM boxes WHERE status = 'pending' AND id % 2 = 0), gone AS (SELECT id FROM boxes WHERE status = 'pending' AND origin = 'auto' AND id NOT IN (SELECT box_id FROM items WHERE box_id IS NOT NULL)),
    rest AS (SELECT * FROM boxes WHERE id NOT IN (SELECT id FROM gone)) SELECT id, photo_id, status FROM rest UNION ALL SELECT n.id, n.photo_id, 'pending' FROM n WHERE """ + _SURVIVES.replace("FROM boxes k", "FROM rest k").replace("k.status IN ('approved', 'rejected')", "k.status NOT IN ('merged', 'split')"),
    "boxes", "items",
)
def redetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.boxes(spark, sf_dir)
    x = F.col("box")
    fresh = b.where("status = 'pending' and id % 2 = 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("box", g.box(x["x"] + 5, x["y"], x["width"], x["height"]))
    return detect.redetected(b, v.items(spark, sf_dir), fresh).select("id", "photo_id", "status")


@query(
    """, kept AS (SELECT * FROM boxes WHERE status = 'pending')""" + _ordered("kept") + """, s AS (SELECT p.photo_id, p.position, k.confidence, CAST(round_even(x * 1.5, 0) AS INTEGER) AS sx, CAST(round_even(y * 1.5, 0) AS INTEGER) AS sy, CAST(round_even((x + w) * 1.5 - x * 1.5, 0) AS INTEGER) AS sw,
    CAST(round_even((y + h) * 1.5 - y * 1.5, 0) AS INTEGER) AS sh FROM kept k JOIN placed p USING (photo_id, id)),
    c AS (SELECT photo_id, position, confidence, least(sx, 1500) AS x, least(sy, 1200) AS y, least(sx + sw, 1500) - least(sx, 1500) AS w, least(sy + sh, 1200) - least(sy, 1200) AS h FROM s), m AS (SELECT photo_id, median(CAST(w * h AS DOUBLE)) AS typical FROM c GROUP BY photo_id)
    SELECT photo_id, position, x, y, w AS width, h AS height, round_even(confidence::DOUBLE, 3) AS confidence, array_to_string(list_filter([CASE WHEN x <= 4 OR y <= 4 OR x + w >= 1496 OR y + h >= 1196 THEN 'touches_border' END, CASE WHEN typical > 0 AND w * h < typical / 2.5 THEN 'small' WHEN typical > 0 AND w * h > typical * 2.5 THEN 'large' END,
    CASE WHEN confidence < 0.35::DOUBLE * 1.4::DOUBLE THEN 'mostly_background' END, CASE WHEN greatest(w, h) / greatest(1, least(w, h)) > 2.5 THEN 'extreme_aspect' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END], lambda f: f IS NOT NULL), ',') AS flags FROM c JOIN m USING (photo_id)""",
    "boxes", recursive=True,
)
def assembled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = v.boxes(spark, sf_dir).where("status = 'pending'").select("photo_id", "id", "box", "confidence", F.col("confidence").alias("foreground"))
    pages = v.photos(spark, sf_dir).select(F.col("id").alias("photo_id"), F.lit(1.5).alias("scale"), F.lit(1500).alias("width"), F.lit(1200).alias("height"))
    found = detect.assembled(kept, pages)
    return found.select("photo_id", "position", "box.*", "confidence", F.array_join("flags", ",").alias("flags"))


_CLUSTERS = """WITH c AS (SELECT p_partkey AS id, ['red', 'blue', 'green'][(p_partkey * k) % 3 + 1] AS name, '#' || lpad(lower(hex((p_partkey * 37 + k * 91) % 65536)), 6, '0') AS hex, ((p_partkey * (k + 3)) % 30) / 64.0::DOUBLE AS share FROM part, (SELECT unnest([1, 2, 3, 4]) AS k)) """


@query(_CLUSTERS + """, b AS (SELECT id, name, sum(share) AS total, arg_max(hex, (share, hex)) AS hex, max(share) AS most FROM c GROUP BY id, name HAVING sum(share) >= 0.05)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round_even(total, 3) DESC, most DESC, name) - 1 AS INTEGER) AS position, name, hex, round_even(total, 3) AS share FROM b""")  # fmt: skip
def color_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_partkey"), F.col("k")
    rows = v.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"))
    name = F.get(F.array(F.lit("red"), F.lit("blue"), F.lit("green")), ((n * k) % 3).cast("int"))
    clusters = rows.select(n.alias("id"), F.concat(F.lit("#"), F.lpad(F.lower(F.hex((n * 37 + k * 91) % 65536)), 6, "0")).alias("hex"), name.alias("name"), (((n * (k + 3)) % 30) / 64.0).alias("share"))
    return catalog.color_shares(clusters).select("id", F.posexplode("colors").alias("position", "c")).select("id", "position", "c.name", "c.hex", "c.share")


# SQL of a colour name: from l, a, b the polar ones, from these the plain name, and then the name.
_POLAR = "sqrt(a * a + b * b) AS chroma, CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END AS hue"
_PLAIN = "CASE WHEN hue < 20 THEN 'pink' WHEN hue < 45 THEN 'red' WHEN hue < 85 THEN 'orange' WHEN hue < 112 THEN 'yellow' WHEN hue < 175 THEN 'green' WHEN hue < 215 THEN 'teal' WHEN hue < 310 THEN 'blue' WHEN hue < 340 THEN 'purple' ELSE 'pink' END"
_NAME = """CASE WHEN chroma < 7 THEN CASE WHEN l < 22 THEN 'black' WHEN l < 45 THEN 'dark gray' WHEN l < 80 THEN 'gray' ELSE 'white' END WHEN hue >= 30 AND hue < 90 AND l < 50 THEN 'brown' WHEN hue >= 55 AND hue < 115 AND chroma < 26 AND l >= 68 THEN 'beige'
    WHEN plain = 'red' AND l >= 62 THEN CASE WHEN hue < 36 THEN 'pink' ELSE 'orange' END WHEN plain = 'red' AND l < 35 THEN 'dark red' WHEN plain = 'blue' AND l < 25 THEN 'navy' WHEN plain = 'blue' AND l >= 65 THEN CASE WHEN hue >= 285 THEN 'lavender' ELSE 'light blue' END
    WHEN plain = 'purple' AND l >= 65 THEN 'lavender' WHEN plain = 'green' AND l < 35 THEN 'dark green' ELSE plain END"""
_LINEAR = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_BENT = "CASE WHEN {v} > 0.008856 THEN pow({v}, 1.0::DOUBLE / 3) ELSE {v} * 7.787 + 16.0::DOUBLE / 116 END"
_ROW = [f"((lr * {r} + lg * {gr} + lb * {b}) / {w})::DOUBLE" for (r, gr, b), w in zip(scoring.XYZ, scoring.WHITE, strict=True)]


@query(
    f"""WITH p AS (SELECT p_partkey AS id, (p_partkey * 7) % 256 AS r, (p_partkey * 13) % 256 AS g, (p_partkey * 29) % 256 AS b FROM part), li AS (SELECT id, {_LINEAR.format(c='r')} AS lr, {_LINEAR.format(c='g')} AS lg, {_LINEAR.format(c='b')} AS lb FROM p),
    f AS (SELECT id, {_BENT.format(v=_ROW[0])} AS fx, {_BENT.format(v=_ROW[1])} AS fy, {_BENT.format(v=_ROW[2])} AS fz FROM li),
    e AS (SELECT id, least(255, greatest(0, round_even((fy * 116 - 16) * 2.55, 0))) AS l8, least(255, greatest(0, round_even((fx - fy) * 500 + 128, 0))) AS a8, least(255, greatest(0, round_even((fy - fz) * 200 + 128, 0))) AS b8 FROM f),
    c AS (SELECT id, l8 * 100 / 255 AS l, a8 - 128 AS a, b8 - 128 AS b FROM e), h AS (SELECT *, {_POLAR} FROM c),
    n AS (SELECT *, {_PLAIN} AS plain FROM h)
    SELECT id, {_NAME} AS name FROM n"""
)
def rgb_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    channel = lambda n: ((k * n) % 256).cast("int")
    return v.table(spark, sf_dir, "part").select(k.alias("id"), scoring.rgb_color_name(channel(7), channel(13), channel(29)).alias("name"))


@query(
    """SELECT id, CAST(round_even((id % 1000) / 1000.0::DOUBLE * 100, 0) AS INTEGER) AS percent, CASE WHEN id % 3 = 0 THEN '' ELSE '/media/crops/' || id || '.png' END AS url, CASE WHEN id % 3 = 0 THEN NULL ELSE 'crops/' || id || '.png' END AS stored, CASE WHEN id % 3 = 0 THEN NULL ELSE '/data/crops/' || id || '.png' END AS path,
    CASE WHEN id % 4 = 0 THEN 'Untitled' ELSE title END AS title, array_to_string(tags[1:2], ',') AS shown, CASE WHEN id % 5 = 0 THEN NULL ELSE 'Page' END AS label, array_to_string(list_filter([lower(tags[1]), 'b c'], lambda g: g <> ''), '|') AS typed FROM items""",
    "boxes", "items",
)
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    stored = F.when(n % 3 != 0, F.concat(F.lit("crops/"), n.cast("string"), F.lit(".png")))
    return v.items(spark, sf_dir).select(
        "id", display.percent((n % 1000) / 1000.0).alias("percent"), display.media_url(stored).alias("url"), display.relative_path(display.absolute_path(stored, "/data/"), "/data").alias("stored"),
        display.absolute_path(stored, "/data").alias("path"), display.title_or(F.when(n % 4 == 0, "").otherwise(F.col("title")), "Untitled").alias("title"), F.array_join(display.first_of(F.col("tags"), 2), ",").alias("shown"),
        display.page_label(F.when(n % 5 == 0, "  ").otherwise(" Page ")).alias("label"), F.array_join(t.split_tags(F.concat(F.lit(" "), F.lower(F.get("tags", F.lit(0))), F.lit(" ,, b c ,"))), "|").alias("typed"),
    )


@query("SELECT greatest(1500, max(CAST(substr(item_code, 5) AS BIGINT))) AS last_code FROM items", "boxes", "items")
def last_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.last_code(v.items(spark, sf_dir), 1500)


@query(
    """WITH f AS (SELECT 'doc_' || doc_id AS name, doc_id % 7 <> 0 AS fine, doc_id, sha256(CASE WHEN doc_id % 7 <> 0 THEN 'FFD8FF' ELSE '' END || coalesce(text, '')) AS h FROM documents), k AS (SELECT DISTINCT h FROM f WHERE doc_id % 50 = 0),
    o AS (SELECT CASE WHEN h IN (FROM k) THEN 'duplicate' WHEN NOT fine THEN 'error' WHEN row_number() OVER (PARTITION BY h ORDER BY lower(name), name) = 1 THEN 'imported' ELSE 'duplicate' END AS outcome, doc_id FROM f)
    SELECT count_if(outcome = 'imported') AS imported, count_if(outcome = 'duplicate') AS duplicates, count_if(outcome = 'error') AS errors, coalesce(sum(doc_id % 4) FILTER (WHERE outcome = 'imported'), 0)::BIGINT AS detections FROM o"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL hashes a text in front where the files have an image's first bytes: equal contents stay equal."""
    rows = v.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    content = F.when(F.col("doc_id") % 7 != 0, F.concat(F.unhex(F.lit("FFD8FF")), F.col("body"))).otherwise(F.col("body"))
    files = rows.select("doc_id", "name", content.alias("content"))
    known = sources.hashed(files.where("doc_id % 50 = 0")).select("sha256")
    return sources.batch_report(sources.ingested(files.select("name", "content"), known), files.select("name", (F.col("doc_id") % 4).alias("detections")))


@query(
    _PIXELS + """, h AS (SELECT photo_id, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS c, r, g, b FROM px), k AS (SELECT photo_id, CASE WHEN c = 0 THEN 0 WHEN v = r THEN ((60.0::DOUBLE * (g - b) / c) + 360) % 360 WHEN v = g THEN 60.0::DOUBLE * (b - r) / c + 120 ELSE 60.0::DOUBLE * (r - g) / c + 240 END / 2 AS hue,
    CASE WHEN v = 0 THEN 0 ELSE 255.0::DOUBLE * c / v END AS s FROM h), n AS (SELECT photo_id, floor(hue / 15) AS bin, count_if(s >= 60) AS n FROM k GROUP BY ALL)
    SELECT photo_id, round(CASE WHEN sum(n) < 20 THEN 0 ELSE count_if(n > greatest(5, (SELECT sum(n) FROM n x WHERE x.photo_id = n.photo_id) * 0.02)) / 12 END, 6) AS hue_diversity FROM n GROUP BY photo_id"""
)
def hue_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.hue_diversity(_pixels(spark, sf_dir)).select("photo_id", F.round("hue_diversity", 6).alias("hue_diversity"))

"""The driver's tables seen as a catalogue: photos, boxes, items, fingerprints, files and review actions, in Spark and as SQL text.

Both sides define the same rows, so that queries on them can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import likeness


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    key = F.col("o_orderkey")
    label = F.when(key % 3 == 0, F.concat(F.lit("Page "), key.cast("string")))
    return o.select(key.alias("id"), F.concat(F.lit("page_"), key.cast("string"), F.lit(".jpeg")).alias("filename"), F.col("o_orderdate").alias("imported_at"), status.alias("status"), label.alias("page_label"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber) isn't unique in the tables, so rows are grouped first."""
    names = {"p": "l_partkey", "s": "l_suppkey", "q": "l_quantity", "rf": "l_returnflag", "ls": "l_linestatus"}
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(n) for n, c in names.items()))
    status = F.when(F.col("rf") == "A", "approved").when(F.col("rf") == "R", "rejected").when(F.col("ls") == "O", "pending").otherwise("merged")
    box = g.box(F.col("p") % 1000, (F.col("s") * 7) % 800, 20 + F.floor("q"), 20 + F.col("p") % 40)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("photo_id"), box.alias("box"), status.alias("status"),
        F.when(F.col("s") % 5 == 0, "manual").otherwise("auto").alias("origin"), ((F.col("p") % 100) / 100.0).alias("confidence"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    # A photo's first box straight from the lines, which needs two columns only.
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("photo_id")).agg((F.first("l_orderkey") * 10 + F.min("l_linenumber")).alias("box_id"))
    n = F.col("p_partkey")
    colors = F.transform(F.slice(F.split("p_name", " "), 1, 2), lambda w: F.struct(F.lit("#808080").alias("hex"), w.alias("name"), F.lit(0.5).alias("share")))
    rows = p.select(
        (n + 1).alias("id"), F.format_string("PIN-%06d", n + 1).alias("item_code"), n.alias("photo_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        F.when(n % 11 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("category"), F.col("p_type").alias("subcategory"), colors.alias("colors"),
        F.when(n % 4 == 0, "keep").otherwise("").alias("notes"), F.col("p_size").alias("quantity"), F.when(n % 7 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("selling_price"),
        F.lit(None).cast("double").alias("purchase_price"), F.split("p_name", " ").alias("tags"), F.when(n % 5 == 0, 0).otherwise((n % 900).cast("int")).alias("width_px"), F.lit(None).cast("int").alias("height_px"),
        F.lit(None).cast("string").alias("crop_path"), F.lit(None).cast("string").alias("transparent_path"), F.lit("2024-05-01T10:00:00+00:00").alias("created_at"),
        F.when(n % 9 == 0, "rejected").otherwise("approved").alias("status"),
    )
    return rows.join(first, "photo_id", "left")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 values as an 8x8 block of frequencies: bits above the median of all but the first, histogram of magnitudes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    # What all values of a row need is bound to a lambda's variable: a column would be worked out again for each of them.
    middle = F.get(F.sort_array(F.array_compact(F.slice("v", 2, 63))), 31)
    half = lambda first, m: likeness.hash_bits(F.transform("v", lambda x: F.when(x > m, 1).otherwise(0)), first)
    bits = F.transform(F.array(middle), lambda m: F.struct(half(0, m).alias("hi"), half(32, m).alias("lo")))[0]
    histogram = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x), lambda total: F.transform("v", lambda x: F.abs(x) / total))
    return e.select("id", bits.alias("bits"), histogram.alias("histogram")).select("id", "bits.hi", "bits.lo", "histogram")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("text").cast("binary").alias("content"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review actions of boxes (users); seq is the event's id. A click counts a copy of a near box's item; one view in 40 splits its box, one merges two."""
    kinds = {"purchase": "approve", "error": "reject", "signup": "reset", "click": "copy"}
    n = F.col("event_id")
    action = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()), F.when(n % 40 == 0, "split").when(n % 40 == 1, "merge"))
    rows = table(spark, sf_dir, "events").select(n.alias("seq"), F.col("user_id").alias("box_id"), action.alias("action"), F.when(action == "copy", F.col("user_id") + n % 4).alias("target_id"))
    rows = rows.where("action is not null")
    return rows.unionByName(rows.where("action = 'merge'").withColumn("box_id", F.col("box_id") + 1))


def reviewed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, photo_id of the boxes of actions(); three to a photo."""
    ids = actions(spark, sf_dir).select(F.col("box_id").alias("id")).distinct()
    return ids.select("id", F.floor(F.col("id") / 3).alias("photo_id"))


#: The same views as common table expressions.
SQL = {
    "photos": """photos AS (SELECT o_orderkey AS id, 'page_' || o_orderkey || '.jpeg' AS filename, o_orderdate AS imported_at,
        CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'error' END AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Page ' || o_orderkey END AS page_label FROM orders)""",
    "boxes": """boxes AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS photo_id, CAST(p % 1000 AS INTEGER) AS x, CAST((s * 7) % 800 AS INTEGER) AS y,
        CAST(20 + floor(q) AS INTEGER) AS w, CAST(20 + p % 40 AS INTEGER) AS h,
        CASE WHEN rf = 'A' THEN 'approved' WHEN rf = 'R' THEN 'rejected' WHEN ls = 'O' THEN 'pending' ELSE 'merged' END AS status,
        CASE WHEN s % 5 = 0 THEN 'manual' ELSE 'auto' END AS origin, (p % 100) / 100.0 AS confidence
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_returnflag) AS rf, min(l_linestatus) AS ls
              FROM lineitem GROUP BY l_orderkey, l_linenumber))""",
    "items": """items AS (SELECT p_partkey + 1 AS id, printf('PIN-%06d', p_partkey + 1) AS item_code, p_partkey AS photo_id, p_name AS title, p_type || ' ' || p_brand AS description,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS category, p_type AS subcategory, string_split(p_name, ' ')[1:2] AS colors,
        CASE WHEN p_partkey % 4 = 0 THEN 'keep' ELSE '' END AS notes, p_size AS quantity, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS selling_price,
        string_split(p_name, ' ') AS tags, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE CAST(p_partkey % 900 AS INTEGER) END AS width_px,
        '2024-05-01T10:00:00+00:00' AS created_at, CASE WHEN p_partkey % 9 = 0 THEN 'rejected' ELSE 'approved' END AS status, b.box_id
        FROM part LEFT JOIN (SELECT photo_id, min(id) AS box_id FROM boxes GROUP BY photo_id) b ON b.photo_id = p_partkey)""",
    "prints": """prints AS (SELECT id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN v[i] > middle THEN 1::BIGINT << (32 - i) ELSE 0 END))::BIGINT AS hi,
        list_sum(list_transform(range(1, 33), lambda i: CASE WHEN v[i + 32] > middle THEN 1::BIGINT << (32 - i) ELSE 0 END))::BIGINT AS lo,
        list_transform(v, lambda x: abs(x) / total) AS histogram
        FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_sort(embedding[2:64]::DOUBLE[])[32] AS middle, list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS total FROM embeddings))""",
    "log": """plain AS (SELECT event_id AS seq, user_id AS box_id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'reset' WHEN 'click' THEN 'copy' ELSE CASE event_id % 40 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' END END AS action,
        CASE WHEN event_type = 'click' THEN user_id + event_id % 4 END AS target_id FROM events),
        log AS (SELECT * FROM plain WHERE action IS NOT NULL UNION ALL SELECT seq, box_id + 1, action, target_id FROM plain WHERE action = 'merge')""",
    # Merges and splits one after the other, with the list of boxes that are gone; then each action against what was true before it.
    "settled": """ends AS (SELECT seq, any_value(action) AS action, list(box_id) AS ids, row_number() OVER (ORDER BY seq) AS k, (any_value(action) = 'split' OR (count(*) >= 2 AND count(DISTINCT box_id // 3) = 1))
            AND bool_and(coalesce((SELECT arg_max(d.action, d.seq) FROM log d WHERE d.box_id = e.box_id AND d.seq < e.seq AND d.action IN ('approve', 'reject', 'reset')) <> 'approve', true)) AS allowed FROM log e WHERE action IN ('merge', 'split') GROUP BY seq),
        walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS lost, false AS took, 0::BIGINT AS seq UNION ALL SELECT e.k, CASE WHEN e.allowed AND NOT list_has_any(w.lost, e.ids) THEN list_concat(w.lost, e.ids) ELSE w.lost END, e.allowed AND NOT list_has_any(w.lost, e.ids), e.seq FROM walk w JOIN ends e ON e.k = w.k + 1),
        gone AS (SELECT unnest(e.ids) AS box_id, e.seq AS gone_seq, e.action AS gone_as FROM ends e JOIN walk w ON w.seq = e.seq AND w.took),
        timed AS (SELECT log.*, gone_seq, gone_as FROM log LEFT JOIN gone USING (box_id)),
        decided AS (SELECT * FROM timed WHERE action IN ('approve', 'reject', 'reset') AND (gone_seq IS NULL OR seq < gone_seq)),
        asked AS (SELECT c.seq, c.box_id, c.target_id, any_value(o.action) AS own, coalesce(any_value(o.seq), -1) AS since, any_value(t.action) AS target_did FROM (SELECT * FROM timed WHERE action = 'copy' AND (gone_seq IS NULL OR seq < gone_seq)) c
            LEFT JOIN decided o ON o.box_id = c.box_id AND o.seq = (SELECT max(seq) FROM decided x WHERE x.box_id = c.box_id AND x.seq < c.seq) LEFT JOIN decided t ON t.box_id = c.target_id AND t.seq = (SELECT max(seq) FROM decided x WHERE x.box_id = c.target_id AND x.seq < c.seq) GROUP BY c.seq, c.box_id, c.target_id),
        counted AS (SELECT * FROM asked WHERE coalesce(own, 'reset') = 'reset' AND target_did = 'approve' QUALIFY row_number() OVER (PARTITION BY box_id, since ORDER BY seq) = 1),
        settled AS (SELECT t.seq, t.action, t.box_id, t.target_id, CASE WHEN t.seq > t.gone_seq THEN 'already merged or split' WHEN t.action IN ('merge', 'split') THEN CASE WHEN t.seq = t.gone_seq THEN NULL ELSE 'not allowed for these boxes' END
            WHEN t.action = 'copy' AND c.seq IS NULL THEN CASE WHEN coalesce(a.own, 'reset') = 'reset' AND coalesce(a.target_did <> 'approve', true) THEN 'target isn''t in the catalogue' ELSE 'only pending boxes can be copies' END END AS reason
            FROM timed t LEFT JOIN counted c ON c.seq = t.seq AND t.action = 'copy' LEFT JOIN asked a ON a.seq = t.seq AND t.action = 'copy'),
        undone AS (SELECT r.seq, r.box_id, c.target_id FROM decided r JOIN counted c ON c.box_id = r.box_id AND c.seq < r.seq WHERE r.action = 'reset' AND NOT EXISTS (SELECT 1 FROM decided m WHERE m.box_id = r.box_id AND m.action = 'reset' AND m.seq > c.seq AND m.seq < r.seq)),
        codes AS (SELECT box_id, min(seq) AS first_seq, printf('PIN-%06d', row_number() OVER (ORDER BY min(seq), box_id)) AS item_code FROM decided WHERE action = 'approve' GROUP BY box_id)""",
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names) + "\n" + body

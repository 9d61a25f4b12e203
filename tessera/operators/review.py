"""Review as an append-only log of actions, settled into the state of boxes and items; merges, splits, validation and metadata changes.

actions(seq, action, box_id, target_id): approve, reject, reset, copy (of the item of box target_id), merge (a row for each box, under one seq) and
split. Order is seq; nothing is updated in place, and an action that isn't allowed changes nothing and comes out with a reason.

What came before an action is looked up within buckets of seq, with one carried value for each key and bucket, so that a hot box or item spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..functions.numbering import numbered
from ..functions.rounding import half_even
from ..functions.scoring import LIMITS, Limits, flags
from ..session import cut_lineage

DECISIONS = ("approve", "reject", "reset")
#: Rules for requests: longest texts, least sides of a box.
LONGEST = {"title": 300, "description": 5000, "category": 100, "subcategory": 100, "notes": 5000}
LEAST_SIDE = 4


def before(rows: DataFrame, key: str, value: Column, into: str, bucket: int = 10_000) -> DataFrame:
    """rows with column `into`: the last non-null value of the same key at an earlier seq."""
    rows = rows.withColumn("_b", F.floor(F.col("seq") / bucket)).withColumn("_v", value)
    inner = Window.partitionBy(key, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("seq"))).alias("_end"))
    carried = ends.select(key, "_b", F.last("_end", True).over(across).alias("_carried"))
    found = rows.withColumn("_near", F.last("_v", True).over(inner)).join(carried, [key, "_b"], "left")
    return found.withColumn(into, F.coalesce("_near", "_carried")).drop("_b", "_v", "_near", "_carried")


def replaced(actions: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id, gone_seq, status (merged, split) of boxes that an allowed merge or split has replaced. boxes: id, photo_id.

    A merge needs two boxes or more of one photo; no box may be approved or replaced before. Which merges happen depends on earlier ones that share a box, so each photo's merges and
    splits are folded in order, with the boxes that are gone. That group is one page.
    """
    decision = F.when(F.col("action").isin(*DECISIONS), F.col("action"))
    ends = before(actions, "box_id", decision, "last").where(F.col("action").isin("merge", "split"))
    ends = ends.join(boxes.select(F.col("id").alias("box_id"), "photo_id"), "box_id", "left")
    events = ends.groupBy("seq").agg(
        F.first("action").alias("action"), F.count("*").alias("n"), F.min("photo_id").alias("low"), F.max("photo_id").alias("high"), F.count("photo_id").alias("known"),
        F.every(F.coalesce(F.col("last") != "approve", F.lit(True))).alias("allowed"),
    )
    events = events.where((F.col("action") == "split") | ((F.col("n") >= 2) & (F.col("low") == F.col("high")) & (F.col("known") == F.col("n")))).where("allowed")
    members = ends.groupBy("seq").agg(F.collect_set("box_id").alias("ids"), F.max("photo_id").alias("photo_id"))
    events = events.select("seq", "action").join(members, "seq")
    # Merges and splits stay within a photo; a split of a box without a photo stands alone.
    page = F.struct("photo_id", F.when(F.col("photo_id").isNull(), F.get("ids", F.lit(0))).alias("alone"))
    pages = events.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("seq", "action", "ids"))).alias("all"))
    kind = "struct<lost:array<bigint>,took:array<struct<seq:bigint,action:string,ids:array<bigint>>>>"
    start = F.struct(F.array().cast("array<bigint>").alias("lost"), F.array().cast("array<struct<seq:bigint,action:string,ids:array<bigint>>>").alias("took")).cast(kind)

    def step(state: Column, event: Column) -> Column:
        taken = F.struct(F.concat(state["lost"], event["ids"]).alias("lost"), F.array_append(state["took"], event).alias("took")).cast(kind)
        return F.when(F.arrays_overlap(state["lost"], event["ids"]), state).otherwise(taken)

    done = pages.select(F.explode(F.aggregate("all", start, step)["took"]).alias("e"))
    done = done.select("e.seq", "e.action", F.explode("e.ids").alias("box_id"))
    return done.select("box_id", F.col("seq").alias("gone_seq"), F.when(F.col("action") == "merge", "merged").otherwise("split").alias("status"))


def settle(actions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every action (row) with `reason` (null: it took effect) and `undone` (of a reset: the box whose item loses a copy)."""
    gone = replaced(actions, boxes)
    rows = actions.join(gone.select("box_id", "gone_seq", F.col("status").alias("gone_as")), "box_id", "left")
    ends = F.col("action").isin("merge", "split")
    took = F.when(ends, F.coalesce(F.col("seq") == F.col("gone_seq"), F.lit(False))).otherwise(F.coalesce(F.col("seq") < F.col("gone_seq"), F.lit(True)))
    late = F.coalesce(F.col("seq") > F.col("gone_seq"), F.lit(False))
    rows = rows.withColumn("reason", F.when(~took, F.when(late, "already merged or split").otherwise("not allowed for these boxes")))
    live = F.col("reason").isNull()
    decision = F.when(live & F.col("action").isin(*DECISIONS), F.struct(F.col("seq").alias("since"), F.col("action").alias("did")))
    rows = before(rows, "box_id", decision, "own")
    # The target's item is in the catalogue if its last decision is an approval. Copies meet their targets' decisions under one key.
    copies = rows.where((F.col("action") == "copy") & live)
    decided = rows.where(decision.isNotNull()).select(F.col("box_id").alias("item"), "seq", F.col("action").alias("did"), F.lit(None).cast("long").alias("copy"))
    asked = copies.select(F.col("target_id").alias("item"), "seq", F.lit(None).cast("string").alias("did"), F.col("seq").alias("copy"))
    met = before(decided.unionByName(asked), "item", F.col("did"), "target_did").where("copy is not null")
    copies = copies.join(met.select(F.col("copy").alias("seq"), "target_did"), "seq")
    pending = F.coalesce(F.col("own.did") == "reset", F.col("own").isNull())
    good = copies.where(pending & F.coalesce(F.col("target_did") == "approve", F.lit(False)))
    # Of several copies since one decision the first takes the box off the queue.
    first = good.groupBy("box_id", F.coalesce("own.since", F.lit(-1)).alias("since")).agg(F.min("seq").alias("seq"))
    wrong = F.when(~pending, "only pending boxes can be copies").when(F.coalesce(F.col("target_did") != "approve", F.lit(True)), "target isn't in the catalogue").otherwise("only pending boxes can be copies")
    copies = copies.select("seq", wrong.alias("wrong")).join(first.select("seq", F.lit(True).alias("counted")), "seq", "left")
    rows = rows.join(copies, "seq", "left").withColumn("reason", F.coalesce("reason", F.when((F.col("action") == "copy") & F.col("counted").isNull(), F.col("wrong"))))
    # A reset takes back the copy that was counted since the last reset.
    mark = F.when(F.col("reason").isNull() & (F.col("action") == "copy"), F.col("target_id")).when(F.col("reason").isNull() & (F.col("action") == "reset"), F.lit(-1))
    rows = before(rows, "box_id", mark, "mark")
    undone = F.when(F.col("reason").isNull() & (F.col("action") == "reset") & (F.col("mark") >= 0), F.col("mark"))
    return cut_lineage(rows.select("seq", "action", "box_id", "target_id", "reason", undone.alias("undone")))


def box_state(settled: DataFrame) -> DataFrame:
    """box_id, status, copy_of (the box whose item it counts for) of every box in the log."""
    did = settled.where("reason is null")
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action").isin("reject", "copy"), "rejected").when(F.col("action") == "reset", "pending")
    status = F.coalesce(status, F.when(F.col("action") == "merge", "merged").otherwise("split"))
    mark = F.when(F.col("action") == "copy", F.col("target_id")).when(F.col("action") == "reset", F.lit(-1))
    state = did.groupBy("box_id").agg(F.max_by(status, "seq").alias("status"), F.max_by(mark, F.when(mark.isNotNull(), F.col("seq"))).alias("mark"))
    every = settled.select("box_id").distinct().join(state, "box_id", "left")
    return every.select("box_id", F.coalesce("status", F.lit("pending")).alias("status"), F.when(F.col("mark") >= 0, F.col("mark")).alias("copy_of"))


def permanent_codes(actions: DataFrame, last_code: int = 0) -> DataFrame:
    """box_id, first_seq, item_code: codes in order of each box's first approval, continuing after the last code; kept for good."""
    first = actions.where("action = 'approve'").groupBy("box_id").agg(F.min("seq").alias("first_seq"))
    rows = numbered(first, ["first_seq", "box_id"], "number", last_code + 1)
    return rows.select("box_id", "first_seq", t.item_code(F.col("number")).alias("item_code"))


def last_code(items: DataFrame, counter: int = 0) -> DataFrame:
    """One row, last_code: the counter, or the largest number among item codes if that is more, so that no code is used twice."""
    return items.agg(F.greatest(F.lit(counter).cast("long"), F.coalesce(F.max(t.code_number(F.col("item_code"))), F.lit(0))).alias("last_code"))


def item_state(settled: DataFrame, last: int = 0) -> DataFrame:
    """box_id, item_code, status, quantity of every item: made with quantity 1 by its box's first approval, restored by later ones, retired by reject and reset.

    A copy adds one to its target's quantity, and its undoing takes one off, but not below 0.
    """
    did = settled.where("reason is null")
    state = did.where(F.col("action").isin(*DECISIONS)).groupBy("box_id").agg((F.max_by("action", "seq") == "approve").alias("in_catalogue"))
    codes = permanent_codes(did, last)
    one = lambda n: F.lit(n).cast("long").alias("delta")
    made = codes.select(F.col("box_id").alias("item_id"), F.col("first_seq").alias("seq"), one(1))
    more = did.where("action = 'copy'").select(F.col("target_id").alias("item_id"), "seq", one(1))
    less = did.where("undone is not null").select(F.col("undone").alias("item_id"), "seq", one(-1))
    n = quantities(made.unionByName(more).unionByName(less)).withColumnRenamed("item_id", "box_id")
    rows = codes.join(state, "box_id").join(n, "box_id")
    return rows.select("box_id", "item_code", F.when(F.col("in_catalogue"), "approved").otherwise("rejected").alias("status"), "quantity")


def quantities(changes: DataFrame, bucket: int = 10_000) -> DataFrame:
    """item_id, quantity: ordered fold of changes(item_id, seq, delta) with a floor at 0, as a sum is wrong once the floor is reached.

    A fold is equal to sum + max(0, -lowest running sum). Both compose, so a hot item's changes are folded in buckets of seq and the buckets' pairs after.
    """
    rows = changes.withColumn("_b", F.floor(F.col("seq") / bucket))
    running = Window.partitionBy("item_id", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.withColumn("_sum", F.sum("delta").over(running)).groupBy("item_id", "_b").agg(F.sum("delta").alias("_total"), F.min("_sum").alias("_low"))
    earlier = Window.partitionBy("item_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_low", F.col("_low") + F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    return parts.groupBy("item_id").agg((F.sum("_total") + F.greatest(F.lit(0), -F.min("_low"))).cast("long").alias("quantity"))


def to_approve(boxes: DataFrame, flags: str = "flags", skip_flagged: bool = True) -> DataFrame:
    """Pending boxes, without flagged ones if these are to be skipped."""
    rows = boxes.where("status = 'pending'")
    return rows.where(F.coalesce(F.size(flags), F.lit(0)) == 0) if skip_flagged else rows


def reference_areas(new: DataFrame, boxes: DataFrame, least: int = 3) -> DataFrame:
    """key, typical: median area of the pending and approved boxes of each new box's photo, but for those in `without` (ids), along with the parts of the same split before it; null under `least` of them.

    new: key, photo_id, without, event, part, box. A page's boxes meet its new ones.
    """
    live = boxes.where(F.col("status").isin("pending", "approved")).select("photo_id", F.col("id").alias("_id"), g.area(F.col("box")).alias("_size"))
    others = new.select("key", "photo_id", "without").join(live, "photo_id").where(~F.array_contains("without", F.col("_id"))).select("key", "_size")
    a, b = new.select("key", "event", "part").alias("a"), new.select("event", "part", g.area(F.col("box")).alias("_size")).alias("b")
    parts = a.join(b, (F.col("a.event") == F.col("b.event")) & (F.col("b.part") < F.col("a.part"))).select("a.key", "b._size")
    return others.unionByName(parts).groupBy("key").agg(F.when(F.count("*") >= least, F.median(F.col("_size").cast("double"))).alias("typical"))


def marked(new: DataFrame, boxes: DataFrame, sizes: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """new (key, photo_id, without, event, part, box) with `flags` against boxes as they are before. sizes: photo_id, width, height."""
    rows = new.join(reference_areas(new, boxes), "key", "left").join(sizes.select("photo_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "photo_id")
    return rows.withColumn("flags", flags(F.col("box"), F.col("_w"), F.col("_h"), F.col("typical"), limits=limits)).drop("typical", "_w", "_h")


def _with(boxes: DataFrame, fresh: DataFrame) -> DataFrame:
    """boxes and fresh ones, which have null in columns that they lack."""
    return boxes.unionByName(fresh.select(*(c for c in boxes.columns if c in fresh.columns)), allowMissingColumns=True)


def with_new_boxes(boxes: DataFrame, new: DataFrame, status: str, first_id: int, sizes: DataFrame | None = None) -> DataFrame:
    """boxes after merges or splits: parents get the status, and new boxes (photo_id, box, confidence, parent_ids and, of a split, part) come as pending, with ids from first_id in order of photo and box.

    With sizes (photo_id, width, height) new boxes get flags against the photo's other boxes, without their parents; the second half of a split sees the first.
    """
    order = ["photo_id", "box.x", "box.y", "box.width", "box.height"]
    fresh = numbered(new, order, "id", first_id)
    fresh = fresh.withColumns({"status": F.lit("pending"), "origin": F.lit({"merged": "merge"}.get(status, status))})
    if sizes is not None:
        part = F.col("part") if "part" in new.columns else F.lit(0)
        fresh = marked(fresh.withColumns({"key": F.col("id"), "without": F.col("parent_ids"), "event": F.element_at("parent_ids", 1), "part": part}), boxes, sizes).drop("key", "without", "event")
    parents = new.select(F.explode("parent_ids").alias("id"), F.lit(True).alias("_parent")).distinct()
    old = boxes.join(parents, "id", "left").withColumn("status", F.when(F.col("_parent"), status).otherwise(F.col("status"))).select(*boxes.columns)
    return _with(old, fresh)


def checked_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """boxes clipped to their photo, with `error` where the request or what is left of it is no usable box (null: fine)."""
    box = F.col("box")
    asked = F.when((box["x"] < 0) | (box["y"] < 0), "negative corner").when((box["width"] <= 0) | (box["height"] <= 0), "no width or height")
    clipped = g.clip(box, width, height)
    small = F.when((clipped["width"] < LEAST_SIDE) | (clipped["height"] < LEAST_SIDE), "too small")
    return boxes.withColumn("error", F.coalesce(asked, small)).withColumn("box", clipped)


def change_errors(changes: DataFrame) -> DataFrame:
    """Metadata changes with `errors`: names of the fields that are too long or negative, in order of name; empty if the change is valid."""
    bad = {n: F.length(n) > most for n, most in LONGEST.items() if n in changes.columns}
    bad |= {n: F.col(n) < 0 for n in ("quantity", "purchase_price", "selling_price") if n in changes.columns}
    return changes.withColumn("errors", F.array_compact(F.array(*(F.when(bad[n], F.lit(n)) for n in sorted(bad)))))


def edited(boxes: DataFrame, edits: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """boxes with the boxes of edits (id, box) put in; merged and split ones can't be edited and stay.

    With sizes (photo_id, width, height) an edit is clipped to its photo, left out if it is no usable box (checked_boxes gives the reason), and flagged against the photo's other boxes as
    they were: each edit without its own box only.
    """
    if sizes is None:
        rows = boxes.alias("b").join(edits.select("id", F.col("box").alias("_new")).alias("e"), "id", "left")
        new = F.when(~F.col("status").isin("merged", "split"), F.col("_new"))
        return rows.withColumn("box", F.coalesce(new, F.col("box"))).select(*boxes.columns)
    open_ = boxes.where(~F.col("status").isin("merged", "split")).select("id", "photo_id")
    asked = edits.select("id", "box").join(open_, "id").join(sizes, "photo_id")
    asked = checked_boxes(asked, F.col("width"), F.col("height")).where("error is null").select("id", "photo_id", "box")
    keyed = asked.select(F.col("id").alias("key"), "photo_id", F.array("id").alias("without"), F.col("id").alias("event"), F.lit(0).alias("part"), "box")
    done = marked(keyed, boxes, sizes).select(F.col("key").alias("id"), F.col("box").alias("_box"), F.col("flags").alias("_flags"), F.lit(True).alias("_edited"))
    rows = boxes.join(done, "id", "left").withColumn("box", F.coalesce("_box", "box"))
    if "flags" in boxes.columns:
        rows = rows.withColumn("flags", F.when(F.col("_edited"), F.col("_flags")).otherwise(F.col("flags")))
    return rows.select(*boxes.columns)


def with_manual(boxes: DataFrame, drawn: DataFrame, first_id: int, sizes: DataFrame) -> DataFrame:
    """boxes and those that were drawn by hand (photo_id, box): clipped to their photo (sizes: photo_id, width, height), pending, with full confidence and flags, ids from first_id in order of photo and box.

    What is no usable box of a known photo is left out; checked_boxes gives the reason.
    """
    order = ["photo_id", "box.x", "box.y", "box.width", "box.height"]
    fine = checked_boxes(drawn.select("photo_id", "box").join(sizes, "photo_id"), F.col("width"), F.col("height")).where("error is null").select("photo_id", "box")
    fresh = numbered(fine, order, "id", first_id)
    fresh = fresh.withColumns({"key": F.col("id"), "without": F.array().cast("array<bigint>"), "event": F.col("id"), "part": F.lit(0)})
    fresh = marked(fresh, boxes, sizes).withColumns({"status": F.lit("pending"), "origin": F.lit("manual"), "confidence": F.lit(1.0)})
    return _with(boxes, fresh)


def upsert_names(known: DataFrame, names: DataFrame, first_id: int) -> DataFrame:
    """id, name: a dimension (categories or tags) with new names added, once each in any case of A-Z, numbered from first_id in that order."""
    key = t.nocase(F.col("name"))
    new = names.where("name is not null").groupBy(key.alias("key")).agg(F.min("name").alias("name"))
    new = new.join(known.select(key.alias("key")), "key", "left_anti")
    new = numbered(new, ["key"], "id", first_id)
    return known.select("id", "name").unionByName(new.select("id", "name"))


def merge_boxes(chosen: DataFrame) -> DataFrame:
    """merge_id, box (union), confidence (largest), parent_ids (ascending) from rows merge_id, id, box, confidence; two boxes at least."""
    by = chosen.groupBy("merge_id").agg(
        F.min("box.x").alias("x"), F.min("box.y").alias("y"), F.max(F.col("box.x") + F.col("box.width")).alias("x2"), F.max(F.col("box.y") + F.col("box.height")).alias("y2"),
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("id")).alias("parent_ids"),
    )
    by = by.where(F.size("parent_ids") >= 2)
    return by.select("merge_id", g.box(F.col("x"), F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("box"), "confidence", "parent_ids")


def split_in_halves(boxes: DataFrame, direction: str | None = None) -> DataFrame:
    """What with_new_boxes makes of splits: photo_id, box, confidence, parent_ids, part of both halves of each box that may be split (pending or rejected); boxes with a half without width or height stay whole."""
    rows = split_boxes(boxes.where(F.col("status").isin("pending", "rejected")), direction)
    whole = rows.groupBy("id").agg(F.every("valid").alias("_valid")).where("_valid").select("id")
    rows = rows.join(whole, "id").join(boxes.select("id", "photo_id", "confidence"), "id")
    return rows.select("photo_id", "box", "confidence", F.array("id").alias("parent_ids"), "part")


def split_boxes(boxes: DataFrame, direction: str | None = None) -> DataFrame:
    """id, part (0 or 1), box, valid: both halves of each box; a half without width or height isn't valid."""
    rows = boxes.select("id", F.posexplode(g.halves(F.col("box"), direction)).alias("part", "box"))
    return rows.withColumn("valid", (F.col("box.width") > 0) & (F.col("box.height") > 0))


def apply_changes(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with metadata changes by id: null means unchanged, texts are trimmed, an empty category or a clear_ flag removes, tags replace, prices round to cents."""
    names = [c for c in ("title", "description", "notes", "subcategory") if c in changes.columns]
    c = lambda n: F.col(f"c.{n}")
    i = lambda n: F.col(f"i.{n}")
    new: dict[str, Column] = {n: F.coalesce(t.stripped(c(n)), i(n)) for n in names}
    if "category" in changes.columns:
        new["category"] = F.when(c("category").isNull(), i("category")).otherwise(t.blank_to_null(c("category")))
    if "tags" in changes.columns:
        new["tags"] = F.coalesce(t.clean_tags(c("tags")), i("tags"))
    if "quantity" in changes.columns:
        new["quantity"] = F.coalesce(c("quantity"), i("quantity"))
    for n in ("selling_price", "purchase_price"):
        if n in changes.columns:
            cents = F.coalesce(half_even(c(n), 2), i(n))
            new[n] = F.when(F.coalesce(c(f"clear_{n}"), F.lit(False)), None).otherwise(cents) if f"clear_{n}" in changes.columns else cents
    rows = items.alias("i").join(changes.alias("c"), F.col("i.id") == F.col("c.id"), "left")
    return rows.select(*(new[n].alias(n) if n in new else i(n) for n in items.columns))

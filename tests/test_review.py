"""The settled review log against one action after the other in plain Python; new boxes, names and checks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import text as t
from tessera.functions.rounding import half_even
from tessera.functions.settings import load_limits, load_settings
from tessera.operators import review


def one_by_one(log, photo):
    status, copy_of, item, quantity, order, refused = {}, {}, {}, {}, [], set()
    for seq, action, ids, target in log:
        now = [status.get(i, "pending") for i in ids]
        b = ids[0]
        gone = any(s in ("merged", "split") for s in now)
        if action in ("merge", "split"):
            fine = all(s in ("pending", "rejected") for s in now) and (action == "split" or (len(ids) > 1 and len({photo[i] for i in ids}) == 1))
            if not fine:
                refused |= {(seq, i) for i in ids}
            for i in ids if fine else ():
                status[i] = {"merge": "merged", "split": "split"}[action]
        elif gone or (action == "copy" and (now[0] != "pending" or item.get(target) != "approved")):
            refused.add((seq, b))
        elif action == "approve":
            status[b] = item[b] = "approved"
            if b not in quantity:
                quantity[b] = 1
                order.append(b)
        elif action == "copy":
            status[b], copy_of[b] = "rejected", target
            quantity[target] += 1
        else:
            status[b] = "rejected" if action == "reject" else "pending"
            if b in item:
                item[b] = "rejected"
            if action == "reset" and b in copy_of:
                quantity[copy_of[b]] = max(0, quantity[copy_of[b]] - 1)
                del copy_of[b]
    return status, copy_of, item, quantity, order, refused


@pytest.mark.parametrize("bucket", [10_000, 7])
def test_log_is_settled_in_order(spark, monkeypatch, bucket):
    rng = random.Random(bucket)
    plain = review.before
    monkeypatch.setattr(review, "before", lambda rows, key, value, into: plain(rows, key, value, into, bucket))
    boxes = list(range(1, 31))
    photo = {b: b // 4 for b in boxes}
    log = []
    for seq in range(600):
        action = rng.choices(["approve", "reject", "reset", "copy", "merge", "split"], [30, 15, 30, 40, 1, 1])[0]
        b = rng.choice(boxes)
        ids = sorted(set(rng.sample(boxes, 2) if rng.random() < 0.3 else [b, min(b + 1, 30)])) if action == "merge" else [b]
        log.append((seq, action, ids, rng.choice(boxes) if action == "copy" else None))
    status, copy_of, item, quantity, order, refused = one_by_one(log, photo)
    assert len(refused) > 50 and "merged" in status.values() and "split" in status.values() and len(copy_of) > 0
    rows = spark.createDataFrame([(s, a, i, x) for s, a, ids, x in log for i in ids], "seq long, action string, box_id long, target_id long").repartition(3)
    settled = review.settle(rows, spark.createDataFrame(list(photo.items()), "id long, photo_id long")).cache()
    assert {(r["seq"], r["box_id"]) for r in settled.where("reason is not null").collect()} == refused and settled.count() == rows.count()
    seen = {i for _, _, ids, _ in log for i in ids}
    assert {r["box_id"]: (r["status"], r["copy_of"]) for r in review.box_state(settled).collect()} == {i: (status.get(i, "pending"), copy_of.get(i)) for i in seen}
    got = {r["box_id"]: (r["item_code"], r["status"], r["quantity"]) for r in review.item_state(settled, 41).collect()}
    assert got == {b: (f"PIN-{42 + k:06d}", item[b], quantity[b]) for k, b in enumerate(order)}


def test_copies_start_from_one(spark):
    log = [(1, "approve", 1, None), (2, "copy", 2, 1), (3, "copy", 3, 1)]
    rows = spark.createDataFrame(log, "seq long, action string, box_id long, target_id long")
    boxes = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "id long, photo_id long")
    assert [r["quantity"] for r in review.item_state(review.settle(rows, boxes)).collect()] == [3]


def test_merged_boxes_and_manual_ones(spark):
    kind = "id long, photo_id long, box struct<x:int,y:int,width:int,height:int>, confidence double, status string, origin string"
    boxes = spark.createDataFrame([(1, 1, (0, 0, 10, 10), 0.5, "pending", "auto"), (2, 1, (20, 5, 10, 10), 0.9, "rejected", "auto"), (3, 2, (0, 0, 5, 5), 0.1, "approved", "auto")], kind)
    merged = review.merge_boxes(boxes.where("photo_id = 1").withColumnRenamed("photo_id", "merge_id")).withColumnRenamed("merge_id", "photo_id")
    after = {r["id"]: r for r in review.with_new_boxes(boxes, merged, "merged", 9).collect()}
    assert [after[i]["status"] for i in (1, 2, 3, 9)] == ["merged", "merged", "approved", "pending"] and tuple(after[9]["box"]) == (0, 0, 30, 15) and after[9]["origin"] == "merge" and after[9]["confidence"] == 0.9
    sizes = spark.createDataFrame([(1, 100, 80), (2, 100, 80)], "photo_id long, width int, height int")
    drawn = spark.createDataFrame([(2, (1, 2, 13, 14)), (2, (95, 70, 40, 40)), (2, (-1, 0, 20, 20)), (2, (90, 90, 20, 20)), (5, (1, 1, 9, 9))], "photo_id long, box struct<x:int,y:int,width:int,height:int>")
    flagged = boxes.withColumn("flags", F.array(F.lit("old")))
    new = {r["id"]: r for r in review.with_manual(flagged, drawn, 7, sizes).where("id >= 7").collect()}
    assert {i: tuple(r["box"]) for i, r in new.items()} == {7: (1, 2, 13, 14), 8: (95, 70, 5, 10)}  # clipped, and without what is no usable box
    assert all((r["status"], r["origin"], r["confidence"]) == ("pending", "manual", 1.0) for r in new.values())
    assert new[7]["flags"] == ["touches_border"] and new[8]["flags"] == ["touches_border"] and "flags" not in review.with_manual(boxes, drawn, 7, sizes).columns
    halves = review.split_in_halves(flagged)
    split = {r["id"]: r for r in review.with_new_boxes(flagged, halves, "split", 20, sizes).collect()}
    assert [split[i]["status"] for i in (1, 2, 3)] == ["split", "split", "approved"] and {r["origin"] for i, r in split.items() if i >= 20} == {"split"} and len(split) == 7
    kept = {r["id"]: r for r in review.edited(flagged, spark.createDataFrame([(1, (50, 50, 80, 9)), (2, (5, 5, 1, 1))], "id long, box struct<x:int,y:int,width:int,height:int>"), sizes).collect()}
    assert tuple(kept[1]["box"]) == (50, 50, 50, 9) and kept[1]["flags"] == ["touches_border", "extreme_aspect"] and tuple(kept[2]["box"]) == (20, 5, 10, 10) and kept[2]["flags"] == ["old"]
    edits = spark.createDataFrame([(1, (9, 9, 9, 9)), (3, (8, 8, 8, 8))], "id long, box struct<x:int,y:int,width:int,height:int>")
    rows = boxes.withColumn("status", F.when(F.col("id") == 3, "split").otherwise(F.col("status")))
    assert {r["id"]: r["box"]["x"] for r in review.edited(rows, edits).collect()} == {1: 9, 2: 20, 3: 0}


def test_flags_leave_out_a_boxs_own_parents(spark):
    """Each new box is compared with the page's others: an edit without its own old box only, the second half of a split with the first."""
    rows = [(i, 1, (10 + 100 * i, 50, side, side), 0.5, "pending", "auto", []) for i, side in enumerate((20, 20, 24, 80))]
    boxes = spark.createDataFrame(rows, "id long, photo_id long, box struct<x:int,y:int,width:int,height:int>, confidence double, status string, origin string, flags array<string>")
    sizes = spark.createDataFrame([(1, 1000, 800)], "photo_id long, width int, height int")
    edits = spark.createDataFrame([(0, (10, 50, 70, 70)), (3, (310, 50, 30, 30))], "id long, box struct<x:int,y:int,width:int,height:int>")
    got = {r["id"]: r["flags"] for r in review.edited(boxes, edits, sizes).collect()}
    # 0: others 400, 576, 6400, so 4900 is large; 3: others 400, 400, 576, so 900 is fine.
    assert got == {0: ["large"], 1: [], 2: [], 3: []}
    halves = review.split_in_halves(boxes.where("id = 3"))
    split = [r["flags"] for r in review.with_new_boxes(boxes, halves, "split", 10, sizes).where("id >= 10").orderBy("id").collect()]
    assert split == [["large"], ["large"]]  # 3200 against 400, 400, 576, and then with 3200 too
    merged = review.merge_boxes(boxes.where("id < 2").withColumn("merge_id", F.col("photo_id"))).withColumnRenamed("merge_id", "photo_id")
    assert review.with_new_boxes(boxes, merged, "merged", 10, sizes).where("id = 10").first()["flags"] == ["extreme_aspect"]  # two others are too few for a median


def test_rounding_is_of_the_binary_value(spark):
    rng = random.Random(11)
    values = [2.675, 0.5745, 0.125, 0.375, 2.5, 1.005, -2.675, 0.0, -0.5, 1e15 + 0.5, 1e17, 2.665, 1.115, 0.285, *(rng.uniform(-1e4, 1e4) for _ in range(300)), *(rng.randint(0, 10**6) / 1000 + 0.0005 for _ in range(700)), *(rng.randint(0, 10**5) / 64 for _ in range(200))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3, 5):
        got = df.select("v", half_even(F.col("v"), digits).alias("r")).collect()
        assert all(r["r"] == round(r["v"], digits) for r in got), digits


def test_white_space_goes_at_the_ends(spark):
    texts = ["\t New \n", "\u3000x\xa0", " \x1c ", "", "a b", "\x85y\u2003"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(t.stripped(F.col("t"))).collect()]
    assert got == [x.strip() for x in texts]


def test_names_are_added_once(spark):
    known = spark.createDataFrame([(1, "Farm"), (2, "sea")], "id long, name string")
    names = spark.createDataFrame([("FARM",), ("Owl",), ("owl",), ("Élan",), (None,)], "name string")
    got = {(r["id"], r["name"]) for r in review.upsert_names(known, names, 10).collect()}
    assert got == {(1, "Farm"), (2, "sea"), (10, "Owl"), (11, "Élan")}


def test_strict_variants_are_errors(spark):
    row = spark.range(1)
    assert row.select(t.item_code(F.lit(0))).first()[0] is None
    with pytest.raises(Exception, match="start at 1"):
        row.select(t.item_code(F.lit(0), strict=True)).collect()
    empty = g.box(1, 1, 0, 5)
    assert row.select(g.padded(empty, 100, 100)).first()[0] is None
    with pytest.raises(Exception, match="empty box"):
        row.select(g.padded(empty, 100, 100, strict=True)).collect()
    assert row.select(g.padded(g.box(10, 10, 10, 10), 100, 100, strict=True)["width"]).first()[0] == 12


def test_settings(tmp_path, caplog):
    path = tmp_path / "limits.toml"
    path.write_text("iou = 0.5\nunknown = 1\n[quality]\nmin_area = 1\n")
    limits = load_limits(str(path), flag_aspect=3)
    assert (limits.iou, limits.min_area, limits.flag_aspect, limits.max_area) == (0.5, 1.0, 3.0, 0.2) and "unknown" in caplog.text
    assert load_limits(str(tmp_path / "none.toml")).iou == 0.45
    path.write_text("iou = [1]\n")
    with pytest.raises(ValueError, match="iou"):
        load_limits(str(path))


def test_settings_of_all_types(tmp_path, caplog):
    path = tmp_path / "all.toml"
    path.write_text('data_dir = "pictures"\nstrange = 2\n[crops]\nTHUMBNAIL_SIZE = "250"\nsquare_crops = false\npadding_percent = 7\n[web]\ncatalog_title = "Owls"\npublish_dir = ""\niou = 0.4\n')
    got = load_settings(str(path), catalog_subtitle="all of them")
    assert (got.data_dir, got.publish_dir, got.thumbnail_size, got.square_crops, got.padding_percent) == (str(tmp_path / "pictures"), None, 250, False, 7.0)
    assert isinstance(got.padding_percent, float) and (got.catalog_title, got.catalog_subtitle, got.html_include_notes) == ("Owls", "all of them", False)
    assert "strange" in caplog.text and "iou" not in caplog.text and load_limits(str(path)).iou == 0.4
    for wrong in ('square_crops = "yes"', "thumbnail_size = true", 'padding_percent = "much"', "thumbnail_size = [1]"):
        path.write_text(wrong)
        with pytest.raises(ValueError, match=wrong.split()[0] if "much" not in wrong else "much"):
            load_settings(str(path))
    assert load_settings(str(tmp_path / "none.toml")) == load_settings()

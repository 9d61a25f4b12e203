"""Folder scan, duplicates in batch and stream, and export sinks."""

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.sources import exports, photos
from tessera.streaming.ingest import ingest_available


def folder(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / name.replace("__", ".")).write_bytes(data)
    return str(tmp_path)


def test_scan_and_batch_duplicates(spark, tmp_path):
    where = folder(tmp_path, b__JPG=b"1", a__png=b"2", __hidden__jpg=b"3", notes__txt=b"4", c__jpeg=b"1")
    found = photos.scan(spark, where)
    assert [r["name"] for r in found.collect()] == ["a.png", "b.JPG", "c.jpeg"]
    known = photos.hashed(found).where("name = 'a.png'").select("sha256")
    got = {r["name"]: r["outcome"] for r in photos.classified(found, known).collect()}
    assert got == {"a.png": "duplicate", "b.JPG": "new", "c.jpeg": "duplicate"}
    assert {r["duplicates"] for r in photos.first_copies(found).collect()} == {0, 1}


def test_stream_takes_each_content_once(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    folder(inbox, a__png=b"1", b__png=b"1", c__png=b"2")
    sink = lambda df, _: seen.extend(r["sha256"] for r in df.collect())
    ingest_available(spark, str(inbox), str(tmp_path / "ck"), sink).awaitTermination(120)
    assert len(seen) == 2
    folder(inbox, d__png=b"2", e__png=b"3")
    ingest_available(spark, str(inbox), str(tmp_path / "ck"), sink).awaitTermination(120)
    assert len(seen) == len(set(seen)) == 3


def test_free_names(spark):
    taken = {("a", "jpg"): {2, 3, 6}, ("c", "png"): {1, 2}}
    wanted = [("a", "jpg", i) for i in range(5)] + [("b", "jpg", 9), ("c", "png", 1), ("a", "png", 4)]
    rows = [(*k, n) for k, numbers in taken.items() for n in numbers]
    got = {(r["stem"], r["extension"], r["seq"]): r["name"] for r in photos.free_names(spark.createDataFrame(wanted, "stem string, extension string, seq long"), spark.createDataFrame(rows, "stem string, extension string, number long")).collect()}
    for stem, ext, seq in wanted:  # one after the other, the first that is free
        used, n = taken.setdefault((stem, ext), set()), 1
        while n in used:
            n += 1
        used.add(n)
        assert got[stem, ext, seq] == (f"{stem}.{ext}" if n == 1 else f"{stem}_{n}.{ext}")


def test_batch_outcomes(spark):
    jpeg = b"\xff\xd8\xff"
    files = [("A.jpg", jpeg + b"1"), ("b.jpg", jpeg + b"1"), ("c.png", b"\x89PNG2"), ("d.jpg", b"not an image"), ("e.jpg", b"not an image"), ("f.webp", b"RIFF1234WEBPx"), ("g.heic", b"1234ftypheic"), ("h.jpg", jpeg + b"old")]
    df = spark.createDataFrame(files, "name string, content binary")
    known = photos.hashed(df.where("name = 'h.jpg'")).select("sha256")
    outcomes = photos.ingested(df, known)
    got = {r["name"]: r["outcome"] for r in outcomes.collect()}
    assert got == {"A.jpg": "imported", "b.jpg": "duplicate", "c.png": "imported", "d.jpg": "error", "e.jpg": "error", "f.webp": "imported", "g.heic": "imported", "h.jpg": "duplicate"}
    found = spark.createDataFrame([("A.jpg", 3), ("c.png", 4), ("d.jpg", 9)], "name string, detections long")
    assert tuple(photos.batch_report(outcomes, found).first()) == (4, 2, 2, 7)
    assert tuple(photos.batch_report(outcomes.limit(0)).first()) == (0, 0, 0, 0)


def sample(spark):
    """Rows of master(): three approved ones and one rejected, with quotes, commas, accents, line feeds and nulls where a reader may stumble."""
    entry = lambda hex_, name: F.struct(F.lit(hex_).alias("hex"), F.lit(name).alias("name"), F.lit(0.25).alias("share"))
    n = F.col("id")
    pick = lambda *values: F.get(F.array(*(F.lit(x) for x in values)), n.cast("int"))
    return spark.range(4).select(
        (n + 11).alias("id"), F.format_string("PIN-%06d", n + 11).alias("item_code"), (n % 2 + 5).alias("photo_id"), pick('Ruby "Owl", small', "Nördlich", "two\nlines", "gone").alias("title"), F.lit("").alias("description"),
        pick("Birds", None, "Maps", "Maps").alias("category"), F.lit("sub").alias("subcategory"), F.array(entry("#112233", "navy"), entry("#445566", "teal"), entry("#000080", "navy")).alias("colors"), pick("private", "", "", "").alias("notes"),
        n.cast("int").alias("quantity"), pick(7.5, None, 0.25, 1.0).alias("selling_price"), pick(1.0, 2.0, None, 3.0).alias("purchase_price"), F.array(F.lit("owl"), F.lit("red gem")).alias("tags"),
        pick(40, 0, None, 5).cast("int").alias("width_px"), pick(30, 20, 10, 5).cast("int").alias("height_px"), pick("crops/11.png", None, "", None).alias("crop_path"), F.lit(None).cast("string").alias("transparent_path"),
        F.lit("2023-07-09T08:00:00+00:00").alias("created_at"), F.when(n == 3, "rejected").otherwise("approved").alias("status"), F.lit("scan.png").alias("source_filename"), pick("Page 5", None, "", None).alias("source_page"),
        F.struct(n.alias("x")).alias("source_box"),
    )


def text_of(path, pattern="part-*"):
    return "".join(open(f, newline="", encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(path, pattern))))


def test_exports(spark, tmp_path):
    rows = sample(spark).coalesce(1)
    paths = exports.export_all(rows, str(tmp_path), "2024-02-03T04:05:06+00:00", title="Owls", publish_to=str(tmp_path / "public"))
    assert sorted(paths) == ["csv", "html", "json"]
    text = text_of(paths["csv"])
    assert text.startswith("\ufeffpin_code,title,") and text.endswith("\r\n")
    records = [r for r in csv.DictReader(io.StringIO(text.replace("\ufeff", ""), newline="")) if r["pin_code"] != "pin_code"]
    assert [r["title"] for r in records] == ['Ruby "Owl", small', "Nördlich", "two\nlines"]
    assert [r["price"] for r in records] == ["7.50", "", "0.25"] and [r["width_px"] for r in records] == ["40", "", ""] and records[0]["colors"] == "navy, teal" and len(records[0]) == 19
    document = json.loads(text_of(paths["json"]))
    assert document["exported_at"] == "2024-02-03T04:05:06+00:00" and document["count"] == 3 and [p["pin_code"] for p in document["pins"]] == ["PIN-000011", "PIN-000012", "PIN-000013"]
    assert document["pins"][1]["tags"] == ["owl", "red gem"] and document["pins"][1]["source_image_id"] == 6 and len(document["pins"][1]["colors"]) == 3
    script = text_of(paths["html"]).strip()
    gallery = json.loads(script.removeprefix("window.CATALOG = ").removesuffix(";"))
    assert gallery["title"] == "Owls" and len(script.splitlines()) == 5
    assert [p["code"] for p in gallery["pins"]] == ["PIN-000011", "PIN-000012", "PIN-000013"] and "private" not in script and "purchase_price" not in script
    assert [p["page"] for p in gallery["pins"]] == ["Page 5", "scan.png", "scan.png"]
    lines = exports.gallery_script(catalog.public_record(rows.where("status = 'approved'")), "Owls")
    version = exports.version(lines).first()["version"]
    assert version == exports.version(lines.repartition(5)).first()["version"] and len(version) == 12
    changed = [lines.withColumn("text", F.regexp_replace("text", "Owl", "owl")), lines.withColumn("line", F.lit(5) - F.col("line")), lines.where("line <> 1")]
    assert len({version, *(exports.version(c).first()["version"] for c in changed)}) == 4
    page = exports.gallery_page(lines, '<title>{{TITLE}}</title><p>{{SUBTITLE}}{{OTHER}}<script src="c.js?v={{VERSION}}">', "Owls & 'Co'", "<b>").first()["text"]
    assert page == f'<title>Owls &amp; &#x27;Co&#x27;</title><p>&lt;b&gt;{{{{OTHER}}}}<script src="c.js?v={version}">'
    exports.publish(spark, paths["html"], str(tmp_path / "public"))  # its own earlier export may be replaced
    other = tmp_path / "other"
    other.mkdir()
    (other / "diary.txt").write_text("mine")
    with pytest.raises(RuntimeError, match="no export"):
        exports.publish(spark, paths["html"], str(other))
    assert (other / "diary.txt").read_text() == "mine"
    with pytest.raises(ValueError, match="xml"):
        exports.export_all(rows, str(tmp_path), "", formats=["xml"])


def test_copies_and_removals(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]))
    files = spark.createDataFrame([(str(tmp_path / f"{i}.bin"), str(tmp_path / "to" / f"{i}.bin")) for i in range(5)], "source string, target string").repartition(3)
    assert exports.copied(files).count() == 5 and (tmp_path / "to" / "3.bin").read_bytes() == b"\x03"
    gone = spark.createDataFrame([(str(tmp_path / "to" / "3.bin"),), (str(tmp_path / "to" / "9.bin"),)], "path string")
    assert exports.removed(gone).count() == 2 and not (tmp_path / "to" / "3.bin").exists() and (tmp_path / "to" / "2.bin").exists()


def test_incremental_copy(spark):
    wanted = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name string, modified long")
    existing = spark.createDataFrame([("a", 5), ("b", 4), ("z", 1)], "name string, modified long")
    assert {r["name"] for r in exports.to_copy(wanted, existing).collect()} == {"b", "c"}
    assert {r["name"] for r in exports.orphans(existing, wanted).collect()} == {"z"}


def test_paths_of_files_are_kept(spark, tmp_path):
    assert os.path.basename(photos.scan(spark, folder(tmp_path, q__webp=b"1")).first()["path"]) == "q.webp"

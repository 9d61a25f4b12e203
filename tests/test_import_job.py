"""An import run that is watched while it goes on."""

import os
import threading
import time

import pytest

from tessera.sources import photos
from tessera.streaming.job import IngestJob

JPEG = b"\xff\xd8\xff"


def test_progress_outcomes_and_reports(spark, tmp_path):
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    for k in range(12):
        (inbox / f"p{k:02d}.jpg").write_bytes(JPEG + bytes([k % 9]))
        os.utime(inbox / f"p{k:02d}.jpg", (1_000_000_000 + k,) * 2)  # the stream takes files by age
    (inbox / "x.png").write_bytes(b"no image")
    (inbox / "notes.txt").write_bytes(b"no photo")
    job = IngestJob(spark, str(inbox), state, files_per_batch=4)
    assert job.results().count() == 0 and not job.status()["running"]
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append(job.status())
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    assert job.start() and not job.start()  # one run at a time
    assert job.wait(240)
    for _ in range(200):
        if not job.status()["running"]:
            break
        time.sleep(0.05)
    stop.set()
    watcher.join()
    last = job.status()
    assert (last["total"], last["index"], last["imported"], last["duplicates"], last["errors"], last["error"]) == (13, 13, 9, 3, 1, None)
    running = [s for s in seen if s["running"] and 0 < s["imported"] + s["duplicates"] + s["errors"] < 13]
    assert running and all(s["total"] == 13 for s in running)  # known while the run went on
    reports = {r["name"]: (r["outcome"], r["message"]) for r in job.results().collect()}
    assert len(reports) == 13 and reports["p00.jpg"] == ("imported", "") and reports["x.png"] == ("error", "Not a readable image.")
    assert reports["p09.jpg"] == ("duplicate", "Already imported as 'p00.jpg'.")
    (inbox / "new.jpg").write_bytes(JPEG + b"\x02")
    (inbox / "other.jpg").write_bytes(JPEG + b"fresh")
    assert job.start() and job.wait(240)
    now = job.status()
    assert (now["total"], now["imported"], now["duplicates"]) == (2, 1, 1) and job.results().count() == 15
    job.close()


def test_a_run_that_breaks_off_says_so(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(JPEG)
    job = IngestJob(spark, str(tmp_path / "in"), str(tmp_path / "state"))

    def broken(files, batch):
        raise ValueError("the disk is full")

    job._batch = broken
    assert job.start() and job.wait(240)
    assert not job.status()["running"] and "the disk is full" in job.status()["error"]
    job.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        IngestJob(spark, str(tmp_path / "nowhere"), str(tmp_path / "state2")).start()


def test_failed_detections_have_a_status_and_a_message(spark):
    files = spark.createDataFrame([("a.jpg", JPEG + b"1"), ("b.jpg", JPEG + b"1"), ("c.jpg", JPEG + b"2"), ("d.jpg", JPEG + b"3"), ("e.jpg", b"zz")], "name string, content binary")
    known = spark.createDataFrame([], "sha256 string, name string")
    runs = spark.createDataFrame([("a.jpg", 3, None), ("c.jpg", None, "too dark")], "name string, detections long, error string")
    got = {r["name"]: r for r in photos.with_detections(photos.reported(files, known), runs).collect()}
    assert {n: (r["outcome"], r["message"], r["detections"], r["status"], r["error_message"]) for n, r in got.items()} == {
        "a.jpg": ("imported", "3 candidate pins", 3, "processed", None), "b.jpg": ("duplicate", "Already imported as 'a.jpg'.", 0, None, None),
        "c.jpg": ("error", "Imported, but detection failed: too dark", 0, "error", "too dark"), "d.jpg": ("imported", "", 0, "pending", None), "e.jpg": ("error", "Not a readable image.", 0, None, None),
    }

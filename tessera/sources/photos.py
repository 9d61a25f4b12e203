"""Photos from a folder: scan, content hash, first copies, and the split of a batch into new and known files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Image extensions.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp", "heic", "heif")


def named(files: DataFrame) -> DataFrame:
    """Adds name to a binaryFile table and keeps visible images, in any case of the extension."""
    rows = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.where(~F.startswith("name", F.lit(".")) & F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*EXTENSIONS) & F.contains("name", F.lit(".")))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Images at the top level of a folder with their content, in order of lower-case name."""
    return named(spark.read.format("binaryFile").load(folder)).orderBy(F.lower("name"), "name")


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def first_copies(files: DataFrame) -> DataFrame:
    """sha256, name (first of its copies), duplicates: a grouped minimum, so that a file with very many copies is reduced before the shuffle."""
    return hashed(files).groupBy("sha256").agg(F.min("name").alias("name"), (F.count("*") - 1).alias("duplicates"))


# First bytes of image formats, in hex.
SIGNATURES = ("FFD8FF", "89504E47", "47494638", "424D", "49492A00", "4D4D002A")


def readable(content: F.Column) -> F.Column:
    """True if the content begins like an image: one of the signatures, a WebP or a HEIF container."""
    head = F.hex(F.substring(content, 1, 12))
    plain = F.lit(False)
    for s in SIGNATURES:
        plain = plain | F.startswith(head, F.lit(s))
    return plain | (F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250"))) | (F.substring(head, 9, 8) == "66747970")


def examined(files: DataFrame) -> DataFrame:
    """name, sha256, fine (it begins like an image) of files (name, content): all that an import needs of contents, read once."""
    return hashed(files).select("name", "sha256", readable(F.col("content")).alias("fine"))


def ingested(files: DataFrame, known: DataFrame) -> DataFrame:
    """name, sha256, outcome of a batch: `duplicate` of a known or earlier file, `error` if it is no image (it isn't recorded, so its copies are errors too), else `imported`."""
    rows = files if "fine" in files.columns else examined(files)
    rows = classified(rows, known).join(rows.select("name", "fine"), "name")
    rows = rows.join(known.select("sha256").distinct().withColumn("known", F.lit(True)), "sha256", "left")
    outcome = F.when(F.coalesce("known", F.lit(False)), "duplicate").when(~F.col("fine"), "error").when(F.col("outcome") == "new", "imported").otherwise("duplicate")
    return rows.select("name", "sha256", outcome.alias("outcome"))


def reported(files: DataFrame, known: DataFrame) -> DataFrame:
    """name, sha256, outcome, message of a batch: ingested() with what a duplicate is a copy of (known: sha256, name; else the first file of the batch), and why a file is an error."""
    rows = ingested(files, known)
    first = known.groupBy("sha256").agg(F.min("name").alias("original"))
    own = rows.where("outcome = 'imported'").select("sha256", F.col("name").alias("own"))
    rows = rows.join(first, "sha256", "left").join(own, "sha256", "left")
    copied = F.concat(F.lit("Already imported as '"), F.coalesce("original", "own"), F.lit("'."))
    message = F.when(F.col("outcome") == "duplicate", copied).when(F.col("outcome") == "error", "Not a readable image.").otherwise("")
    return rows.select("name", "sha256", "outcome", message.alias("message"))


def with_detections(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """reports with detections, and status and error_message of the photo: imported ones are `processed`, or `error` if their detection failed (they stay recorded, so their copies are duplicates); others have no status.

    runs: name, detections, error (null: it went well). The outcome of a photo whose detection failed is an error too, with a message; those without a run yet are `pending`.
    """
    rows = reports.join(runs.select("name", "detections", F.col("error").alias("_error"), F.lit(True).alias("_ran")), "name", "left")
    imported, failed = F.col("outcome") == "imported", F.col("_error").isNotNull()
    said = F.concat(F.lit("Imported, but detection failed: "), F.col("_error"))
    found = F.concat(F.coalesce("detections", F.lit(0)).cast("string"), F.lit(" candidate pins"))
    status = F.when(imported, F.when(failed, "error").when(F.col("_ran"), "processed").otherwise("pending"))
    return rows.select(
        "name", "sha256", F.when(imported & failed, "error").otherwise(F.col("outcome")).alias("outcome"), F.when(imported & failed, said).when(imported & F.col("_ran"), found).otherwise(F.col("message")).alias("message"),
        F.when(imported & ~failed, F.coalesce("detections", F.lit(0))).otherwise(0).cast("long").alias("detections"), status.alias("status"), F.when(imported, F.col("_error")).alias("error_message"),
    )


def batch_report(outcomes: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """One row: imported, duplicates, errors, detections of a batch. detections: name, detections."""
    counts = {"imported": "imported", "duplicates": "duplicate", "errors": "error"}
    found = outcomes.join(detections, "name", "left") if detections is not None else outcomes.withColumn("detections", F.lit(0))
    some = F.when(F.col("outcome") == "imported", F.col("detections"))
    return found.agg(*(F.count_if(F.col("outcome") == o).alias(n) for n, o in counts.items()), F.coalesce(F.sum(some), F.lit(0)).cast("long").alias("detections"))


def classified(files: DataFrame, known: DataFrame) -> DataFrame:
    """name, sha256, outcome of a batch: `duplicate` if the hash is known or an earlier file of the batch (by lower-case name) has it, else `new`."""
    rows = (files if "sha256" in files.columns else hashed(files)).select("name", "sha256")
    first = rows.groupBy("sha256").agg(F.min_by("name", F.struct(F.lower("name"), F.col("name"))).alias("first"))
    seen = known.select("sha256").distinct().withColumn("known", F.lit(True))
    rows = rows.join(first, "sha256").join(seen, "sha256", "left")
    new = F.col("known").isNull() & (F.col("name") == F.col("first"))
    return rows.select("name", "sha256", F.when(new, "new").otherwise("duplicate").alias("outcome"))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """stem, extension, seq -> name: the first free name of stem.ext, stem_2.ext, stem_3.ext ... for each wanted file in order of seq.

    taken: stem, extension, number (1: without a number). Free numbers are the gaps between taken ones and all after them; a gap is a range, and the
    n-th file finds its gap by the count of free numbers before it, so that nothing is tried out.
    """
    key = ["stem", "extension"]
    order = Window.partitionBy(*key).orderBy("number")
    used = taken.select(*key, "number").where("number >= 1").distinct().unionByName(wanted.select(*key).distinct().withColumn("number", F.lit(0).cast("long")))
    gaps = used.withColumn("until", F.lead("number").over(order)).withColumn("free", F.coalesce(F.col("until") - F.col("number") - 1, F.lit(1 << 60)))
    gaps = gaps.withColumn("before", F.coalesce(F.sum("free").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("free > 0")
    rows = wanted.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("seq")))
    rows = rows.join(gaps, key).where((F.col("_rank") > F.col("before")) & (F.col("_rank") <= F.col("before") + F.col("free")))
    number = F.col("number") + F.col("_rank") - F.col("before")
    suffix = F.when(number == 1, "").otherwise(F.concat(F.lit("_"), number.cast("string")))
    return rows.select(*key, "seq", F.concat("stem", suffix, F.lit("."), "extension").alias("name"))

"""Export sinks: CSV, JSON, a gallery's catalogue script and its version, incremental copies, publishing, and all of them as one export."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numbering import numbered
from ..operators import catalog
from ..session import cut_lineage

FORMATS = ("csv", "json", "html")
#: A folder with this file was made by an export and may be replaced.
MARKER = ".tessera-export"


def csv_line(fields: Sequence[Column]) -> Column:
    """One CSV line: fields with a comma, a quote or a line end are quoted, and quotes in them doubled. Line ends in fields stay as they are."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    plain = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.concat_ws(",", *(F.when(c.rlike('[,"\\r\\n]'), quoted(c)).otherwise(c) for c in plain))


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat records of approved rows of master(): a byte-order mark, a header, CRLF line ends. The part files, one after the other, are the document."""
    flat = catalog.flat_record(rows.where("status = 'approved'"))
    head = rows.sparkSession.createDataFrame([("", "\ufeff" + ",".join(flat.columns))], "code string, text string")
    lines = head.unionByName(flat.select(F.col("pin_code").alias("code"), csv_line([F.col(c) for c in flat.columns]).alias("text")))
    lines.orderBy("code").select("text").write.option("lineSep", "\r\n").text(path)


def full_record(rows: DataFrame) -> DataFrame:
    """pin_code, record: the flat record as JSON with arrays of tags and colours, the source box and the photo's id."""
    more = rows.select(F.col("item_code").alias("pin_code"), F.col("tags").alias("tag_list"), F.col("colors").alias("color_list"), "source_box", F.col("photo_id").alias("source_image_id"))
    flat = catalog.flat_record(rows).join(more, "pin_code").drop("tags", "colors").withColumnsRenamed({"tag_list": "tags", "color_list": "colors"})
    return flat.select("pin_code", F.to_json(F.struct(*flat.columns), {"ignoreNullFields": "false"}).alias("record"))


def json_document(records: DataFrame, exported_at: str) -> DataFrame:
    """line, text: the lines of one document {exported_at, count, pins} around one record a line, so that no task holds the document."""
    n = records.agg(F.count("*").alias("count"))
    rows = numbered(records, ["pin_code"], "line")
    body = rows.crossJoin(F.broadcast(n)).select("line", F.concat(F.lit("  "), "record", F.when(F.col("line") < F.col("count"), ",").otherwise("")).alias("text"))
    head = n.select(F.lit(0).cast("long").alias("line"), F.concat(F.lit("{"), F.lit('"exported_at": '), F.to_json(F.array(F.lit(exported_at))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(exported_at)))) - 2), F.lit(', "count": '), F.col("count").cast("string"), F.lit(', "pins": [')).alias("text"))
    return head.unionByName(body).unionByName(n.select((F.col("count") + 1).alias("line"), F.lit("]}").alias("text")))


def write_json(rows: DataFrame, path: str, exported_at: str) -> None:
    """The document of approved rows of master(); the part files, one after the other, are the document."""
    lines = json_document(full_record(rows.where("status = 'approved'")), exported_at)
    lines.orderBy("line").select("text").write.text(path)


def gallery_script(records: DataFrame, title: str) -> DataFrame:
    """line, text: the lines of the script `window.CATALOG = {title, pins};` around one public record a line in order of code, so that no task holds the script. records: item_code, record."""
    n = records.agg(F.count("*").alias("count"))
    rows = numbered(records.select("item_code", "record"), ["item_code"], "line")
    body = rows.crossJoin(F.broadcast(n)).select("line", F.concat("record", F.when(F.col("line") < F.col("count"), ",").otherwise("")).alias("text"))
    quoted = F.to_json(F.array(F.lit(title)))
    head = n.select(F.lit(0).cast("long").alias("line"), F.concat(F.lit('window.CATALOG = {"title":'), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(',"pins":[')).alias("text"))
    return head.unionByName(body).unionByName(n.select((F.col("count") + 1).alias("line"), F.lit("]};").alias("text")))


def version(lines: DataFrame) -> DataFrame:
    """One row, version: 12 hex digits that change with any line (line, text) of a document or its place. Lines are digested along with their numbers, and the digests added up bit by bit."""
    digest = F.sha2(F.concat(F.col("line").cast("string"), F.lit(":"), "text"), 256)
    parts = [F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("long")).alias(f"p{at}") for at in (1, 16, 31)]
    sums = lines.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.substring(F.sha2(F.concat_ws(":", "n", "p1", "p16", "p31"), 256), 1, 12).alias("version"))


def gallery_page(lines: DataFrame, template: str, title: str, subtitle: str = "") -> DataFrame:
    """One row, text: the gallery's page from its template, whose {{TITLE}}, {{SUBTITLE}} and {{VERSION}} are filled in; the version makes browsers load the script of these lines."""
    return version(lines).select(t.filled(F.lit(template), {"TITLE": F.lit(title), "SUBTITLE": F.lit(subtitle), "VERSION": F.col("version")}).alias("text"))


def to_copy(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (name, modified) whose target is missing or older."""
    older = existing.select("name", F.col("modified").alias("done"))
    return wanted.join(older, "name", "left").where(F.col("done").isNull() | (F.col("done") < F.col("modified"))).drop("done")


def orphans(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing files that no record wants any more."""
    return existing.join(wanted.select("name"), "name", "left_anti")


def copied(files: DataFrame) -> DataFrame:
    """source, target of files (URIs or paths that all executors see), each copied by the task that holds its row."""

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for source, target in zip(frame["source"], frame["target"], strict=True):
                there, path = fs.FileSystem.from_uri(target)
                there.create_dir(path.rsplit("/", 1)[0])
                fs.copy_files(source, target)
            yield frame

    return files.select("source", "target").mapInPandas(copy, "source string, target string")


def removed(files: DataFrame) -> DataFrame:
    """path of files, each deleted by the task that holds its row; one that is gone already is no error."""

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for uri in frame["path"]:
                there, path = fs.FileSystem.from_uri(uri)
                if there.get_file_info(path).type != fs.FileType.NotFound:
                    there.delete_file(path)
            yield frame

    return files.select("path").mapInPandas(remove, "path string")


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Replace the target folder by the source; RuntimeError if the target holds files and no marker of an earlier export."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(source)
    there = old.getFileSystem(conf)
    if there.exists(old) and len(there.listStatus(old)) and not there.exists(jvm.org.apache.hadoop.fs.Path(old, MARKER)):
        raise RuntimeError(f"{target} holds files that no export has written")
    there.delete(old, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(new.getFileSystem(conf), new, there, old, False, conf)
    there.create(jvm.org.apache.hadoop.fs.Path(old, MARKER), True).close()


def export_all(rows: DataFrame, folder: str, exported_at: str, formats: Sequence[str] = FORMATS, title: str = "", publish_to: str | None = None) -> dict[str, str]:
    """Write approved rows of master() below a folder in each format; the paths by format, and what kept the gallery from being published as `warning`."""
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}")
    approved = cut_lineage(rows.where("status = 'approved'"))
    paths = {f: f"{folder.rstrip('/')}/catalog.{f}" for f in FORMATS if f in formats}
    if "csv" in paths:
        write_csv(approved, paths["csv"])
    if "json" in paths:
        write_json(approved, paths["json"], exported_at)
    if "html" in paths:
        gallery_script(catalog.public_record(approved), title).orderBy("line").select("text").write.text(paths["html"])
        if publish_to:
            try:
                publish(rows.sparkSession, paths["html"], publish_to)
            except RuntimeError as e:
                paths["warning"] = str(e)
    return paths

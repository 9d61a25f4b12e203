"""Incremental ingestion of a folder: every available image once, each content hash once for good."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..sources import photos

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def new_photos(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of name, sha256 of images whose content hasn't come before. The hashes seen are state without a watermark, as a copy may come at any time."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    return photos.hashed(photos.named(files)).select("name", "sha256").dropDuplicates(["sha256"])


def ingest_available(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is in the folder now and stop; the checkpoint remembers files and hashes for the next call."""
    stream = new_photos(spark, folder).withColumn("imported_at", F.date_trunc("second", F.current_timestamp()))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()

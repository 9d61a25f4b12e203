"""Token-id files: patched frame-of-reference blocks in Parquet shards, with an index of block starts.

File format. A file set is a Parquet table with one row per run of consecutive documents:

    shard      long            number of the shard, ascending with doc_id
    run        long            number of the run within its shard
    doc_ids    array<long>     documents of the run, ascending
    lengths    array<int>      ids of each document, end id included
    starts     array<int>      byte offset of each block in payload
    payload    binary          the blocks, one after the other

A block holds up to BLOCK ids:

    u32 minimum, u16 count, u8 width, u8 0, u16 number of exceptions, u16 0
    packed      ceil(count * width / 8) bytes: (id - minimum) mod 2**width, little-endian bit order
    positions   u16 for each exception
    high parts  u32 for each exception: (id - minimum) >> width

width is the smallest at which at least the PERCENTILE of the block's ids need no exception.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 4096
PERCENTILE = 90
#: Ids gathered in a run before it is written: bounds memory and what a reader must load for one block.
RUN_IDS = 1 << 18
_HEAD = np.dtype([("minimum", "<u4"), ("count", "<u2"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2"), ("zero2", "<u2")])
FILE_SCHEMA = "shard long, run long, doc_ids array<long>, lengths array<int>, starts array<int>, payload binary"


@lru_cache(maxsize=64)
def _bit_places(count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte in which each of count packed ids begins, and the bit within it."""
    at = np.arange(count) * width
    return at >> 3, (at & 7).astype(np.uint64)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65535 ids below 2**32; width 0 (all but exceptions equal) stores no packed bits."""
    ids = np.asarray(ids, dtype=np.uint32)
    low = ids.min()
    rest = ids - low
    nth = max(0, -(-len(rest) * percentile // 100) - 1)
    width = int(np.partition(rest, nth)[nth]).bit_length()
    out = np.flatnonzero(rest > (1 << width) - 1)
    head = np.zeros(1, dtype=_HEAD)
    head["minimum"], head["count"], head["width"], head["exceptions"] = low, len(ids), width, len(out)
    if width:
        low_bytes = rest.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : -(-width // 8)]
        planes = np.unpackbits(low_bytes, axis=1, bitorder="little")[:, :width]
        packed = np.packbits(planes.ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    high = (rest[out].astype(np.uint64) >> np.uint64(width)).astype("<u4")
    return head.tobytes() + packed + out.astype("<u2").tobytes() + high.tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    """The ids of the block that begins at byte `at`."""
    head = np.frombuffer(data, dtype=_HEAD, count=1, offset=at)[0]
    count, width, outliers = int(head["count"]), int(head["width"]), int(head["exceptions"])
    at += _HEAD.itemsize
    ids = np.zeros(count, dtype=np.uint64)
    if width:
        size = -(-count * width // 8)
        packed = np.zeros(size + 4, dtype=np.uint64)  # an id's bits begin in one byte and end at most four bytes later
        packed[:size] = np.frombuffer(data, dtype=np.uint8, count=size, offset=at)
        first, shift = _bit_places(count, width)
        for i in range(-(-(width + 7) // 8)):
            ids |= packed[first + i] << np.uint64(8 * i)
        ids = (ids >> shift) & np.uint64((1 << width) - 1)
        at += size
    positions = np.frombuffer(data, dtype="<u2", count=outliers, offset=at)
    high = np.frombuffer(data, dtype="<u4", count=outliers, offset=at + 2 * outliers)
    ids[positions] |= high.astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(head["minimum"])).astype(np.uint32)


def encode_run(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[list[int], bytes]:
    """Byte offsets of the blocks, and the payload."""
    starts, parts, at = [], [], 0
    for i in range(0, len(ids), block):
        parts.append(encode_block(ids[i : i + block], percentile))
        starts.append(at)
        at += len(parts[-1])
    return starts, b"".join(parts)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write the ids in ascending order of id_col.

    Rows are range-partitioned and sorted by id_col (each output task gets one range, so shards ascend); a null or empty
    text gives the end id alone; repeated ids each get their own stream, in any order; a null id comes first. An
    empty table writes an empty file set. Columns other than the two are not read.
    """
    common.bound_batches(docs.sparkSession)
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).withColumn("shard", F.spark_partition_id().cast("long"))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, names, lengths, parts, total, shard = tokens.encoder(vocabulary), 0, [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            starts, payload = encode_run(np.frombuffer(b"".join(parts), dtype="<u4"))
            columns = [[shard], [number], [list(names)], [list(lengths)], [starts], [payload]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "run", "doc_ids", "lengths", "starts", "payload"])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if len(doc_ids):
                shard = batch.column(2)[0].as_py()
            for a, b in common.text_chunks(common.byte_lengths(texts), tokens.CHUNK):
                for name, ids in zip(doc_ids[a:b], encoder.many(texts[a:b]), strict=True):
                    names.append(name)
                    parts.append(ids + end)
                    lengths.append(len(parts[-1]) // 4)
                    total += lengths[-1]
                    if total >= RUN_IDS:
                        yield row()
                        number, names, lengths, parts, total = number + 1, [], [], [], 0
        if names:
            yield row()

    ranged.mapInArrow(runs, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, shard, run, n (place within its run), ids (binary, little-endian unsigned 32-bit)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = [decode_block(row["payload"], at) for at in row["starts"]]
                data = np.concatenate(blocks or [np.zeros(0, np.uint32)]).astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)]) * 4
                n = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int64()), pa.array([row["run"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                        pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "shard", "run", "n", "ids"],
                )

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(documents, "doc_id long, shard long, run long, n int, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (as unsigned 32-bit)."""
    from pyspark.sql import Window

    rows = read(spark, path).select("doc_id", "shard", "run", "n", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    totals = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("ids"))
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("run", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents to a file set in the shared folder, read it back and derive each document's digest."""
    path = common.new_path(spark, "token_files")
    write(common.documents(spark, sf_dir), path, tokens.default_vocabulary())
    return digests(spark, path)

"""Helpers shared by the corpus operators: shared-folder tables, prefix sums, words and component labels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space as the contracts define it: space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Rows of a narrow table up to which small() broadcasts it.
BROADCAST_ROWS = 1_000_000

#: Rows of a batch that goes to Python, at most.
BATCH_ROWS = 1000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one temporary folder per process, but only if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tessera-"))
        base = _own_folder[0]
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Let no batch that goes to Python hold more than BATCH_ROWS rows (a smaller setting stays): rows of texts may be long, and each task holds a few batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what was written outlives any executor, and everything that reads it twice
    (counts and then rows, for instance) sees the same rows in the same files.
    """
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A stored number of each row, for stages that must tell rows apart whose ids are null or repeated.
ROW = "_row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a unique long in column _row, stored, so that everything that reads it sees the same numbers."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def byte_lengths(texts: pa.Array) -> list[int]:
    """UTF-8 bytes of each string, 0 for a null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def text_chunks(sizes: Sequence[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of consecutive texts of at most limit bytes together; a longer text has its own range."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_text(df: DataFrame, new: str, make: Callable[[], Callable[[list[str | None]], list[Sequence]]], keep: Sequence[str] = ("doc_id",), chunk: int = 1 << 20) -> DataFrame:
    """Columns `keep`, unchanged, and the new ones (a schema string) that are computed from column text.

    make() is called once in each task; what it returns gets texts of at most chunk bytes together (or one longer text) and gives
    the values of each new column. Kept columns pass as Arrow data, whatever their types and nulls.
    """
    bound_batches(df.sparkSession)
    schema = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(new).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts, kept = batch.column(len(keep)), batch.columns[: len(keep)]
            for a, b in text_chunks(byte_lengths(texts), chunk):
                values = compute(texts[a:b].to_pylist())
                arrays = [c[a:b] for c in kept] + [pa.array(list(v), f.type) for v, f in zip(values, list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, apart: Sequence[str]) -> DataFrame:
    """Columns `apart` of df as they are, and all others in one struct _rest by their place, so that no name clashes with an operator's own."""
    rest = [column(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in apart]
    return df.select(*map(column, apart), F.struct(F.lit(0).alias("none"), *rest).alias("_rest"))


def unpacked(columns: Sequence[str], apart: Sequence[str]) -> list[Column]:
    """The columns that packed() was given, in their order, to select from rows with columns `apart` and _rest."""
    return [column(c) if c in apart else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(columns)]


def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A text in parts of `limit` characters or a little more, cut before ASCII white space, so that no word is split."""
    at = 0
    while len(text) - at > limit and (cut := _SPACE.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked to be broadcast if a count proves that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bitmaps of 32,768 row numbers (4 KB each) up to which kept() broadcasts them: 64 MB, for half a billion rows.
BITMAPS = 16_384


def kept(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of a numbered() table whose number is in column _row of `numbers`, without a shuffle of the rows: the numbers go to them as bitmaps, one bit for each row.

    Only beyond BITMAPS (counted) are rows joined by shuffle.
    """
    bitmaps = numbers.groupBy(F.bitmap_bucket_number(ROW).alias("_tessera_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("_tessera_bits"))
    bitmaps = stored(bitmaps, "bitmaps")
    if bitmaps.limit(BITMAPS + 1).count() > BITMAPS:
        return rows.join(numbers, ROW, "left_semi").select(*map(column, rows.columns))
    place = F.bitmap_bit_position(ROW)
    byte = F.conv(F.hex(F.substring("_tessera_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2
    joined = rows.withColumn("_tessera_bucket", F.bitmap_bucket_number(ROW)).join(F.broadcast(bitmaps), "_tessera_bucket")
    return joined.where(set_ == 1).select(*map(column, rows.columns))


def prefix_sums(df: DataFrame, sums: dict[str, str], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add the exclusive running sum of each column in `sums` (under the name it maps to) in the given order, per keys (or over all rows).

    No task gets a whole group: rows are range-partitioned by (keys, order), so that a hot key spans many
    partitions, and only one total for each (key, partition) is summed up across partitions. The order columns
    must identify a row within its key for a repeatable result; equal rows get sums in any order. Null values count as 0.
    """
    keys, order = list(keys), list(order)
    ranged = stored(
        df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in [*keys, *order])).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    amount = {into: F.coalesce(F.col(value), F.lit(0)).cast("long") for value, into in sums.items()}
    totals = ranged.groupBy("_part", *keys).agg(*(F.sum(a).alias(f"_total_{into}") for into, a in amount.items()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *keys, *(F.coalesce(F.sum(f"_total_{into}").over(before), F.lit(0)).alias(f"_base_{into}") for into in amount))
    within = Window.partitionBy("_part", *keys).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({f"_sum_{into}": F.coalesce(F.sum(a).over(within), F.lit(0)) for into, a in amount.items()})
    matches = F.col("l._part") == F.col("r._part")
    for k in keys:
        matches &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = summed.alias("l").join(bases.alias("r"), matches, "left")
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), *((F.col(f"_sum_{into}") + F.col(f"_base_{into}")).cast("long").alias(into) for into in amount))


def components(spark: SparkSession, links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """Label every node of an undirected link table with the smallest node it reaches: columns node, component.

    Alternates large-star and small-star steps (each a grouped minimum and a join), which need about log(n)
    rounds and never gather a component in one task: a hot node's links are reduced by partial aggregation.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    known = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("u").alias("x"), "m", F.col("v").alias("y"))
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("y").alias("u"), F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        # Links that a round leaves as they were are stars around the least node of each component.
        before, known = known, edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if known == before:
            break
    else:
        raise RuntimeError(f"component labels didn't settle in {rounds} rounds")
    nodes = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(nodes)


def count_words(text: str | None) -> int:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text; a null text has none. UTF-8 bytes split at the same places."""
    return sum(len(p.encode("utf-8", "surrogatepass").split()) for p in pieces(text)) if text else 0

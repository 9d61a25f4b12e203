"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def numbered(df: DataFrame, order: list[str | Column], into: str = "number", start: int | Column = 1) -> DataFrame:
    """Number rows from `start` in the given order, which must tell rows apart for repeatable results.

    Rows are dealt to ranges of the order, sorted and stored with their place, so nothing is shuffled again; of each range only its count meets the others in one running sum.
    Ranges follow the rows' own distribution, which a run over df finds out first: what is costly to work out twice is better stored before. They stay even at any size.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # Spark's increasing ids have the partition above the place in it.
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return ranged.join(F.broadcast(counts), "_part").withColumn(into, (F.col("_before") + F.col("_place") + first).cast("long")).drop("_part", "_place", "_before")

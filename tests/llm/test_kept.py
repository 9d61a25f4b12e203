"""Rows kept by bitmaps of their numbers; columns of spans."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing


@pytest.mark.parametrize("bound", [common.BITMAPS, 0])
def test_rows_are_kept_by_number(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BITMAPS", bound)
    rng = random.Random(2)
    rows = common.numbered(spark.range(100_000, numPartitions=3).withColumns({"a.b": F.col("id") * 2, "_bucket": F.lit("x")}), "rows")
    numbers = [r[common.ROW] for r in rows.select(common.ROW).collect()]
    chosen = sorted(rng.sample(numbers, 30_000)) + [numbers[0], numbers[-1]]
    chosen = sorted(set(chosen))
    kept = spark.createDataFrame([(n,) for n in chosen], f"{common.ROW} long").repartition(4)
    got = common.kept(rows, kept)
    assert got.columns == rows.columns and sorted(r[common.ROW] for r in got.select(common.ROW).collect()) == chosen
    assert common.kept(rows, kept.where("false")).count() == 0


def test_spans_have_the_documented_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", "t")], "doc_id long, text string, source string")
    _, spans = mixing.mix(docs, block=2, slots=3)
    assert spans.columns == ["shard", "slot", "source", "block_no", "doc_id", "row", "first_word", "n_words"]

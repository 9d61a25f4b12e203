"""Codes beyond six digits."""

from pyspark.sql import functions as F

from tessera.functions import text as t


def test_long_codes_are_hashed_whole(spark):
    def page(code):
        h = 0
        for ch in code:
            h = (h * 31 + ord(ch)) % 2**32
        return h

    codes = [f"PIN-{n:06d}" for n in (999_999, 1_000_000, 1_000_007, 1_200_000, 12_345_678)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "v string").coalesce(1).select(t.card_hash(F.col("v"))).collect()]
    assert got == [page(c) for c in codes] and len(set(got)) == len(codes)

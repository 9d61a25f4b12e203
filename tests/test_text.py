"""Text helpers: case folding, wildcards, tags, prices, codes, cards, flags and likeness."""

from pyspark.sql import functions as F

from tessera.functions import likeness, scoring
from tessera.functions import text as t
from tessera.operators import lookalikes, pixels


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_like(spark):
    assert values(spark, lambda c: t.contains_nocase(c, "RiNg"), "a Ring", "rung", "spRINGs") == [True, False, True]
    assert values(spark, lambda c: t.contains_nocase(c, "a\\b"), "xA\\By", "ab") == [True, False]
    assert values(spark, lambda c: t.contains_nocase(c, "r_ng"), "rong", "rng") == [True, False]
    assert values(spark, lambda c: t.contains_nocase(c, "É"), "é", "É") == [False, True]


def test_tags(spark):
    df = spark.createDataFrame([(["Cow", " flowers ", "cow", "", "Two   words"],)], "v array<string>")
    assert df.select(t.clean_tags(F.col("v"))).first()[0] == ["cow", "flowers", "two words"]
    long = spark.createDataFrame([(["x" * 60 + "a", "x" * 60 + "b"],)], "v array<string>")
    assert long.select(t.clean_tags(F.col("v"))).first()[0] == ["x" * 60, "x" * 60]


def test_codes_prices_and_escapes(spark):
    df = spark.createDataFrame([(42,), (1_000_000,), (0,)], "n long")
    assert [r[0] for r in df.select(t.item_code(F.col("n"))).collect()] == ["PIN-000042", "PIN-1000000", None]
    assert values(spark, t.code_number, "PIN-000042", "PIN-x") == [42, None]
    assert spark.range(1).select(t.price(F.lit(10.0)), t.price(F.lit(None).cast("double"))).first()[:] == ("10.00", "")
    assert values(spark, t.html_escaped, "<b>&") == ["&lt;b&gt;&amp;"]


def test_card_style(spark):
    def expected(code):
        h = 0
        for ch in code:
            h = (h * 31 + ord(ch)) % 2**32
        s = h - 2**32 if h >= 2**31 else h
        shifted = s >> 3
        rest = abs(shifted) % 7 * (1 if shifted >= 0 else -1)
        return h % 6, (rest - 3) * 0.5

    codes = [f"PIN-{n:06d}" for n in range(1, 200)]
    df = spark.createDataFrame([(c,) for c in codes], "v string")
    assert [tuple(r) for r in df.select(*t.card_style(F.col("v"))).collect()] == [expected(c) for c in codes]


def test_flag_texts(spark):
    row = spark.range(1).select(scoring.flag_texts(F.array(F.lit("small"), F.lit("odd")))).first()[0]
    assert row == [scoring.FLAG_TEXTS["small"], "odd"]


def test_likeness_bounds(spark):
    h = F.array(F.lit(0.25), F.lit(0.75))
    same = likeness.overall(likeness.hamming(F.lit(5), F.lit(7), F.lit(5), F.lit(7)), likeness.color(h, h))
    assert spark.range(1).select(same).first()[0] == 1.0
    assert spark.range(1).select(likeness.overall(F.lit(64), F.lit(0.0))).first()[0] == 0.0
    assert lookalikes.most_differing_bits(0.55) == 26


def test_perceptual_hash_matches_a_direct_transform(spark):
    import numpy as np

    side, size = 32, 8
    image = np.random.default_rng(1).integers(0, 256, (side, side)).astype(float)
    rows = [(1, x, y, float(image[y, x])) for y in range(side) for x in range(side)]
    got = pixels.perceptual_hash(spark.createDataFrame(rows, "photo_id long, x int, y int, gray double")).first()["bits"]
    k = np.arange(side)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / (2 * side)) * np.where(k[:, None] == 0, np.sqrt(1 / side), np.sqrt(2 / side))
    low = (basis @ image @ basis.T)[:size, :size].ravel()
    assert got == "".join("1" if v > np.median(low[1:]) else "0" for v in low)


def test_colours_alone_can_match(spark):
    """Equal histograms and opposite hashes score 0.45."""
    assert [lookalikes.most_differing_bits(t) for t in (0.4, 0.45, 1.0)] == [64, 64, 0]
    rows = [(1, 0, 0, [0.5, 0.5]), (2, 2**32 - 1, 2**32 - 1, [0.5, 0.5]), (3, 2**32 - 1, 2**32 - 1, [1.0, 0.0])]
    prints = spark.createDataFrame(rows, "id long, hi long, lo long, histogram array<double>")
    got = [tuple(r) for r in lookalikes.best_matches(prints.where("id = 1"), prints, threshold=0.4).collect()]
    assert got == [(1, 2, 1, 0.45)]
    assert {(r["id_a"], r["id_b"]) for r in lookalikes.similar_pairs(prints, threshold=0.4).collect()} == {(1, 2), (2, 3)}

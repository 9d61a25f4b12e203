"""Lookups that find nothing, normalised tables, times in whole seconds, grouped bounds of look-alikes."""

import random

import pytest

from tessera.operators import catalog, lookalikes
from tessera.streaming.ingest import ingest_available


def test_a_missing_row_is_an_error(spark):
    rows = spark.createDataFrame([(1, "PIN-000001")], "id long, item_code string")
    assert catalog.get(rows, "item_code", "pin-000001").first()["id"] == 1 and catalog.get(rows, "id", 1).count() == 1
    with pytest.raises(LookupError, match="no id 2"):
        catalog.get(rows, "id", 2)
    with pytest.raises(LookupError, match="no item_code pin-000009"):
        catalog.get(rows, "item_code", "pin-000009")


def test_categories_and_tags_by_their_tables(spark):
    items = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "id long, category_id long")
    categories = spark.createDataFrame([(7, "Owls"), (8, "Unused")], "id long, name string")
    assert {r["id"]: r["category"] for r in catalog.with_categories(items, categories).collect()} == {1: "Owls", 2: None, 3: None}
    tags = spark.createDataFrame([(1, "Night"), (2, "day")], "id long, name string")
    bridge = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 1)], "item_id long, tag_id long")
    assert sorted(r["id"] for r in catalog.tagged(items, bridge, tags, "NIGHT").collect()) == [1, 3]
    assert catalog.tagged(items, bridge, tags, "none").count() == 0


def test_import_times_are_whole_seconds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    seen = []
    ingest_available(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, _: seen.extend(r["imported_at"] for r in df.collect())).awaitTermination(120)
    assert len(seen) == 1 and seen[0].microsecond == 0


@pytest.mark.parametrize("threshold", [0.3, 0.55])
def test_bounds_lose_no_pair(spark, threshold):
    """All pairs by plain Python; histograms of a length that groups don't divide, some with half the total, some equal, some empty."""
    rng, rows = random.Random(4), []
    for i in range(120):
        values = [rng.random() ** 3 for _ in range(37)]
        total = sum(values) * (1 if i % 4 else 2)
        rows.append((i, rng.getrandbits(32), rng.getrandbits(32), [v / total for v in values]))
    rows += [(200 + i, *rows[i][1:]) for i in range(10)] + [(300, 0, 0, [0.0] * 37)]
    df = spark.createDataFrame(rows, "id long, hi long, lo long, histogram array<double>").repartition(3)
    want = {}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            bits = (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count()
            colors = 0.0
            for x, y in zip(a[3], b[3], strict=True):
                colors += min(x, y)
            score = 0.55 * max(0.0, ((1 - bits / 64) - 0.5) * 2) + 0.45 * colors
            if score >= threshold:
                want[min(a[0], b[0]), max(a[0], b[0])] = round(score, 3)
    got = {(r["id_a"], r["id_b"]): r["score"] for r in lookalikes.similar_pairs(df, threshold, blocks=5).collect()}
    assert got == want and len(got) >= 10

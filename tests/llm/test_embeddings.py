"""The vector index against brute force: copies, near copies, labels, and vectors that can't be compared."""

import numpy as np

from tessera.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, x string, times int"


def data():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        rows.append((rng.normal(size=24), i % 3))
    for i in range(60):  # near copies at distances around the limit
        v = rows[i][0]
        rows.append((v + rng.normal(size=24) * np.linalg.norm(v) * rng.uniform(0.02, 0.11), rows[i][1] if i % 4 else (i + 1) % 3))
    rows += [rows[0]] * 5 + [(rows[1][0] * 7, rows[1][1])]
    rows = [(i, [float(x) for x in v], int(c), "clash", 1) for i, (v, c) in enumerate(rows)]
    odd = [[float("nan")] * 24, [float("inf")] + [0.0] * 23, [0.0] * 24, [], None, [None] + [1.0] * 23]
    rows += [(1000 + i, v, 0, "clash", 1) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None, "clash", 1), (2001, rows[0][1][:8], 0, "clash", 1), (2002, rows[0][1][:8], 0, "clash", 1)]
    return rows


def brute(rows, least):
    usable = [(i, np.asarray(v, np.float32).astype(float), c) for i, v, c, *_ in rows if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, v, c) in enumerate(usable):
        for j, w, d in usable[:n]:
            if c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = data()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    found, want = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}, brute(rows, 0.93)
    assert sum(n for n, _ in found.values()) >= 0.95 * sum(n for n, _ in want.values())
    wrong = [i for i in want if found[i] != want[i]]
    assert len(wrong) <= 2, wrong
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_and_unusable(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = embeddings.near_duplicates(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)).collect()
    assert tuple(row) == (1, 0, 1, True)


def test_low_rank_vectors_beside_a_long_one(spark):
    """Vectors that vary in few directions, and one of many more components, must not shrink what is probed."""
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(4, 64))
    rows = []
    for i in range(700):
        v = rng.normal(size=4) @ basis
        rows.append(v)
        if i % 2:
            rows.append(v + (rng.normal(size=4) * rng.uniform(0.1, 0.35)) @ basis)
    rows = [(i, [float(x) for x in v], 1, "clash", 1) for i, v in enumerate(rows)] + [(5000, [1.0] * 512, 1, "clash", 1)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    unit = np.array([np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) for _, v, *_ in rows[:-1]])
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want)) and got[5000] == 0

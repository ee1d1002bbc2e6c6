import os

import numpy as np

from newsloom.llm.vectors import linked, near_vectors, quantise

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def brute(rows):
    """(n_links, component) per row, all pairs of a label in double precision."""
    unit = []
    for vec_id, x, label in rows:
        ok = x is not None and label is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)
        v = np.array(x, float) if ok else None
        v = v / np.abs(v).max() if ok else None
        unit.append(None if v is None else v / np.linalg.norm(v))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by = {}
    for k, (u, row) in enumerate(zip(unit, rows)):
        if u is not None:
            by.setdefault((row[2], len(u)), []).append(k)
    for ks in by.values():
        i, j = np.nonzero(np.triu(np.stack([unit[k] for k in ks]) @ np.stack([unit[k] for k in ks]).T >= 0.93, 1))
        for a, b in zip(i, j):
            a, b = ks[a], ks[b]
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[x] = y
    smallest = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            smallest[find(k)] = min(smallest.get(find(k), row[0]), row[0])
    return [(row[0], links[k], smallest[find(k)] if row[0] is not None else None) for k, row in enumerate(rows)]


def check(frame, **settings):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    got = near_vectors(frame, **settings).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_vectors(spark):
    frame = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet")
    check(frame)
    check(frame, tile=7, per_pivot=20)


def test_clusters_in_several_tiles(spark):
    random = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = random.normal(size=24)
        for _ in range(60):
            rows.append((len(rows), (centre + random.normal(scale=random.choice([0.02, 0.3]), size=24)).tolist(), c % 3))
    rows += [(len(rows) + k, rows[5][1], 0) for k in range(200)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=40, per_pivot=90)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.3], 1), (12, [1e300, 1.0], 1),
        (13, [1e-300, 0.0], 1), (14, [-0.0, 1.0], 2), (15, [0.0, 1.0], 2), (16, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, size int, raw string")
    check(frame)
    assert near_vectors(frame.limit(0)).count() == 0


def test_error_bounds_hold():
    random = np.random.default_rng(3)
    a = random.standard_t(2, size=(400, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    codes, scale, error = quantise(a)
    rough = (codes.astype(int) @ codes.astype(int).T) * scale[:, None] * scale
    assert (np.abs(rough - a @ a.T) <= error[:, None] + error + error[:, None] * error + 1e-9).all()
    i, j = linked(a, a, 0.8)
    assert set(zip(i, j)) == set(zip(*np.nonzero(a @ a.T >= 0.8)))

import numpy as np
from pyspark.sql import types as T

from stratawave.llm import vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.LongType())])


def brute(rows):
    n = np.zeros(len(rows), int)
    root = list(range(len(rows)))
    links = []
    for i, (_, a, la, _) in enumerate(rows):
        for j, (_, b, lb, _) in enumerate(rows):
            if i != j and la == lb and la is not None and a and b and len(a) == len(b) and None not in a and None not in b:
                x, y = np.array(a, float), np.array(b, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= vectors.NEAR:
                    links.append((i, j))
                    n[i] += 1
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    ids = [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]
    return sorted((r[0], int(k), c, r[0] == c) for r, k, c in zip(rows, n, ids, strict=True))


def test_links_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        base = rng.standard_normal(8).astype(np.float32)
        for k in range(rng.integers(1, 5)):
            near = (base + (0.08 * rng.standard_normal(8) if k else 0)).astype(np.float32)
            rows.append((len(rows), near.tolist(), i % 3 if i % 10 else None, 7))
    rows += [(1000, None, 1, 7), (1001, [0.0] * 8, 1, 7), (1002, [float("nan")] * 8, 1, 7), (1003, [float("inf")] * 8, 1, 7), (1004, [None] * 8, 1, 7), (1005, [], 1, 7), (1006, rows[0][1][:4], rows[1][2], 7)]
    rows += [(2000 + i, rows[11][1], rows[11][2], 7) for i in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got, recall = vectors.near_duplicates(frame, per_centre=20, overlap=3)
    assert recall >= vectors.RECALL
    assert sorted(tuple(r) for r in got.collect()) == brute([(a, [float(np.float32(x)) if x is not None else None for x in b] if b is not None else None, c, d) for a, b, c, d in rows])


def test_dense_group_is_reached(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    x = base / np.linalg.norm(base) + 0.1 * rng.standard_normal((300, 64)) / 8
    starts, to = vectors.both_ways(vectors.pruned(x / np.linalg.norm(x, axis=1, keepdims=True)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = sum(len(q) for q, _ in vectors.search(unit, starts, to, np.arange(300)))
    assert found == (unit @ unit.T >= vectors.NEAR).sum() - 300


def test_group_over_many_shards_is_completed(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(32)
    x = base / np.linalg.norm(base) + 0.13 * rng.standard_normal((4000, 32)) / np.sqrt(32)
    x = np.concatenate([x, rng.standard_normal((500, 32))]).astype(np.float32)
    rows = [(i, v.tolist(), 1, 7) for i, v in enumerate(x)] + [(5000 + i, x[i].tolist(), 2, 7) for i in range(30)]
    got, recall = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), per_centre=100)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= vectors.NEAR
    got = {r["vec_id"]: r for r in got.collect()}
    assert recall == 1.0
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    small = near[:30, :30].sum(axis=1) - 1
    assert [got[5000 + i]["n_links"] for i in range(30)] == small.tolist()
    root = np.arange(len(x))
    a, b = np.nonzero(near)
    assert [got[i]["component_id"] for i in range(len(x))] == vectors._roots(len(x), a, b)[root].tolist()


def test_empty(spark):
    got, recall = vectors.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and recall == 1.0

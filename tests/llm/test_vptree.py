from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from treeline.llm.vptree import PRODUCTION_FACTOR, Regions, VPTree, nearest

SCHEMA = "vec_id long, embedding array<double>"


def brute(ids, points, queries, k):
    out = []
    for q in queries:
        d = np.sqrt(((points[ids == q][0] - points) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out += [(int(q), r + 1, int(ids[i]), float(d[i])) for r, i in enumerate(order)]
    return out


def data(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim))
    points[n // 2 : n // 2 + n // 5] = points[0]  # a third-like group of copies
    return np.arange(n), points


def test_factor_one_is_exact_with_ties():
    ids, points = data(700, 6)
    dist, found = VPTree(ids, points, leaf=16).search(ids[:50], points[:50], 7, 1.0)
    want = brute(ids, points, ids[:50], 7)
    assert [(int(q), int(v)) for q, row in zip(ids[:50], found, strict=True) for v in row] == [(q, v) for q, _, v, _ in want]
    assert np.allclose(dist.ravel(), [s for *_, s in want])


def test_query_matches_brute_force_and_recall(spark):
    ids, points = data(900, 16)
    rows = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points, strict=True)], SCHEMA)
    asks = rows.where("vec_id % 100 = 0")
    exact = sorted(tuple(r) for r in nearest(rows, asks, 10, 1.0, shard_rows=200, block_queries=4, leaf=32).collect())
    want = brute(ids, points, [i for i in ids if i % 100 == 0], 10)
    assert [r[:3] for r in exact] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in exact], [r[3] for r in want])
    loose = {r[:3:2] for r in map(tuple, nearest(rows, asks, 10, PRODUCTION_FACTOR, shard_rows=200).collect())}
    assert len(loose & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in nearest(df, df.where("vec_id = 0"), 10).collect()] == [(0, 1, 1, 1.0)]
    assert nearest(df.limit(0), df.limit(0)).collect() == []


def test_repeated_queries_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 2), (2, [2.0, 0.0], 3), (3, [9.0, 9.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = [tuple(r) for r in nearest(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_regions_hold_every_point_and_bound_it():
    _, points = data(600, 5)
    regions = Regions(np.arange(200), points[:200], 9)
    home = regions.place(points)
    assert regions.n == 9 and set(home) <= set(range(9))
    slack = regions.slack(points[:40])
    for q in range(40):
        dist = np.sqrt(((points[q] - points) ** 2).sum(1))
        assert all(slack[q, r] <= dist[home == r].min() + 1e-9 for r in set(home))


def test_clustered_vectors_skip_regions_and_long_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 300)) * 50
    points = np.concatenate([c + rng.normal(size=(40, 300)) for c in centres])
    tree = VPTree(np.arange(480), points, leaf=20)
    tree.search(np.arange(40), points[:40], 5)
    assert tree.scanned < 0.5 * 40 * 480
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], SCHEMA)
    got = sorted(tuple(r) for r in nearest(rows, rows.where("vec_id % 20 = 0"), 5, 1.0, shard_rows=50, leaf=16).collect())
    assert [r[:3] for r in got] == [r[:3] for r in brute(np.arange(480), points, range(0, 480, 20), 5)]

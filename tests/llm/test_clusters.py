"""Centroid clustering: against plain rounds over all centroids."""

import hashlib
import math

import numpy as np
import pytest

from tilewright.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, `x` long, distance long, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4, 5, "z") for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dim, scale=1024.0):
    """Rows (id, cluster, distance) and centroids by looking at every centroid for every vector."""
    good = [(i, [max(min(math.floor(scale * c), 2**27), -(2**27)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in good]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(good, of, strict=True) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in good), key=str), c


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * 2) / 4  # many ties
    x[10:40] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim + 1)), (904, [None] + [0.0] * (dim - 1)), (905, [math.nan] * dim), (906, [math.inf] + [0.0] * (dim - 1))]
    return rows + [(907, [1e300] + [0.0] * (dim - 1)), (908, [-1e300] * dim), (909, [0.0] * dim), (910, [-0.0] * dim)]


@pytest.mark.parametrize("k, dim, leaf", [(8, 64, 4), (8, 3, 1), (30, 2, 2), (1, 4, 4), (1000, 2, 4)])
def test_clusters_equal_brute_force(spark, k, dim, leaf):
    rows = vectors(220, dim, k)
    found, centroids = clusters.clusters(table(spark, rows).repartition(4), k=k, rounds=4, dim=dim, leaf=leaf)
    expected, c = plain(rows, k, 4, dim)
    assert centroids.tolist() == c
    assert sorted(map(tuple, found.collect()), key=str) == expected


@pytest.mark.parametrize("n, dim, spread", [(1, 3, 5), (2, 3, 5), (500, 2, 1000), (300, 8, 3), (64, 64, 1 << 27)])
def test_nearest_by_the_tree(n, dim, spread):
    rng = np.random.default_rng(n)
    c = rng.integers(-spread, spread + 1, (n, dim))
    c[n // 2 :: 7] = c[0]
    x = np.concatenate([rng.integers(-spread, spread + 1, (200, dim)), c, c + rng.integers(-1, 2, c.shape)])
    for leaf in (1, 4):
        at, distance, looked = clusters.Vantage(c, leaf).nearest(x)
        every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x[:260]], object)
        assert at[:260].tolist() == [min(range(n), key=lambda j: (row[j], j)) for row in every]
        assert distance[:260].tolist() == [min(row) for row in every]
    if (n, dim) == (500, 2):
        assert looked < 0.2 * n * len(x)


def test_few_vectors_and_none(spark, tmp_path):
    for rows in ([], [(5, [0.5] * 64)], [(5, [0.5] * 64), (5, [0.5] * 64), (6, None)]):
        path = tmp_path / str(len(rows))
        table(spark, rows).write.parquet(str(path / "embeddings.parquet"))
        got = clusters.query(spark, str(path)).collect()
        assert [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got] == [(5, 0, 0, 0, 0) for i, v in rows if v]
        assert all(r.centroid_sha256 == hashlib.sha256(",".join(["512"] * 64).encode()).hexdigest() for r in got)


def test_too_many_centroids(spark):
    with pytest.raises(ValueError, match="components of centroids"):
        clusters.clusters(table(spark, []), k=1 << 20)

"""Centroid clustering against plain integers."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lodestone.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string, id string, vector string"


def brute(rows, k=16, rounds=3, scale=64, dims=64, seed=1):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    now = [w for _, w in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        at = [nearest(w)[1] for _, w in kept]
        moved = {j: [sum(x) // at.count(j) for x in zip(*(w for (_, w), a in zip(kept, at, strict=True) if a == j), strict=True)] for j in set(at)}
        now = [moved.get(j, c) for j, c in enumerate(now)]
    told = [(i, *nearest(w)) for i, w in kept]
    sums = {}
    for _, d, j in told:
        sums[j] = sums.get(j, 0) + d
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, j, fits(d), fits(sums[j]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, d, j in told), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", "i", "v") for i, v in rows], SCHEMA)


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "dims"), [(16, 3, 64), (4, 0, 3), (40, 2, 5), (1, 2, 2)])
def test_clusters_are_those_of_plain_integers(spark, k, rounds, dims):
    rows = vectors(120, dims, k) + [(500, None), (501, [1.0] * (dims + 1)), (502, []), (503, [None] + [1.0] * (dims - 1)), (504, [float("nan")] * dims), (505, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (600, [0.0] * dims), (601, [-0.0] * dims), (602, [1e-320] * dims)]
    got = centroids.clusters(table(spark, rows), k=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute(rows, k, rounds, dims=dims)


def test_ties_go_to_the_lowest_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-6, 7) for y in range(-6, 7))]  # a grid: ties everywhere
    assert rows_of(centroids.clusters(table(spark, rows), k=9, rounds=3, dims=2)) == brute(rows, 9, 3, dims=2)
    same = [(i, [0.5, 0.25]) for i in range(50)]
    got = centroids.clusters(table(spark, same), k=5, rounds=2, dims=2).collect()
    assert {r["cluster"] for r in got} == {0} and {r["inertia"] for r in got} == {0}


def test_parts_of_any_size_are_exact(spark):
    rows = vectors(40, 3, 1) + [(100 + i, v) for i, v in enumerate([[1e30, -2e30, 5.0], [1.7e308, 1.0, -1.7e308], [2.0**40, 2.0**40 + 1, 0.0], [65536.0, 65536.5, -65536.25], [3e9, 1.0, 2.0]])]
    for k in (1, 3, 45):  # with 45 all of them are centroids
        assert rows_of(centroids.clusters(table(spark, rows), k=k, rounds=2, dims=3)) == brute(rows, k, 2, dims=3)


def test_no_vectors_and_few(spark):
    assert centroids.clusters(table(spark, []), k=3).count() == 0
    assert centroids.clusters(table(spark, [(1, None), (2, [1.0])]), k=3).count() == 0
    two = vectors(2, 64, 5)
    assert rows_of(centroids.clusters(table(spark, two))) == brute(two)
    with pytest.raises(ValueError, match="at least 1"):
        centroids.Clustering(k=0)


def test_the_screen_never_loses_the_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, centroids.NARROW):
        rows, near = rng.integers(-scale, scale + 1, (400, 64)), rng.integers(-scale, scale + 1, (16, 64))
        rows[:100] = near[rng.integers(0, 16, 100)] + rng.integers(-1, 2, (100, 64))
        near[5] = near[2]
        exact = ((rows[:, None, :] - near[None]) ** 2).sum(axis=2)
        may = centroids.shortlist(rows, near)
        assert (may | (exact > exact.min(axis=1)[:, None])).all()
        label, distance, unsure = centroids.nearest(rows, near)
        assert (label == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and unsure > 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({queries.OP11})").fetchall(), key=str)
    assert rows_of(queries.op11_centroid_clustering(spark, sf)) == want

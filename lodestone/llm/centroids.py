"""Centroid clustering of integer vectors, screened in float32 and settled in exact integers.

Every round is one pass over the vectors. A task multiplies its vectors with all centroids in float32 and bounds the error of
each product: n terms summed in any order are off by at most n u / (1 - n u) times the product of the two norms, u = 2^-24. So
each squared distance lies in an interval, and only centroids whose interval meets that of the best are worked out again, in
integers; ties go to the lowest number. Vectors and centroids whose parts float32 cannot hold go to integers at once.

A task sends one row a cluster: count, sums, inertia, as decimal digits, so that no number overflows. These are added in two
steps, and the driver sees the centroids alone, whose number and length are parameters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest part of a vector that is screened: squared distances stay below 2^53, so that float64 holds them.
NARROW = 1 << 22
_UNIT = 2.0**-24
_PAIRS = 1 << 15
LONG_MAX = (1 << 63) - 1

Centroids = list[list[int]]


def integers(numbers: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of every part: which rows are narrow, these as int64, and the others as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(numbers * scale)
    narrow = (np.abs(scaled) <= NARROW).all(axis=1)

    def whole(x: float, y: float) -> int:
        if math.isfinite(y):
            return int(y)
        above, below = x.as_integer_ratio()
        return scale * above // below

    wide = np.empty((int((~narrow).sum()), numbers.shape[1]), object)
    for i, row in enumerate(np.flatnonzero(~narrow)):
        wide[i] = [whole(x, y) for x, y in zip(numbers[row].tolist(), scaled[row].tolist(), strict=True)]
    return narrow, scaled[narrow].astype(np.int64), wide


def shortlist(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each row, by intervals around float32 products. The nearest one always is among them."""
    n = rows.shape[1]
    products = (rows.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    score = (centroids * centroids).sum(axis=1)[None, :] - 2 * products
    norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    error = 2 * (n * _UNIT / (1 - n * _UNIT)) * norm(rows)[:, None] * norm(centroids)[None, :] * (1 + 1e-9) + np.abs(score) * 2.0**-50
    return score - error <= (score + error).min(axis=1)[:, None]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each narrow row's nearest centroid, and how many rows the screen left open."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    may = shortlist(rows, centroids)
    label = may.argmax(axis=1)
    unsure = np.flatnonzero(may.sum(axis=1) > 1)
    if len(unsure):
        exact = np.full((len(unsure), len(centroids)), LONG_MAX)
        at, number = np.nonzero(may[unsure])
        for i in range(0, len(at), _PAIRS):
            a, c = at[i : i + _PAIRS], number[i : i + _PAIRS]
            exact[a, c] = ((rows[unsure[a]] - centroids[c]) ** 2).sum(axis=1)
        label[unsure] = exact.argmin(axis=1)
    return label, ((rows - centroids[label]) ** 2).sum(axis=1), len(unsure)


def settled(numbers: np.ndarray, centroids: Centroids, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places, clusters, exact squared distances and integer parts of the rows, those that float32 cannot screen in a lot of their own."""
    narrow, rows, wide = integers(numbers, scale)
    exact = np.array(centroids, object)
    if (np.abs(exact) <= NARROW).all():
        label, distance, _ = nearest(rows, exact.astype(np.int64))
        yield np.flatnonzero(narrow), label, distance, rows
    else:
        yield np.flatnonzero(narrow), *_in_integers(rows.astype(object), exact), rows
    yield np.flatnonzero(~narrow), *_in_integers(wide, exact), wide


def _in_integers(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = np.empty((len(rows), len(centroids)), object)
    for number, centroid in enumerate(centroids):
        far[:, number] = ((rows - centroid) ** 2).sum(axis=1)
    label = np.array([min(range(len(centroids)), key=lambda j: (row[j], j)) for row in far], np.int64)
    return label, far[np.arange(len(rows)), label]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(centroids: Centroids, scale: int, dims: int):
    """One row a cluster that the task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for _, numbers in _blocks(batches, dims):
            for _, label, distance, rows in settled(numbers, centroids, scale):
                for j in np.unique(label):
                    mine = label == j
                    new = [int(mine.sum()), int(distance[mine].sum()), *map(int, rows[mine].sum(axis=0))]
                    seen[int(j)] = [a + b for a, b in zip(seen.get(int(j), [0] * len(new)), new, strict=True)]
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(seen, pa.int32()), "part": pa.array([part] * len(seen), pa.int32()), "sums": pa.array([[str(x) for x in v] for v in seen.values()], pa.list_(pa.string()))})

    return run


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = [str(sum(map(int, column))) for column in zip(*rows["sums"], strict=True)]
    return pd.DataFrame({"cluster": [key[0]], "part": [0], "sums": [total]}).astype({"cluster": "int32", "part": "int32"})


def _kept(vectors: DataFrame, dims: int, id_column: str, vector_column: str) -> DataFrame:
    """Ids and vectors of ``dims`` parts, none of them null or not finite."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("vector") == dims) & F.coalesce(~odd, F.lit(False)))


class Clustering:
    """Clusters the vectors of a table by ``rounds`` of assigning and averaging, from starts that a hash chooses.

    Kept are vectors of exactly ``dims`` parts, none null or not finite; each part x becomes floor(``scale`` * x) of the double x.
    Centroids 0, 1, ... start as the ``k`` kept vectors whose sha256 of "``seed``:id" is smallest (all, if fewer; null ids last, and
    equal ids in the order of their vectors). A round assigns every vector to the nearest centroid by squared distance, ties to the
    smaller number, and moves each centroid that has vectors to their mean, rounded down in each part; one without vectors stays.
    Rows that repeat count each for itself, other columns are not read, and an empty table has no centroids and no rows. Parts of
    any finite size are exact; a distance or inertia that a long cannot hold is null.
    """

    def __init__(self, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding"):
        if min(k, scale, dims) < 1 or rounds < 0:
            raise ValueError("k, scale and dims are at least 1, rounds at least 0")
        self.k, self.rounds, self.scale, self.dims, self.seed = k, rounds, scale, dims, seed
        self.id_column, self.vector_column = id_column, vector_column

    def start(self, vectors: DataFrame) -> Centroids:
        name = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.col("id").cast("string")), 256)
        first = _kept(vectors, self.dims, self.id_column, self.vector_column).select(name.alias("name"), "vector").orderBy(F.asc_nulls_last("name"), "vector").limit(self.k).collect()
        out = []
        for row in first:
            narrow, rows, wide = integers(np.array([row["vector"]], float), self.scale)
            out.append([int(x) for x in (rows if narrow[0] else wide)[0]])
        return out

    def sums(self, vectors: DataFrame, centroids: Centroids) -> dict[int, tuple[int, int, list[int]]]:
        """For each cluster that has vectors: how many, the sum of their squared distances, and the sum of each part."""
        if not centroids:
            return {}
        parts = _kept(vectors, self.dims, self.id_column, self.vector_column).mapInArrow(_sums(centroids, self.scale, self.dims), "cluster int, part int, sums array<string>")
        schema = "cluster int, part int, sums array<string>"
        added = parts.groupBy("cluster", "part").applyInPandas(_add, schema).groupBy("cluster").applyInPandas(_add, schema).collect()
        return {r["cluster"]: (int(r["sums"][0]), int(r["sums"][1]), [int(x) for x in r["sums"][2:]]) for r in added}

    def fit(self, vectors: DataFrame) -> Centroids:
        centroids = self.start(vectors)
        for _ in range(self.rounds):
            found = self.sums(vectors, centroids)
            centroids = [[x // found[j][0] for x in found[j][2]] if j in found else c for j, c in enumerate(centroids)]
        return centroids

    def assign(self, vectors: DataFrame, centroids: Centroids) -> DataFrame:
        """id, cluster and squared distance of every kept vector."""
        kept = _kept(vectors, self.dims, self.id_column, self.vector_column)
        schema = f"{self.id_column} long, cluster int, distance long"
        if not centroids:
            return kept.select(F.col("id").alias(self.id_column), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).where(F.lit(False))
        names, scale, dims = [self.id_column, "cluster", "distance"], self.scale, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, numbers in _blocks(batches, dims):
                for at, label, distance, _ in settled(numbers, centroids, scale):
                    held = [x if x <= LONG_MAX else None for x in map(int, distance)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(label, pa.int32()), pa.array(held, pa.int64())], names)

        return kept.mapInArrow(run, schema)


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """Every kept vector with its cluster: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Options are those of ``Clustering``. The inertias sum squared distances over the cluster and over all; centroid_sha256 is the
    lowercase hex sha256 of the final centroid's parts, in decimal and joined by commas.
    """
    of = Clustering(**options)
    centroids = of.fit(vectors)
    found = of.sums(vectors, centroids)
    whole = sum(inertia for _, inertia, _ in found.values())
    held = lambda x: x if x <= LONG_MAX else None
    told = [(j, held(found[j][1]), held(whole), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j in found]
    facts = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return of.assign(vectors, centroids).join(F.broadcast(facts), "cluster").select(of.id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

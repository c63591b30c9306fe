"""Vector search: exact, and over an inverted file of cells.

Rows and queries are both dealt to blocks of bounded size, and a task meets one block of each: neither side passes the driver, and
a hot cell is several blocks. The inverted file has coarse centroids fitted on a bounded sample; every row lies in the cell of its
nearest centroid, and cells are folders, so that a search opens the cells its queries probe.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and queries that one task holds.
ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048


def unit_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix of unit vectors) for each length of the usable vectors of a list column: whole, finite and not zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), length)
        size = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(x).all(axis=1) & (size > 0) & np.isfinite(size)
        if ok.any():
            yield int(length), at[ok], x[ok] / size[ok, None]


def _best(k: int):
    """The k best rows of a block for each query of a block; what ties with the last one stays, the merge decides."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query", asked.schema.field("query").type), ("row", rows.schema.field("row").type), ("score", pa.float64())])
        out = []
        queries = {n: (at, x) for n, at, x in unit_rows(asked["vector"].combine_chunks())} if len(asked) else {}
        ids, keys = asked["query"].combine_chunks(), rows["row"].combine_chunks()
        for length, at, x in unit_rows(rows["vector"].combine_chunks()) if len(rows) else ():
            if length not in queries:
                continue
            place, matrix = queries[length]
            for start in range(0, len(place), 256):
                scores = matrix[start : start + 256] @ x.T
                for q, line in zip(place[start : start + 256], scores, strict=True):
                    own = np.round(line, 9)
                    best = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
                    out.append(pa.Table.from_arrays([pa.array([ids[q].as_py()] * len(best), schema.field(0).type), keys.take(pa.array(at[best])), pa.array(line[best])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _merge(found: DataFrame, k: int) -> DataFrame:
    from lodestone.operators.recall import ranked

    return ranked(found, "query", [F.desc(F.round("score", 9)), "row"], k)


def _meet(rows: DataFrame, asked: DataFrame, sizes: dict[int, int], asked_sizes: dict[int, int], k: int) -> DataFrame:
    """``rows`` (cell, row, vector) against ``asked`` (cell, query, vector) within each cell, in blocks."""

    def blocks(counts: dict[int, int], most: int):
        each = F.create_map(*(F.lit(x) for cell, n in counts.items() for x in (cell, -(-n // most)))) if counts else F.create_map(F.lit(-1), F.lit(0))
        return F.coalesce(F.element_at(each, F.col("cell")), F.lit(0))

    def dealt(column: str, counts: dict[int, int], most: int):
        return F.pmod(F.xxhash64(column), F.greatest(blocks(counts, most), F.lit(1))).cast("int")

    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    left = asked.select("cell", dealt("query", asked_sizes, QUERY_BLOCK).alias("q"), every(blocks(sizes, ROW_BLOCK)).alias("r"), "query", "vector")
    right = rows.select("cell", every(blocks(asked_sizes, QUERY_BLOCK)).alias("q"), dealt("row", sizes, ROW_BLOCK).alias("r"), "row", "vector")
    schema = f"query {asked.schema['query'].dataType.simpleString()}, row {rows.schema['row'].dataType.simpleString()}, score double"
    return _merge(left.groupBy("cell", "q", "r").cogroup(right.groupBy("cell", "q", "r")).applyInArrow(_best(k), schema), k)


def exact_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 50) -> DataFrame:
    """The k nearest rows by cosine for each query, ties to the smaller key: (query, key, score, rank).

    Vectors of other lengths are not compared; a null, zero or broken one takes no part. No rows, no queries or a k below 1 give none.
    """
    rows = vectors.select(F.lit(0).alias("cell"), F.col(key).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.select(F.lit(0).alias("cell"), F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("vector"))
    found = _meet(rows, asked, {0: rows.count()}, {0: asked.count()}, max(k, 1))
    return found.where(F.lit(k > 0)).select(F.col("query").alias(query_key), F.col("row").alias(key), "score", "rank")


class Cells(NamedTuple):
    """An inverted file: its folder and the centroids of its cells, unit vectors."""

    folder: str
    centroids: np.ndarray


def fit_cells(vectors: DataFrame, vector: str, cells: int, sample: int = 50_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of spherical k-means over at most ``sample`` usable vectors of the most frequent length, chosen by hash.

    The sample is bounded, so it is fitted on the driver; fewer usable vectors than ``cells`` give as many cells.
    """
    usable = vectors.select(F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    chosen = usable.orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(sample).toArrow()
    found = max(unit_rows(chosen["vector"].combine_chunks()), key=lambda x: (len(x[2]), x[0]), default=None) if chosen.num_rows else None
    if found is None:
        return np.zeros((0, 0))
    x = found[2]
    centroids = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 0, total / np.where(size > 0, size, 1), centroids)
    return centroids


def _near_cells(centroids: np.ndarray, probes: int):
    """Each row's nearest cells; rows of another length are in cell -1, with all others of their kind, and a query's probes have it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, x in unit_rows(batch.column(1)):
                if len(centroids) and length == centroids.shape[1]:
                    scores = x @ centroids.T
                    near = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                else:
                    near = np.full((len(at), 1), -1)
                place = np.repeat(at, near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(pa.array(place)), batch.column(1).take(pa.array(place))], ["cell", batch.schema.names[0], "vector"])

    return run


def _placed(rows: DataFrame, name: str, centroids: np.ndarray, probes: int) -> DataFrame:
    return rows.mapInArrow(_near_cells(centroids, probes), f"cell int, {name} {rows.schema[name].dataType.simpleString()}, vector array<double>")


def write_cells(vectors: DataFrame, key: str, vector: str, folder: str, cells: int = 256, sample: int = 50_000) -> Cells:
    """Fits the cells, then writes every usable row (row, vector) to the folder of its cell; unusable ones can be nobody's neighbour."""
    centroids = fit_cells(vectors, vector, cells, sample)
    rows = vectors.select(F.col(key).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    _placed(rows, "row", centroids, 1).sortWithinPartitions("cell").write.partitionBy("cell").mode("overwrite").parquet(f"{folder}/cells")
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    return Cells(folder, centroids)


def read_cells(spark: SparkSession, folder: str) -> Cells:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
    return Cells(folder, np.array([r["centroid"] for r in rows]))


def search_cells(index: Cells, queries: DataFrame, query_key: str, query_vector: str, key: str, k: int = 50, probes: int = 16) -> DataFrame:
    """The k nearest rows among the ``probes`` cells nearest to each query: (query, key, score, rank), ties to the smaller key.

    With ``probes`` of at least the number of cells every row is compared, and the result is that of ``exact_top_k``.
    """
    spark = queries.sparkSession
    asked = _placed(queries.select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("vector")), "query", index.centroids, probes)
    kind = "cell int, row long, vector array<double>"
    try_rows = spark.read.parquet(f"{index.folder}/cells") if _has_rows(spark, index.folder) else spark.createDataFrame([], kind)
    asked_sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rows = try_rows.where(F.col("cell").isin(list(asked_sizes))) if asked_sizes else try_rows.where(F.lit(False))
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    found = _meet(rows.select("cell", "row", "vector"), asked, sizes, asked_sizes, max(k, 1))
    return found.where(F.lit(k > 0)).select(F.col("query").alias(query_key), F.col("row").alias(key), "score", "rank")


def calibrated_probes(index: Cells, vectors: DataFrame, key: str, vector: str, k: int = 10, target: float = 0.95, asked: int = 256) -> int:
    """How many cells to probe so that ``target`` of the k nearest rows lie in them, measured on ``asked`` rows chosen by hash.

    These rows are searched exactly, once, when the index is built; the driver sees their neighbours' cells, asked * k numbers at most.
    """
    if not len(index.centroids):
        return 1
    rows = vectors.select(F.col(key).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    chosen = rows.where(F.size("vector") == index.centroids.shape[1]).orderBy(F.xxhash64("row"), "row").limit(asked).select(F.col("row").alias("query"), F.col("vector").alias("asked"))
    found = exact_top_k(rows, "row", "vector", chosen, "query", "asked", k)
    placed = vectors.sparkSession.read.parquet(f"{index.folder}/cells").select("row", "cell")
    told = found.join(placed, "row").join(chosen, "query").select("asked", "cell").toArrow()
    if not told.num_rows:
        return 1
    needs = []
    for _, at, x in unit_rows(told["asked"].combine_chunks()):
        order = np.argsort(np.argsort(-(x @ index.centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
        needs.append(order[np.arange(len(at)), told["cell"].to_numpy()[at]] + 1)
    needs = np.sort(np.concatenate(needs))
    return int(needs[min(len(needs) - 1, int(np.ceil(target * len(needs))) - 1)])


def _has_rows(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cells")
    return any(s.isDirectory() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))

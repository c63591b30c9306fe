"""Exact top-k search by term-at-a-time accumulation.

A component of a vector is a term; a block of rows has for each term its postings, the rows where it is not zero and their
weights. Each query scatters its weight times the postings' weights into a dense array of scores, one term after the other;
partition selection takes the best k of a block, and the blocks' winners are merged by a window over each query.

Queries and rows are both dealt to blocks of bounded size, and each pair of blocks is one task: neither side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 512, 8192


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, term by term. Products that leave 64 bits wrap around."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, term])
        asked = np.flatnonzero(queries[:, term])
        if not len(at) or not len(asked):
            continue
        weights = rows[at, term]
        if len(at) == len(rows):
            for q in asked:
                scores[q] += queries[q, term] * weights
        else:
            for q in asked:
                scores[q, at] += queries[q, term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in that order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        rows = rows.sort_values("vec_id", kind="stable")
        lengths = rows["vector"].map(len)
        for length, asked in queries.groupby(queries["vector"].map(len)):
            alike = rows[lengths == length]
            if not len(alike):
                continue
            ids = alike["vec_id"].to_numpy()
            matrix = np.array(alike["vector"].tolist(), np.int64)
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                scores = accumulate(np.array(part["vector"].tolist(), np.int64), matrix)
                for q, row in zip(part["vec_id"], scores, strict=True):
                    others = ids != q
                    out += [(int(q), int(ids[others][i]), int(row[others][i])) for i in best(row[others], ids[others], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector, each component x as floor(scale * x) of the double x. Rows with a null or non-finite part are left out."""
    number = F.col("embedding").cast("array<double>")
    whole = F.coalesce(~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return vectors.where(whole & F.col("vec_id").isNotNull()).select("vec_id", F.transform(number, lambda x: F.floor(x * scale)).alias("vector"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k rows with the highest inner product for each row of ``vectors`` (vec_id, vector of longs) that is a query.

    A query never finds its own vec_id. Ties go to the smaller vec_id; fewer than k candidates return all. Rows that repeat
    a vec_id are candidates each for itself, and count as one query if their vectors are equal. Vectors of different lengths
    are never compared; an empty table has no rows.

    Returns query_id, rank (from 1), vec_id, score.
    """
    queries = vectors.where(is_query).distinct()
    n_rows, n_queries = vectors.count(), queries.count()
    row_blocks, query_blocks = -(-n_rows // ROW_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(block(query_blocks).alias("q"), every(row_blocks).alias("r"), "vec_id", "vector")
    right = vectors.select(every(query_blocks).alias("q"), block(row_blocks).alias("r"), "vec_id", "vector")
    won = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return won.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

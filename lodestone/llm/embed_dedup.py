"""Near-duplicate vectors by collision counting on random projections.

The distance of two unit vectors along a random Gaussian line is normal with their distance as deviation. So each vector opens
a window around itself on each of many sorted lines; a pair at the threshold meets in a window with a known chance, and the
number of windows it must meet in is set from the binomial law, so that no more than a given share of such pairs is missed.
Pairs that reach that number are verified by cosine in double precision.

Equal vectors of a label are one class. The classes of a label are dealt to blocks of bounded size and each pair of blocks is one task, which
returns link counts by vector and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.shared import Scratch

LINES = 48
#: Half a window, in distances at the threshold.
REACH = 2.0
MISS = 1e-6
#: Classes in a block.
BLOCK = 2048


def needed(lines: int = LINES, reach: float = REACH, miss: float = MISS) -> int:
    """The windows a pair must meet in, so that at most ``miss`` of the pairs at the threshold fall short."""
    p = math.erf(reach / math.sqrt(2))
    below = 0.0
    for hits in range(lines + 1):
        below += math.comb(lines, hits) * p**hits * (1 - p) ** (lines - hits)
        if below > miss:
            return hits
    return lines


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng(48).standard_normal((dim, LINES))


def _collisions(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """For each pair the lines on which b lies in the window around a: ranks of the window's ends on the sorted line, then a count."""
    count = np.zeros((len(a), len(b)), np.uint8)
    for line in range(a.shape[1]):
        order = np.argsort(b[:, line], kind="stable")
        rank = np.empty(len(b), np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        low = np.searchsorted(b[order, line], a[:, line] - reach, "left").astype(np.uint16)
        width = np.searchsorted(b[order, line], a[:, line] + reach, "right").astype(np.uint16) - low
        for at in range(0, len(a), 64):
            count[at : at + 64] += (rank[None, :] - low[at : at + 64, None]) < width[at : at + 64, None]
    return count


def links_between(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Which pairs of unit vectors reach the threshold. ``same``: a and b are one block, and a pair is told once."""
    reach = REACH * math.sqrt(max(2 - 2 * threshold, 1e-12)) + 1e-9
    lines = _lines(a.shape[1])
    left, right = np.nonzero(_collisions(a @ lines, b @ lines, reach) >= needed())
    if same:
        left, right = left[left < right], right[left < right]
    linked = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(left), 50_000):
        i, j = left[at : at + 50_000], right[at : at + 50_000]
        ok = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        linked[i[ok], j[ok]] = True
    return linked


def forest(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links enough to connect what ``linked`` connects, no more than there are nodes."""
    if same:
        near = linked | linked.T
        ids = ids_a
    else:
        n = len(ids_a)
        near = np.zeros((n + len(ids_b),) * 2, bool)
        near[:n, n:], near[n:, :n] = linked, linked.T
        ids = np.concatenate([ids_a, ids_b])
    fresh, out = near.any(axis=1), []
    for root in np.flatnonzero(fresh):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            node = queue.pop()
            ahead = np.flatnonzero(near[node] & fresh)
            fresh[ahead] = False
            queue.extend(ahead)
            out.extend((int(ids[node]), int(ids[x])) for x in ahead)
    return out


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    x = np.array(pdf["embedding"].tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _block_pair(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "rep"], kind="stable")
        first, second = int(pdf["first"].iloc[0]), int(pdf["second"].iloc[0])
        rows = []
        for _, alike in pdf.groupby(pdf["embedding"].map(len)):  # vectors of other lengths are never compared
            a, b = alike[alike["block"] == first], alike[alike["block"] == second]
            if not len(a) or not len(b):
                continue
            linked = links_between(_unit(a), _unit(b), threshold, first == second)
            ids_a, ids_b = a["rep"].to_numpy(), b["rep"].to_numpy()
            to_a, to_b = linked @ b["copies"].to_numpy(np.int64), linked.T @ a["copies"].to_numpy(np.int64)
            rows += [(int(i), int(n), None) for i, n in zip(ids_a, to_a, strict=True) if n] + [(int(i), int(n), None) for i, n in zip(ids_b, to_b, strict=True) if n]
            rows += [(u, 0, v) for u, v in forest(linked, ids_a, ids_b, first == second)]
        return pd.DataFrame({"u": pd.array([r[0] for r in rows], "Int64"), "n": pd.array([r[1] for r in rows], "Int64"), "v": pd.array([r[2] for r in rows], "Int64")})

    return run


def linked_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links among vectors of the same label whose cosine is at least ``threshold``.

    ``vectors`` has vec_id (long), embedding (array of numbers) and label. A null label, a null, empty or zero vector, or one
    with a null or non-finite component links with nothing; vectors of different lengths do not either. Rows that repeat a
    vec_id count as vectors of their own. A null vec_id returns its row with no links. Other columns are not read.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links reach), kept.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "collisions")
    number = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.size(number) > 0, F.lit(False)) & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(number, lambda x: x != 0)
    usable = F.coalesce(whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # equal vectors meet by a hash of 128 bits, so that no shuffle is sorted by whole vectors
    key = [F.xxhash64("embedding").alias("high"), F.xxhash64(F.lit("low"), "embedding").alias("low")]
    rows = vectors.select("vec_id", number.alias("embedding"), "label", usable.alias("usable")).select("*", *key)
    same = rows.where("usable").groupBy("label", "high", "low")
    classes = scratch.table(same.agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")

    blocks = classes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = classes.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", other).select("label", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep", "copies", "embedding")
    found = dealt.groupBy("label", "first", "second").applyInPandas(_block_pair(threshold), "u long, n long, v long")
    found = scratch.table(found, "links")

    # classes may share a rep only if a vec_id repeats with different vectors; their links are then the vec_id's
    degree = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    joined = connected_components(found.where("v is not null").select("u", "v"), scratch).withColumnRenamed("id", "rep")
    known = classes.join(degree, "rep", "left").join(joined, "rep", "left")
    known = known.select("label", "high", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("usable"))
    out = rows.select("vec_id", "label", "high", "low", "usable").join(known, ["label", "high", "low", "usable"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

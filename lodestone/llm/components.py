"""Connected components of a graph of links, by alternating large stars and small stars.

Each round is two joins against the smallest neighbour of each node, which is pre-aggregated before it is shuffled. No node's
neighbours are gathered in memory; those of a hub do meet in one shuffle partition, which the adaptive planner splits where it
is large. Rounds end when the set of links no longer changes, and each is written to the
shared folder, so that lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` has ids u, v (any order, repeats and loops allowed; rows with a null are ignored).

    Returns (id, component) for every id that has a link, component being the smallest id it can reach.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = scratch.table(_small_star(_large_star(now)), "stars")
        scratch.drop(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"the stars still changed after {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

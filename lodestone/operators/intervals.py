"""Joins and set operations on line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines to a bin; a range is listed in each bin it touches, so that range joins are equi joins.
BIN = 64


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))


def stabbing_join(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """For (path, line) the shortest range (path, id, start_line, end_line) that holds the line; ties by start, then id."""
    hit = points.withColumn("bin", F.floor(F.col("line") / BIN)).join(_binned(ranges, "start_line", "end_line"), ["path", "bin"]).where("line between start_line and end_line")
    order = Window.partitionBy("path", "line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id")
    return hit.withColumn("n", F.row_number().over(order)).where("n = 1").select("path", "line", "id", "start_line", "end_line")


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ranges of one path that share a line: (path, left_id, right_id). Each pair meets in its first common bin."""
    a = _binned(left, "start_line", "end_line").select("path", "bin", F.col("id").alias("left_id"), F.col("start_line").alias("s1"), F.col("end_line").alias("e1"))
    b = _binned(right, "start_line", "end_line").select("path", "bin", F.col("id").alias("right_id"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    hit = a.join(b, ["path", "bin"]).where("s1 <= e2 and s2 <= e1").where(F.floor(F.greatest("s1", "s2") / BIN) == F.col("bin"))
    return hit.select("path", "left_id", "right_id")


def _islands(ranges: DataFrame, gap: int) -> DataFrame:
    own = Window.partitionBy("path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start_line") > reach + gap + 1)).cast("int")
    return ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def merge_ranges(ranges: DataFrame, gap: int = 0) -> DataFrame:
    """Ranges of a path that overlap, touch or lie at most ``gap`` lines apart become one."""
    return _islands(ranges, gap).groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("parts")).drop("island")


def gaps(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """The longest runs of lines 1..total of a path that no range covers."""
    merged = merge_ranges(ranges).select("path", "start_line", "end_line")
    ends = totals.select("path", (F.col("total") + 1).alias("start_line"), (F.col("total") + 1).alias("end_line"))
    own = Window.partitionBy("path").orderBy("start_line")
    before = F.coalesce(F.lag("end_line").over(own), F.lit(0))
    rows = merged.unionByName(ends).select("path", (before + 1).alias("first"), (F.col("start_line") - 1).alias("last"))
    return rows.where("first <= last").select("path", F.col("first").alias("start_line"), F.col("last").alias("end_line"))

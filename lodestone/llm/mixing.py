"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Every document of a source expects target / source size copies. In the order of size and doc_id the expected copies are
prefix-summed and one random offset, drawn from the source's name and a seed, is added; a document is emitted once for each
whole number that its interval crosses. As neighbours in that order have nearly the same size, the words taken differ from
the target by little more than the largest document.

The prefix sum is the rank times the expected copies, and the rank is made of three parts, none of which gathers a source in
one task: rows before this size (a window over a source's distinct sizes), rows of this size in earlier buckets (a window over
the buckets' counts), and the row number within the bucket. Buckets are ranges of doc_id, about equal in rows, so the order is
that of size and doc_id (null last) for any bounds and any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
SEED = "mix"
#: Rows of one source and size that a window sorts in one task, about.
BUCKET_ROWS = 50_000
#: Ranges of ids, and ranges of each of them, at most; with more rows than these make buckets for, buckets grow.
COARSE, FINE = 256, 1000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """For (source, source_size) its target, expected copies and offset.

    Weights go by the order of sources' code points, null last, repeating. Targets share ``share`` of all sizes by weight;
    none exceeds ``cap`` times its source's size, and the excess is shared again by weight until none is above. That fixed
    point is one level per unit of weight: with sources in the order of cap size / weight, those are capped for which the
    level, with all before them capped, is above their own cap. This table has one row for each source, and its windows sort them
    in one task: a million sources would still be some tens of megabytes.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*(F.lit(x) for x in weights)), (F.row_number().over(by_name) - 1) % len(weights))
    rows = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * cap)
    total = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / open_).withColumn("capped", F.col("level") > F.col("limit") / F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(total)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.least(level * F.col("weight"), F.col("limit")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce("source", F.lit("")))), 1, 7), 16, 10).cast("long") / float(1 << 28)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"), offset.alias("offset"))


def _shares(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def _reached(bounds: Column, most: int, doc_id: Column) -> Column:
    """How many of at most ``most`` sorted bounds an id has reached, by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(bounds, n + s - 1) <= doc_id, n + s).otherwise(n))


def _with_buckets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with the bucket of row.doc_id: ranges of ids, about equal in rows, in their order; a null id comes last.

    Ids are cut into at most ``COARSE`` ranges by quantiles, and each range into at most ``FINE`` by quantiles of its own. So the
    plan holds so many numbers at most whatever the table's size, and the finer bounds, a table of at most ``COARSE`` rows, are
    written once, as quantiles are approximate. Which bounds they are changes no result.
    """
    wanted = -(-ids.count() // BUCKET_ROWS)
    if wanted <= 1:
        return rows.withColumn("bucket", F.col("row.doc_id").isNull().cast("int"))
    groups = min(COARSE, -(-wanted // FINE))
    fine = min(FINE, -(-wanted // groups))
    known = ids.where("doc_id IS NOT NULL")
    coarse = sorted(set(known.agg(F.percentile_approx("doc_id", _shares(groups), 10_000)).first()[0] or [])) if groups > 1 else []
    group = lambda doc_id: _reached(F.array(*(F.lit(x).cast("long") for x in coarse)), len(coarse), doc_id) if coarse else F.lit(0)
    of_group = known.groupBy(group(F.col("doc_id")).alias("group")).agg((F.percentile_approx("doc_id", _shares(fine), 10 * max(1_000, fine)) if fine > 1 else F.array().cast("array<long>")).alias("bounds"))
    bounds = Scratch(rows.sparkSession, "mixing").table(of_group.select("group", F.sort_array(F.array_distinct("bounds")).alias("bounds")), "bounds")
    placed = rows.withColumn("group", F.coalesce(group(F.col("row.doc_id")), F.lit(0))).join(F.broadcast(bounds), "group", "left")
    bucket = F.when(F.col("row.doc_id").isNull(), (COARSE + 1) * (FINE + 1)).otherwise(F.col("group") * (FINE + 1) + _reached(F.col("bounds"), fine, F.col("row.doc_id")))
    return placed.withColumn("bucket", bucket).drop("group", "bounds")


def _source_key(source: Column) -> Column:
    """A key that joins null with null."""
    return F.struct(source.isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("name"))


def with_copies(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), size, source_size, target and copies (how often the row is emitted).

    ``docs`` has doc_id and source, and text unless ``size`` gives the rows' sizes. A null text has size 0, a null source is a
    source of its own, and rows that repeat are sampled each for itself; a source of size 0 is never emitted. Which of equal
    rows is emitted does not matter; reruns agree. As the columns of ``docs`` travel in the struct, their names clash with
    nothing.
    """
    words = size_of(F.col("text")) if size is None else size
    rows = _with_buckets(docs.select(F.struct("*").alias("row"), words.alias("size"), _source_key(F.col("source")).alias("key")), docs.select("doc_id"))
    by_bucket = rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_bucket.groupBy("key", "size").agg(F.sum("n").alias("n")).withColumn("smaller", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n")
    starts = by_bucket.withColumn("earlier", F.coalesce(F.sum("n").over(in_size), F.lit(0))).join(by_size, ["key", "size"])
    sizes = by_bucket.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sizes.select(F.when(~F.col("key.absent"), F.col("key.name")).alias("source"), "source_size")
    plan = targets(named, weights, share, cap).select(_source_key(F.col("source")).alias("key"), "source_size", "target", "rate", "offset")
    starts = starts.join(plan, "key").select("key", "size", "bucket", (F.col("smaller") + F.col("earlier")).alias("start"), "source_size", "target", "rate", "offset")
    in_bucket = Window.partitionBy("key", "size", "bucket").orderBy("row.doc_id")
    last = F.col("start") + F.row_number().over(in_bucket)
    edge = lambda rank: F.floor(rank * F.col("rate") + F.col("offset"))
    placed = rows.join(starts, ["key", "size", "bucket"])
    return placed.withColumn("copies", (edge(last) - edge(last - 1)).cast("int")).select("row", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is emitted, with the columns of ``docs``.

    Nulls, repeats and sources without words are as in ``with_copies``; an empty table gives an empty mix.
    """
    chosen = with_copies(docs, None, weights, share, cap).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every row of ``docs``."""
    narrow = docs.select("doc_id", "source", size_of(F.col("text")).alias("words"))
    rows = with_copies(narrow, F.col("words"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

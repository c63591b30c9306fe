"""Usage, quota and quality aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, group: str, value: str, ratio: float) -> DataFrame:
    """(group, percentile): the value at index round(ratio n) - 1, half to even, within 0 and n - 1.

    Ranks are made by a window that sorts and spills; no group's values are gathered in an array.
    """
    own = Window.partitionBy(group)
    rows = rows.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(own.orderBy(value)) - 1).withColumn("n", F.count("*").over(own))
    index = F.least(F.greatest(F.bround(ratio * F.col("n")) - 1, F.lit(0)), F.col("n") - 1)
    return rows.where(F.col("place") == index).select(group, F.col(value).alias("percentile"))


def run_stats(runs: DataFrame, group: str, state: str, value: str, at: str) -> DataFrame:
    """Runs by outcome; times of successful ones only, whole numbers; the last state.

    Times are summed as decimals of nine places, so that the order in which tasks add them cannot bring a whole average below
    itself; a group with times that no decimal holds is averaged as doubles.
    """
    done = F.col(state) == "done"
    exact = F.when(done, F.col(value).try_cast("decimal(28,9)"))
    average = F.when(F.count(exact) == F.count(F.when(done, F.col(value))), F.floor(F.avg(exact)).cast("long")).otherwise(F.floor(F.avg(F.when(done, F.col(value)))))
    return runs.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("succeeded"),
        F.count_if(F.col(state) == "failed").alias("failed"),
        average.alias("avg_value"),
        F.min(F.when(done, F.col(value))).alias("min_value"),
        F.max(F.when(done, F.col(value))).alias("max_value"),
        F.max_by(state, at).alias("last_state"),
    )


def usage_summary(audit: DataFrame, group: str) -> DataFrame:
    """Answers by outcome. Not measured is null, never 0; a degraded call without an answer is a failure."""
    failed = F.col("degraded") & F.col("answerable").isNull()
    return audit.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if("answerable").alias("succeeded"),
        F.count_if(~F.col("answerable")).alias("insufficient"),
        F.count_if(failed).alias("failed"),
        F.floor(F.avg("latency")).alias("avg_latency"),
        F.round(F.avg("coverage"), 4).alias("avg_coverage"),
    )


def distribution(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(value), F.lit("unknown")).alias(value)).agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, value: str, k: int = 10) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def keep_newest(rows: DataFrame, group: str, at: str, key: str, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at), F.desc(key)))).where(F.col("place") <= n).drop("place")


def latest_activity(tables: list[DataFrame], key: str, at: str, limit: int) -> DataFrame:
    """Of several tables the latest time for each key, newest first."""
    both = None
    for t in tables:
        both = t.select(key, at) if both is None else both.unionByName(t.select(key, at))
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias("latest")).orderBy(F.desc("latest"), key).limit(limit)


def quota_state(used: Column, limit: Column, warn: float = 0.8) -> Column:
    """exceeded, warning or ok; a limit of 0 is none."""
    return F.when(limit == 0, "ok").when(used >= limit, "exceeded").when(used >= warn * limit, "warning").otherwise("ok")


def sliding_counts(events: DataFrame, key: str, seconds: str, window: int) -> DataFrame:
    """For each event those of its key in the last ``window`` seconds, itself included (the window is open at its old end)."""
    frame = Window.partitionBy(key).orderBy(seconds).rangeBetween(-window + 1, 0)
    return events.withColumn("in_window", F.count("*").over(frame))


def recent_stubs(events: DataFrame, key: list[str], at: str, ttl: int) -> DataFrame:
    """Marks events whose key was seen at most ``ttl`` seconds ago; each sighting starts the time anew."""
    before = F.lag(at).over(Window.partitionBy(*key).orderBy(at, "event_id"))
    return events.withColumn("is_stub", F.coalesce(F.col(at) - before <= ttl, F.lit(False)))


def retrieval_metrics(results: DataFrame, expected: DataFrame, groups: list[str]) -> DataFrame:
    """recall@5, recall@10 and mean reciprocal rank by group, from results (query_id, doc, rank) and expected (query_id, doc, groups)."""
    hits = expected.join(results, ["query_id", "doc"], "left").groupBy("query_id", *groups).agg(F.min("rank").alias("first"))
    within = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return hits.groupBy(*groups).agg(F.count("*").alias("queries"), F.round(within(5), 6).alias("recall_5"), F.round(within(10), 6).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def verified_citations(answers: DataFrame, text: str, known: str) -> DataFrame:
    """valid and invalid citations ``[E1]`` or ``[F1]`` of a text, and the share of paragraphs they could cover."""
    cited = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[([EF][0-9]+)\]"), F.lit(1)))
    paragraphs = F.size(F.filter(F.split(F.col(text), r"\n\n+"), lambda p: F.trim(p) != ""))
    rows = answers.withColumn("valid", F.size(F.array_intersect(cited, F.col(known)))).withColumn("invalid", F.size(F.array_except(cited, F.col(known))))
    return rows.withColumn("coverage", F.when(paragraphs > 0, F.round(F.least(F.lit(1.0), F.col("valid") / paragraphs), 4)).otherwise(0.0))


def token_sum(calls: DataFrame, group: str, at: Column, since: Column, tokens: str) -> DataFrame:
    """(group, used): tokens of the calls since a time, 0 for a group that has only older ones."""
    recent = F.sum(F.when(at >= since, F.col(tokens)))
    return calls.groupBy(group).agg(F.coalesce(recent, F.lit(0)).alias("used"))

"""Stateful operators: the recording rate limiter, in batch and as a stream, and upserts from a stream of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.incremental import effective_changes


def admit(times: list[float], kept: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Whether each hit is let in: fewer than ``limit`` hits let in within the window before it. Rejected hits do not count; a limit of 0 or less is none."""
    said = []
    for t in times:
        kept = [x for x in kept if x > t - window]
        ok = limit <= 0 or len(kept) < limit
        said.append(ok)
        if ok and limit > 0:
            kept.append(t)
    return said, kept


def limiter(events: DataFrame, key: str, at: str, order: str, limit: int, window: float) -> DataFrame:
    """(key, order, allowed) of each event: one fold per key in the order of time.

    Keys are sorted within their partitions and read in Arrow batches; from one batch to the next go the times of the last key's
    hits that were let in, ``limit`` of them at most, so a key of any size takes bounded memory.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for pdf in batches:
            said = []
            for _, part in pdf.groupby((pdf["_own"] != pdf["_own"].shift()).cumsum(), sort=False):
                own = part["_own"].iloc[0]
                allowed, kept = admit(part[at].tolist(), kept if own == last else [], limit, window)
                last = own
                said += allowed
            yield pdf[[key, order]].assign(allowed=said)

    rows = events.select(key, order, at, F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("_own"))  # null is a key of its own
    return rows.repartition("_own").sortWithinPartitions("_own", at, order).mapInPandas(run, f"{key} {types[key]}, {order} {types[order]}, allowed boolean")


def limiter_stream(events: DataFrame, key: str, at: str, order: str, limit: int, window: float, late: str = "10 minutes") -> DataFrame:
    """The same over a stream; a key's state is the times of the hits that it let in, at most ``limit`` of them.

    ``at`` is in seconds. Hits more than ``late`` behind the newest ones of earlier batches are dropped. A key's state goes when
    the watermark has passed the last hit that it let in by ``window``, as none of its times counts from then on.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([at, order], kind="stable")
        kept = list(state.get[0]) if state.exists else []
        said, kept = admit(pdf[at].tolist(), kept, limit, window)
        _keep_until(state, (kept,), max(kept, default=0.0) + window)
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": said})

    rows = events.select(key, order, at, F.timestamp_seconds(F.col(at)).alias("_at")).withWatermark("_at", late)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _keep_until(state: GroupState, value: tuple, seconds: float) -> None:
    """Holds a state until the watermark passes ``seconds``; what is over already is not held."""
    until = int(seconds * 1000) + 1
    if until <= state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
        return
    state.update(value)
    state.setTimeoutTimestamp(until)


def recent_stubs_stream(events: DataFrame, key: list[str], at: str, order: str, ttl: int, late: str = "10 minutes") -> DataFrame:
    """(order, is_stub) of each event of a stream: whether its key was seen at most ``ttl`` seconds before, each sighting anew.

    ``at`` is in whole seconds; events of one second go by ``order``. A key's state is the time it was seen last, and goes when the
    watermark has passed that by ``ttl``. Events more than ``late`` behind the newest ones of earlier batches are dropped; one that
    comes after a later one of its key in another batch is no stub of it and does not turn its time back.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([at, order], kind="stable")
        last, said = state.get[0] if state.exists else None, []
        for now in pdf[at].tolist():
            said.append(last is not None and 0 <= now - last <= ttl)
            last = now if last is None else max(last, now)
        _keep_until(state, (last,), last + ttl)
        yield pd.DataFrame({order: pdf[order], "is_stub": said})

    rows = events.select(*key, order, F.col(at).cast("long").alias(at), F.timestamp_seconds(F.col(at).cast("long")).alias("_at")).withWatermark("_at", late)
    return rows.groupBy(*key).applyInPandasWithState(run, f"{order} {types[order]}, is_stub boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


class ChangeLog:
    """A table (path, hash) kept as a log of changes: a base and the batches after it.

    A micro-batch writes the last change of each of its own paths and nothing else, so what it costs follows the batch. Every
    ``compact_every`` batches the log is written out as a new base. Batches are folders named by their number, so one that is run again
    writes the same again; a base counts once its success marker is there. Batches before the base before last are deleted.
    """

    SCHEMA = "path string, hash string, op string, batch long"

    def __init__(self, spark: SparkSession, table: str, compact_every: int = 16):
        if compact_every < 1:
            raise ValueError("compact_every is at least 1")
        self.spark, self.table, self.compact_every = spark, table.rstrip("/"), compact_every

    def _numbers(self, kind: str, complete: bool = True) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.table}/{kind}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("batch=")] if files.exists(at) else []
        return sorted(int(p.getName().partition("=")[2]) for p in names if not complete or files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.table}/{kind}").parquet(*(f"{self.table}/{kind}/batch={n:012d}" for n in numbers))

    def _latest(self, upto: int | None = None) -> DataFrame:
        bases = [n for n in self._numbers("base") if upto is None or n <= upto]
        base = bases[-1:]
        after = [n for n in self._numbers("delta") if (not base or n > base[0]) and (upto is None or n <= upto)]
        rows = self._read("base", base).unionByName(self._read("delta", after))
        return rows.groupBy("path").agg(F.max_by(F.struct("hash", "op"), "batch").alias("last")).select("path", "last.*").where("op <> 'deleted'")

    def current(self) -> DataFrame:
        """The table as of the last batch: (path, hash)."""
        return self._latest().select("path", "hash")

    def compact(self, number: int) -> None:
        """Writes the base of all batches up to ``number``."""
        self._latest(number).select("path", "hash", "op").write.mode("overwrite").parquet(f"{self.table}/base/batch={number:012d}")
        jvm, bases = self.spark._jvm, self._numbers("base")
        if len(bases) > 1:
            for kind, last in (("base", bases[-2] - 1), ("delta", bases[-2])):
                for old in self._numbers(kind, complete=False):
                    if old <= last:
                        path = jvm.org.apache.hadoop.fs.Path(f"{self.table}/{kind}/batch={old:012d}")
                        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def apply(self, changes: DataFrame, checkpoint: str):
        """A stream writer that takes batches of changes (path, seq, op, hash) into the log; it is started by the caller."""

        def batch(df: DataFrame, number: int) -> None:
            effective_changes(df).select("path", "hash", "op").write.mode("overwrite").parquet(f"{self.table}/delta/batch={number:012d}")
            if (number + 1) % self.compact_every == 0:
                self.compact(number)

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, at: str, size: str, late: str) -> DataFrame:
    """Counts by type in event-time windows with a watermark (an addition of ours)."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), "event_type").agg(F.count("*").alias("n"))

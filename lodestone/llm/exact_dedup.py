"""Exact deduplication as a stream with keyed state on disk.

Documents arrive as a file stream. Each is reduced to a digest of its normalised text, its length, its identifier and its
locator (file and row), and these arrivals are grouped by digest in a streaming aggregation whose state RocksDB holds on the
executors' disks and the checkpoint folder keeps. No watermark is set, so no key ever expires: for every digest ever seen the
state retains how many rows had it, and the identifier and locator of the row that stays. A later run with the same folder
takes new files only and goes on from that state. Groups of any size are pre-aggregated before they are shuffled.

A digest seen more than once is a hit. The texts of hits are read again and compared in full bytes, by grouping them by digest
and text, each text sent once a task; which rows may be hits is told by a bitmap of 2 MB, whatever the table's size. Texts that
share a digest but differ are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch

#: Bits of the map that tells which digests may be hits: 2 MB.
BITS = 1 << 24
#: A group that holds this share of all rows is hot, so there are at most a thousand of them.
HOT_SHARE = 1000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else every partition of the state takes some megabytes of disk ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    """The text without spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns; a null text is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _order(points: Column, doc_id: Column, path: Column, row: Column) -> Column:
    """What the row that stays has least: most code points first, then the smallest id, a null one last, then the locator."""
    return F.struct((-points).alias("less"), doc_id.isNull().alias("unnamed"), doc_id.alias("doc_id"), path.alias("path"), row.alias("row"))


class StreamDedup:
    """Deduplicates documents that arrive as files, with state kept in ``home``, a folder that all executors share.

    Texts are equal when their normalised texts are. Of equal ones the row with the most code points in its original text stays,
    then the smallest doc_id, a null one last; of rows that repeat altogether the first by file and row. A null text is an empty one,
    and all empty or blank texts are equal. Other columns are not read. ``digest`` names a normalised text; texts that differ are
    never taken as equal, whatever it gives.
    """

    def __init__(self, spark: SparkSession, home: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.home, self.digest = spark, home.rstrip("/"), digest

    def _run(self, rows: DataFrame, name: str, sink: str, mode: str) -> None:
        writer = rows.writeStream.format(sink).outputMode(mode).option("checkpointLocation", f"{self.home}/{name}-checkpoint").trigger(availableNow=True)
        with _on_disk(self.spark):
            running = writer.start(f"{self.home}/{name}") if sink == "parquet" else writer.start()
        running.awaitTermination()

    def absorb(self, stream: DataFrame) -> None:
        """Takes all files of the stream that no earlier call with this folder took. ``stream`` is a file stream with doc_id and text."""
        told = stream.select("doc_id", self.digest(normalised()).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
        self._run(told, "arrivals", "parquet", "append")
        seen = self.spark.readStream.schema(self.arrivals().schema).parquet(f"{self.home}/arrivals")
        kept = seen.groupBy("digest").agg(F.count("*").alias("size"), F.min(_order(F.col("points"), F.col("doc_id"), F.col("path"), F.col("row"))).alias("keep"))
        self._run(kept, "groups", "noop", "update")

    def arrivals(self) -> DataFrame:
        """One row for every document so far: doc_id, digest, points, path, row."""
        return self.spark.read.parquet(f"{self.home}/arrivals")

    def groups(self) -> DataFrame:
        """The keyed state: digest, size, keep (doc_id, path and row of the document that stays)."""
        state = self.spark.read.format("statestore").load(f"{self.home}/groups-checkpoint")
        return state.select("key.digest", F.col("value.count").alias("size"), F.col("value.min").alias("keep"))

    def _hits(self, content: DataFrame, many: DataFrame) -> DataFrame:
        """Rows of ``content`` whose digest may be among ``many``, none of which is left out: digest, whole (normalised text), order."""
        bit = F.xxhash64("digest").bitwiseAND(F.lit(BITS - 1))  # never null, so that no filter works the digest out once more
        bitmap = many.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        where = F.col("_metadata")
        rows = content.select(normalised().alias("whole"), _order(F.length(F.coalesce("text", F.lit(""))).cast("long"), F.col("doc_id"), where["file_path"], where["row_index"]).alias("order"))
        rows = rows.withColumn("digest", self.digest(F.col("whole"))).withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("bit", F.bitmap_bit_position(bit).cast("int"))
        byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
        return rows.join(F.broadcast(bitmap), "bucket").where(F.get(F.array(*(F.lit(1 << i) for i in range(8))), F.col("bit") % 8).bitwiseAND(byte) != 0).select("digest", "whole", "order")

    def clashes(self, content: DataFrame, many: DataFrame) -> DataFrame:
        """Digests among ``many`` that texts with different bytes share: the full check of all hits."""
        texts = self._hits(content, many).groupBy("digest", "whole").agg(F.count("*").alias("rows"))
        return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")

    def _by_bytes(self, content: DataFrame, clashing: DataFrame) -> DataFrame:
        """Documents of clashing digests, grouped by their bytes."""
        rows = self._hits(content, clashing).join(clashing, "digest", "left_semi")
        kept = rows.groupBy("digest", "whole").agg(F.count("*").alias("size"), F.min("order").alias("keep"))
        own = F.col("order")
        return rows.join(kept, ["digest", "whole"]).select(own["doc_id"].alias("doc_id"), "digest", own["path"].alias("path"), own["row"].alias("row"), "size", "keep")

    def decisions(self, content: DataFrame) -> DataFrame:
        """Every document taken so far: doc_id, keep_id, group_size, kept, digest, keep_path and keep_row (where the kept text lies).

        ``content`` is the same files as a table. Rows that repeat are rows of their own, one of which stays; no documents give no rows.
        """
        scratch = Scratch(self.spark, "exact-dedup")
        light = self.arrivals().drop("points")
        many = scratch.table(self.groups().where("size > 1"), "many")
        clashing = scratch.table(self.clashes(content, many), "clashing")
        apart = None
        if not clashing.isEmpty():
            apart = scratch.table(self._by_bytes(content, clashing), "apart")
            light, many = light.join(clashing, "digest", "left_anti"), many.join(clashing, "digest", "left_anti")
        total = self.arrivals().count()
        hot = many.where(F.col("size") * HOT_SHARE >= total).select("digest", F.col("size").alias("hot_size"), F.col("keep").alias("hot_keep"))
        rest = many.where(F.col("size") * HOT_SHARE < total).withColumnRenamed("digest", "key")
        # a document of a hot group knows its group already: a key of its own keeps it out of one task
        key = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("path", "row").cast("string")))
        rows = light.join(F.broadcast(hot), "digest", "left").withColumn("key", key).join(rest, "key", "left")
        rows = rows.select("doc_id", "digest", "path", "row", F.coalesce("hot_size", "size").alias("size"), F.coalesce("hot_keep", "keep").alias("keep"))
        rows = rows if apart is None else rows.unionByName(apart)
        alone = F.col("size").isNull()
        return rows.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | ((F.col("keep.path") == F.col("path")) & (F.col("keep.row") == F.col("row")))).alias("kept"),
            "digest",
            F.coalesce("keep.path", "path").alias("keep_path"),
            F.coalesce("keep.row", "row").alias("keep_row"),
        )


def deduplicate(spark: SparkSession, path: str, home: str | None = None, bytes_per_batch: int = 1 << 38) -> DataFrame:
    """The decisions on all documents in the Parquet file or folder ``path``; with a ``home`` of an earlier call only new files are hashed.

    Streams read paths as patterns, so the names in ``path`` should hold none of ``[``, ``{``, ``*`` and ``?``. A batch takes files of
    about ``bytes_per_batch`` together, one file at least.
    """
    content = spark.read.parquet(path)
    # as a pattern, a path may be a file as well as a folder
    stream = spark.readStream.schema(content.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
    dedup = StreamDedup(spark, home or Scratch(spark, "exact-dedup-state").top)
    dedup.absorb(stream)
    return dedup.decisions(content)

"""Tables around the index: accounts, uploads, caches with a time to live, counters and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds and entries of the cache of query vectors.
VECTOR_TTL, VECTOR_ENTRIES = 60, 256


def owned_by(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions or tokens (user_id, ...) with their user (user_id, name); rows of unknown users go."""
    return rows.join(users.select("user_id", "name"), "user_id")


def invite_uses(uses: DataFrame, users: DataFrame) -> DataFrame:
    """All uses of invitations with the user's name, null for a user that is gone."""
    return uses.join(users.select("user_id", "name"), "user_id", "left")


def blobs(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, blob_hash, content) of a ledger (path, blob_hash) from a content-addressed table (blob_hash, content).

    ``content`` is null for a blob that is not there. Equal blobs are stored once, however many paths name them.
    """
    return ledger.join(stored.select("blob_hash", "content"), "blob_hash", "left").select("path", "blob_hash", "content")


def client_scan(seen: DataFrame, cached: DataFrame, config: str) -> DataFrame:
    """(path, state): unchanged, changed or deleted. A cache hit takes both the content hash and the configuration's hash."""
    old = cached.select("path", F.col("hash").alias("old"), F.col("config").alias("old_config"), F.lit(True).alias("was"))
    rows = seen.select("path", "hash", F.lit(True).alias("is")).join(old, "path", "full")
    hit = (F.col("hash") == F.col("old")) & (F.col("old_config") == config)
    return rows.select("path", F.when(F.col("is").isNull(), "deleted").when(hit, "unchanged").otherwise("changed").alias("state"))


def uploaded(files: DataFrame, accepted: DataFrame, skipped: DataFrame) -> DataFrame:
    """``files`` (path, ...) that the server accepted and did not skip."""
    return files.join(accepted.select("path"), "path", "left_semi").join(skipped.select("path"), "path", "left_anti")


def split_errors(rows: DataFrame, error: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, failed keys with their first error): one row's error leaves out all rows of its key, and nothing else."""
    failed = rows.where(F.col(error).isNotNull()).groupBy(key).agg(F.min(error).alias(error))
    return rows.join(failed.select(key), key, "left_anti").drop(error), failed


def check_limits(files: DataFrame, visited: int = 50_000, files_most: int = 2_000, bytes_most: int = 64 << 20) -> DataFrame:
    """Markdown files of a folder (path, length) without version control; beyond any limit the whole scan fails, nothing is cut."""
    markdown = F.lower("path").rlike(r"\.(md|markdown)$")
    sums = files.agg(F.count("*").alias("v"), F.count_if(markdown).alias("f"), F.coalesce(F.sum(F.when(markdown, F.col("length"))), F.lit(0)).alias("b"))
    over = (F.col("v") > visited) | (F.col("f") > files_most) | (F.col("b") > bytes_most)
    checked = sums.select(F.when(over, F.raise_error(F.format_string("too many files: %d visited, %d Markdown files, %d bytes", "v", "f", "b")).cast("boolean")).otherwise(True).alias("_fits"))
    return files.where(markdown).crossJoin(F.broadcast(checked)).where("_fits").drop("_fits")


def live(rows: DataFrame, at: str, ttl: int, now: int) -> DataFrame:
    """Entries that are younger than their time to live."""
    return rows.where(F.lit(now) - F.col(at) < ttl)


def cached_vectors(queries: DataFrame, cache: DataFrame, now: int, ttl: int = VECTOR_TTL) -> DataFrame:
    """``queries`` (model, query, ...) with the vector of a live entry (model, query, vector, at), else null."""
    own = Window.partitionBy("model", "query").orderBy(F.desc("at"))
    fresh = live(cache, "at", ttl, now).withColumn("n", F.row_number().over(own)).where("n = 1")
    return queries.join(fresh.select("model", "query", "vector"), ["model", "query"], "left")


def cache_after(cache: DataFrame, added: DataFrame, entries: int = VECTOR_ENTRIES) -> DataFrame:
    """The cache with new entries: one of a key, the newest; of all keys the last so many that came."""
    own = Window.partitionBy("model", "query").orderBy(F.desc("at"))
    rows = cache.unionByName(added).withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    return rows.orderBy(F.desc("at"), "model", "query").limit(entries)


def rescans(projects: DataFrame, now: int) -> DataFrame:
    """``projects`` (project, last, interval, pending) as due or pending: never scanned before, or not within the interval."""
    due = F.col("last").isNull() | (F.lit(now) - F.col("last") >= F.col("interval"))
    return projects.select("project", F.when(due, "due").when(F.col("pending"), "pending").otherwise("recent").alias("state"))


def embedding_stats(actions: DataFrame) -> DataFrame:
    """Counts over the actions of ``incremental.vector_reuse``: what was embedded, what shared a vector, what was skipped."""
    kind = F.col("action")
    embedded, deduped = F.count_if(kind == "embedded"), F.count_if(kind.isin("reused", "cached", "shared"))
    return actions.agg((embedded + deduped).alias("upserted"), embedded.alias("embedded"), deduped.alias("deduped"), F.count_if(kind == "skipped").alias("skipped"))


def ingest_counters(changes: DataFrame, chunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: files by change, chunks written, and distinct skipped paths (a path skipped twice counts once)."""
    kinds = changes.agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "deleted")))
    return kinds.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(skipped.agg(F.count_distinct("path").alias("skipped")))


def content_signature(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row that any write to the index changes: the newest file, the number of files, the last edge and the last symbol."""
    one = files.agg(F.max("indexed_at").alias("latest"), F.count("*").alias("files"))
    return one.crossJoin(edges.agg(F.max("id").alias("edges"))).crossJoin(symbols.agg(F.max("id").alias("symbols")))

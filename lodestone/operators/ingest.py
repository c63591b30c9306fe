"""Ingest as one job: a batch of changed files goes through parsing, chunking, linking and vector reuse into the index's tables.

The tables are DataFrames by name: files (path, language, content_hash), symbols (path, name, fqn, kind, start_line, end_line,
is_exported), chunks (id, file_path, symbol_fqn, symbol_kind, start_line, end_line, content, content_hash), edges (path, source,
target, kind, line, provenance) and vectors (id, hash). A first ingest starts from ``empty``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, graph, incremental, parse, scanners

SCHEMAS = {
    "files": "path string, language string, content_hash string",
    "symbols": "path string, name string, fqn string, kind string, start_line int, end_line int, is_exported boolean",
    "chunks": "id string, file_path string, symbol_fqn string, symbol_kind string, start_line int, end_line int, content string, content_hash string",
    "edges": "path string, source string, target string, kind string, line int, provenance string",
    "vectors": "id string, hash string",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def parsed(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, raw edges, sections) of files (path, language, text), each by the parser of its language."""
    python, other = texts.where("language = 'python'"), texts.where("language <> 'python'")
    symbols = parse.python_symbols(python).unionByName(scanners.symbols(other))
    edges = parse.python_edges(python).unionByName(scanners.edges(other))
    return chunking.finalize(symbols), edges, parse.sections(texts.where("language = 'markdown'"))


def ingest(index: dict[str, DataFrame], files: DataFrame, changes: DataFrame, cached: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The index after a batch, with three more tables: actions, skipped and counters; all are written below ``folder``.

    Each step reads what the one before has written, so no text is parsed twice and a lost executor repeats a step at most. The
    old index is not touched; readers change over when all is written.

    ``files``: path, content of what was added or modified; ``changes``: path, seq, op (the last of a path counts); ``cached``:
    hash of vectors at hand. What belongs to a touched path is deleted first, the new rows come in, calls are resolved against
    all symbols, those of untouched files included, and vectors go last: kept by id and hash, else reused by hash, taken from
    the cache, or embedded once for each text. Vectors of chunks that are gone are deleted only then, so that a moved chunk
    finds its vector.
    """

    def written(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    last = written("changes", incremental.effective_changes(changes).select("path", "op"))
    kept = incremental.cascade_delete({"files": index["files"], "symbols": index["symbols"], "edges": index["edges"], "chunks": index["chunks"].withColumnRenamed("file_path", "path")}, last)
    prepared = written("prepared", chunking.prepare(files.join(last.where("op <> 'deleted'"), "path", "left_semi")))
    texts = prepared.where("skip_reason is null").select("path", "language", "text", "content_hash")
    symbols, raw, sections = (written(name, rows) for name, rows in zip(("new_symbols", "new_edges", "new_sections"), parsed(texts), strict=True))
    chunks = written("new_chunks", chunking.structural(texts.select("path", "text"), symbols, sections))

    out = {"files": written("files", kept["files"].unionByName(texts.select(*_columns("files"))))}
    out["symbols"] = written("symbols", kept["symbols"].unionByName(symbols.select(*_columns("symbols"))))
    out["chunks"] = written("chunks", kept["chunks"].withColumnRenamed("path", "file_path").select(*_columns("chunks")).unionByName(chunks.select(*_columns("chunks"))))

    own = raw.select("path", "source", "target", "kind", "line").distinct()
    calls = own.where("kind = 'calls'").withColumn("id", F.xxhash64("path", "source", "target", "line"))
    asked = calls.select("id", F.col("source").alias("from_symbol"), F.col("target").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", F.col("path").alias("file_path"), F.lit(None).cast("string").alias("hint_path"))
    found = graph.resolve_references(asked, out["symbols"].withColumnRenamed("path", "file_path")).where("target is not null").select("id", F.col("target").alias("to"), "provenance")
    linked = calls.join(found, "id", "left").select("path", "source", F.coalesce("to", "target").alias("target"), "kind", "line", F.coalesce("provenance", F.lit("failed")).alias("provenance"))
    plain = own.where("kind <> 'calls'").withColumn("provenance", F.lit("parsed"))
    out["edges"] = written("edges", kept["edges"].select(*_columns("edges")).unionByName(linked.unionByName(plain).select(*_columns("edges"))))

    wanted = out["chunks"].select("id", F.col("content_hash").alias("hash"))
    out["actions"] = written("actions", incremental.vector_reuse(wanted, index["vectors"], cached))
    out["vectors"] = written("vectors", wanted)
    out["skipped"] = prepared.where("skip_reason is not null").select("path", "skip_reason")
    counted = lambda rows, name: rows.agg(F.count("*").alias(name))
    kinds = last.agg(*(F.count_if(F.col("op") == op).alias(op) for op in ("added", "modified", "deleted")))
    out["counters"] = kinds.crossJoin(counted(chunks, "chunks")).crossJoin(counted(out["skipped"], "skipped"))
    return out

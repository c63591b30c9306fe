"""Content identities: of a blob (path and bytes), of a file (bytes) and of a chunk (text with unified line ends)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_newlines


def blob_hash(path: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(F.lit("00")), content), 256)


def file_content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_content_hash(text: Column) -> Column:
    return F.sha2(F.encode(normalize_newlines(text), "UTF-8"), 256)


def project_id(identity: Column) -> Column:
    return F.substring(F.sha2(F.encode(identity, "UTF-8"), 256), 1, 16)


def checkpoint_id(hashes: Column) -> Column:
    """Of an array of blob hashes: order and repeats do not matter."""
    return F.concat(F.lit("cp_"), F.substring(F.sha2(F.encode(F.array_join(F.array_sort(F.array_distinct(hashes)), "\n"), "UTF-8"), 256), 1, 16))

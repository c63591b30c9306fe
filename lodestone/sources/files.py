"""Sources: directories, ignore rules, JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, length, skip_reason) of all files below ``root``. Bytes that are not UTF-8 become U+FFFD."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = re.sub("^/+", "/", root.split(":", 1)[-1].rstrip("/"))
    rooted = F.regexp_replace("path", "^.*?" + re.escape(below) + "/", "")
    rows = found.select(rooted.alias("path"), "length", "content").where(~paths.is_pruned(F.col("path")))
    reason = F.coalesce(paths.size_reason(F.col("path"), F.col("length")), F.when(paths.is_binary(F.col("content")), "binary"))
    rows = rows.withColumn("skip_reason", reason)
    return rows.select("path", F.when(F.col("skip_reason").isNull(), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), "length", "skip_reason")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression of the path and all below it, negated) of one line of an ignore file; nothing for blanks and comments."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_dirs, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dirs else "(?:/.*)?$"), negated


def with_ignored(files: DataFrame, rules: list[str]) -> DataFrame:
    """``files`` with ``ignored``: the last rule that matches decides, but nothing below an excluded directory is rescued."""
    compiled = [p for p in map(ignore_pattern, rules) if p]
    own = F.lit(False)
    for pattern, negated in compiled:
        own = F.when(F.col("path").rlike(pattern), not negated).otherwise(own)
    parts = F.split("path", "/")

    def excluded(prefix):
        said = F.lit(False)
        for pattern, negated in compiled:
            said = F.when(prefix.rlike(pattern) | F.concat(prefix, F.lit("/x")).rlike(pattern) & F.lit(pattern.endswith("/.*$")), not negated).otherwise(said)
        return said

    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return files.withColumn("ignored", own | F.exists(above, excluded))


def json_lines(spark: SparkSession, path: str, schema: str, key: str, named: str = "*.jsonl") -> DataFrame:
    """Records of JSON-lines files below ``path`` that are so ``named``; blank and ``#`` lines are skipped. A repeated key raises an error."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", named).text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][key]!r} occurs {repeated[0]['n']} times")
    return rows


def request_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a log of JSON lines, rotated backups included; lines that are no JSON are left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value").where("r is not null and startswith(ltrim(value), '{')")
    return rows.select("r.*")


#: Files and folders that are read though ignored.
ALLOWED = ("agents.md", "claude.md", ".agent.md", ".cursorrules", "handoff.md", "skills")


def allow_entry(line: str) -> tuple[str, bool, bool] | None:
    """(name in lower case, is a folder, negated) of one line of an allow list; nothing for blanks, comments and wildcards.

    A name with a slash, or without a dot, is a folder, of which the last part counts; any other is a file's name.
    """
    text = line.rstrip()
    if not text or text.lstrip().startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:].strip() if negated else text
    text = text[1:] if text[:2] in ("\\#", "\\!") else text
    name = text.strip("/")
    if not name or re.search(r"[*?\[]", text):
        return None
    folder = "/" in text or "." not in text
    return (name.rsplit("/", 1)[-1].lower() if folder else text.lower()), folder, negated


def with_allowed(files: DataFrame, entries: list[str] = (), builtin: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``files`` with ``allowed``: the last entry that matches the file's name, or a folder on its way, decides. Pruned folders are never allowed."""
    low = F.split(F.lower("path"), "/")
    allowed = F.lit(False)
    for entry in filter(None, map(allow_entry, [*builtin, *entries])):
        name, folder, negated = entry
        hit = F.array_contains(F.slice(low, F.lit(1), F.size(low) - 1), name) if folder else F.element_at(low, -1) == name
        allowed = F.when(hit, not negated).otherwise(allowed)
    return files.withColumn("allowed", allowed & ~paths.is_pruned(F.col("path")))


def directory_size(spark: SparkSession, root: str) -> DataFrame:
    """One row: files and bytes below ``root``. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("length")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))

"""Sinks of small results: side files, packs and reports. Paths may be in any store that Spark can write."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file: written beside its place, then moved there, so that readers see the old or the new one."""
    at, store = _place(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = store.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(new, at, options)


def write_side_file(spark: SparkSession, path: str, value: dict) -> None:
    """A manifest or state as JSON with sorted keys."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True))


def read_side_file(spark: SparkSession, path: str) -> dict | None:
    """The value, or nothing if there is no such file or it is no JSON object."""
    at, store = _place(spark, path)
    if not store.exists(at):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        value = json.loads(rows[0][0]) if rows else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


#: Tasks move their own files into place, all at once; else the driver moves every file of the job, one after the other.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Small files that one task writes, about.
FILES_A_TASK = 100


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` that become a file each, dealt to tasks by their number: by their bytes, which are few, Spark would take one task."""
    return rows.repartition(rows.count() // FILES_A_TASK + 1, *by)


def write_side_files(rows: DataFrame, root: str, key: str) -> None:
    """A side file for every row, in a folder named by its ``key`` (one row each), as JSON with sorted keys; the executors write them."""
    names = sorted(c for c in rows.columns if c != key)
    values = rows.select(key, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
    spread(values, key).write.options(**MOVED_BY_TASKS).mode("overwrite").partitionBy(key).text(root)


def read_side_files(spark: SparkSession, root: str, key: str, schema: str) -> DataFrame:
    """(key, value) of all side files below ``root``, value as a struct of ``schema``; a file that holds no JSON object is left out."""
    rows = spark.read.option("wholetext", True).text(root).select(key, "value")
    return rows.where(F.startswith(F.ltrim("value"), F.lit("{"))).select(key, F.from_json("value", schema).alias("value")).where("value IS NOT NULL")


def pack_json(packs: DataFrame, key: str) -> DataFrame:
    """(key, json): items of a pack (position first) as one object for each key; a pack is of bounded size."""
    rest = [c for c in packs.columns if c != key]
    ordered = F.array_sort(F.collect_list(F.struct("position", *(c for c in rest if c != "position"))))
    return packs.groupBy(key).agg(F.to_json(F.struct(ordered.alias("items")), {"ignoreNullFields": "false"}).alias("json"))


def markdown_table(columns: list[str]) -> Column:
    """A row of a Markdown table; pipes and line ends in values are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    return F.concat(F.lit("| "), F.array_join(F.array(*map(cell, columns)), " | "), F.lit(" |"))


def write_report(rows: DataFrame, path: str, title: str, order: list[str]) -> None:
    """A Markdown report with one table, as text files below ``path``. Rows are sorted by ``order`` in a single task: for reports only."""
    names = rows.columns
    head = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines = rows.sparkSession.createDataFrame([(0, n, h) for n, h in enumerate(head)], "part int, n long, value string")
    body = rows.orderBy(*order).coalesce(1).select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("n"), markdown_table(names).alias("value"))
    lines.unionByName(body).coalesce(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)

"""Tables of an index under one version: a change batch is one commit over all of them, and readers see all tables of one version.

Rows lie in buckets by a hash of their path. A commit reads and writes only the buckets that its paths touch, into folders of its
own, and then publishes a manifest that names the folders of every bucket of every table. The manifest is renamed into place,
which one writer alone can do for a version: before it nothing of the commit is seen, after it all of it. Files of buckets that a
commit does not touch are named on by the next manifest. Rows are rebalanced by bucket before they are written: a bucket with one
huge file becomes several files, and few rows become one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published the version that a commit was about to publish."""


def _counted(seen: Observation, *names: str) -> dict[str, int]:
    """What a write observed; nothing where the optimizer saw that no row would come, as then no row is observed."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


class Snapshots:
    """Tables (each with a ``path`` column) below ``folder``, which all executors share.

    ``buckets`` is set by the first commit and kept by the manifest. A table that has no rows in a bucket has no folder for it.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, StructType], buckets: int = 64):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self.buckets = self._manifest(self.version())["buckets"] if self.version() else buckets

    # ------------------------------------------------------------------ manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, at = self._files(), self._path("manifests")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()) if files.exists(at) else []

    def version(self) -> int:
        """The version that readers see; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"buckets": self.buckets, "tables": {name: {} for name in self.schemas}, "counters": {}}
        stream = self._files().open(self._path(f"manifests/{version:020d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        files, draft = self._files(), self._path(f"manifests/.draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        final, jvm = self._path(f"manifests/{version:020d}"), self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without the option to overwrite
            context.rename(draft, final, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise

    # ------------------------------------------------------------------ reading

    def _read(self, manifest: dict, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        held = manifest["tables"].get(name, {})
        folders = [f"{self.folder}/{held[str(b)]}" for b in (held if buckets is None else buckets) if str(b) in held]
        return self.spark.read.schema(self.schemas[name]).parquet(*folders) if folders else self.spark.createDataFrame([], self.schemas[name])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest unless told; its paths' hashes are not looked at."""
        return self._read(self._manifest(self.version() if version is None else version), name)

    def counters(self, version: int | None = None) -> dict[str, int]:
        """What the commit of a version counted while it wrote: rows by table, changed paths by kind."""
        return self._manifest(self.version() if version is None else version)["counters"]

    def bucket(self, path: str = "path") -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------------ writing

    def commit(self, changes: DataFrame, rows: dict[str, DataFrame]) -> int:
        """Replaces, in all tables at once, what belongs to the changed paths; gives the new version.

        ``changes`` has path and change (added, modified or deleted), one row for a path; ``rows`` has the new rows of some tables,
        of changed paths only. A changed path without new rows in a table loses its rows there. A table's null paths are of no file and
        are never changed. A commit without changes publishes nothing. Counters are observed in the very jobs that write.
        """
        before = self.version()
        manifest = self._manifest(before)
        paths, seen = changes.where("path IS NOT NULL").select("path", "change"), Observation(f"changes-{uuid.uuid4().hex}")
        counted = paths.observe(seen, *(F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "deleted")))
        folder = f"commits/{uuid.uuid4().hex}"
        counted.withColumn("bucket", self.bucket()).write.parquet(f"{self.folder}/{folder}/changes")
        paths = self.spark.read.parquet(f"{self.folder}/{folder}/changes")
        touched = sorted(r["bucket"] for r in paths.select("bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return before
        counters = _counted(seen, "added", "modified", "deleted")
        tables = {name: dict(manifest["tables"].get(name, {})) for name in self.schemas}
        for name, schema in self.schemas.items():
            old = self._read(manifest, name, touched).join(paths.select("path"), "path", "left_anti").select(schema.names)
            new = rows.get(name)
            held, made = old, Observation(f"rows-{uuid.uuid4().hex}")
            if new is not None:
                new = new.join(paths.select("path"), "path", "left_semi").select(schema.names)
                held = old.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
            else:
                held = old.withColumn("fresh", F.lit(False))
            held = held.observe(made, F.count_if("fresh").alias("written"), F.count_if(~F.col("fresh")).alias("kept")).drop("fresh")
            at = f"{folder}/{name}"
            held.withColumn("bucket", F.coalesce(self.bucket(), F.lit(0))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
            counters |= {f"{name}_{k}": v for k, v in _counted(made, "written", "kept").items()}
            status = self._files().listStatus(self._path(at))
            found = {s.getPath().getName().partition("=")[2] for s in status if s.isDirectory() and s.getPath().getName().startswith("bucket=")}
            for b in touched:
                tables[name].pop(str(b), None)
            tables[name] |= {b: f"{at}/bucket={b}" for b in found}
        self._publish(before + 1, {"buckets": self.buckets, "tables": tables, "counters": counters})
        return before + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests of all but the last ``keep`` versions and every commit folder that no manifest left names.

        Not to be run while a commit is under way. Gives the number of commit folders that went.
        """
        files, versions = self._files(), self.versions()
        for old in versions[: max(0, len(versions) - keep)]:
            files.delete(self._path(f"manifests/{old:020d}"), False)
        named = {folder.split("/")[1] for v in self.versions() for held in self._manifest(v)["tables"].values() for folder in held.values()}
        gone = 0
        if files.exists(self._path("commits")):
            for s in files.listStatus(self._path("commits")):
                if s.getPath().getName() not in named:
                    gone += files.delete(s.getPath(), True)
        return gone

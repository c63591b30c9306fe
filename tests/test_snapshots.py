"""Commits over several tables, the change log, and stream state that expires."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import snapshots, usage
from lodestone.streaming import stateful


@pytest.fixture
def store(spark, tmp_path):
    schemas = {"files": spark.createDataFrame([], "path string, hash string").schema, "chunks": spark.createDataFrame([], "path string, id string").schema}
    return snapshots.Snapshots(spark, f"file://{tmp_path}", schemas, buckets=8)


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, change string")


def put(spark, store, rows, files, chunks):
    return store.commit(changes(spark, *rows), {"files": spark.createDataFrame(files, "path string, hash string"), "chunks": spark.createDataFrame(chunks, "path string, id string")})


def fill(spark, store):
    names = [f"p{i}" for i in range(40)]
    return put(spark, store, [(n, "added") for n in names], [(n, "1") for n in names], [(n, f"{n}.{j}") for n in names for j in range(3)])


def files_of(store, version):
    manifest = store._manifest(version)
    top = store.folder.removeprefix("file://")
    return {b: sorted(os.listdir(f"{top}/{at}")) for b, at in manifest["tables"]["files"].items()}


def test_a_commit_rewrites_only_the_buckets_it_touches(spark, store):
    assert fill(spark, store) == 1
    touched = {str(r["b"]) for r in changes(spark, ("p3", ""), ("p4", ""), ("new", "")).select(store.bucket().alias("b")).collect()}
    assert put(spark, store, [("p3", "modified"), ("p4", "deleted"), ("new", "added")], [("p3", "2"), ("new", "2"), ("p9", "not changed")], [("p3", "p3.9")]) == 2
    before, after = files_of(store, 1), files_of(store, 2)
    assert all(after[b] == before[b] for b in before if b not in touched) and any(b not in touched for b in before)
    held = {r["path"]: r["hash"] for r in store.read("files").collect()}
    assert len(held) == 40 and held["p3"] == held["new"] == "2" and held["p9"] == "1" and "p4" not in held
    assert sorted(r["id"] for r in store.read("chunks").where("path IN ('p3', 'p4', 'p5')").collect()) == ["p3.9", "p5.0", "p5.1", "p5.2"]
    assert store.read("files", 1).count() == 40 and store.read("chunks", 1).count() == 120
    counted = store.counters()
    assert (counted["added"], counted["modified"], counted["deleted"], counted["files_written"], counted["chunks_written"]) == (1, 1, 1, 2, 1)


def test_a_failed_write_between_tables_changes_nothing(spark, store):
    fill(spark, store)
    broken = spark.createDataFrame([("p3", "x")], "path string, id string").withColumn("id", F.raise_error(F.lit("disk is gone")))
    with pytest.raises(Exception, match="disk is gone"):
        store.commit(changes(spark, ("p3", "modified")), {"files": spark.createDataFrame([("p3", "2")], "path string, hash string"), "chunks": broken})
    assert store.version() == 1 and {r["hash"] for r in store.read("files").collect()} == {"1"} and store.read("chunks").count() == 120
    assert store.vacuum() == 1  # what the failed commit left
    assert put(spark, store, [("p3", "modified")], [("p3", "2")], []) == 2 and store.read("chunks").count() == 117


def test_of_two_writers_one_wins(spark, store):
    fill(spark, store)
    other = snapshots.Snapshots(spark, store.folder, store.schemas)
    assert other.buckets == 8
    manifest = store._manifest(1)
    other._publish(2, manifest)
    with pytest.raises(snapshots.Conflict):
        store._publish(2, manifest)
    assert store.version() == 2 and not any(n.startswith(".draft") for n in os.listdir(store.folder.removeprefix("file://") + "/manifests") if not n.endswith(".crc"))


def test_empty_stores_and_empty_commits(spark, store):
    assert store.version() == 0 and store.read("files").count() == 0
    assert put(spark, store, [], [], []) == 0
    assert put(spark, store, [("a", "added"), (None, "added")], [("a", "1"), (None, "2")], []) == 1
    assert store.read("files").count() == 1 and store.read("chunks").count() == 0
    assert put(spark, store, [("a", "deleted")], [], []) == 2 and store.read("files").count() == 0


LOG = "path string, seq long, op string, hash string"
BATCHES = ([("a", 1, "added", "1"), ("b", 2, "added", "2")], [("a", 3, "modified", "x"), ("a", 4, "modified", "3"), ("b", 5, "deleted", None), ("c", 6, "added", "4")], [("b", 7, "added", "5")], [("c", 8, "deleted", None)], [("d", 9, "added", "6")])


@pytest.mark.parametrize("every", [1, 2, 16])
def test_a_log_holds_the_last_change_and_batches_stay_small(spark, tmp_path, every):
    source, log = str(tmp_path / "in"), stateful.ChangeLog(spark, f"file://{tmp_path}/table", every)
    for rows in BATCHES:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        log.apply(spark.readStream.schema(LOG).parquet(source), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, log.current().collect())) == [("a", "3"), ("b", "5"), ("d", "6")]
    last = spark.read.parquet(f"{tmp_path}/table/delta/batch={4:012d}")
    assert last.count() == 1  # the batch's own change, not the table
    if every == 2:
        assert log._numbers("base") == [1, 3] and log._numbers("delta") == [2, 3, 4]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    log = stateful.ChangeLog(spark, f"file://{tmp_path}/table", 2)
    writes = []

    class Writer:
        def foreachBatch(self, f):
            writes.append(f)
            return self

        def option(self, *_):
            return self

    class Changes:
        writeStream = Writer()

    log.apply(Changes(), "unused")
    for number in (0, 0, 1, 1, 2, 2):
        writes[0](spark.createDataFrame(BATCHES[number], LOG), number)
    assert sorted(map(tuple, log.current().collect())) == [("a", "3"), ("b", "5"), ("c", "4")]
    assert stateful.ChangeLog(spark, f"file://{tmp_path}/none").current().count() == 0


EVENTS = "event_id long, user string, s long"


def drained(spark, tmp_path, make, parts):
    source = str(tmp_path / "in")
    rows, states = [], []
    for rows_ in parts:
        spark.createDataFrame(rows_, EVENTS).coalesce(1).write.mode("append").parquet(source)
        run = make(spark.readStream.schema(EVENTS).parquet(source)).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        run = run.foreachBatch(lambda df, _: rows.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        run.awaitTermination()
        states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    return rows, states


def test_recent_stubs_of_a_stream(spark, tmp_path):
    parts = [[(1, "a", 100), (2, "a", 500), (3, "b", 700), (4, None, 700)], [(5, "a", 1101), (6, "b", 1200), (7, None, 1300)], [(8, "b", 9000), (9, "a", 9001)], [(10, "z", 20_000), (11, "a", 100)], [(12, "y", 40_000)]]
    rows, states = drained(spark, tmp_path, lambda e: stateful.recent_stubs_stream(e, ["user"], "s", "event_id", 600, "100 seconds"), parts)
    in_time = [r for p in parts for r in p if r[0] != 11]
    want = usage.recent_stubs(spark.createDataFrame(in_time, EVENTS), ["user"], "s", 600)
    assert {k: v for k, v in rows if k != 11} == {r["event_id"]: r["is_stub"] for r in want.collect()}
    assert 11 not in dict(rows)  # far behind the watermark
    assert states[0] == 3 and states[-1] <= 2  # keys of the first batches are gone


def test_the_limiters_state_goes(spark, tmp_path):
    parts = [[(i, f"u{i}", 10 + i) for i in range(20)], [(30, "u1", 20_000)], [(31, "u2", 40_000)], [(32, "u2", 60_000)]]
    rows, states = drained(spark, tmp_path, lambda e: stateful.limiter_stream(e.withColumn("s", F.col("s").cast("double")), "user", "s", "event_id", 1, 100.0, "10 seconds"), parts)
    assert len(rows) == 23 and all(allowed for *_, allowed in rows)
    assert states[0] == 20 and states[-1] <= 2

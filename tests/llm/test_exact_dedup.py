"""Exact deduplication against plain Python, over several batches and with digests that clash."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, queries

SCHEMA = "doc_id long, text string, digest string, path string, row string, size string, keep string"
WHITE = " \t\n\x0b\x0c\r"
TEXTS = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "onetwo"), (5, "one\ntwo  "), (6, "one two"), (6, "one two"), (7, "One two"), (8, "one two"), (9, "漢字 é"), (10, "漢字\r\né"), (None, "one  two"), (None, None),
    (11, "word " * 30_000), (12, "word" * 30_000), (13, "alone"), (14, "\x1cx"), (15, "x"), (16, "one\x0btwo\x0c"), (17, "é"), (18, "é"),
]


def plain(text):
    return "".join(c for c in text or "" if c not in WHITE)


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[plain(text)].append((-len(text or ""), i is None, i if i is not None else 0, i))
    return Counter((i, min(groups[plain(text)])[3], len(groups[plain(text)])) for i, text in rows), {k: min(v)[3] for k, v in groups.items()}


def write(spark, rows, path, parts=1):
    spark.createDataFrame([(i, t, *"dprsk") for i, t in rows], SCHEMA).repartition(parts).write.mode("append").parquet(path)


def told(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in df.collect())


def test_groups_are_those_of_plain_python(spark, tmp_path):
    write(spark, TEXTS, str(tmp_path / "docs"), 3)
    got = exact_dedup.deduplicate(spark, str(tmp_path / "docs"), str(tmp_path / "state")).cache()
    want, keepers = brute(TEXTS)
    assert told(got) == want
    assert got.where("kept").count() == len(keepers)  # one row of each group stays, of rows that repeat altogether as well
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[3]["digest"] == hashlib.sha256(b"onetwo").hexdigest() and rows[0]["digest"] == hashlib.sha256(b"").hexdigest()
    at = got.where("doc_id = 4").select("keep_path", "keep_row").first()
    kept = spark.read.parquet(at["keep_path"]).select("text", F.col("_metadata.row_index").alias("n")).where(F.col("n") == at["keep_row"]).first()
    assert kept["text"] == "one\ntwo  "  # the locator leads to the text that stays


def test_state_outlives_a_run(spark, tmp_path):
    docs, home = str(tmp_path / "docs"), str(tmp_path / "state")
    seen = []
    for part in (TEXTS[:7], TEXTS[7:15], TEXTS[15:], [(90, "one    two    longest"), (91, "one two               ")]):
        write(spark, part, docs)
        seen += part
        got = exact_dedup.deduplicate(spark, docs, home)
        assert told(got) == brute(seen)[0]
    dedup = exact_dedup.StreamDedup(spark, home)
    assert dedup.arrivals().count() == len(seen) and dedup.groups().count() == len({plain(t) for _, t in seen})
    dedup.absorb(spark.readStream.schema(SCHEMA).parquet(docs))  # nothing new
    assert dedup.arrivals().count() == len(seen)


def test_small_batches_give_the_same(spark, tmp_path):
    write(spark, TEXTS * 3, str(tmp_path / "docs"), 5)
    got = exact_dedup.deduplicate(spark, str(tmp_path / "docs"), str(tmp_path / "state"), bytes_per_batch=1)
    assert told(got) == brute(TEXTS * 3)[0]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_texts_whose_digests_clash_are_told_apart(spark, tmp_path, bits):
    docs = str(tmp_path / "docs")
    rows = TEXTS + [(100 + i, f"text {i % 7}") for i in range(40)]
    write(spark, rows, docs, 2)
    content = spark.read.parquet(docs)
    dedup = exact_dedup.StreamDedup(spark, str(tmp_path / "state"), digest=lambda t: F.substring(F.conv(F.substring(F.md5(t), 1, 1), 16, 2), 1, bits))
    dedup.absorb(spark.readStream.schema(SCHEMA).parquet(docs))
    got = dedup.decisions(content).cache()
    want, keepers = brute(rows)
    assert told(got) == want and got.where("kept").count() == len(keepers)


def test_a_hot_group_is_not_one_task(spark, tmp_path):
    rows = [(i, "the same text") for i in range(3000)] + [(10_000 + i, f"text number {i}") for i in range(3000)]
    write(spark, rows, str(tmp_path / "docs"), 4)
    got = exact_dedup.deduplicate(spark, str(tmp_path / "docs"), str(tmp_path / "state"))
    assert told(got) == brute(rows)[0]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "docs"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "docs"), str(tmp_path / "state")).count() == 0


def test_settings_are_given_back(spark, tmp_path):
    key = next(iter(exact_dedup._STATE))
    before = spark.conf.get(key)
    write(spark, TEXTS, str(tmp_path / "docs"))
    exact_dedup.deduplicate(spark, str(tmp_path / "docs"), str(tmp_path / "state"))
    assert spark.conf.get(key) == before


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP12})").fetchall())
    got = queries.op12_exact_dedup(spark, sf)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want

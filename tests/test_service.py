"""Tables around the index, side files and reports, allow lists, routes."""

import pytest

from lodestone.operators import parse, service
from lodestone.sources import files, sinks


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_accounts(spark):
    users = spark.createDataFrame([(1, "a")], "user_id int, name string")
    rows = spark.createDataFrame([(1, "s1"), (2, "s2")], "user_id int, session string")
    assert pairs(service.owned_by(rows, users)) == [(1, "s1", "a")]
    assert pairs(service.invite_uses(rows, users)) == [(1, "s1", "a"), (2, "s2", None)]


def test_uploads(spark):
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    cached = spark.createDataFrame([("a", "1", "k"), ("b", "2", "old"), ("d", "4", "k")], "path string, hash string, config string")
    assert pairs(service.client_scan(seen, cached, "k")) == [("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("d", "deleted")]
    assert pairs(service.uploaded(seen, seen.where("path != 'c'"), seen.where("path = 'a'"))) == [("b", "2")]
    stored = spark.createDataFrame([("1", "x")], "blob_hash string, content string")
    assert pairs(service.blobs(seen.withColumnRenamed("hash", "blob_hash"), stored)) == [("a", "1", "x"), ("b", "2", None), ("c", "3", None)]
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "bad"), ("b", 1, None)], "path string, n int, error string")
    good, failed = service.split_errors(rows, "error", "path")
    assert pairs(good) == [("b", 1)] and pairs(failed) == [("a", "bad")]


def test_limits(spark):
    rows = spark.createDataFrame([("a.md", 10), ("b.MARKDOWN", 5), ("c.py", 99)], "path string, length long")
    assert [r[0] for r in pairs(service.check_limits(rows))] == ["a.md", "b.MARKDOWN"]
    for limit in ({"visited": 2}, {"files_most": 1}, {"bytes_most": 14}):
        with pytest.raises(Exception, match="too many files"):
            service.check_limits(rows, **limit).collect()


def test_caches(spark):
    cache = spark.createDataFrame([("m", "q", 1.0, 50), ("m", "q", 2.0, 90), ("m", "old", 3.0, 10)], "model string, query string, vector double, at long")
    asked = spark.createDataFrame([("m", "q"), ("m", "old"), ("n", "q")], "model string, query string")
    assert pairs(service.cached_vectors(asked, cache, 100)) == [("m", "old", None), ("m", "q", 2.0), ("n", "q", None)]
    assert pairs(service.cache_after(cache, cache.selectExpr("model", "'new' AS query", "vector", "200L AS at").limit(1), 2)) == [("m", "new", 1.0, 200), ("m", "q", 2.0, 90)]
    projects = spark.createDataFrame([("a", None, 10, False), ("b", 95, 10, True), ("c", 95, 10, False), ("d", 90, 10, True)], "project string, last long, interval long, pending boolean")
    assert pairs(service.rescans(projects, 100)) == [("a", "due"), ("b", "pending"), ("c", "recent"), ("d", "due")]


def test_counters(spark):
    actions = spark.createDataFrame([(a,) for a in ("embedded", "shared", "reused", "cached", "skipped", "skipped")], "action string")
    assert pairs(service.embedding_stats(actions)) == [(4, 1, 3, 2)]
    changes = spark.createDataFrame([("a", "added"), ("b", "modified"), ("c", "added")], "path string, change string")
    skipped = spark.createDataFrame([("x",), ("x",)], "path string")
    assert pairs(service.ingest_counters(changes, actions, skipped)) == [(2, 1, 0, 6, 1)]
    ids = spark.createDataFrame([(4,), (9,)], "id int")
    assert pairs(service.content_signature(spark.createDataFrame([(7,)], "indexed_at long"), ids, ids.where("id > 99"))) == [(7, 1, 9, None)]


def test_side_files_and_reports(spark, tmp_path):
    at = f"file://{tmp_path}/state.json"
    assert sinks.read_side_file(spark, at) is None
    sinks.write_side_file(spark, at, {"v": 1})
    sinks.write_side_file(spark, at, {"v": 2, "n": "é"})
    assert sinks.read_side_file(spark, at) == {"v": 2, "n": "é"}
    packs = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a|x\ny", 3)], "q int, position int, path string, n int")
    assert sinks.pack_json(packs, "q").first()["json"] == '{"items":[{"position":1,"path":"a|x\\ny","n":3},{"position":2,"path":"b","n":null}]}'
    sinks.write_report(packs, f"file://{tmp_path}/report", "Packs", ["position"])
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/report").collect()][:1] == ["# Packs"]
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.rstrip().split("\n")[-2:] == ["| 1 | 1 | a\\|x y | 3 |", "| 1 | 2 | b |  |"]


def test_allow_list(spark):
    rows = spark.createDataFrame([(p,) for p in ("x/AGENTS.md", ".c/skills/a.md", "skills", "node_modules/skills/a.md", "docs/mine/a.py", "b.py")], "path string")
    allowed = lambda *e: [r["path"] for r in files.with_allowed(rows, list(e)).where("allowed").collect()]
    assert allowed() == ["x/AGENTS.md", ".c/skills/a.md"]
    assert allowed("# x", "", "!skills", "*.py", "docs/mine", "b.py") == ["x/AGENTS.md", "docs/mine/a.py", "b.py"]


def test_directory_of_odd_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff")
    (tmp_path / "b.md").write_bytes(b"12")
    assert {r["path"]: r["text"] for r in files.directory(spark, str(tmp_path)).collect()} == {"a.md": "ok �", "b.md": "12"}
    assert pairs(files.directory_size(spark, str(tmp_path))) == [(2, 6)]


ROUTES = """from fastapi import FastAPI, APIRouter as R
app = FastAPI()
router = R()
other = make()

@app.get("/a")
async def a(): ...

@router.post("/b")
@other.get("/x")
def b(): ...
"""


def test_routes(spark):
    assert parse.route_rows(ROUTES) == [("app", "a", "/a", 6), ("router", "b", "/b", 9)]
    assert parse.route_rows(ROUTES + "app = 1\n") == [("router", "b", "/b", 9)] and parse.route_rows("def (") == []
    assert parse.route_rows("import fastapi\napp = fastapi.FastAPI()\n@app.get('/')\ndef f(): ...\n") == [("app", "f", "/", 3)]
    assert parse.python_routes(spark.createDataFrame([("m.py", ROUTES)], "path string, text string")).count() == 2

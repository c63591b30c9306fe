"""Import hints, ES modules, member calls, writes of resolved references."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import linking


def test_import_hints(spark):
    rows = spark.createDataFrame([("pkg/a/b.py", ".x"), ("pkg/a/b.py", "..m.x"), ("pkg/a/b.py", "m.n.x"), ("pkg/a/b.py", "x"), ("", "a.b"), (None, ".x"), ("top.py", "...y.z")], "f string, n string")
    got = [r[0] for r in rows.select(linking.import_hints(F.col("f"), F.col("n"))).collect()]
    assert got == [
        ["pkg/a/__init__.py", "pkg/a/x.py", "pkg/a/x/__init__.py"], ["pkg/m.py", "pkg/m/__init__.py"], ["m/n.py", "m/n/__init__.py"], [], [], [], ["y.py", "y/__init__.py"],
    ]
    files = spark.createDataFrame([("src/m/n.py",), ("src/xm/n.py",), ("m/n.py",)], "path string")
    refs = spark.createDataFrame([(1, "pkg/a/b.py", "m.n.x")], "id int, file_path string, reference_name string")
    assert sorted(r["path"] for r in linking.hinted_files(refs, files).collect()) == ["m/n.py", "src/m/n.py"]


def test_module_paths(spark):
    rows = spark.createDataFrame([("src/a.ts", "./b.js"), ("src/a.ts", "../c"), ("src/a.ts", "../../d"), ("a.ts", "b"), ("a.ts", "./x%y"), ("src/a.ts", "../../src/b.ts")], "f string, m string")
    got = [r[0] for r in rows.select(linking.module_paths(F.col("f"), F.col("m"))).collect()]
    assert got[0] == ["src/b.js", "src/b.ts"] and got[1][:2] == ["c", "c.js"] and "c/index.tsx" in got[1] and len(got[1]) == 17
    assert got[2:] == [[], [], [], []]


@pytest.fixture(scope="module")
def scripts(spark):
    symbols = [("a.ts::run", "run", "a.ts", "function", True), ("b.ts::run", "run", "b.ts", "export", True), ("c.ts::Box", "Box", "c.ts", "variable", True), ("d.ts::x", "x", "d.ts", "export", True), ("e.ts::x", "x", "e.ts", "export", True), ("a.ts::priv", "priv", "a.ts", "function", False)]
    edges = [("b.ts::run", "js:./a#run", "exports", "parsed"), ("d.ts::x", "js:./e#x", "exports", "parsed"), ("e.ts::x", "js:./d#x", "exports", "parsed")]
    return (
        spark.createDataFrame(symbols, "fqn string, name string, file_path string, kind string, is_exported boolean"),
        spark.createDataFrame([(p,) for p in ("a.ts", "b.ts", "c.ts", "d.ts", "e.ts", "f.ts", "f.js")], "path string"),
        spark.createDataFrame(edges, "source string, target string, kind string, provenance string"),
    )


def test_modules(spark, scripts):
    refs = [(1, "js:./b#run", "m.ts", "calls"), (2, "js:./c#Box", "m.ts", "imports"), (3, "js:./c#Box", "m.ts", "calls"), (4, "js:./d#x", "m.ts", "imports"), (5, "js:./a#priv", "m.ts", "imports"), (6, "js:./f#run", "m.ts", "imports"), (7, "js:./a#*", "m.ts", "imports"), (8, "js:./a#run", "m.py", "imports")]
    got = linking.resolve_modules(spark.createDataFrame(refs, "ref int, target string, source_file string, kind string"), *scripts)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a.ts::run"), (2, "c.ts::Box")]


def test_member_calls(spark):
    symbols = [("EventLoop::run", "run", "c1", "method", "loop.cc"), ("net::EventLoop::run", "run", "c2", "method", "loop.h"), ("A::send", "send", "c3", "method", "a.cc"), ("B::send", "send", "c4", "method", "b.cc"), ("stop", "stop", "c5", "function", "s.py")]
    df = spark.createDataFrame(symbols, "fqn string, name string, chunk_id string, kind string, file_path string")
    targets = spark.createDataFrame([("loop_.run",), ("c->send",), ("x->a.stop",), ("run",), ("y.?",)], "target string")
    assert sorted(tuple(r) for r in linking.member_calls(targets, df).collect()) == [("loop_.run", "EventLoop::run", "c1")]
    whole = spark.createDataFrame([("x.stop",)], "target string")
    assert [tuple(r) for r in linking.member_calls(whole, df).collect()] == [("x.stop", "stop", "c5")]


def test_write_resolved(spark):
    edges = spark.createDataFrame([("a", "f", "g", "calls", 1, "parsed")], "file_path string, source string, target string, kind string, line int, provenance string")
    refs = spark.createDataFrame([(1, "a", "m.g", "pending", None), (2, "a", "m.h", "pending", None), (3, "b", "q", "pending", None)], "id int, file_path string, reference_name string, status string, name_tail string")
    resolved = spark.createDataFrame([(1, "f", "g", "calls", 1, "parsed"), (1, "f", "k", "calls", 1, "synthesized"), (2, "f", None, "calls", 2, None)], "id int, source string, target string, kind string, line int, provenance string")
    after, rest = linking.write_resolved(edges, refs, resolved)
    assert sorted(r["target"] for r in after.collect()) == ["g", "k"]
    assert sorted((r["id"], r["status"], r["name_tail"]) for r in rest.collect()) == [(2, "failed", "h"), (3, "pending", None)]


def test_references(spark):
    refs = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s1", "b")], "spec string, symbol string")
    assert [tuple(r)[:2] for r in linking.references_of(refs, spark.createDataFrame([("b",), ("b",)], "symbol string"), "symbol").select("spec", "symbol").collect()] == [("s1", "b"), ("s2", "b")]
    assert linking.members_of(refs, spark.createDataFrame([("s2",)], "spec string"), "spec").count() == 1

"""Operators that have no SQL twin, on fixtures of their own."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hashing, paths, text
from lodestone.operators import fusion, gap, graph, incremental, packing, parse, recall, tables, usage
from lodestone.sources import files
from lodestone.streaming import stateful


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_scalar_text(spark):
    one = lambda c, v, kind="string": column(spark, [v], kind).select(c.alias("x")).first()["x"]
    assert one(text.segment(F.col("v")), "foo_bar(1) == 2") == "foo _ bar ( 1 ) = = 2"
    assert one(text.name_words(F.col("v")), "parseHttpRequest_v2") == ["parse", "http", "request", "v", "2"]
    assert one(text.name_words(F.col("v")), "app.HTTPServer2Go") == ["app", "http", "server", "2", "go"]
    assert one(text.query_words(F.col("v")), "Where does the HTTP server start_up Server code") == ["http", "server"]
    assert one(text.name_tail(F.col("v")), "a::b.c") == "c"
    assert one(text.estimate_tokens(F.col("v")), "") == 0 and one(text.estimate_tokens(F.col("v")), "a") == 1
    assert one(text.estimate_tokens(F.col("v")), "漢字漢abcd") == 3
    assert one(text.format_bytes(F.col("v")), 1536, "long") == "1.5 KiB" and one(text.format_bytes(F.col("v")), 12, "long") == "12 B"
    assert one(text.relative_age(F.col("v")), 7300, "long") == "2 hours ago"
    assert one(text.l2_normalize(F.col("v")), [3.0, 4.0], "array<double>") == [0.6, 0.8] and one(text.l2_normalize(F.col("v")), [0.0, 0.0], "array<double>") == [0.0, 0.0]
    assert one(text.numbered_lines(F.col("v"), F.lit(7)), "a\nb") == "7 | a\n8 | b"
    assert len(one(hashing.project_id(F.col("v")), "x")) == 16
    assert one(hashing.chunk_content_hash(F.col("v")), "a\r\nb\rc") == one(hashing.file_content_hash(F.encode("v", "UTF-8")), "a\nb\nc")


def test_path_classes(spark):
    def told(f, *values):
        return [r[0] for r in column(spark, values).select(f(F.col("v"))).collect()]

    assert told(paths.language, "a/b.py", "x.TSX", "m.d/none", "k.kt", "h.h") == ["python", "tsx", None, "kotlin", "c"]
    assert told(paths.is_test, "tests/a.py", "src/test_x.py", "a/x_test.go", "latest/a.py") == [True, True, True, False]
    assert told(paths.doctype, "README.md", "docs/a.md", "CHANGELOG.md", "docs/adr/1.md", "x.md") == ["readme", "guide", "changelog", "adr", "guide"]
    assert told(paths.is_example, "examples/a.py", "src/a.py") == [True, False]
    assert told(lambda c: paths.is_pruned(c), "a/node_modules/b.js", "node_modules.md") == [True, False]
    assert told(lambda c: paths.path_matches(F.lit("a/b/c.py"), c), "b/c.py", "c.py", "xc.py") == [True, True, False]
    assert told(lambda c: paths.has_intent(c, ("changelog", "release")), "What is in the Release?", "none") == [True, False]
    generated = spark.createDataFrame([("a_pb2.py", ""), ("a.py", "# Code generated. DO NOT EDIT."), ("a.py", "\n" * 12 + "do not edit")], "p string, t string")
    assert [r[0] for r in generated.select(paths.is_generated(F.col("p"), F.col("t"))).collect()] == [False, True, False]
    data = [bytearray(b"plain text\n"), bytearray(b"a\x00b"), bytearray(b"\x01\x02abc"), bytearray("äöü".encode())]
    assert [r[0] for r in column(spark, data, "binary").select(paths.is_binary(F.col("v"))).collect()] == [False, True, True, False]
    headers = paths.with_languages(column(spark, ["a.h", "b.cpp"]).withColumnRenamed("v", "path")).collect()
    assert {r["path"]: r["language"] for r in headers} == {"a.h": "cpp", "b.cpp": "cpp"}
    alone = paths.with_languages(column(spark, ["a.h"]).withColumnRenamed("v", "path")).collect()
    assert alone[0]["language"] == "c"


def test_ignore_rules(spark):
    rules = ["# note", "*.log", "!keep.log", "/build/", "docs/**/draft", "tmp?", "data[0-9].txt"]
    rows = ["a/x.log", "keep.log", "build/keep.log", "src/build/x", "docs/a/b/draft", "docs/draft/x", "tmp1", "tmp12", "a/data3.txt", "dataX.txt", "ok.py"]
    got = {r["path"]: r["ignored"] for r in files.with_ignored(column(spark, rows).withColumnRenamed("v", "path"), rules).collect()}
    assert [p for p in rows if got[p]] == ["a/x.log", "build/keep.log", "docs/a/b/draft", "docs/draft/x", "tmp1", "a/data3.txt"]


def test_directory_and_json_lines(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("no")
    (tmp_path / "src" / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "src" / "big.txt").write_text("a" * 200_000)
    got = {r["path"]: (r["text"], r["skip_reason"]) for r in files.directory(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.py": ("x = 1\n", None), "c.bin": (None, "binary"), "big.txt": (None, "oversize:200000")}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.jsonl").write_text('# note\n\n{"id": "a", "query": "q"}\n{"id": "b", "query": "r"}\n')
    assert files.json_lines(spark, str(tmp_path / "g"), "id string, query string", "id").count() == 2
    (tmp_path / "g" / "y.jsonl").write_text('{"id": "a"}\n')
    with pytest.raises(ValueError, match="'a' occurs 2 times"):
        files.json_lines(spark, str(tmp_path / "g"), "id string, query string", "id")
    (tmp_path / "req.log").write_text(json.dumps({"id": "1"}) + "\nbroken\n")
    assert [r["id"] for r in files.request_log(spark, str(tmp_path / "req.log"), "id string").collect()] == ["1"]


MARKDOWN = """preface
# One
text
```
# not a heading
```
## Two
### Three
## Two
# Last"""


def test_sections():
    assert parse.markdown_sections(MARKDOWN) == [
        ("", "", 0, 1, 1), ("One", "One", 1, 2, 9), ("Two", "One > Two", 2, 7, 8), ("Three", "One > Two > Three", 3, 8, 8), ("Two", "One > Two", 2, 9, 9), ("Last", "Last", 1, 10, 10),
    ]
    assert parse.markdown_sections("") == []


def test_splitting_loses_nothing():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "word ", "\n", "\n\n", "x" * 30]) for _ in range(rng.randint(0, 120)))
        out = parse.split_text(t, 6, 60)
        assert "".join(p for _, _, p in out) == t and all(len(p) <= 60 for _, _, p in out)
        line = 1
        for first, _, piece in out:
            assert first == line
            line += piece.count("\n")


def test_a_part_that_is_too_large_ends_what_was_joined():
    assert [p for *_, p in parse.split_text("aa\n\nbb cc dd ee\n\nff\n\ngg", 9, 8)] == ["aa\n\n", "bb cc ", "dd ee\n", "\n", "ff\n\ngg"]
    assert parse.split_text("a\nb\nc\n", 2, 99) == [(1, 2, "a\nb\n"), (3, 3, "c\n")]
    assert parse.split_text("x" * 7, 9, 3) == [(1, 1, "xxx"), (1, 1, "xxx"), (1, 1, "x")] and parse.split_text("") == []


def test_files_that_do_not_parse_keep_their_symbols():
    text = "import os\n\nclass A(Base):\n    def good(self):\n        return os.x()\n\ndef broken(:\n    pass\n\n@mark\ndef late():\n    return A()\n\nclass Half:\n    def one(self):\n        return (1\n    def two(self):\n        pass\n"
    symbols, edges, _, error = parse.python_rows(text)
    assert [s[:5] for s in symbols] == [
        ("A", "A", "class", 3, 5), ("good", "A.good", "method", 4, 5), ("broken", "broken", "function", 7, 8), ("late", "late", "function", 10, 12),
        ("Half", "Half", "class", 14, 18), ("one", "Half.one", "method", 15, 16), ("two", "Half.two", "method", 17, 18),
    ]
    assert {e[:3] for e in edges} >= {("", "os", "imports"), ("A", "Base", "extends"), ("A.good", "os.x", "calls"), ("late", "A", "calls")} and error.startswith("SyntaxError")


SOURCE = '''
__all__ = ["Base", "run"]
import os.path
from . import local
from .pkg import thing as other

LIMIT: int = 3

class Base(other):
    @property
    def size(self):
        return os.path.getsize(self.path)

async def run(x):
    def inner():
        return getattr(x, "y")()
    return Base(inner())
'''


def test_python_symbols_and_edges(spark):
    files_ = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    got = {(r["fqn"], r["kind"], r["start_line"], r["is_exported"]) for r in parse.python_symbols(files_).collect()}
    assert got == {("LIMIT", "variable", 7, False), ("Base", "class", 9, True), ("Base.size", "method", 10, False), ("run", "function", 14, True), ("run.inner", "function", 15, False)}
    got = {(r["source"], r["target"], r["kind"]) for r in parse.python_edges(files_).collect()}
    assert got >= {("", "os.path", "imports"), ("", ".local", "imports"), ("", ".pkg.thing", "imports"), ("Base", "other", "extends"), ("Base.size", "os.path.getsize", "calls"), ("run", "Base", "calls"), ("run", "inner", "calls")}
    assert {r["reference"] for r in parse.python_unresolved(files_).collect()} >= {"getattr"}
    assert parse.python_rows("def (")[3].startswith("SyntaxError")


def test_limiter():
    assert stateful.admit([0, 1, 2, 3, 10, 11], [], 2, 10.0) == ([True, True, False, False, True, True], [10, 11])
    assert stateful.admit([0, 0], [], 0, 1.0)[0] == [True, True]


def test_limiter_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    source = str(tmp_path / "in")
    events.repartition(1).write.parquet(source)
    stream = stateful.limiter_stream(spark.readStream.schema(events.schema).parquet(source), "user_id", "s", "event_id", 3, 36_000.0)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = stateful.limiter(events, "user_id", "s", "event_id", 3, 36_000.0)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, want.collect()))


def test_packing(spark):
    rows = [(1, "a", "f1", "code", 0, 0.1, 500), (1, "b", "f1", "code", 2, 9.0, 3000), (1, "c", "f1", "code", 2, 5.0, 3000), (1, "d", "f2", "code", 3, 8.0, 9000), (1, "e", "f3", "code", 2, 1.0, 10), (1, "f", "f4", "spec", 2, 0.5, 100)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, path string, kind string, tier int, score double, tokens long")
    got = [r["chunk_id"] for r in packing.assemble(df, packing.Budget(tokens=8000, per_file=4000)).orderBy("position").collect()]
    assert got == ["a", "b", "f"]
    sections = {r["chunk_id"]: r["section"] for r in packing.render_groups(df).collect()}
    assert sections["b"] == "core" and sections["c"] == "related" and sections["f"] == "docs"
    sure = packing.answerability(df.withColumn("channels", F.lit(2))).first()
    assert sure["answerable"] and sure["confidence"] == "medium"


def test_packing_merges_cuts_and_keeps_floors(spark):
    schema = "query_id int, chunk_id string, path string, kind string, tier int, score double, tokens long, symbol_fqn string, start_line int, end_line int, head_tokens long"
    rows = [
        # near ranges are one item and pay for their lines once; another chunk of the symbol goes
        (1, "a", "f", "code", 2, 9.0, 1000, "A", 1, 10, None), (1, "b", "f", "code", 2, 8.0, 1000, "B", 6, 15, None), (1, "c", "f", "code", 2, 7.0, 100, "A", 90, 91, None), (1, "d", "f", "code", 2, 7.0, 300, "D", 40, 50, None),
        # beyond the whole budget: the head is shown; the best document has its place; documents have 950 tokens
        (2, "a", "f", "code", 2, 9.0, 20_000, None, None, None, 80), (2, "s", "m", "spec", 2, 3.7, 2000, None, None, None, None), (2, "t", "m", "spec", 2, 3.65, 10, None, None, None, None),
        # a file has 2,500 tokens unless its chunk is near the best; code is taken below the floor if there is too little
        (3, "a", "f", "code", 2, 9.0, 4000, None, None, None, None), (3, "b", "g", "code", 2, 5.0, 2400, None, None, None, None), (3, "c", "g", "code", 2, 4.9, 200, None, None, None, None), (3, "d", "h", "code", 3, 4.0, 3000, None, None, None, None),
        (4, "a", "f", "code", 2, 9.0, 13_000, None, None, None, None), (4, "b", "g", "code", 2, 0.01, 50, None, None, None, None),
    ]
    got = {}
    for r in packing.assemble(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = (r["position"], r["form"], r["tokens"], r["used"])
    assert got[1] == {"a": (1, "whole", 1000, 2300), "b": (1, "merged", 500, 2300), "d": (2, "whole", 300, 2300)}
    assert got[2] == {"a": (1, "head", 80, 2580), "s": (2, "whole", 2000, 2580)}
    assert {k: v[0] for k, v in got[3].items()} == {"a": 1, "b": 2}
    assert set(got[4]) == {"a", "b"}


def test_fusion_keeps_first_ranks(spark):
    lists = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "a", 4), (1, "x", "b", 2), (1, "y", "b", 1)], "q long, channel string, k string, rank int")
    rows = {r["k"]: r for r in fusion.reciprocal_rank_fusion(lists, "q", "k").collect()}
    assert rows["a"]["channel_ranks"] == {"x": 1} and rows["b"]["channel_ranks"] == {"x": 2, "y": 1} and rows["b"]["position"] == 1


def test_incremental_tables(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert sorted(map(tuple, incremental.upsert_last(table, new, "k", "seq").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    config = spark.createDataFrame([("parser_config_hash", "p"), ("embedding_model", "m"), ("embedding_dim", "8")], "key string, value string")
    said = lambda c, *a: incremental.invalidation(c, *a).first()["action"]
    assert [said(config.limit(0), "p", "m", 8), said(config, "q", "m", 8), said(config, "p", "m", 9), said(config, "p", "m", 8)] == ["none", "full_reparse", "reembed", "none"]
    old = spark.createDataFrame([("s1", "f"), ("s2", "g")], "id string, fqn string")
    moved = spark.createDataFrame([("s9", "f")], "id string, fqn string")
    refs = spark.createDataFrame([("d", "s1"), ("d", "s2")], "spec string, symbol string")
    assert sorted(map(tuple, incremental.stale_references(refs, old, moved).collect())) == [("d", "s2", True), ("d", "s9", False)]


def test_literal_needs_four_characters(spark):
    df = spark.createDataFrame([(1, "name", "body body")], "id long, name string, body string")
    assert recall.literal(df, "id", "name", "body", "bod").count() == 0 and recall.literal(df, "id", "name", "body", "BODY").first()["times"] == 2


def test_percentile_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(10)], "g int, v double")
    assert usage.nearest_rank(df, "g", "v", 0.95).first()["percentile"] == 9.0 and usage.nearest_rank(df, "g", "v", 0.25).first()["percentile"] == 1.0


def test_walk_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, line int")
    row = graph.walk(edges, spark.createDataFrame([("a",), ("z",)], "start string")).orderBy("start").collect()
    assert [tuple(r) for r in row] == [("a", ["a", "b"], True), ("z", ["z"], False)]


def test_citations(spark):
    df = spark.createDataFrame([("one [E1] [E9]\n\ntwo [F1]", ["E1", "F1"])], "t string, k array<string>")
    row = usage.verified_citations(df, "t", "k").first()
    assert (row["valid"], row["invalid"], row["coverage"]) == (2, 1, 1.0)


def test_nothing_but_the_entry_names_the_llm_package():
    import pathlib

    top = pathlib.Path(__file__).parent.parent / "lodestone"
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"lodestone\.llm|import llm", p.read_text()), p


def test_second_round(spark):
    schema = "query_id long, pack int, position int, path string, start_line int, end_line int, elided int"
    base = spark.createDataFrame([(1, 0, 1, "a", 1, 10, 5), (1, 0, 2, "b", 1, 10, 0)], schema)
    extra = spark.createDataFrame([(1, 1, 1, "a", 1, 30, 0), (1, 1, 2, "b", 5, 30, 3), (1, 1, 3, "c", 1, 2, 0), (1, 1, 7, "d", 1, 2, 0)], schema)
    assert {(r["path"], r["end_line"]) for r in gap.merge_packs(base, extra).collect()} == {("a", 30), ("b", 10), ("c", 2)}
    asked = spark.createDataFrame([(1, 1, 0, 0, 3), (2, 0, 0, 2, 0)], "query_id long, unresolved int, stale_docs int, omitted int, items int")
    index = spark.createDataFrame([(False, 2)], "stale boolean, pending int")
    got = sorted((r["query_id"], r["code"]) for r in gap.missing_evidence(asked, index).collect())
    assert got == [(1, "indexing_pending"), (1, "unresolved_reference"), (2, "indexing_pending"), (2, "no_context_match"), (2, "retrieval_truncated")]
    rows = spark.createDataFrame([(1, "x", 1, False, 0, 1.0, 1, 5), (1, "y", 1, True, 0, 0.5, 1, 5), (1, "z", 0, False, 0, 0.1, 1, 5)], "query_id long, chunk_id string, source_class int, in_chain boolean, overlap int, score double, start_line int, end_line int")
    assert [r["chunk_id"] for r in gap.backfill_order(rows).orderBy("position").collect()] == ["z", "y", "x"]


def test_index_tables(spark):
    edges = spark.createDataFrame([("p/__init__.py", ".m.run", "imports"), ("p/x.py", "m.run", "imports"), ("p/__init__.py", "m.other", "imports")], "source string, target string, kind string")
    assert [tuple(r) for r in tables.reexports(edges, spark.createDataFrame([("run",)], "name string")).collect()] == [("run", "p/__init__.py")]
    symbols = spark.createDataFrame([("1", "run", "a.run"), ("2", "run", "b.run"), ("3", "go", "c.go")], "id string, name string, fqn string")
    mentions = spark.createDataFrame([("d", "a.run"), ("d", "go"), ("e", "run")], "spec string, mention string")
    known = spark.createDataFrame([("d", "3")], "spec string, symbol string")
    assert sorted(map(tuple, tables.link_sections(mentions, symbols, known).collect())) == [("d", "1"), ("e", "1"), ("e", "2")]
    refs = spark.createDataFrame([(1, "x.run", "run", "failed"), (2, "zip", "zip", "failed"), (3, "run", "run", "pending")], "id int, reference_name string, name_tail string, status string")
    assert [r["id"] for r in tables.retry_failed(refs, symbols).collect()] == [1]
    chunks = spark.createDataFrame([("c1", "@Deprecated", "function"), ("c2", "x", "spec_block")], "id string, content string, symbol_kind string")
    ids = spark.createDataFrame([(2, "c1"), (1, "c2"), (3, "gone")], "position int, id string")
    assert [r["id"] for r in tables.fetch(chunks, ids).orderBy("position").collect()] == ["c2", "c1"]
    assert [r["id"] for r in tables.with_marker(chunks, ids, "@deprecated").collect()] == ["c1"]
    row = tables.counts(spark.createDataFrame([("a", 5), ("b", 9)], "path string, indexed_at long"), chunks, refs)
    assert tuple(row.first()) == (2, 9, 2, True, 1, 2)
    stored = spark.createDataFrame([("ready", 2, 2, 0)], "state string, files int, chunks int, vectors int")
    assert tables.index_gap(row.select("files", "chunks"), stored).first()["reason"] == "vectors"
    ledger = spark.createDataFrame([("a", "h", 3), ("b", "h", 4)], "path string, hash string, size long")
    assert tuple(tables.ledger_counts(ledger).first()) == (2, 1, 7) and tuple(tables.ledger_counts(ledger.limit(0)).first()) == (0, 0, 0)
    runs = spark.createDataFrame([(1, "k", 9), (2, "z", 1)], "id int, call_id string, at long")
    asked = spark.createDataFrame([(7, "k", 3)], "id int, call_id string, at long")
    assert [tuple(r) for r in tables.call_timeline(runs, asked, F.lit("k")).collect()] == [("query", 7, 3), ("index", 1, 9)]
    rows = [(1, "h", "a.h", "n::f", "cpp", "f();", 9.0), (1, "s", "a.cc", "n::f", "cpp", "f() {}", 5.0), (1, "p", "a.py", "f", "python", "", 1.0), (1, "q", "b.py", "f", "python", "", 1.0)]
    found = tables.same_symbol(spark.createDataFrame(rows, "query_id long, chunk_id string, path string, fqn string, language string, content string, score double"))
    assert {r["chunk_id"] for r in found.collect()} == {"s", "p", "q"}
    assert tables.stage_times(spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.5)], "name string, wall double, cpu double")).first()["wall"] == 3.0
    pool = spark.createDataFrame([(1, "a", 2, 3.0), (1, "b", 2, 1.0), (1, "b", 1, 9.0)], "query_id long, path string, channels int, score double")
    assert tuple(tables.consensus(pool).first()) == (1, 2, 2, 3.0, 3.0)
    specs = spark.createDataFrame([("d", True), ("d", True), ("e", False)], "spec string, stale boolean")
    assert [r["spec"] for r in tables.stale_specs(specs, specs.select("spec").distinct()).collect()] == ["d"]

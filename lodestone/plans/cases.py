"""Queries of rules on paths, names and texts: every part gets a case by its key, and SQL has the values listed by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import mentions, paths, text
from lodestone.operators import chunking, parse, scanners
from lodestone.plans.registry import query, table
from lodestone.sources import files


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _values(cases: list[tuple], columns: list[str]) -> str:
    """SQL of every part with the expected values of its case; the first field of a case is its input."""
    rows = ", ".join("(" + ", ".join(map(_literal, (n, *case[1:]))) + ")" for n, case in enumerate(cases))
    return f"SELECT p_partkey, {', '.join(columns)} FROM part JOIN (VALUES {rows}) AS c(n, {', '.join(columns)}) ON p_partkey % {len(cases)} = n"


def _inputs(spark: SparkSession, d: str, cases: list[tuple], name: str = "v") -> DataFrame:
    """Every part with the input of its case."""
    inputs = F.array(*(F.lit(case[0]) for case in cases))
    return table(spark, d, "part").select("p_partkey", F.get(inputs, (F.col("p_partkey") % len(cases)).cast("int")).alias(name))


def listed(cases: list[tuple], columns: list[str]) -> Callable:
    """Registers ``f(column)``, a list of expressions, as a query with the listed values as its SQL."""

    def register(f: Callable[[Column], list[Column]]) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return _inputs(spark, d, cases).select("p_partkey", *(c.alias(name) for c, name in zip(f(F.col("v")), columns, strict=True)))

        run.__name__ = f.__name__
        query(_values(cases, columns))(run)
        return f

    return register


PATHS = [
    ("src/main.py", False, False, False, False, "guide", "python"),
    ("tests", True, False, False, False, "guide", None),
    ("test_foo", False, False, False, False, "guide", None),
    ("pkg/test_foo.py", True, False, False, False, "guide", "python"),
    ("pkg/foo_test.go", True, False, False, False, "guide", None),
    ("a/testdata/x.json", True, False, False, False, "guide", None),
    ("latest/contest.c++", False, False, False, False, "guide", "cpp"),
    ("docs/releases/v1.md", False, True, False, False, "guide", "markdown"),
    ("CHANGELOG.md", False, True, False, False, "changelog", "markdown"),
    ("changes.py", False, False, False, False, "guide", "python"),
    ("release notes.txt", False, True, False, False, "guide", None),
    ("docs_src/tutorial/app.py", False, False, True, False, "guide", "python"),
    ("cookbook/x.tsx", False, False, True, False, "guide", "tsx"),
    ("Snippets/a.MDX", False, False, True, False, "guide", "markdown"),
    ("example.py", False, False, False, False, "guide", "python"),
    ("env/lib/x.h++", False, False, False, True, "guide", "cpp"),
    ("a/.ruff_cache/b", False, False, False, True, "guide", None),
    ("pkg.eggs/.eggs/x.ipp", False, False, False, True, "guide", "cpp"),
    ("vendor/lib.tpp", False, False, False, False, "guide", "cpp"),
    ("cmake-build-debug/x.c", False, False, False, True, "guide", "c"),
    ("build-x/y/z.rs", False, False, False, True, "guide", "rust"),
    ("outer/out/z.kts", False, False, False, True, "guide", "kotlin"),
    ("build", False, False, False, False, "guide", None),
    ("AGENTS.md", False, False, False, False, "agent-instructions", "markdown"),
    ("x/Skill.md", False, False, False, False, "agent-instructions", "markdown"),
    ("README", False, False, False, False, "readme", None),
    ("docs/design/x.md", False, False, False, False, "design", "markdown"),
    ("Architecture-2.md", False, False, False, False, "design", "markdown"),
    ("docs/adr/7.md", False, False, False, False, "adr", "markdown"),
    ("api.md", False, False, False, False, "api", "markdown"),
    ("x/OpenAPI.markdown", False, False, False, False, "api", "markdown"),
    ("src/foo.md", False, False, False, False, "guide", "markdown"),
]


@listed(PATHS, ["test", "changelog", "example", "pruned", "doctype", "language"])
def path_rules(v: Column) -> list[Column]:
    return [paths.is_test(v), paths.is_changelog(v), paths.is_example(v), paths.is_pruned(v), paths.doctype(v), paths.language(v)]


GENERATED = [
    ("foo_generated.py|x", True),
    ("a/x.pb2.py|x", True),
    ("a/x.pb.cc|x", True),
    ("x.Designer.cs|x", True),
    ("autogen_table.c|x", True),
    ("x.g.cs|x", True),
    ("x_pb2.py|x", False),
    ("x.min.js|x", False),
    ("x.generated.ts|x", False),
    ("a.go|// Code generated by protoc. DO NOT EDIT.", True),
    ("a.go|// please don't edit", True),
    ("a.go|/* @generated */", True),
    ("block.cc|// blocks generated by block_builder.cc", False),
    ("a.py|1\n2\n3\n4\n5\n6\n7\n8\n9\nautomatically generated", True),
    ("a.py|1\n2\n3\n4\n5\n6\n7\n8\n9\n10\nautomatically generated", False),
]


@listed(GENERATED, ["generated"])
def generated_files(v: Column) -> list[Column]:
    return [paths.is_generated(F.split(v, r"\|", 2)[0], F.split(v, r"\|", 2)[1])]


NAMES = [
    ("HTTPServer2Go", "http server 2 go"),
    ("app.parseHttpRequest_v2", "app parse http request v 2"),
    ("leveldb::DBImpl::Get", "leveldb db impl get"),
    ("XMLHttpRequest", "xml http request"),
    ("a-b/c_d", "a b c d"),
    ("aaAA", "aa"),
    ("99bottles", "99 bottles"),
    ("", ""),
]


@listed(NAMES, ["words"])
def name_word_lists(v: Column) -> list[Column]:
    return [F.array_join(text.name_words(v), " ")]


QUERIES = [
    ("Where is the HTTP cache implemented", "http cache", False, False, False),
    ("which unittest covers parse_args", "unittest covers", True, False, False),
    ("what's new in version 3", "version", False, True, False),
    ("Show a SAMPLE of the demo", "show sample demo", False, False, True),
    ("更新日志在哪里", "", False, True, False),
    ("示例 and 测试", "", True, False, True),
    ("latest Latest value of x1abc", "latest", True, False, False),
    ("", "", False, False, False),
]


@listed(QUERIES, ["words", "asks_test", "asks_changelog", "asks_example"])
def query_intents(v: Column) -> list[Column]:
    return [F.array_join(text.query_words(v), " "), *(paths.has_intent(v, w) for w in (paths.TEST_WORDS, paths.CHANGELOG_WORDS, paths.EXAMPLE_WORDS))]


LANGUAGE_MARKS = [
    ("docs/zh/guide/a.md", "docs/guide/a.md", "zh"),
    ("docs/guide/a.md", "docs/guide/a.md", None),
    ("README.zh-CN.md", "README.md", "zh-cn"),
    ("v1-ja.md", "v1.md", "ja"),
    ("notes_pt_br.rst", "notes.rst", "pt_br"),
    ("src/de/code.py", "src/de/code.py", None),
    ("a/KO/b/fr/c.txt", "a/b/fr/c.txt", "ko"),
    ("xen.md", "xen.md", None),
]


@listed(LANGUAGE_MARKS, ["variant_key", "locale"])
def translation_keys(v: Column) -> list[Column]:
    return [paths.translation(v)["key"], paths.translation(v)["locale"]]


KINDS = [
    ("spec_block|tests/a.md", "spec"),
    ("fallback_block|tests/a.py", "fallback"),
    ("function|tests/a.py", "test"),
    ("method|src/a_test.py", "test"),
    ("function|src/a.py", "code"),
    ("class_skeleton|testing/a.py", "code"),
]


@listed(KINDS, ["kind"])
def chunk_kinds(v: Column) -> list[Column]:
    return [paths.chunk_kind(F.split(v, r"\|")[0], F.split(v, r"\|")[1])]


SIZES = [
    ("a.py|1048576", None),
    ("a.py|1048577", "oversize:1048577"),
    ("a.md|900000", None),
    ("a.json|131072", None),
    ("a.json|131073", "oversize:131073"),
    ("Makefile|200000", "oversize:200000"),
]


@listed(SIZES, ["skip_reason"])
def size_limits(v: Column) -> list[Column]:
    return [paths.size_reason(F.split(v, r"\|")[0], F.split(v, r"\|")[1].cast("long"))]


#: Bytes in hexadecimal.
BYTES = [
    ("", False),
    ("706C61696E0A09", False),
    ("6100", True),
    ("0102616263", True),
    ("01616263646566676869", False),
    ("0D0A0D0A09", False),
    ("E4B8ADE69687", False),
    ("61" * 8192 + "00", False),
    ("61" * 8191 + "00", True),
]


@listed(BYTES, ["is_binary"])
def binary_files(v: Column) -> list[Column]:
    return [F.coalesce(paths.is_binary(F.unhex(v)), F.lit(False))]


#: Path, and whether these rules ignore it. The last rule that matches decides; nothing below an ignored folder comes back.
RULES = ["# comment", "", "*.log", "!keep.log", "/top.txt", "cache/", "!cache/keep.txt", "docs/**/*.tmp", "a?c", "[xy].dat", "deep/*/z", "\\!not"]
IGNORED = [
    ("x.log", True),
    ("a/b/x.log", True),
    ("keep.log", False),
    ("a/keep.log", False),
    ("top.txt", True),
    ("a/top.txt", False),
    ("cache/x", True),
    ("a/cache/x/y", True),
    ("cache/keep.txt", True),
    ("cache", False),
    ("docs/x.tmp", True),
    ("docs/a/b/x.tmp", True),
    ("other/x.tmp", False),
    ("abc", True),
    ("abc/inner", True),
    ("abbc", False),
    ("x.dat", True),
    ("z.dat", False),
    ("deep/q/z", True),
    ("deep/q/r/z", False),
    ("#", False),
]


@query(_values(IGNORED, ["ignored"]))
def ignore_rules(spark, d):
    return files.with_ignored(_inputs(spark, d, IGNORED, "path"), RULES).select("p_partkey", "ignored")


ALLOW = ["docs/private/", "notes.txt", "!handoff.md", "*.skip", "# x"]
ALLOWED = [
    ("AGENTS.md", True),
    ("a/Claude.md", True),
    ("handoff.md", False),
    ("a/skills/x.py", True),
    ("skills.py", False),
    ("x/private/y.z", True),
    ("private.md", False),
    ("b/notes.txt", True),
    ("node_modules/agents.md", False),
    ("x.skip", False),
    ("src/x.py", False),
]


@query(_values(ALLOWED, ["allowed"]))
def allow_list(spark, d):
    return files.with_allowed(_inputs(spark, d, ALLOWED, "path"), ALLOW).select("p_partkey", "allowed")


MENTIONS = [
    ("Call `do_it` before readConfig.", "do_it|readConfig"),
    ("See src/app/main.py and MAX_SIZE, then Foo::bar", "src/app/main.py|MAX_SIZE|Foo::bar"),
    ("nothing named here", ""),
    ("snake_case snake_case HttpServer", "snake_case|HttpServer"),
]


@query(_values(MENTIONS, ["found"]))
def section_mentions(spark, d):
    cases = _inputs(spark, d, MENTIONS)
    found = mentions.mentions(cases, "p_partkey", "v").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("position", "mention"))).alias("m"))
    joined = F.array_join(F.transform("m", lambda m: m["mention"]), "|")
    return cases.select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.coalesce(joined, F.lit("")).alias("found"))


#: Text, and its pieces within 3 lines and 12 characters, each as first-last:text.
SPLITS = [
    ("one\ntwo\nthree\nfour", "1-2:one\ntwo\n~3-4:three\nfour"),
    ("aa\n\nbb cc dd ee ff\n\ngg", "1-2:aa\n\n~3-3:bb cc dd ee ~3-3:ff\n~4-4:\n~5-5:gg"),
    ("abcdefghijklmnopqrstuvwxyz", "1-1:abcdefghijkl~1-1:mnopqrstuvwx~1-1:yz"),
    ("a\nb\nc\n", "1-3:a\nb\nc\n"),
    ("a\n\n\n\nb", "1-2:a\n\n~3-5:\n\nb"),
    ("short", "1-1:short"),
]


@query(_values(SPLITS, ["pieces"]))
def split_pieces(spark, d):
    cases = _inputs(spark, d, SPLITS, "text").withColumn("path", F.col("p_partkey").cast("string"))
    made = parse.fallback_chunks(cases, 3, 12)
    told = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(":"), F.col("content"))
    rows = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("piece", told.alias("told")))).alias("p"))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), F.array_join(F.transform("p", lambda x: x["told"]), "~").alias("pieces"))


PYTHON = [
    ("def f():\n    g()\n", "f function 1-2 True"),
    ("class A(B):\n    def m(self):\n        pass\n", "A class 1-3 True; A.m method 2-3 False"),
    ("@d\nasync def _h():\n    pass", "_h function 1-3 False"),
    ("__all__ = ['x']\nx: int = 1\ndef y(): pass", "x variable 2-2 True; y function 3-3 False"),
    ("def ok():\n    pass\n\ndef bad(:\n    pass\n\nclass C:\n    pass\n", "ok function 1-2 True; bad function 4-5 True; C class 7-8 True"),
    ("import os", ""),
]


def _told_symbols(rows: DataFrame) -> DataFrame:
    one = F.concat_ws(" ", "fqn", "kind", F.concat_ws("-", "start_line", "end_line"), F.initcap(F.col("is_exported").cast("string")))
    listed_ = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "fqn", one.alias("one")))).alias("s"))
    return listed_.select("path", F.array_join(F.transform("s", lambda x: x["one"]), "; ").alias("symbols"))


def _symbols_of(cases: DataFrame, found: DataFrame) -> DataFrame:
    return cases.select("p_partkey", "path").join(_told_symbols(found), "path", "left").select("p_partkey", F.coalesce("symbols", F.lit("")).alias("symbols"))


@query(_values(PYTHON, ["symbols"]))
def python_definitions(spark, d):
    cases = _inputs(spark, d, PYTHON, "text").withColumn("path", F.col("p_partkey").cast("string"))
    return _symbols_of(cases, parse.python_symbols(cases))


PYTHON_EDGES = [
    ("import os.path\nfrom ..a import b\n", "extends 0; imports os.path ..a.b; calls 0"),
    ("class A(pkg.B):\n    def m(self):\n        self.x.go(f())\n", "extends pkg.B; imports 0; calls self.x.go f"),
    ("getattr(a, 'b')()\n", "extends 0; imports 0; calls 0"),
]


@query(_values(PYTHON_EDGES, ["edges"]))
def python_references(spark, d):
    cases = _inputs(spark, d, PYTHON_EDGES, "text").withColumn("path", F.col("p_partkey").cast("string"))
    in_place = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "target")))).getField("target")
    found = parse.python_edges(cases, placed=True).groupBy("path").agg(*(in_place(k).alias(k) for k in ("extends", "imports", "calls")))
    none = F.array().cast("array<string>")
    rows = cases.select("p_partkey", "path").join(found, "path", "left")
    told = [F.concat(F.lit(f"{k} "), F.when(F.size(F.coalesce(k, none)) == 0, "0").otherwise(F.array_join(k, " "))) for k in ("extends", "imports", "calls")]
    return rows.select("p_partkey", F.concat_ws("; ", *told).alias("edges"))


ROUTES = [
    ("from fastapi import FastAPI\napp = FastAPI()\n@app.get('/a')\ndef a(): pass\n@app.post('/b')\nasync def b(): pass\n", "app>a /a; app>b /b"),
    ("import fastapi\nr = fastapi.APIRouter()\n@r.delete('/x')\ndef x(): pass\n", "r>x /x"),
    ("from fastapi import FastAPI\napp = FastAPI()\napp = other()\n@app.get('/a')\ndef a(): pass\n", ""),
    ("app = make()\n@app.get('/a')\ndef a(): pass\n", ""),
]


@query(_values(ROUTES, ["routes"]))
def route_registrations(spark, d):
    cases = _inputs(spark, d, ROUTES, "text").withColumn("path", F.col("p_partkey").cast("string"))
    one = F.concat(F.col("source"), F.lit(">"), F.col("target"), F.lit(" "), F.col("route"))
    found = parse.python_routes(cases).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", one.alias("one")))).alias("r"))
    rows = cases.select("p_partkey", "path").join(found, "path", "left")
    return rows.select("p_partkey", F.coalesce(F.array_join(F.transform("r", lambda x: x["one"]), "; "), F.lit("")).alias("routes"))


#: Language and text, and the names of the symbols that the line scanners find, by line.
SCANNED = [
    ("c|#include <x.h>\nint add(int a, int b) {\n  return a + b;\n}\nstruct P { int x; };\n", "add P"),
    ("cpp|namespace n {\nclass A {\n public:\n  void go() { f(); }\n};\n}\n", "n A go"),
    ("javascript|export function run() { go(); }\nclass K {\n  m() { return 1; }\n}\n", "run K m"),
    ("kotlin|class A {\n  fun b(): Int { return 1 }\n}\nfun c() { d() }\n", "A b c"),
    ("rust|pub struct S;\nimpl S {\n  pub fn new() -> S { S }\n}\nfn main() { S::new(); }\n", "S new main"),
    ("c|/* int hidden() { } */\nint seen(void)\n{\n}\n", "seen"),
    ("cpp|class A\n    : public B\n{\n  int one(int a,\n          int b)\n  {\n    return two(a);\n  }\n};\nint declared(int);\nvoid A::three()\n{\n}\n", "A one three"),
]


@query(_values(SCANNED, ["names"]))
def scanned_definitions(spark, d):
    cases = _inputs(spark, d, SCANNED).withColumn("path", F.col("p_partkey").cast("string"))
    cases = cases.select("p_partkey", "path", F.split("v", r"\|", 2)[0].alias("language"), F.split("v", r"\|", 2)[1].alias("text"))
    found = scanners.symbols(cases).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name"))).alias("s"))
    rows = cases.select("p_partkey", "path").join(found, "path", "left")
    return rows.select("p_partkey", F.coalesce(F.array_join(F.transform("s", lambda x: x["name"]), " "), F.lit("")).alias("names"))


#: Python content, and its signature and docstring.
HEADERS = [
    ('def f(a,\n      b):\n    """Says."""\n    return a\n', "def f(a,\n      b):", "Says."),
    ("@d\nclass A:\n    x = 1\n", "@d\nclass A:", ""),
    ("def g(): # ( open\n    'one'\n", "def g(): # ( open", "one"),
]


@query(_values(HEADERS, ["signature", "docstring"]))
def code_headers(spark, d):
    cases = _inputs(spark, d, HEADERS, "content").withColumns({"symbol_kind": F.lit("function"), "symbol_fqn": F.lit("x"), "language": F.lit("python")})
    return chunking.with_headers(cases, "language").select("p_partkey", "signature", "docstring")

"""Rules on paths, names, texts and files over the tables' own rows, each with SQL that works the rule out from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import mentions, paths, text
from lodestone.operators import chunking, incremental, linking, parse, scanners, words
from lodestone.plans.registry import query, table, work_dir
from lodestone.sources import files, sinks

# ------------------------------------------------------------------ a path for every document

FOLDERS = ("src", "tests", "docs", "docs/zh", "node_modules", "build-x", "Examples", "release-notes", "app/testdata", "docs/adr", "out", "docs/design")
BEFORE = ("", "test_", "README-", "CHANGELOG-", "api_", "autogen")
AFTER = ("", "_test", ".ja", "_generated", ".pb", "-zh-CN")
ENDS = (".py", ".md", ".c", ".h++", ".txt", ".go", ".rst", "", ".cc")


def _sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: Every document gets a path of its first two words, with folders, beginnings, endings and extensions by its key.
PATHS = f"""
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS words FROM documents),
n AS (SELECT *, coalesce(words[1], 'none') AS first, coalesce(words[2], 'none') AS second FROM w),
p AS (SELECT *, {_sql(FOLDERS)}[1 + doc_id % 12] || '/' || second || '/' || {_sql(BEFORE)}[1 + doc_id // 12 % 6] || first || {_sql(AFTER)}[1 + doc_id // 72 % 6] || {_sql(ENDS)}[1 + doc_id // 5 % 9] AS path FROM n),
q AS (SELECT *, lower(path) AS low, string_split(path, '/')[:-2] AS dirs, string_split(lower(path), '/')[:-2] AS low_dirs, string_split(path, '/')[-1] AS base FROM p)"""
IS_TEST = r"(regexp_matches(path, '(^|/)(tests?|testdata|fixtures)(/|$)') OR regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\.[A-Za-z0-9]+$'))"
IS_DOCUMENT = r"regexp_matches(low, '\.(md|mdx|rst|txt|adoc)$')"


def _named(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, path, first, second."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", "text", *(F.coalesce(F.get(words, F.lit(i)), F.lit("none")).alias(c) for i, c in enumerate(("first", "second"))))
    pick = lambda values, over: F.get(F.array(*map(F.lit, values)), (F.floor(F.col("doc_id") / over) % len(values)).cast("int"))
    return rows.withColumn("path", F.concat(pick(FOLDERS, 1), F.lit("/"), "second", F.lit("/"), pick(BEFORE, 12), "first", pick(AFTER, 72), pick(ENDS, 5)))


@query(f"""
WITH {PATHS}, e(ext, language) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in paths.LANGUAGES.items())})
SELECT doc_id, path, {IS_TEST} AS test, {IS_DOCUMENT} AND (len(list_intersect(low_dirs, {_sql(paths.CHANGELOG_DIRS)})) > 0 OR regexp_matches(lower(base), '{paths.CHANGELOG_NAME}')) AS changelog,
  len(list_intersect(low_dirs, {_sql(paths.EXAMPLE_DIRS)})) > 0 AS example,
  len(list_intersect(dirs, {_sql(paths.PRUNED)})) > 0 OR len(list_filter(dirs, lambda x: regexp_matches(x, '^(cmake-build-.*|build-.*|out|htmlcov|\\.cache|\\.gradle|\\.next|\\.nuxt|\\.turbo|\\.parcel-cache|__pypackages__)$'))) > 0 AS pruned,
  CASE WHEN list_contains({_sql(paths.AGENT_NAMES)}, lower(base)) THEN 'agent-instructions' WHEN starts_with(lower(base), 'readme') THEN 'readme' WHEN starts_with(lower(base), 'architecture') OR contains('/' || path, '/docs/design/') THEN 'design'
    WHEN contains('/' || path, '/docs/adr/') THEN 'adr' WHEN regexp_matches(lower(base), '^(api|protocol|openapi)') THEN 'api' WHEN starts_with(lower(base), 'changelog') THEN 'changelog' ELSE 'guide' END AS doctype, language
FROM q LEFT JOIN e ON ext = regexp_extract(lower(base), '\\.([^.]+)$', 1)
""")
def document_path_rules(spark, d):
    v = F.col("path")
    rules = {"test": paths.is_test(v), "changelog": paths.is_changelog(v), "example": paths.is_example(v), "pruned": paths.is_pruned(v), "doctype": paths.doctype(v), "language": paths.language(v)}
    return _named(spark, d).select("doc_id", "path", *(c.alias(name) for name, c in rules.items()))


#: A banner stands in the line after the first doc_id % 14 ones, in every third document.
@query(f"""
WITH {PATHS}, b AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_concat(list_concat(string_split(text, chr(10))[:doc_id % 14], ['# This file was GENERATED by ' || first || '; do not edit']), string_split(text, chr(10))[doc_id % 14 + 1:]), chr(10)) ELSE text END AS body FROM q)
SELECT doc_id, contains(lower(base), '_generated.') OR contains(lower(base), 'autogen') OR regexp_matches(lower(base), '(\\.pb\\.cc|\\.pb\\.h|\\.pb\\.cpp|\\.pb2\\.py|\\.designer\\.cs|\\.g\\.cs)$')
  OR len(list_filter({_sql(paths.GENERATED_BANNERS)}, lambda x: contains(lower(array_to_string(string_split(body, chr(10))[:10], chr(10))), x))) > 0 AS generated FROM b
""")
def document_generated(spark, d):
    lines, at = F.split("text", "\n"), (F.col("doc_id") % 14).cast("int")
    banner = F.array(F.concat(F.lit("# This file was GENERATED by "), "first", F.lit("; do not edit")))
    body = F.array_join(F.concat(F.slice(lines, F.lit(1), at), banner, F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))), "\n")
    return _named(spark, d).select("doc_id", paths.is_generated(F.col("path"), F.when(F.col("doc_id") % 3 == 0, body).otherwise(F.col("text"))).alias("generated"))


@query(f"""
WITH {PATHS}, m AS (SELECT *, list_position(list_transform(low_dirs, lambda x: list_contains({_sql(paths.LOCALES)}, x)), true) AS place, lower(regexp_extract(base, '(?i)[-_.]({"|".join(sorted(paths.LOCALES, key=len, reverse=True))})\\.[A-Za-z0-9]+$', 1)) AS mark FROM q)
SELECT doc_id, CASE WHEN NOT {IS_DOCUMENT} THEN path WHEN place > 0 THEN array_to_string(list_concat(list_concat(dirs[:place - 1], dirs[place + 1:]), [base]), '/')
  WHEN mark <> '' THEN array_to_string(list_concat(dirs, [regexp_replace(base, '(?i)[-_.](' || mark || ')(\\.[A-Za-z0-9]+)$', '\\2')]), '/') ELSE path END AS variant_key,
  CASE WHEN NOT {IS_DOCUMENT} THEN NULL WHEN place > 0 THEN low_dirs[place] WHEN mark <> '' THEN mark END AS locale FROM m
""")
def document_variants(spark, d):
    found = paths.translation(F.col("path"))
    return _named(spark, d).select("doc_id", found["key"].alias("variant_key"), found["locale"].alias("locale"))


@query(f"""
WITH {PATHS} SELECT doc_id, CASE lang WHEN 'de' THEN 'spec' WHEN 'fr' THEN 'fallback' ELSE CASE WHEN {IS_TEST} THEN 'test' ELSE 'code' END END AS kind,
  CASE WHEN strlen(text) * 60 > CASE WHEN regexp_extract(lower(base), '\\.([^.]+)$', 1) IN ({", ".join(f"'{x}'" for x in paths.LANGUAGES)}) THEN 1048576 ELSE 131072 END THEN 'oversize:' || strlen(text) * 60 END AS skip_reason
FROM q JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
""")
def document_kinds(spark, d):
    rows = _named(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    kind = F.when(F.col("lang") == "de", "spec_block").when(F.col("lang") == "fr", "fallback_block").otherwise("function")
    return rows.select("doc_id", paths.chunk_kind(kind, F.col("path")).alias("kind"), paths.size_reason(F.col("path"), F.octet_length("text").cast("long") * 60).alias("skip_reason"))


#: Every document's bytes behind as many control bytes as its key says, and behind its text a NUL for some.
@query("""
WITH b AS (SELECT doc_id, left(hex(encode(repeat(chr(1), CAST(doc_id % 97 AS INT)) || text)) || CASE WHEN doc_id % 5 = 0 THEN '00' ELSE '' END, 16384) AS h FROM documents),
c AS (SELECT doc_id, regexp_extract_all(h, '..') AS bytes FROM b)
SELECT doc_id, list_contains(bytes, '00') OR len(list_filter(bytes, lambda x: x < '20' AND x NOT IN ('09', '0A', '0D'))) > 0.1 * len(bytes) AS is_binary FROM c
""")
def document_bytes(spark, d):
    content = F.concat(F.encode(F.concat(F.repeat(F.lit("\x01"), (F.col("doc_id") % 97).cast("int")), "text"), "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    return table(spark, d, "documents").select("doc_id", paths.is_binary(content).alias("is_binary"))


#: The last rule that matches decides; nothing below a folder that is ignored comes back.
RULES = ["# rules of the documents", "*.md", "!README*", "node_modules/", "/docs/zh", "app/**/*.c", "!/docs/zh/**/*.py", "src/*/test_*.[ct]*"]


@query(f"""
WITH {PATHS} SELECT doc_id,
  CASE WHEN regexp_matches(path, '^src/[^/]+/test_[^/]*\\.[ct][^/]*$') THEN true WHEN starts_with(path, 'docs/zh/') AND ends_with(path, '.py') THEN false WHEN starts_with(path, 'app/') AND ends_with(path, '.c') THEN true WHEN starts_with(path, 'docs/zh/') THEN true
    WHEN list_contains(dirs, 'node_modules') THEN true WHEN starts_with(base, 'README') THEN false ELSE ends_with(base, '.md') END OR starts_with(path, 'docs/zh/') OR list_contains(dirs, 'node_modules') AS ignored FROM q
""")
def document_ignored(spark, d):
    return files.with_ignored(_named(spark, d), RULES).select("doc_id", "ignored")


#: Allowed by a name or a folder, the last entry that matches decides.
ENTRIES = ["docs/design/", "!adr", "none_test.py", "src"]


@query(f"""
WITH {PATHS} SELECT doc_id, CASE WHEN list_contains(low_dirs, 'src') THEN true WHEN lower(base) = 'none_test.py' THEN true WHEN list_contains(low_dirs, 'adr') THEN false WHEN list_contains(low_dirs, 'design') THEN true
  WHEN list_contains(low_dirs, 'skills') THEN true ELSE lower(base) IN ('agents.md', 'claude.md', '.agent.md', '.cursorrules', 'handoff.md') END
  AND NOT (list_contains(dirs, 'node_modules') OR list_contains(dirs, 'out') OR len(list_filter(dirs, lambda x: starts_with(x, 'build-'))) > 0
    OR len(list_intersect(dirs, {_sql(paths.PRUNED)})) > 0) AS allowed FROM q
""")
def document_allowed(spark, d):
    return files.with_allowed(_named(spark, d), ENTRIES).select("doc_id", "allowed")


# ------------------------------------------------------------------ words and names


@query(f"""
WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Which tests cover ' WHEN turn % 4 = 1 THEN 'show an EXAMPLE of ' WHEN turn % 4 = 2 THEN 'release notes on ' ELSE '' END || text AS text FROM conversations),
w AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: regexp_matches(x, '^[a-z]{{4,}}$') AND NOT list_contains({_sql(text.STOP_WORDS)}, x)) AS words FROM q)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(words)), ' ') AS words, {", ".join(f"len(list_filter({_sql(words)}, lambda x: contains(lower(text), x))) > 0 AS asks_{name}" for name, words in (("test", paths.TEST_WORDS), ("changelog", paths.CHANGELOG_WORDS), ("example", paths.EXAMPLE_WORDS)))} FROM w
""")
def turn_intents(spark, d):
    turn = F.col("turn") % 4
    said = F.concat(F.when(turn == 0, "Which tests cover ").when(turn == 1, "show an EXAMPLE of ").when(turn == 2, "release notes on ").otherwise(""), "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", said.alias("text"))
    asks = {"test": paths.TEST_WORDS, "changelog": paths.CHANGELOG_WORDS, "example": paths.EXAMPLE_WORDS}
    return rows.select("conv_id", "turn", F.array_join(F.sort_array(text.query_words(F.col("text"))), " ").alias("words"), *(paths.has_intent(F.col("text"), w).alias(f"asks_{name}") for name, w in asks.items()))


#: The first words of every turn in camel case and with numbers, as a symbol's name.
@query("""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+')[:4] AS words FROM conversations),
n AS (SELECT conv_id, turn, coalesce(words[1], '') || upper(coalesce(words[2], '')) || '_' || coalesce(words[3], '') || conv_id || '::' || upper(left(coalesce(words[4], ''), 1)) || lower(substr(coalesce(words[4], ''), 2)) || 'HTTPServer' AS name FROM w)
SELECT conv_id, turn, name, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)))), ' ') AS words FROM n
""")
def turn_names(spark, d):
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(4)]
    last = F.concat(F.upper(F.substring(w[3], 1, 1)), F.lower(F.substring(w[3], F.lit(2), F.length(w[3]))))
    name = F.concat(w[0], F.upper(w[1]), F.lit("_"), w[2], "conv_id", F.lit("::"), last, F.lit("HTTPServer"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", name.alias("name"))
    return rows.select("conv_id", "turn", "name", F.array_join(F.sort_array(text.name_words(F.col("name"))), " ").alias("words"))


@query(f"WITH {PATHS} SELECT doc_id, first || '_' || second || '|src/' || second || '/' || first || '.py|read' || upper(left(second, 1)) || substr(second, 2) || '|' || upper(left(first, 1)) || substr(first, 2) || '::' || second AS found FROM q")
def document_mentions(spark, d):
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    said = F.concat(F.lit("First `"), "first", F.lit("_"), "second", F.lit("`, then src/"), "second", F.lit("/"), "first", F.lit(".py; read"), capital("second"), F.lit(" calls "), capital("first"), F.lit("::"), "second", F.lit(" at last."))
    rows = _named(spark, d).select("doc_id", said.alias("said"))
    found = mentions.mentions(rows, "doc_id", "said").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "mention"))).alias("m"))
    return found.select("doc_id", F.array_join(F.transform("m", lambda m: m["mention"]), "|").alias("found"))


# ------------------------------------------------------------------ sources made of documents


def _source(spark: SparkSession, d: str, language: str) -> DataFrame:
    """A source file for every document, of its words, with as many statements as the length of its text says."""
    n = (F.length("text") % 7).cast("int")
    if language == "python":
        body = F.repeat(F.concat(F.lit("        self.c_"), "second", F.lit("()\n")), n + 1)
        code = F.concat(F.lit("import p_"), "second", F.lit("\n\n\nclass K_"), "first", F.lit("(b_"), "second", F.lit('):\n    """Of '), "first", F.lit('."""\n\n    def m_'), "first", F.lit("(self):\n"), body, F.lit("\n\ndef _f_"), "second", F.lit("(x):\n    return g_"), "first", F.lit("(x)\n"))
    else:
        body = F.repeat(F.concat(F.lit("    "), "second", F.lit("(1);\n")), n + 1)
        code = F.concat(F.lit("/* int hidden(void) { } */\n#include <"), "first", F.lit('.h>\nint f_'), "first", F.lit("(int a,\n    int b)\n{\n"), body, F.lit("}\nstruct S_"), "second", F.lit(" { int x; };\n"))
    return _named(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(language).alias("language"), code.alias("text"), "first", "second", n.alias("n"))


@query(f"""
WITH {PATHS}, s AS (SELECT *, length(text) % 7 AS n FROM q)
SELECT doc_id, fqn, kind, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, exported AS is_exported FROM (
  SELECT doc_id, 'K_' || first AS fqn, 'class' AS kind, 4 AS start_line, 8 + n AS end_line, true AS exported FROM s UNION ALL
  SELECT doc_id, 'K_' || first || '.m_' || first, 'method', 7, 8 + n, false FROM s UNION ALL SELECT doc_id, '_f_' || second, 'function', 11 + n, 12 + n, false FROM s)
""")
def document_python_symbols(spark, d):
    found = parse.python_symbols(_source(spark, d, "python"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "fqn", "kind", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "is_exported")


@query(f"""
WITH {PATHS} SELECT DISTINCT doc_id, kind, target FROM (SELECT doc_id, 'imports' AS kind, 'p_' || second AS target FROM q UNION ALL SELECT doc_id, 'extends', 'b_' || second FROM q UNION ALL SELECT doc_id, 'calls', 'self.c_' || second FROM q UNION ALL SELECT doc_id, 'calls', 'g_' || first FROM q)
""")
def document_python_edges(spark, d):
    return parse.python_edges(_source(spark, d, "python")).select(F.col("path").cast("long").alias("doc_id"), "kind", "target").distinct()


@query(f"WITH {PATHS} SELECT doc_id, 'f_' || first AS name, 3 AS start_line FROM q UNION ALL SELECT doc_id, 'S_' || second, CAST(8 + length(text) % 7 AS INTEGER) FROM q")
def document_c_symbols(spark, d):
    found = scanners.symbols(_source(spark, d, "c"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "name", F.col("start_line").cast("int").alias("start_line"))


@query(f"WITH {PATHS} SELECT doc_id, 'r_' || first AS source, 'h_' || second AS target, '/' || first || '/' || doc_id AS route FROM q WHERE doc_id % 4 < 3")
def document_routes(spark, d):
    framework = F.when(F.col("doc_id") % 4 < 3, "FastAPI").otherwise("Other")
    code = F.concat(F.lit("from fastapi import FastAPI\n\nr_"), "first", F.lit(" = "), framework, F.lit("()\n\n\n@r_"), "first", F.lit(".get('/"), "first", F.lit("/"), "doc_id", F.lit("')\ndef h_"), "second", F.lit("():\n    pass\n"))
    rows = _named(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("python").alias("language"), code.alias("text"))
    return parse.python_routes(rows).select(F.col("path").cast("long").alias("doc_id"), "source", "target", "route")


@query(f"WITH {PATHS} SELECT doc_id, 'def ' || first || '(a,' || chr(10) || repeat(' ', CAST(length(text) % 7 AS INT)) || second || '=(1, 2)):' AS signature, 'Says ' || second || '.' AS docstring FROM q")
def document_headers(spark, d):
    content = F.concat(F.lit("def "), "first", F.lit("(a,\n"), F.repeat(F.lit(" "), (F.length("text") % 7).cast("int")), "second", F.lit('=(1, 2)):\n    """Says '), "second", F.lit('."""\n    return a\n'))
    rows = _named(spark, d).select("doc_id", content.alias("content"), F.lit("function").alias("symbol_kind"), F.lit("x").alias("symbol_fqn"), F.lit("python").alias("language"))
    return chunking.with_headers(rows, "language").select("doc_id", "signature", "docstring")


# ------------------------------------------------------------------ modules, settings, files


#: A part is a module; it exports what the part of half its key exports, down to part 0. Eight symbols are as far as a chain is followed.
@query("""
WITH RECURSIVE l AS (SELECT l_orderkey * 10 + l_linenumber AS ref, min(l_partkey) AS k FROM lineitem GROUP BY ALL), c AS (SELECT ref, k, 1 AS n FROM l UNION ALL SELECT ref, k // 2, n + 1 FROM c WHERE k > 0)
SELECT ref, 'm0.ts::x' AS fqn FROM c WHERE k = 0 AND n <= 8
""")
def part_modules(spark, d):
    module = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    named = lambda c, end: F.concat(F.lit("m"), c, F.lit(end))
    symbols = module.select(named("id", ".ts::x").alias("fqn"), F.lit("x").alias("name"), named("id", ".ts").alias("file_path"), F.lit("function").alias("kind"), F.lit(True).alias("is_exported"))
    edges = module.where("id > 0").select(named("id", ".ts::x").alias("source"), F.concat(F.lit("js:./"), named(F.floor(F.col("id") / 2), "#x")).alias("target"), F.lit("exports").alias("kind"), F.lit("parsed").alias("provenance"))
    line = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref")).agg(F.min("l_partkey").alias("part"))
    refs = line.select("ref", F.concat(F.lit("js:./"), named("part", "#x")).alias("target"), F.lit("main.ts").alias("source_file"), F.lit("calls").alias("kind"))
    return linking.resolve_modules(refs, symbols, symbols.select(F.col("file_path").alias("path")), edges)


@query("SELECT o_orderkey AS id, 'lib/m' || s_suppkey || '/n.py' AS path FROM orders JOIN supplier ON s_suppkey = o_custkey")
def supplier_hint_files(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("app/x.py").alias("file_path"), F.concat(F.lit("m"), "o_custkey", F.lit(".n.f"), "o_orderkey").alias("reference_name"))
    path = lambda start: table(spark, d, "supplier").select(F.concat(F.lit(start), "s_suppkey", F.lit("/n.py")).alias("path"))
    return linking.hinted_files(refs, path("lib/m").unionByName(path("lib/xm")))


#: The stored settings are what the suppliers say last: the parser's mark, and the model and its dimension unless no supplier has them.
@query("""
WITH s AS (SELECT 'p' || max(s_suppkey) AS parser, 'm' || count(DISTINCT s_nationkey) AS model, count(*) AS dim FROM supplier)
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'full_reparse' WHEN n_nationkey % 5 IN (1, 2) THEN 'reembed' ELSE 'none' END AS action FROM nation, s
""")
def nation_invalidations(spark, d):
    stored = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("parser"), F.count_distinct("s_nationkey").alias("model"), F.count("*").alias("dim")).first()
    parser, model, dim = f"p{stored['parser']}", f"m{stored['model']}", stored["dim"]
    nation = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("n"))
    out = None
    for n, now in enumerate(((parser + "x", model, dim), (parser, model + "x", dim), (parser, model, dim + 1), (parser, model, dim), (parser, model, dim))):
        config = table(spark, d, "supplier").agg(F.concat(F.lit("p"), F.max("s_suppkey")).alias("parser_config_hash"), F.concat(F.lit("m"), F.count_distinct("s_nationkey")).alias("embedding_model"), F.count("*").cast("string").alias("embedding_dim"))
        config = config.select(F.explode(F.create_map(*(x for c in config.columns for x in (F.lit(c), F.col(c))))).alias("key", "value"))
        one = nation.where(F.col("n") == n).crossJoin(incremental.invalidation(config, *now)).select("n_nationkey", "action")
        out = one if out is None else out.unionByName(one)
    return out


def _supplier_files(spark: SparkSession, d: str) -> str:
    """A folder with a file for every supplier, written by the executors, below one for its nation, and one that is never read."""
    root = work_dir(spark)
    s = table(spark, d, "supplier")
    said = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    sinks.spread(s.select("s_nationkey", "s_suppkey", said.alias("value")), "s_nationkey", "s_suppkey").write.options(**sinks.MOVED_BY_TASKS).partitionBy("s_nationkey", "s_suppkey").text(f"{root}/files")
    s.select(said.alias("value")).coalesce(1).write.text(f"{root}/files/node_modules")
    return f"{root}/files"


SUPPLIER_FILES = """f AS (SELECT s_nationkey, s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || '}' || chr(10) AS text FROM supplier)"""


@query(f"WITH {SUPPLIER_FILES} SELECT 's_nationkey=' || s_nationkey || '/s_suppkey=' || s_suppkey AS folder, length(text) AS length, text, CAST(NULL AS VARCHAR) AS skip_reason FROM f")
def scanned_suppliers(spark, d):
    found = files.directory(spark, _supplier_files(spark, d))
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length", "text", "skip_reason")


@query(f"WITH {SUPPLIER_FILES} SELECT count(*) + 1 AS files, CAST(2 * sum(length(text)) AS BIGINT) AS bytes FROM f")
def supplier_bytes(spark, d):
    return files.directory_size(spark, _supplier_files(spark, d))



@query("SELECT s_suppkey, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def supplier_side_files(spark, d):
    root = work_dir(spark)
    sinks.write_side_files(table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), root, "s_suppkey")
    return sinks.read_side_files(spark, root, "s_suppkey", "name string, nation int, balance double").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "value.*")


#: Lines of JSON among comments and blank lines, in as many files as there are nations.
@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def supplier_lines(spark, d):
    root = work_dir(spark)
    said = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    lines = table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("# supplier "), "s_suppkey", F.lit("\n\n  "), said, F.lit("\n   # end")).alias("value"))
    lines.repartition("s_nationkey").write.partitionBy("s_nationkey").text(root)
    return files.json_lines(spark, root, "id long, name string, nation int", "id", named="*.txt").select("id", "name", "nation")


# ------------------------------------------------------------------ words without spaces


#: The turns' sentences lose their spaces and get them back by the words of the documents; SQL goes along each run by its places.
@query("""
WITH RECURSIVE dict AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) <= 8 GROUP BY word HAVING count(*) >= 2),
total AS (SELECT sum(n) AS total FROM dict), t AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(lower(text), '[^a-z.]', '', 'g'), '[a-z]+|\\.') AS pieces FROM conversations),
piece AS (SELECT conv_id, turn, unnest(pieces) AS piece, unnest(range(len(pieces))) AS place FROM t), run AS (SELECT DISTINCT piece AS run FROM piece WHERE piece <> '.'),
gram AS (SELECT run, e AS "end", unnest(range(greatest(e - 8, 0), e)) AS start FROM (SELECT run, unnest(range(1, length(run) + 1)) AS e FROM run)),
edge AS (SELECT run, "end", start, CASE WHEN n IS NOT NULL THEN CAST(round(1000 * ln(total / n)) AS BIGINT) WHEN "end" - start = 1 THEN CAST(round(1000 * ln(total)) AS BIGINT) END AS cost
  FROM gram CROSS JOIN total LEFT JOIN dict ON word = substr(run, start + 1, "end" - start)),
into_ AS (SELECT run, "end", list({'cost': cost, 'start': start}) AS edges FROM edge WHERE cost IS NOT NULL GROUP BY ALL),
lattice AS (SELECT run, list({'edges': edges, 'recent': []::BIGINT[], 'back': []::BIGINT[]} ORDER BY "end") AS steps FROM into_ GROUP BY run),
walked AS (SELECT run, list_reduce(list_prepend({'edges': []::STRUCT(cost BIGINT, start BIGINT)[], 'recent': [CAST(0 AS BIGINT)], 'back': []::BIGINT[]}, steps), lambda a, x: {
    'edges': []::STRUCT(cost BIGINT, start BIGINT)[],
    'recent': list_append(a.recent, list_min(list_transform(x.edges, lambda e: {'cost': a.recent[e.start - len(a.back) + len(a.recent)] + e.cost, 'start': e.start})).cost)[-8:],
    'back': list_append(a.back, list_min(list_transform(x.edges, lambda e: {'cost': a.recent[e.start - len(a.back) + len(a.recent)] + e.cost, 'start': e.start})).start)}).back AS back FROM lattice),
path(run, pos, back, words) AS (
  SELECT run, length(run), back, []::VARCHAR[] FROM walked UNION ALL SELECT run, back[pos], back, list_prepend(substr(run, back[pos] + 1, pos - back[pos]), words) FROM path WHERE pos > 0
), told AS (SELECT run, array_to_string(words, ' ') AS words FROM path WHERE pos = 0)
SELECT c.conv_id, c.turn, coalesce(string_agg(coalesce(words, piece), ' ' ORDER BY place), '') AS segmented FROM conversations c LEFT JOIN piece p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN told ON run = piece GROUP BY ALL
""")
def turns_segmented(spark, d):
    said = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    dictionary = table(spark, d, "documents").select(said.alias("word")).where(F.length("word") <= 8).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z.]", "").alias("text"))
    return words.segmented(rows, ["conv_id", "turn"], "text", dictionary, run="[a-z]+", longest=8)

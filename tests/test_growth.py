"""Operators whose work must follow their rows, and results that must not depend on the order in which tasks bring them."""

import functools
import math
import operator
import os
import random
import re

from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import channels, chunking, fixpoint, gap, graph, intervals, linking, parse, phrases, recall, rendering, scopes, tables, usage, words
from lodestone.plans import catalog, operations
from lodestone.sources import sinks


def planned(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_substrings_do_not_carry_their_run(spark):
    runs = spark.createDataFrame([("天地人和" * n,) for n in range(1, 40)], "run string")
    dictionary = spark.createDataFrame([("天地", 5), ("地人", 9), ("和", 2)], "word string, n long")
    told = words.segmented_runs(runs, dictionary)
    assert "collect_list" not in planned(told)
    assert {r["run"]: "".join(r["words"]) for r in told.collect()} == {"天地人和" * n: "天地人和" * n for n in range(1, 40)}


def test_words_of_a_place_are_found_not_tried(spark):
    rng = random.Random(8)
    priced = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 4, 8]) for _ in range(40)}
    runs = sorted({"".join(rng.choice("abz") for _ in range(rng.randint(1, 30))) for _ in range(300)})
    cost = lambda w: round(1000 * math.log(sum(priced.values()) / priced[w])) if w in priced else round(1000 * math.log(sum(priced.values()))) if len(w) == 1 else None
    want = {}
    for run in runs:
        best = [(0, 0, [])]
        for end in range(1, len(run) + 1):
            best.append(min((best[at][0] + cost(run[at:end]), at, [*best[at][2], run[at:end]]) for at in range(max(end - 6, 0), end) if cost(run[at:end]) is not None))
        want[run] = best[-1][2]
    told = words.segmented_runs(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame(sorted(priced.items()), "word string, n long"), longest=6)
    assert {r["run"]: r["words"] for r in told.collect()} == want
    assert all("lambda" in line for line in planned(told).splitlines() if "conv(" in line)  # bytes are told for buckets, not for each substring


def test_first_members_without_pairs(spark):
    rng = random.Random(3)
    rows = [("p", f"C{rng.randint(0, 3)}", "class", a, a + rng.randint(0, 9)) for a in (rng.randint(1, 60) for _ in range(60))]
    rows += [("p", f"C{rng.randint(0, 3)}.m{n}", "method", a, a) for n, a in enumerate(rng.randint(1, 60) for _ in range(40))]
    rows += [("p", "C0", "class", None, 9), ("q", "C0", "class", 1, 60), ("p", "C9", "struct", 4, 4), ("p", "C9::x", "function", 4, 4)]
    got = chunking.first_members(spark.createDataFrame(rows, "path string, fqn string, kind string, start_line int, end_line int"))
    want = {}
    for path, name, kind, a, b in rows:
        lines = [s for p, f, _, s, _ in rows if p == path and f.startswith((name + ".", name + ":")) and a is not None and a <= s <= b] if kind in ("class", "struct") else []
        if lines:
            want[path, name] = min(lines + [want.get((path, name), 99)])
    assert {(r["path"], r["fqn"]): r["member_line"] for r in got.collect()} == want
    assert "Join" not in planned(got)


def test_whole_averages_stay_whole(spark):
    times = [0.3, 2.7, 1.5, 0.6, 1.8, 2.5, 0.1, 0.1, 0.4, 0.0]
    assert functools.reduce(operator.add, times) < 10  # in doubles, in this order
    rows = [("a", "done", t, n) for n, t in enumerate(times)] + [("b", "done", 1e300, 1), ("b", "done", 3e300, 2), ("c", "failed", 1.0, 1)]
    got = {r["g"]: r["avg_value"] for r in usage.run_stats(spark.createDataFrame(rows[:10] + rows[12:], "g string, s string, v double, t int").coalesce(1), "g", "s", "v", "t").collect()}
    assert got == {"a": 1, "c": None}
    assert usage.run_stats(spark.createDataFrame(rows[10:12], "g string, s string, v double, t int"), "g", "s", "v", "t").first()["avg_value"] == 2**63 - 1


def test_edges_of_a_line_have_places(spark):
    files = spark.createDataFrame([(f"p{n}", "f(g(h()), k())\nz()\n") for n in range(300)], "path string, text string").repartition(7)
    got = parse.python_edges(files, placed=True).where("kind = 'calls'").orderBy(F.rand(1)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "target"))).getField("target").alias("t")).collect()
    assert len(got) == 300 and {tuple(r["t"]) for r in got} == {("f", "g", "h", "k", "z")}


def test_section_links_meet_each_symbol_once(spark):
    rng = random.Random(5)
    symbols = [(n, f"{rng.choice('abc')}.{rng.choice('xyz')}") for n in range(40)]
    mentions = sorted({(n, rng.choice(["a.x", "b::y", "q.z", "x", "c.none", "b.y"])) for n in range(30) for _ in range(4)})
    known = sorted({(rng.randint(0, 29), rng.randint(0, 39)) for _ in range(200)})
    want = set()
    for spec, mention in mentions:
        exact = {i for i, f in symbols if f == mention}
        want |= {(spec, i) for i in exact or {i for i, f in symbols if f.split(".")[-1] == mention.replace("::", ".").split(".")[-1]}}
    got = tables.link_sections(spark.createDataFrame(mentions, "spec long, mention string"), spark.createDataFrame(symbols, "id long, fqn string"), spark.createDataFrame(known, "spec long, symbol long"))
    assert sorted(map(tuple, got.collect())) == sorted(want - set(known))
    assert "Window" not in planned(got)


def test_section_links_are_not_broadcast_by_the_size_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BLOCK", 8)
    spark.range(600).selectExpr("id", "'q.' || id % 3 AS fqn").write.parquet(f"{tmp_path}/symbols")
    spark.range(90).selectExpr("id % 30 AS spec", "IF(id % 2 = 0, 'q.', 'r::') || id % 4 AS mention").write.parquet(f"{tmp_path}/mentions")
    spark.range(900).selectExpr("id % 10 AS spec", "id % 590 AS symbol").distinct().write.parquet(f"{tmp_path}/known")
    symbols, mentions, known = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("symbols", "mentions", "known"))
    got = tables.link_sections(mentions, symbols, known)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(n % 30, i) for n in range(90) for i in range(600) if i % 3 == n % 4} - {(n % 10, n % 590) for n in range(900)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_gaps_beside_repeated_ranges(spark):
    ranges = [(f"o{n}", a, b) for n in range(500) for a, b in ((7, 16), (14, 15), (28, 43), (28, 43), (42, 64), (42, 72), (49, 58))]
    rows = spark.createDataFrame(ranges, "path string, start_line int, end_line int").repartition(8)
    got = intervals.gaps(rows, rows.select("path", F.lit(100).alias("total")).distinct())
    assert sorted(map(tuple, got.collect())) == sorted((f"o{n}", a, b) for n in range(500) for a, b in ((1, 6), (17, 27), (73, 100)))


def test_small_files_are_dealt_by_their_number(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert sinks.spread(rows, "k").select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_binary_makes_no_row_of_pairs(spark):
    cases = [(b"", False), (b"\t\n\r" * 9, False), (b"a\0", True), (bytes(range(32)), True), (b"\x01" + b"x" * 9, False), (b"\x01\x02" + b"x" * 9, True), (b"\x7f\x80\xff" * 9, False), (b"\r\n" * 4096 + b"\0", False), (None, None)]
    got = spark.createDataFrame(cases, "v binary, want boolean").select("want", paths.is_binary(F.col("v")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect()) and "regexp_extract_all" not in planned(got)


def test_pairs_of_query_and_chunk_are_not_shuffled(spark, tmp_path):
    chunks = spark.createDataFrame([(n, "the the K\u212a " + "abc"[n % 3] if n else None, f"S{n % 2}") for n in range(60)], "k long, text string, name string")
    index = recall.index_of(chunks, "k", {"text": 1.0, "name": 5.0})
    assert "Aggregate" not in planned(index.postings)
    assert {r["term"]: r["f"] for r in index.postings.where("k = 1").collect()} == {"the": 2, "k": 1, "b": 1, "s1": 5}
    recall.write_index(index, str(tmp_path))
    stored = recall.read_index(spark, str(tmp_path))
    assert tuple(stored.stats.first()) == (60, (59 * 5 + 1) / 60)
    asked = spark.createDataFrame([(q, f"the {c}") for q, c in enumerate("abc")], "q long, asked string")
    best = recall.bm25_best(recall.bm25_scores(stored, "k", asked, "q", "asked"), "k", "q", 2)
    assert sorted((r["q"], r["k"]) for r in best.collect()) == [(0, 3), (0, 6), (1, 1), (1, 4), (2, 2), (2, 5)]
    scores = recall.bm25_scores(stored, "k", asked, "q", "asked")
    assert "hashpartitioning(q#" not in scores.select("k", "score")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_only_fused_texts_are_packed(spark, sf):
    assert "LeftSemi" in planned(catalog._fused(spark, sf)[1])


def test_pointers_that_no_call_needs_are_not_followed(spark, tmp_path):
    assigned = [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "g"), ("p", "c", "a"), ("p", "w", "a"), ("q", "a", "g"), ("q", "v", "a")]
    calls = [("p", "o", 1, "a"), ("p", "o", 2, "h"), ("p", "o", 3, "g")]
    functions = spark.createDataFrame([("p", "g"), ("q", "g")], "path string, name string")
    got = fixpoint.pointer_calls(spark.createDataFrame(calls, "path string, owner string, line int, name string"), spark.createDataFrame(assigned, "path string, variable string, value string"), functions, str(tmp_path))
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(1, "g", "synthesized"), (2, "h", "parsed"), (3, "g", "parsed")]
    met = {r["node"] for r in spark.read.parquet(f"{tmp_path}/reach-*/round-*").select("node").collect()}
    assert {"p\0a", "p\0b", "p\0c"} <= met and not met & {"p\0w", "q\0a", "q\0v"}


def test_members_of_containers_are_no_product(spark):
    named = spark.createDataFrame([(q, 0, "m") for q in range(3)], "query_id long, position long, token string")
    packed = spark.createDataFrame([(q, 1, "k0", "m.a") for q in range(3)], "query_id long, position long, chunk_id string, symbol_fqn string")
    pool = spark.createDataFrame([(q, n + 1, f"k{n}", None) for q in range(3) for n in range(4)], "query_id long, position long, chunk_id string, export_of string")
    symbols = spark.createDataFrame([("m.a", "k0"), ("m.b", "k1"), ("n.c", "k2"), ("m.b.d", "k3")], "fqn string, chunk_id string")
    edges = spark.createDataFrame([], "source string, target string, kind string, line int")
    found = gap.closures(named, packed, pool, symbols, edges, spark.createDataFrame([], "spec string, symbol string"))
    assert sorted((r["query_id"], r["group_no"], r["chunk_id"], r["order_key"]) for r in found.collect()) == [(q, 1001, f"k{n}", n + 1) for q in range(3) for n in (1, 3)]
    assert not re.search(r"Join Inner, \(name#\d+ = name#\d+\)", planned(found))


def test_streamed_changes_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(operations, "work_dir", lambda *_: str(tmp_path))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        operations.streamed_changes(spark, "/root/testdata/sf0.1").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]) > 3


def test_phrases_are_met_by_pairs_of_words(spark):
    chunks = spark.createDataFrame([(0, "a b c"), (1, "c b a"), (2, "x A, B. c a b c"), (3, None), (4, "a"), (5, "a b b c")], "k long, text string")
    got = recall.phrase(chunks, "k", "text", spark.createDataFrame([(7, "a b c"), (8, "a"), (9, "b b")], "q long, asked string"), "q", "asked")
    assert sorted((r["q"], r["k"], r["times"]) for r in got.collect()) == [(7, 0, 1), (7, 2, 2), (9, 5, 1)]
    assert re.search("zip_?with", planned(got).lower())


def test_literal_recall_makes_no_pairs_of_words(spark, monkeypatch):
    texts = ["a b c", "c b a", "x A, B. c a b c", None, "a", "a b b c", "", "a b a b a", "ab", "\u212a b a\u00e9b a  b"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    asked = spark.createDataFrame([(6, "B  a"), (7, "a b c"), (8, "a"), (9, "b b"), (10, "a b a"), (11, "a-b"), (12, None)], "q long, asked string")
    rows = lambda t: sorted((r["q"], r["k"], r["times"], r["rank"]) for r in t.collect())
    got = rows(recall.scanned_phrase(chunks, "k", "text", asked, "q", "asked", 3))
    assert got == rows(recall.phrase(chunks, "k", "text", asked, "q", "asked", 3)) and len(got) == 11
    monkeypatch.setattr(recall, "NEEDLES", 4)
    assert got == rows(recall.scanned_phrase(chunks, "k", "text", asked, "q", "asked", 3))
    monkeypatch.undo()
    held = chunks.select(F.col("k").alias("chunk_id"), F.lit("f").alias("symbol_fqn"), F.col("text").alias("content"), F.lit("f").alias("name"))
    phrases = asked.select("q", F.lit(0).alias("position"), F.col("asked").alias("phrase"), F.lit(True).alias("strong"))
    assert not re.search("zip_?with", planned(channels.literal_recall(held, held, phrases, "q")).lower())


def test_a_place_is_looked_up_once_however_deep_its_scopes(spark):
    scope = spark.createDataFrame([("f", f"s{n:02}", n, 200 - n) for n in range(60)] + [("f", "t", 100, 100), ("g", "s00", 0, 9)], "path string, scope string, start int, end int")
    names = spark.createDataFrame([("f", f"s{n:02}", "x", n) for n in range(0, 60, 2)] + [("f", "t", "x", 99), ("g", "s00", "x", None)], "path string, scope string, name string, value int")
    places = [("f", 1, 100, "x", 2), ("f", 2, 101, "x", 99), ("f", 3, 55, "x", 59), ("f", 4, 200, "x", 1), ("f", 5, 201, "x", None), ("f", 6, 3, "y", None), ("g", 1, 9, "x", 7), ("h", 1, 9, "x", 7), (None, 1, 1, None, 1)]
    got = scopes.innermost(spark.createDataFrame(places, "path string, ref int, at int, root string, more int"), scope, names)
    assert {(r["path"], r["ref"]): (r["more"], r["value"]) for r in got.collect()} == {("f", 1): (2, 99), ("f", 2): (99, 58), ("f", 3): (59, 54), ("f", 4): (1, 0), ("f", 5): (None, None), ("f", 6): (None, None), ("g", 1): (7, None), ("h", 1): (7, None), (None, 1): (1, None)}
    assert planned(got).count("Join") == 1


def test_phrases_meet_chunks_by_grams(spark):
    chunks = spark.createDataFrame([(1, "a b c d e f g", "a b"), (2, "a b a b a b a b a b", None), (3, "a b c d x f g", "c d"), (4, None, "")], "k long, text string, name string")
    index = phrases.positions_of(chunks, "k", ["text", "name"])
    assert "Aggregate" not in planned(index.postings)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"a": 3, "b": 3, "c": 2, "d": 2, "e": 1, "f": 2, "g": 2, "x": 1}
    asked = [(1, "a b"), (2, "b a b"), (3, "a b a b a b a"), (4, "A-B c d e"), (5, "a b c d e f g"), (6, "a b c d e f x"), (7, "d a"), (8, "g"), (9, "c d none")]
    found = phrases.occurrences(index, "k", spark.createDataFrame(asked, "q long, asked string"), "q", "asked")
    assert {(r["q"], r["k"]): (r["times"], r["length"]) for r in found.collect()} == {(1, 1): (2, 9), (1, 2): (5, 10), (1, 3): (1, 9), (2, 2): (4, 10), (3, 2): (2, 10), (4, 1): (1, 9), (5, 1): (1, 9)}
    assert planned(found).count("Join") == 2


def test_methods_climb_to_the_nearest_alone(spark, tmp_path):
    rng = random.Random(9)
    extends = sorted({(f"c{n}", f"c{rng.randint(max(0, n - 9), n + 2)}") for n in range(1, 40) for _ in range(2)})
    methods = [(f"c{n}.{m}/{a}", f"c{n}", m, a) for n in range(40) for m in "fg" for a in (0, 1) if n < 2 or rng.random() < 0.3]
    methods += [("twice", "c39", "f", 0), ("twice", "c20", "f", 0), ("twice", "c20", "f", 0), ("none", None, "f", 0)]
    ways = {}
    for c in {c for c, _ in extends}:
        near, distance = {c}, 0
        while near:
            distance += 1
            near = {b for a, b in extends if a in near and a != b} - {b for x, b in ways if x == c} - {c}
            ways |= {(c, b): distance for b in near}
    hits = [(m, o, ways[c, b]) for m, c, n, a in methods for o, b, x, y in methods if (c, b) in ways and (n, a) == (x, y)]
    want = {h for h in hits if h[2] == min(d for m, _, d in hits if m == h[0])}
    got = fixpoint.overrides(spark.createDataFrame(methods, "method string, class string, name string, arity int"), spark.createDataFrame([*extends, ("c3", None)], "class string, base string"), str(tmp_path))
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)
    # classes whose methods all have their nearest climb no further
    chain = [(f"k{n}", f"k{n - 1}") for n in range(1, 30)]
    fixpoint.overrides(spark.createDataFrame([(f"k{n}.f", f"k{n}", "f", 0) for n in range(30)], "method string, class string, name string, arity int"), spark.createDataFrame(chain, "class string, base string"), f"{tmp_path}/chain").count()
    assert spark.read.parquet(f"{tmp_path}/chain/overrides-*/level-*").count() == 29


def test_modules_are_resolved_once_for_each_target(spark):
    refs = spark.createDataFrame([(n, f"js:./a{n % 2}#x" if n else None, "m.ts", [None, "calls", "reads"][n % 3]) for n in range(60)], "ref int, target string, source_file string, kind string")
    symbols = spark.createDataFrame([("a0.ts::x", "x", "a0.ts", "variable", True), ("a1.ts::x", "x", "a1.ts", "function", True)], "fqn string, name string, file_path string, kind string, is_exported boolean")
    edges = spark.createDataFrame([], "source string, target string, kind string, provenance string")
    got = linking.resolve_modules(refs, symbols, symbols.select(F.col("file_path").alias("path")), edges)
    assert {r["ref"]: r["fqn"] for r in got.collect()} == {n: f"a{n % 2}.ts::x" for n in range(1, 60) if n % 2 or n % 3 == 2}
    assert re.search(r"Aggregate \[target#\d+, source_file#\d+, kind#\d+\]", planned(got))
    paths_ = refs.select(linking.module_paths(F.col("source_file"), F.col("target")).alias("p"))
    assert planned(paths_).count("aggregate(") == 1


def test_lines_are_taken_from_anchors(spark):
    rng = random.Random(4)
    rows = [(n, "\n".join(rng.choice(["alpha", "Beta", "x"]) for _ in range(rng.randint(1, 60))), rng.randint(0, 50), rng.choice(["", "beta", "see p.py:30 and p.py:41", "alpha p.py:9"]), [rng.randint(0, 90) for _ in range(rng.randint(0, 9))]) for n in range(200)]
    frame = spark.createDataFrame(rows, "n int, content string, start int, query string, calls array<int>")
    for most in (3, 5, 12):
        shown = frame.select("n", rendering.focused(F.col("content"), F.col("start"), F.col("query"), F.lit("p.py"), F.col("calls"), most).alias("f"))
        got = {r["n"]: [i for s in r["f"] for i in range(s["start"], s["end"] + 1)] for r in shown.collect()}
        for n, content, start, query, calls in rows:
            lines, head = content.split("\n"), min(4, most)
            held = [i for i, x in enumerate(lines) if i >= head and any(w in x.lower() for w in re.findall("[a-z]{3,}", query))][:8]
            anchors = [a for a in dict.fromkeys([int(x) - start for x in re.findall(r"p\.py:(\d+)", query)] + [c - start for c in calls[:8]] + held) if head <= a < len(lines)]
            near = sorted((min((i, p) for i, a in enumerate(anchors) for p, at in enumerate((0, -1, 1, -2, 2, -3, 3)) if a + at == x), x) for x in range(head, len(lines)) if any(abs(x - a) <= 3 for a in anchors))
            kept = sorted([*range(head), *(x for _, x in near)][:most])
            want = range(len(lines)) if len(lines) <= most else kept if len(kept) > head else range(most)
            assert got[n] == [start + x for x in want]
    # no line is held against all anchors
    assert "array_position" not in planned(shown)


def test_only_calls_of_seeds_are_ranked(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 2, "parsed"), ("a", "c", "calls", 1, "parsed"), ("b", "a", "calls", 1, "parsed"), ("c", "a", "calls", 1, "parsed"), ("d", "c", "calls", 1, "parsed"), ("d", "b", "calls", 1, "parsed")], "source string, target string, kind string, line int, provenance string")
    symbols = spark.createDataFrame([(n, "k" + n, n == "c") for n in "abcd"], "fqn string, chunk_id string, is_exported boolean")
    out, into = graph._ranked_calls(edges, symbols, spark.createDataFrame([("a",)], "fqn string"))
    assert sorted((r["source"], r["target"], r["place"]) for r in out.collect()) == [("a", "b", 2), ("a", "c", 1)]
    assert sorted((r["source"], r["target"], r["place"], r["n"]) for r in into.collect()) == [("b", "a", 2, 2), ("c", "a", 1, 2)]

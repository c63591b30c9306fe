"""Fixpoints and scopes against plain Python."""

import random
from collections import defaultdict, deque

from lodestone.operators import fixpoint, scopes


def test_reach_is_breadth_first_and_ends_in_cycles(spark, tmp_path):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("hub", f"h{i}") for i in range(50)] + [("h3", "hub"), ("n1", "hub"), (None, "n1"), ("n1", None)]
    seed = [(f"n{rng.randrange(60)}", f"i{j % 4}") for j in range(12)] + [("hub", "i9"), ("hub", "i9"), (None, "i1")]
    out = defaultdict(set)
    for a, b in edges:
        if a and b:
            out[a].add(b)
    want = {}
    for item in {i for n, i in seed if n}:
        queue = deque((n, 1) for n in {n for n, i in seed if i == item and n})
        while queue:
            node, d = queue.popleft()
            if (node, item) not in want:
                want[node, item] = d
                queue.extend((x, d + 1) for x in out[node])
    got = fixpoint.reach(spark.createDataFrame(seed, "node string, item string"), spark.createDataFrame(edges, "node string, next string"), str(tmp_path), hub=7)
    rows = got.collect()
    assert {(r["node"], r["item"]): r["distance"] for r in rows} == want and len(rows) == len(want)
    none = spark.createDataFrame([], "node string, item string")
    assert fixpoint.reach(none, spark.createDataFrame(edges, "node string, next string"), str(tmp_path)).count() == 0


def test_overrides_take_the_nearest_base(spark, tmp_path):
    extends = spark.createDataFrame([("D", "C"), ("C", "B"), ("B", "A"), ("A", "D"), ("D", "X")], "class string, base string")
    methods = [("D.f/1", "D", "f", 1), ("C.f/2", "C", "f", 2), ("B.f/1", "B", "f", 1), ("A.f/1", "A", "f", 1), ("X.f/1", "X", "f", 1), ("A.g/0", "A", "g", 0), ("D.g/0", "D", "g", 0)]
    got = fixpoint.overrides(spark.createDataFrame(methods, "method string, class string, name string, arity int"), extends, str(tmp_path))
    rows = {(r["method"], r["overridden"], r["distance"]) for r in got.collect()}
    assert {r for r in rows if r[0].startswith("D")} == {("D.f/1", "X.f/1", 1), ("D.g/0", "A.g/0", 3)}
    assert ("B.f/1", "A.f/1", 1) in rows and not any(a.split(".")[0] == b.split(".")[0] for a, b, _ in rows)


def test_pointers_follow_aliases(spark, tmp_path):
    assigned = [("f", "p", "q"), ("f", "q", "r"), ("f", "r", "p"), ("f", "r", "add"), ("f", "q", "sub"), ("f", "u", "nothing"), ("g", "p", "add"), ("f", "p", "q")]
    calls = [("f", "main", 1, "p"), ("f", "main", 2, "u"), ("f", "main", 3, "add"), ("g", "main", 4, "p"), ("g", "main", 5, "zed")]
    functions = spark.createDataFrame([("f", "add"), ("f", "sub"), ("g", "add")], "path string, name string")
    got = fixpoint.pointer_calls(spark.createDataFrame(calls, "path string, owner string, line int, name string"), spark.createDataFrame(assigned, "path string, variable string, value string"), functions, str(tmp_path))
    assert sorted((r["path"], r["line"], r["target"], r["provenance"]) for r in got.collect()) == [
        ("f", 1, "add", "synthesized"), ("f", 1, "sub", "synthesized"), ("f", 2, "u", "unresolved"), ("f", 3, "add", "parsed"), ("g", 4, "add", "synthesized"), ("g", 5, "zed", "parsed"),
    ]


def nested(rng, start, end, out, depth=0):
    out.append((start, end, depth))
    at = start
    while depth < 5 and at < end:
        a = at + rng.randint(0, 6)
        b = a + rng.randint(0, max(1, (end - start) // 2))
        if b > end:
            break
        if (a, b) != (start, end):
            nested(rng, a, b, out, depth + 1)
        at = b + 1


def test_innermost_scope_that_has_the_name(spark):
    rng = random.Random(8)
    rows, names, places = [], [], []
    for f in range(6):
        found = []
        nested(rng, 0, 120, found)
        rows += [(f"f{f}", f"s{i}", a, b, d) for i, (a, b, d) in enumerate(found)]
        names += [(f"f{f}", f"s{i}", n, f"{i}{n}") for i in range(len(found)) for n in "xyz" if rng.random() < 0.3]
        places += [(f"f{f}", r, rng.randint(0, 125), rng.choice("xyzw")) for r in range(60)]
    scope = spark.createDataFrame([r[:4] for r in rows], "path string, scope string, start int, end int")
    assert {(r["path"], r["scope"]): r["depth"] for r in scopes.depths(scope).collect()} == {(p, s): d for p, s, _, _, d in rows}
    got = scopes.innermost(spark.createDataFrame(places, "path string, ref int, at int, root string"), scope, spark.createDataFrame(names, "path string, scope string, name string, value string"))
    inside = {(p, s): (a, b, d) for p, s, a, b, d in rows}
    for r in got.collect():
        hits = [(inside[p, s][2], v) for p, s, n, v in names if p == r["path"] and n == r["root"] and inside[p, s][0] <= r["at"] <= inside[p, s][1]]
        assert r["value"] == (max(hits)[1] if hits else None)


def test_resolution_rules(spark):
    scope = spark.createDataFrame([("f", "r", 0, 100), ("f", "in", 10, 50), ("f", "deep", 20, 30)], "path string, scope string, start int, end int")
    declared = [("f", "r", "a", "f::a", "function"), ("f", "in", "a", None, "variable"), ("f", "r", "v", "f::v", "variable"), ("f", "r", "C", "f::C.m", "method"), ("f", "r", "b", "f::b", "function")]
    asked = [(1, 5, "a", "calls", None), (2, 15, "a", "calls", None), (3, 5, "v", "calls", None), (4, 5, "v", "reads", None), (5, 25, "b", "calls", None), (6, 35, "b", "calls", None), (7, 5, "T", "calls", None), (8, 5, "T", "reads", None),
             (9, 5, "ns.go", "calls", None), (10, 5, "ns", "calls", None), (11, 5, "one.x", "calls", None), (12, 5, "this.m", "calls", "f::C"), (13, 5, "this.n", "calls", "f::C"), (14, 5, "a.b", "reads", None), (15, 5, "zed", "calls", None)]
    imports = [("f", "T", "m", "T", True), ("f", "ns", "m", "*", False), ("f", "one", "m", "one", False)]
    got = scopes.resolve(
        spark.createDataFrame([("f", *r) for r in asked], "path string, ref int, at int, target string, kind string, class_owner string"), scope,
        spark.createDataFrame(declared, "path string, scope string, name string, symbol string, kind string"), spark.createDataFrame([("f", "deep", "b")], "path string, scope string, name string"),
        spark.createDataFrame(imports, "path string, name string, module string, imported string, only_type boolean"), spark.createDataFrame([], "path string, symbol string"),
    )
    rows = {r["ref"]: (r["outcome"], r["target"]) for r in got.collect()}
    assert rows == {
        1: ("resolved", "f::a"), 2: ("unresolved", "a"), 3: ("unresolved", "v"), 4: ("resolved", "f::v"), 5: ("binding_boundary", "b"), 6: ("resolved", "f::b"), 7: ("unresolved", "T"), 8: ("resolved", "js:m#T"),
        9: ("resolved", "js:m#go"), 10: ("unresolved", "ns"), 11: ("unresolved", "one.x"), 12: ("resolved", "f::C.m"), 13: ("unresolved", "this.n"), 14: ("unresolved", "a.b"), 15: ("unresolved", "zed"),
    }

"""Word lattices against brute force, forms chosen inside the packing fold, and features of what the graph adds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.operators import fusion, packing, rendering, words


def best_words(run, counts, longest):
    total = sum(counts.values()) or 1
    cost = lambda w: round(1000 * math.log(total / counts[w])) if w in counts else round(1000 * math.log(total)) if len(w) == 1 else None
    best, back = [0], [0]
    for end in range(1, len(run) + 1):
        options = [(best[s] + c, s) for s in range(max(0, end - longest), end) if (c := cost(run[s:end])) is not None]
        best.append(min(options)[0])
        back.append(min(options)[1])
    out, at = [], len(run)
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def test_runs_take_the_path_of_least_cost(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choice("天地人和") for _ in range(rng.randint(1, 4))): rng.randint(2, 90) for _ in range(60)}
    runs = sorted({"".join(rng.choice("天地人和外") for _ in range(rng.randint(1, 30))) for _ in range(80)})
    dictionary = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["run"]: list(r["words"]) for r in words.segmented_runs(spark.createDataFrame([(r,) for r in runs], "run string"), dictionary).collect()}
    assert got == {r: best_words(r, counts, 4) for r in runs}


def test_texts_of_several_scripts(spark):
    rows = [(1, "请问天地 hello-world 和人42!"), (2, None), (3, ""), (4, "  "), (5, "天地" * 3000), (6, "plain only")]
    dictionary = spark.createDataFrame([("天地", 50), ("和人", 9), ("请", 3), ("天", 2)], "word string, n long")
    got = {r["k"]: r["segmented"] for r in words.segmented(spark.createDataFrame(rows, "k int, t string"), ["k"], "t", dictionary).collect()}
    assert got == {1: "请 问 天地 hello - world 和人 42 !", 2: None, 3: "", 4: "", 5: " ".join(["天地"] * 3000), 6: "plain only"}
    empty = {r["k"]: r["segmented"] for r in words.segmented(spark.createDataFrame(rows[:1], "k int, t string"), ["k"], "t", dictionary.limit(0)).collect()}
    assert empty == {1: "请 问 天 地 hello - world 和 人 42 !"}


def test_a_dictionary_counts_the_corpus(spark):
    rows = [("天地人",), ("天地x天",), (None,), ("天地人",)]
    got = {r["word"]: r["n"] for r in words.counted_dictionary(spark.createDataFrame(rows, "t string"), "t", longest=2).collect()}
    assert got == {"天": 4, "地": 3, "人": 2, "天地": 3, "地人": 2}


def test_forms_cost_what_is_shown(spark):
    body = "\n".join(f"line {i} {'needle' if i == 70 else 'hay'} and some more words" for i in range(100))
    rows = spark.createDataFrame([(1, "a", "f", 1, body, "where is the needle"), (2, "b", "f", 1, None, "x")], "query_id int, chunk_id string, path string, start_line int, content string, query string")
    got = {r["chunk_id"]: r for r in packing.with_forms(rows, "content", heads=(40, 5), focus=(12,), query="query").collect()}
    cost = lambda t: max(1, math.ceil(len(t) / 4))
    shown = rows.where("chunk_id = 'a'").select(rendering.focused(F.col("content"), F.col("start_line"), F.col("query"), F.col("path"), F.array().cast("array<int>"), 12).alias("s")).first()["s"]
    assert any("needle" in s["text"] for s in shown)
    want = {"head 40": cost("\n".join(body.split("\n")[:40])), "head 5": cost("\n".join(body.split("\n")[:5])), "focus 12": cost("\n".join(s["text"] for s in shown))}
    forms = [(f["form"], f["tokens"]) for f in got["a"]["forms"]]
    assert dict(forms) == want and [t for _, t in forms] == sorted((t for _, t in forms), reverse=True)
    assert {f["tokens"] for f in got["b"]["forms"]} == {0}


@pytest.mark.parametrize(("room", "form"), [(5000, "whole"), (2600, "head 40"), (1200, "focus 20"), (650, "head 5"), (540, None)])
def test_the_fold_takes_the_largest_form_that_fits(spark, room, form):
    forms = [("head 40", 1500), ("focus 20", 600), ("head 5", 100)]
    rows = spark.createDataFrame([(1, "a", "f", "code", 2, 9.0, 4000, forms)], f"query_id int, chunk_id string, path string, kind string, tier int, score double, tokens long, forms {packing.FORMS}")
    got = packing.assemble(rows, packing.Budget(tokens=room, per_file=10_000, core=2.0)).collect()
    assert [r["form"] for r in got] == ([form] if form else [])


def test_what_the_graph_adds_is_marked(spark):
    pool = spark.createDataFrame([(1, "a", 0.02, 1), (1, "b", 0.01, 2), (2, "a", 0.02, 1)], "query_id int, chunk_id string, rrf_score double, position int")
    near = spark.createDataFrame([(1, "c", "a", "parsed"), (1, "d", "b", "synthesized"), (1, "b", "a", "parsed"), (2, "c", "z", None), (1, "c", "b", "parsed")], "query_id int, chunk_id string, parent string, provenance string")
    far = spark.createDataFrame([(1, "e", "parsed"), (1, "c", "parsed"), (2, "f", "synthesized")], "query_id int, chunk_id string, provenance string")
    rows = {(r["query_id"], r["chunk_id"]): r for r in fusion.rerank(fusion.with_graph(pool, near, far), "query_id", "chunk_id").collect()}
    told = {k: (r["near_top"], r["flow_chain"], r["synthesized"], round(r["score"], 6)) for k, r in rows.items()}
    assert told == {
        (1, "a"): (False, False, False, 0.5), (1, "b"): (False, False, False, 0.25), (1, "c"): (True, False, False, 0.5), (1, "d"): (False, False, True, -0.2), (1, "e"): (False, True, False, 0.6),
        (2, "a"): (False, False, False, 0.5), (2, "c"): (False, False, False, 0.0), (2, "f"): (False, True, True, 0.4),
    }
    assert rows[1, "e"]["position"] == 1 and texts.CJK

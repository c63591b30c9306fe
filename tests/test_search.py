"""Phrases by positions and vectors by cells, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import phrases, vector_search


def words(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


def starts(held, asked):
    return sum(held[i : i + len(asked)] == asked for i in range(len(held) - len(asked) + 1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "a", "b", "c", "Of"]) for _ in range(rng.randint(0, 40))), rng.choice(["the a", "b", None])) for i in range(80)]
    return [*rows, (80, None, None), (81, "", "x"), (82, "a a a a a", "a a"), (83, "rare; the-rare the", None)]


def test_phrases_are_those_of_the_texts(spark, texts, tmp_path):
    chunks = spark.createDataFrame(texts, "chunk_id long, text string, name string")
    asked = [(1, "the a"), (2, "a a"), (3, "of the a"), (4, "the rare the"), (5, "word"), (6, "missing the"), (7, ""), (8, None), (9, "a b c the")]
    phrases.write_positions(phrases.positions_of(chunks, "chunk_id", ["text", "name"]), str(tmp_path))
    index = phrases.read_positions(spark, str(tmp_path))
    found = phrases.occurrences(index, "chunk_id", spark.createDataFrame(asked, "query_id long, asked string"), "query_id", "asked")
    got = {(r["query_id"], r["chunk_id"]): r["times"] for r in found.collect()}
    want = {}
    for q, text in asked:
        for i, body, name in texts:
            n = starts(words(body), words(text)) + starts(words(name), words(text)) if len(words(text)) > 1 else 0
            if n:
                want[q, i] = n
    assert got == want and want[2, 82] == 5


def test_a_phrase_reads_no_text(spark, texts, tmp_path):
    chunks = spark.createDataFrame(texts, "chunk_id long, text string, name string")
    phrases.write_positions(phrases.positions_of(chunks, "chunk_id", ["text", "name"]), str(tmp_path))
    top = phrases.phrase_top_k(phrases.read_positions(spark, str(tmp_path)), "chunk_id", spark.createDataFrame([(1, "the a")], "query_id long, asked string"), "query_id", "asked", 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans and all("text" not in s for s in scans) and "PartitionFilters: [folder" in plan
    rows = top.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["score"] >= rows[1]["score"] >= rows[2]["score"]


def test_no_chunks_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string")
    index = phrases.positions_of(none, "chunk_id", ["text"])
    asked = spark.createDataFrame([(1, "the a")], "query_id long, asked string")
    assert phrases.phrase_top_k(index, "chunk_id", asked, "query_id", "asked").count() == 0
    some = phrases.positions_of(spark.createDataFrame([(1, "the a")], none.schema), "chunk_id", ["text"])
    assert phrases.phrase_top_k(some, "chunk_id", asked.limit(0), "query_id", "asked").count() == 0


VECTORS = "id long, vector array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.4
    x[300:600] = x[0]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [1.0, 2.0]), (905, [2.0, 4.1]), (906, [])]
    return spark.createDataFrame(rows, VECTORS)


def brute(rows, asked, k):
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in asked:
        if q in usable:
            scored = sorted((-round(float(usable[q] @ u), 9), i) for i, u in usable.items() if len(u) == len(v))
            out |= {(q, rank): i for rank, (_, i) in enumerate(scored[:k], 1)}
    return out


def of(found):
    return {(r["query"], r["rank"]): r["id"] for r in found.collect()}


def test_blocks_give_the_exact_neighbours(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_search, "ROW_BLOCK", 100)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 20)
    asked = vectors.where("id % 7 = 0 OR id > 899").select(F.col("id").alias("query"), F.col("vector").alias("asked"))
    got = of(vector_search.exact_top_k(vectors, "id", "vector", asked, "query", "asked", 5))
    rows = [tuple(r) for r in vectors.collect()]
    assert got == brute(rows, [(i, v) for i, v in rows if i % 7 == 0 or i > 899], 5)
    assert vector_search.exact_top_k(vectors, "id", "vector", asked, "query", "asked", 0).count() == 0
    assert vector_search.exact_top_k(vectors.limit(0), "id", "vector", asked, "query", "asked", 5).count() == 0


def test_cells_reach_the_recall_they_are_calibrated_for(spark, vectors, tmp_path):
    asked = vectors.where("id % 5 = 0 OR id > 899").select(F.col("id").alias("query"), F.col("vector").alias("asked"))
    index = vector_search.write_cells(vectors, "id", "vector", str(tmp_path), cells=16)
    again = vector_search.read_cells(spark, str(tmp_path))
    assert np.allclose(index.centroids, again.centroids)
    assert spark.read.parquet(f"{tmp_path}/cells").count() == 902  # every usable row, those of another length too
    exact = of(vector_search.exact_top_k(vectors, "id", "vector", asked, "query", "asked", 10))
    assert of(vector_search.search_cells(again, asked, "query", "asked", "id", 10, probes=16)) == exact
    probes = vector_search.calibrated_probes(again, vectors, "id", "vector", 10, 0.95)
    assert 1 <= probes < 16
    near = of(vector_search.search_cells(again, asked, "query", "asked", "id", 10, probes))
    by_query = lambda found: {(q, i) for (q, _), i in found.items()}
    assert len(by_query(near) & by_query(exact)) >= 0.9 * len(exact)


def test_recall_of_the_registered_index(spark, sf):
    from lodestone.plans import catalog

    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    exact = pairs(catalog.cosine_topk(spark, sf))
    assert len(pairs(catalog.indexed_topk(spark, sf)) & exact) >= 0.9 * len(exact)


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], VECTORS)
    index = vector_search.write_cells(none, "id", "vector", str(tmp_path), cells=4)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query long, asked array<double>")
    assert vector_search.search_cells(index, asked, "query", "asked", "id", 3).count() == 0
    assert vector_search.calibrated_probes(index, none, "id", "vector") == 1


def test_an_index_follows_its_files(spark, sf, tmp_path):
    from lodestone.plans import catalog

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 50").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.search_index(spark, str(tmp_path)).stats.first()["n"] == 50
    assert catalog.positional_index(spark, str(tmp_path)).stats.first()["n"] == 50
    docs.where("doc_id < 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert catalog.search_index(spark, str(tmp_path)).stats.first()["n"] == 70
    assert catalog.positional_index(spark, str(tmp_path)).stats.first()["n"] == 70

"""What queries name, the recall channels and the merged pool."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.functions import mentions
from lodestone.operators import channels


def test_explicit_and_inferred():
    q = "Does `refresh_token` in src/auth/token.py call TokenService::refresh, a.b.py and readConfig or MAX_SIZE? See `x y`, foo_bar, HttpClient"
    assert mentions.explicit(q) == [("symbol", "refresh_token"), ("path", "src/auth/token.py"), ("path", "a.b.py"), ("symbol", "TokenService::refresh")]
    assert mentions.inferred(q) == ["readConfig", "MAX_SIZE", "foo_bar", "HttpClient"]
    assert mentions.explicit(None) == [] and mentions.inferred("") == [] and mentions.explicit("a.unknown") == [("symbol", "a.unknown")]


def test_literal_phrases():
    Phrase = mentions.Phrase
    assert mentions.literal_phrases('find `abc-def` and "quoted words here" x=1 short') == [Phrase("abc-def", True), Phrase("quoted words here", True)]
    assert mentions.literal_phrases("Cannot include the same router instance")[0] == Phrase("Cannot include the same router instance", True)
    assert mentions.literal_phrases("GRAPH_MODE capability definition", ("capability",)) == [Phrase("GRAPH_MODE", True), Phrase("definition", False)]
    assert mentions.literal_phrases("  ") == [] and mentions.literal_phrases(None) == []
    assert len(mentions.literal_phrases(" ".join(f"key{i}=val{i}" for i in range(20)))) == 6


def test_mentions_in_prose(spark):
    text = "Call `run now` then fooBar, A::b, snake_case and src/x.py; fooBar again"
    assert mentions.mentioned(text) == ["run now", "fooBar", "A::b", "snake_case", "src/x.py"]
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    assert [(r[0], r[1]) for r in mentions.mentions(rows, "id", "t").collect()] == [(1, i) for i in range(5)]


@pytest.fixture(scope="module")
def index(spark):
    symbols = [("s1", "refresh", "Token.refresh", "c1", "a.py", 3, True), ("s2", "refresh", "Other::refresh", "c2", "b.cpp", 1, False), ("s3", "refresh", "x.refresh", None, "c.py", 1, True)]
    chunks = [("c1", "a.py", "Token.refresh", "function", 3, 9, "def refresh(): mode=FAST  # deprecated"), ("c2", "b.cpp", "Other::refresh", "method", 1, 2, "mode=FAST mode=FAST the quick brown fox"), ("c3", "d.md", "Guide", "spec_block", 1, 5, "The quick brown fox runs")]
    return (
        spark.createDataFrame(symbols, "id string, name string, fqn string, chunk_id string, file_path string, start_line int, is_exported boolean"),
        spark.createDataFrame(chunks, "chunk_id string, file_path string, symbol_fqn string, symbol_kind string, start_line int, end_line int, content string"),
    )


def ranks(df):
    return [(r["q"], r["chunk_id"], r["rank"]) for r in df.orderBy("q", "rank").collect()]


def test_channels(spark, index):
    symbols, chunks = index
    tokens = spark.createDataFrame([(1, 0, "Other.refresh"), (1, 1, "refresh"), (2, 0, "none")], "q int, position int, token string")
    assert ranks(channels.symbol_recall(symbols, tokens, "q", True)) == [(1, "c2", 1), (1, "c1", 2)]
    assert ranks(channels.symbol_recall(symbols, tokens, "q", False)) == [(1, "c1", 1), (1, "c2", 2)]
    phrases = spark.createDataFrame([(1, 0, "mode=FAST", True), (1, 1, "quick brown fox", True), (2, 0, "REFRESH", False)], "q int, position int, phrase string, strong boolean")
    found = channels.literal_recall(chunks, symbols, phrases, "q")
    assert ranks(found) == [(1, "c2", 1), (1, "c1", 2), (1, "c3", 3), (2, "c1", 1), (2, "c2", 2)]
    assert {(r["q"], r["tier"]) for r in found.collect()} == {(1, 0), (2, 1)}


def test_gather_and_merge(spark, index):
    symbols, chunks = index
    tokens = spark.createDataFrame([(1, 0, "refresh")], "q int, position int, token string")
    gone = spark.createDataFrame([(1, "lost", 1)], "q int, chunk_id string, rank int")

    def broken():
        raise AnalysisException("no table")

    rows, failed = channels.gather({"exact": lambda: channels.symbol_recall(symbols, tokens, "q", True), "bm25": lambda: gone, "vector": broken}, "q")
    assert failed == ["vector: AnalysisException"]
    named = spark.createDataFrame([(1, "b.cpp")], "q int, path string")
    out = {r["chunk_id"]: r for r in channels.merge(rows.withColumn("tier", F.lit(1)), chunks, "q", named).collect()}
    assert set(out) == {"c1", "c2"}
    assert (out["c1"]["tier"], out["c2"]["tier"]) == (1, 0)
    assert out["c2"]["reasons"] == ["refresh", "explicit path"] and out["c1"]["kind"] == "code"
    with pytest.raises(AnalysisException):
        channels.gather({"exact": broken}, "q")


def test_signals(spark, index):
    symbols, chunks = index
    pool = spark.createDataFrame([(1, "c1", "a.py", "Token.refresh", 1), (1, "c2", "a.py", "Other::refresh", 2)], "query_id int, chunk_id string, path string, symbol_fqn string, position int")
    stale = spark.createDataFrame([("c2",)], "chunk_id string")
    files = spark.createDataFrame([("a.py", True)], "path string, generated boolean")
    out = {r["chunk_id"]: r for r in channels.signals(pool, chunks, symbols, stale, files).collect()}
    assert [out["c1"][c] for c in ("exported", "stale", "generated", "deprecated", "near_top")] == [True, False, True, True, False]
    assert [out["c2"][c] for c in ("exported", "stale", "generated", "deprecated", "near_top")] == [False, True, True, False, True]


def test_lexical_cleaning(spark):
    row = spark.createDataFrame([("`A::b` x",)], "q string").select(mentions.lexical_query(F.col("q")).alias("q"), mentions.lexical_tokens(F.array(F.lit("—"), F.lit("漢"), F.lit(":"), F.lit("a1"))).alias("t")).first()
    assert row["q"] == " A b  x" and row["t"] == ["漢", "a1"]


@pytest.mark.parametrize("block", [1000, 5])
def test_needles_are_found_in_one_pass_or_by_grams(spark, monkeypatch, block):
    monkeypatch.setattr(channels, "BLOCK", block)
    rng = random.Random(block)
    texts = [(i, "".join(rng.choice("ab.é\n ") for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(60, None), (61, ""), (62, "aaaaaaa")]
    needles = sorted({"".join(rng.choice("ab.é") for _ in range(rng.randint(1, 7))) for _ in range(60)}) + ["aaa", "nowhere at all", ""]
    got = channels.occurrences(spark.createDataFrame(texts, "chunk_id long, text string"), "text", spark.createDataFrame([(n,) for n in needles + needles[:3]], "low string"))
    want = {(i, n): t.count(n) for i, t in texts for n in needles if n and t and n in t}
    assert {(r["chunk_id"], r["low"]): r["times"] for r in got.collect()} == want
    none = channels.occurrences(spark.createDataFrame(texts, "chunk_id long, text string"), "text", spark.createDataFrame([], "low string"))
    assert none.count() == 0


def test_literal_recall_by_positions(spark):
    from lodestone.operators import phrases

    rows = [("a", "x", "must start with a slash"), ("b", "y", "it must start with one: must start with two and then very many other words follow"), ("c", "must", "must not start with"), ("d", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, symbol_fqn string, content string")
    symbols = spark.createDataFrame([("a", "starter")], "chunk_id string, name string")
    asked = spark.createDataFrame([(1, 0, "Must start, with", True), (1, 1, "slash", True), (1, 2, "start", False)], "query int, position int, phrase string, strong boolean")
    index = phrases.positions_of(chunks, "chunk_id", ["content"])
    by_texts = {r["chunk_id"]: r["tier"] for r in channels.literal_recall(chunks, symbols, asked, "query").collect()}
    found = channels.literal_recall(chunks, symbols, asked, "query", positions=index).orderBy("rank").collect()
    assert {r["chunk_id"]: r["tier"] for r in found} == by_texts == {"a": 0, "b": 0}
    assert [r["rank"] for r in found] == [1, 2]

"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lodestone.llm import queries, spelling
from lodestone.llm.shared import Scratch

SCHEMA = "doc_id long, text string, word string, n string, best string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least, misspell):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if misspell and h % misspell == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= least}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and distance_one(a, b):
                near[a].append((-words[b], b))
    form = {w: min(near[w])[1] for w in words if near[w] and -min(near[w])[0] >= ratio * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()), near


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 12))) for _ in range(40)] + ["straße", "naïveté", "ÀÉÎõÿ×÷", "Ünïcôdé"]
    out = []
    for i in range(n):
        said = []
        for _ in range(rng.randint(0, 60)):
            w = words[min(int(rng.expovariate(0.2)), len(words) - 1)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abZ") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            said.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "1", "_"]).join(said)))
    return [*out, (None, "Word words worlds word"), (900, None), (901, ""), (902, "a"), (3, out[3][1]), (903, "longest " * 30_000)]


@pytest.mark.parametrize(("least", "least_n", "ratio", "misspell", "shard", "block"), [(7, 2, 10, 31, 100_000, 400_000), (5, 1, 2, 3, 7, 11), (2, 1, 2, 0, 50, 5), (7, 1, 3, 1, 3, 1000)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, least, least_n, ratio, misspell, shard, block):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (shard, block))
    rows = texts(least + shard)
    docs = spark.createDataFrame([(i, t, "w", "n", "b") for i, t in rows], SCHEMA)
    words = {w: n for w, n in counted(rows, least, misspell).items() if n >= least_n}
    got = spelling.variants(docs, least, least_n, ratio, misspell)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == brute(words, ratio)[0]


def test_one_edit_is_the_distance():
    rng = random.Random(3)
    for _ in range(20_000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        assert spelling.one_edit(a, b) == (a != b and distance_one(a, b)), (a, b)


@pytest.mark.parametrize(("short", "indexed", "segment"), [(16, 256, 64), (0, 256, 64), (2, 6, 2), (0, 256, 1)])
def test_halves_find_all_near_words(monkeypatch, short, indexed, segment):
    """Also through the index of other halves, with cut segments, and with words too long for the index."""
    for name, value in (("SHORT_LIST", short), ("INDEXED", indexed), ("SEGMENT", segment)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(short + segment)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(900)})
    halves = spelling.Halves(words)
    for word in words:
        want = {w for w in words if distance_one(w, word) and w != word and (len(w) < len(word) or len(w) == len(word) and w < word)}
        assert {words[i] for i in halves.near(word)} == want


def test_very_long_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    rows = [(1, f"{long} {long[:-1]} {long[:7]}x{long[8:]}"), (2, f"{long} {'a' * 70} {'a' * 71} {'a' * 64} {'a' * 63}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["word"], r["n_near"]) for r in spelling.variants(docs, min_count=1).collect()}
    assert got == {(long, 2), (long[:-1], 1), (f"{long[:7]}x{long[8:]}", 1), ("a" * 70, 1), ("a" * 71, 1), ("a" * 64, 1), ("a" * 63, 1)}


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 5)
    for text in ("", "abc", "abcdefghij", "ab cd efghij klmno", "é" * 20 + " x", "1234567890 abc"):
        parts = list(spelling._pieces(text))
        assert "".join(parts) == text
        assert [w for p in parts for w in re.findall("[a-zé]+", p)] == re.findall("[a-zé]+", text)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "test"))
    assert dict(map(tuple, got.collect())) == {w: "w37" for w, _ in chain}


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "short")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="at least 2"):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.OP13})").fetchall())
    assert rows_of(queries.op13_spelling_variants(spark, sf)) == want

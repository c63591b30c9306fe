"""Chunks of files, headers, texts to embed, batches."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, parse

CODE = '''import os

class Box:
    """A box."""

    size: int = 1

    def open(self, a=")",
             b=[1]):  # note
        """Opens
        it."""
        return a


def free():
    return 1

print(free())
'''


def test_prepare(spark):
    rows = [("a.py", b"x = 1\r\ny"), ("b.bin", b"a\x00b"), ("c.txt", b"x" * 140_000), ("d.md", b"\xff ok"), ("e.pb2.py", b"")]
    out = {r["path"]: r for r in chunking.prepare(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert out["a.py"]["text"] == "x = 1\ny" and out["a.py"]["segmented"] == "x = 1 y" and out["a.py"]["language"] == "python"
    assert out["b.bin"]["skip_reason"] == "binary" and out["b.bin"]["text"] is None and out["c.txt"]["skip_reason"] == "oversize:140000"
    assert out["d.md"]["text"].endswith(" ok") and out["e.pb2.py"]["generated"]


def test_structural(spark):
    files = spark.createDataFrame([("a.py", CODE), ("empty.py", ""), ("one.txt", "z" * 90_000), ("none.py", None)], "path string, text string")
    symbols = parse.python_symbols(files.where("path = 'a.py'"))
    none = spark.createDataFrame([], "path string, heading_path string, start_line int, end_line int")
    chunks = chunking.structural(files, symbols, none)
    rows = sorted(chunks.where("file_path = 'a.py'").collect(), key=lambda r: (r["start_line"], r["end_line"]))
    assert [(r["symbol_fqn"], r["symbol_kind"], r["start_line"], r["end_line"]) for r in rows] == [
        ("(module)", "fallback_block", 1, 1), ("Box", "class_skeleton", 3, 7), ("Box.open", "method", 8, 12), ("free", "function", 15, 16), ("(module)", "fallback_block", 17, 18)
    ]
    assert {r["id"] for r in chunks.where("file_path = 'one.txt'").collect()} == {"one.txt:(module):1", "one.txt:(module):1#2", "one.txt:(module):1#3"}
    assert chunks.where("file_path IN ('empty.py', 'none.py')").count() == 0
    heads = {r["symbol_fqn"]: r for r in chunking.with_headers(chunks.where("file_path = 'a.py'").withColumn("language", F.lit("python")), "language").collect()}
    assert heads["Box.open"]["signature"].split("\n")[-1].strip() == "b=[1]):  # note" and heads["Box.open"]["docstring"].startswith("Opens")
    assert heads["Box"]["docstring"] == "A box." and heads["(module)"]["signature"] == "" and heads["free"]["docstring"] == ""


def test_repeated_ids_raise(spark):
    files = spark.createDataFrame([("a.py", "x\ny\n")], "path string, text string")
    twice = spark.createDataFrame([("a.py", "f", "function", 1, 2), ("a.py", "f", "function", 1, 2)], "path string, fqn string, kind string, start_line int, end_line int")
    with pytest.raises(Exception, match="repeated chunk id"):
        chunking.structural(files, twice, spark.createDataFrame([], "path string, heading_path string, start_line int, end_line int")).collect()


def test_headers():
    assert chunking.braced_header("int f(int a,\n      int b)\n{\n") == "int f(int a,\n      int b)" and chunking.braced_header("{x") == "{x"
    assert chunking.python_header("@deco\ndef f(\n  a,\n):\n    'doc'\n") == ("@deco\ndef f(\n  a,\n):", "doc")
    assert chunking.python_header("x = 1") == ("x = 1", "")


def test_embedding_text_and_cuts(spark):
    row = [("p.py", "f", "def f():", "doc", "def f():\n    return 1"), ("p.py", "", "", None, "body")]
    df = spark.createDataFrame(row, "p string, f string, s string, d string, c string")
    got = [r[0] for r in df.select(chunking.embedding_text(*map(F.col, "pfsdc"))).collect()]
    assert got == ["p.py :: f\n\ndef f():\n\ndoc\n\n    return 1", "p.py\n\nbody"]
    cut = spark.createDataFrame([("aé漢x",), ("ab",), (None,)], "t string")
    assert [r[0] for r in cut.select(chunking.cut_bytes(F.col("t"), 5)).collect()] == ["aé", "ab", None]
    words = " ".join(f"word{i}" for i in range(50))
    from public_tokenizers import path
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    short = spark.createDataFrame([(words,), ("",), (None,)], "t string").select(chunking.cut_tokens(F.col("t"), 9, str(path("byte_bpe_50k.json"))).alias("t")).collect()
    assert words.startswith(short[0]["t"]) and 0 < len(model.encode(short[0]["t"]).ids) <= 9 and short[1]["t"] == "" and short[2]["t"] is None


def test_batches(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([3, 3, 10, 1, 1, 1, 1])], "i int, t long").coalesce(1)
    got = [r["batch"] for r in chunking.batches(rows, "t", 3, 6).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError):
        chunking.batches(rows, "t", 0, 1)


def test_finalize(spark):
    rows = spark.createDataFrame([("a", "x", "b" * 200, "function", 1, 2), ("a", "x", "b" * 200, "function", 1, 2)], "path string, name string, fqn string, kind string, start_line int, end_line int")
    assert [len(r["fqn"]) for r in chunking.finalize(rows).collect()] == [120]
    errors = spark.createDataFrame([("a", i, "m") for i in range(30)], "path string, line int, message string")
    assert chunking.first_errors(errors).count() == 20

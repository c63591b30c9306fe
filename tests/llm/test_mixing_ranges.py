"""The mixture's order does not depend on how ids are cut into ranges."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, queries


@pytest.mark.parametrize(("rows", "coarse", "fine"), [(1, 4, 3), (3, 1, 5), (2, 50, 1), (10, 2, 1000), (1, 256, 1000)])
def test_any_ranges_give_the_same_mixture(spark, sf, monkeypatch, rows, coarse, fine):
    for name, value in (("BUCKET_ROWS", rows), ("COARSE", coarse), ("FINE", fine)):
        monkeypatch.setattr(mixing, name, value)
    texts = F.when(F.col("doc_id") % 2 == 0, "same size here").when(F.col("doc_id") % 3 == 0, "two words").otherwise(F.col("text"))
    ids = F.when(F.col("doc_id") != 7, F.col("doc_id") * F.when(F.col("doc_id") % 5 == 0, -1).otherwise(1_000_003))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", texts).withColumn("doc_id", ids)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.execute(queries.OP10).fetchall(), key=str)
    assert sorted((tuple(r) for r in mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) == want


def test_the_plan_does_not_grow_with_the_ranges(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def length(rows):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        return len(mixing.taken(docs)._jdf.queryExecution().analyzed().toString())

    few, many = length(50), length(1)
    assert many < 1.2 * few

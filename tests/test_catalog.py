"""Every catalog query with SQL gives the same rows as DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name in ("phrase_topk",), "no rows"
    sql = catalog.oracle_sql().get(name)
    if sql:
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        want = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

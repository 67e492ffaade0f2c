import duckdb
import pytest

import __spark_entry__
from framelake.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    rel = c.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(x) for x in df.columns]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
